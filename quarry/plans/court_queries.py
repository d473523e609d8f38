"""Queries of the court-records stages on miniature tables, each with SQL that states the same rules in another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import exprs as E
from quarry.operators import appeals as AP
from quarry.operators import authorship as AU
from quarry.operators import corpus as C
from quarry.operators import linkage as L
from quarry.operators import outcomes as OC
from quarry.operators import resolution as RS
from quarry.operators import stats as ST
from quarry.plans import miniatures as M
from quarry.plans.registry import query


def _re(pattern: str) -> str:
    """A pattern of the operators as a literal of the SQL dialect."""
    return "'" + pattern.replace(r"\p{IsAlphabetic}", r"\p{L}").replace("'", "''") + "'"


def _in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(f"""WITH {M.ctes(M.COURTS)}, kinds(jurisdiction, kind) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in C.EXCLUDED.items())})
SELECT id, short_name, full_name, jurisdiction, coalesce(kind, 'other_non_target_court') AS exclusion_category FROM courts LEFT JOIN kinds USING (jurisdiction)
WHERE lower(full_name) LIKE '%court of appeals%' AND id NOT IN {_in(C.COURTS)}""")
def q80_excluded_courts(t):
    return C.excluded_courts(M.COURTS.df(t.spark))


# The pool of judges in SQL: three sources, one shape.
_ALPHA = r"lower(regexp_replace({}, '[^\p{{L}}]', '', 'g'))"
_POOL_SQL = f"""{M.ctes(*M.POOL)},
seats AS (SELECT * FROM persons JOIN positions ON person_id = id WHERE gender IN ('m', 'f') AND position_type IN {_in(L.POSITION_TYPES)} AND court_id IS NOT NULL),
named AS (
  SELECT id::VARCHAR AS judge_id, name_first AS f, nullif(trim(name_middle), '') AS m, name_last AS l, gender, court_id, min(date_start) AS s, max(date_termination) AS e FROM seats GROUP BY ALL
  UNION ALL
  SELECT nid::VARCHAR, first_name, middle_name, last_name, gender, court_id, commission_date, termination_date FROM bio JOIN service USING (nid) JOIN court_map ON fjc_court_name = court_name
  WHERE trim(gender) <> '' AND last_name IS NOT NULL AND (jid, court_id) NOT IN (SELECT (fjc_id, court_id) FROM seats WHERE fjc_id IS NOT NULL)
  UNION ALL
  SELECT 'sup_' || sup_id, name_first, name_middle, name_last, gender, court_id, start_date, end_date FROM supplement),
pool AS (SELECT judge_id, {_ALPHA.format("l")} AS last_norm, {_ALPHA.format("concat_ws(' ', f, m, l)")} AS full_norm, concat_ws(' ', f, l) AS display_name,
  lower(left(f, 1)) AS first_initial, lower(left(m, 1)) AS mid_initial, gender, court_id, s AS start_date, e AS end_date FROM named)"""


def _pool(t):
    return AU.dated_pool(*(m.df(t.spark) for m in M.POOL))


@query(f"WITH {_POOL_SQL} SELECT * REPLACE (coalesce(mid_initial, '') AS mid_initial) FROM pool")
def q81_dated_pool(t):
    return _pool(t).withColumn("mid_initial", F.coalesce("mid_initial", F.lit("")))


_ANY_TITLE = "|".join(x.replace(" ", r"\s+") for x in AU._TITLES)
_READ_TITLE = "|".join(r"\s+".join(f"[{w[0].upper()}{w[0]}]{w[1:]}" for w in x.split()) for x in AU._TITLES)
_START = r"^\p{L}[\p{L}.''\- ]+"
_DECODED = "raw"
for _e, _by in (("<[^>]+>", None), *AU._ENTITIES):
    _DECODED = f"regexp_replace({_DECODED}, '<[^>]+>', ' ', 'g')" if _by is None else f"replace({_DECODED}, {_re(_e)}, {_re(_by)})"
_XML_SQL = rf"""{M.ctes(M.OPINIONS)},
tags AS (SELECT *, regexp_extract(xml_harvard, '(?s)<author[^>]*>(.*)</author>', 1) AS raw FROM opinions WHERE xml_harvard LIKE '%<author%'),
cleaned AS (SELECT *, trim(regexp_replace(regexp_replace({_DECODED}, '\s+', ' ', 'g'), '^[*\s0-9]+', '')) AS author_tag FROM tags),
called AS (SELECT *, CASE WHEN {" OR ".join(f"regexp_matches(author_tag, '(?i)' || {_re(p)})" for p in AU._NO_AUTHOR)} THEN ''
  WHEN regexp_matches(author_tag, '(?i){_START}(,\s*(jr|sr|ii|iii|iv|v)\.?)?,\s*({_ANY_TITLE})') THEN trim(regexp_extract(author_tag, '^([^,]+(?:,\s*(?:[Jj][Rr]|[Ss][Rr]|II|III|IV|V)\.?)?),\s*(?:{_READ_TITLE})', 1))
  WHEN regexp_matches(author_tag, '(?i){_START}\s+({_ANY_TITLE})') THEN trim(regexp_extract(author_tag, '^(.+?)\s+(?:{_READ_TITLE})', 1)) ELSE '' END AS author_name FROM cleaned),
bare AS (SELECT *, trim(regexp_replace(author_name, '(?i),?\s+(Jr|Sr|II|III|IV|V)\.?$', '')) AS b FROM called
  WHERE length(author_name) BETWEEN 3 AND 80 AND NOT ({" OR ".join(f"regexp_matches(author_name, '(?i)' || {_re(p)})" for p in AU._NO_XML_NAME)})),
xml_names AS (SELECT opinion_id, court_id, year_filed, author_tag, author_name, {_ALPHA.format("b")} AS fullname, {_ALPHA.format(r"regexp_extract(b, '(\S+)$', 1)")} AS lastname,
  lower(left(regexp_replace(author_name, '^[^\p{{L}}]+', ''), 1)) AS initial1,
  lower(CASE WHEN regexp_matches(author_name, '^\p{{L}}[.]\p{{L}}[.]\s') THEN regexp_extract(author_name, '^\p{{L}}[.](\p{{L}})', 1) ELSE regexp_extract(author_name, '^\p{{L}}[.]?\s*(\p{{L}})[.]?\s', 1) END) AS initial2,
  regexp_matches(author_name, '^\p{{L}}[.]?\s*\p{{L}}?[.]?\s+[\p{{L}}''-]+$') AS initials FROM bare)"""
_FORMS = '"fullname" AS "full", lastname AS "last", initial1 AS first_initial, nullif(initial2, \'\') AS middle_initial, initials AS is_initial_name'


@query(f"WITH {_XML_SQL} SELECT opinion_id, author_tag, author_name, {_FORMS} FROM xml_names")
def q82_xml_names(t):
    return AU.xml_names(M.OPINIONS.df(t.spark)).select("opinion_id", "author_tag", "author_name", "full", "last", "first_initial", "middle_initial", "is_initial_name")


_BASE = r"regexp_replace(regexp_replace(html_with_citations, '(?i)</p>|</div>|<br\s*/?>|</blockquote>|</center>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_PAT = {n.split("_")[0] + ("b" if "pre_inline" in n and "non" not in n else ""): (n, k, p) for n, k, _, p in AU.PATTERNS}
_GOOD = rf"v <> '' AND NOT regexp_matches(v, '(?i)(^|\s)and\s') AND v NOT LIKE '%;%' AND (v NOT LIKE '%,%' OR regexp_matches(v, {_re(AU._LIST_END)}))"


def _line_sql(key: str, layouts: tuple[str, ...], value: str = "regexp_extract(x, {p}, 1)", guarded: bool = False) -> str:
    name, priority, pattern = _PAT[key]
    guard = " AND (seen IS NULL OR n - seen > 5)" if guarded else ""
    return f"SELECT opinion_id, {priority} AS priority, n, {value.format(p=_re(pattern))} AS v, '{name}' AS pattern FROM lines WHERE kind IN {_in(layouts)} AND regexp_matches(x, {_re(pattern)}){guard}"


def _harvard_sql(key: str) -> str:
    name, priority, pattern = _PAT[key]
    return f"SELECT opinion_id, {priority}, NULL, regexp_extract(left(html_with_citations, 15000), {_re(pattern)}, 1), '{name}' FROM kinds WHERE kind = 'harvard_structured' AND regexp_matches(left(html_with_citations, 15000), {_re(pattern)})"


_PLAIN = ("plain_html", "xml_inline")
_HTML_SQL = rf"""kinds AS (SELECT *, CASE WHEN html_with_citations LIKE '%class="indent"%' THEN 'harvard_structured' WHEN regexp_matches(html_with_citations, '^\s*<\?xml') THEN 'xml_inline'
  WHEN regexp_matches(html_with_citations, '^\s*<pre\s[^>]*class="inline"') THEN 'pre_inline' ELSE 'plain_html' END AS kind FROM opinions WHERE year_filed >= 1960 AND trim(html_with_citations) <> ''),
cut AS (SELECT opinion_id, kind, string_split(left({_BASE}, 8000), chr(10)) AS ls FROM kinds),
each AS (SELECT opinion_id, kind, trim(unnest(ls)) AS x, generate_subscripts(ls, 1) AS n FROM cut),
lines AS (SELECT *, max(CASE WHEN regexp_matches(x, '(?i)^Before\s*:') THEN n END) OVER (PARTITION BY opinion_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS seen FROM each),
found AS (
  {_line_sql("A1", (*_PLAIN, "pre_inline"), value=r"regexp_replace(regexp_extract(x, {p}, 1), '\s*[:.]?\s*$', '')")}
  UNION ALL {_line_sql("A2", (*_PLAIN, "pre_inline"))}
  UNION ALL {_line_sql("A3", _PLAIN, guarded=True)}
  UNION ALL {_line_sql("A3b", ("pre_inline",), guarded=True)}
  UNION ALL {_line_sql("A4", _PLAIN, guarded=True)}
  UNION ALL {_harvard_sql("A10")}
  UNION ALL {_harvard_sql("A11")}),
picked AS (SELECT opinion_id, trim(v) AS v, pattern FROM found WHERE {_GOOD.replace("v ", "trim(v) ").replace("(v,", "(trim(v),")} AND NOT regexp_matches(trim(v), {_re(AU._PANEL)})
  QUALIFY row_number() OVER (PARTITION BY opinion_id ORDER BY priority, n NULLS LAST) = 1),
named_html AS (SELECT k.opinion_id, court_id, year_filed, kind, v, pattern, trim(regexp_replace(v, {_re(AU._TITLE_END)}, '')) AS author_name FROM kinds k JOIN picked USING (opinion_id)
  WHERE length(v) BETWEEN 3 AND 80 AND NOT regexp_matches(v, {_re(AU._COLLECTIVE)})),
html_names AS (SELECT opinion_id, court_id, year_filed, kind, pattern, author_name, {_ALPHA.format("v")} AS fullname, lower(regexp_replace(string_split(v, ' ')[-1], '[^a-zA-Z]', '', 'g')) AS lastname,
  {_ALPHA.format(r"regexp_extract(regexp_replace(author_name, '(?i),?\s+(Jr\.?|Sr\.?|II|III|IV|V|2nd|3rd)\s*$', ''), '(\S+)\s*$', 1)")} AS bare,
  lower(left(regexp_replace(v, '^[^a-zA-Z]+', ''), 1)) AS initial1, lower(regexp_extract(v, '^\p{{L}}[.]?\s*(\p{{L}})[.]?\s', 1)) AS initial2, regexp_matches(v, '^\p{{L}}[.]?\s*\p{{L}}?[.]?\s+\p{{L}}+$') AS initials FROM named_html)"""


@query(f"WITH {M.ctes(M.OPINIONS)}, {_HTML_SQL} SELECT opinion_id, kind AS html_layout, v AS found_name, pattern AS found_pattern FROM kinds LEFT JOIN picked USING (opinion_id)")
def q83_html_authors(t):
    base = M.OPINIONS.df(t.spark).where((F.col("year_filed") >= 1960) & (F.trim("html_with_citations") != ""))
    return AU.html_author(base).select("opinion_id", "html_layout", "found_name", "found_pattern")


@query(f'WITH {M.ctes(M.OPINIONS)}, {_HTML_SQL} SELECT opinion_id, author_name, {_FORMS}, fullname AS "compound", bare AS "stripped" FROM html_names')
def q84_html_names(t):
    return AU.html_names(M.OPINIONS.df(t.spark)).select("opinion_id", "author_name", "full", "last", "first_initial", "middle_initial", "is_initial_name", "compound", "stripped")


# A ladder in SQL: the least tier of any judge, then its judges.
_HERE = "p.court_id = c.court_id"
_TIME = "coalesce(year(p.start_date) <= c.year_filed, true) AND coalesce(year(p.end_date) >= c.year_filed, true)"
_FULL = "p.full_norm = c.fullname"
_INIT = "c.initials AND p.last_norm = c.lastname AND p.first_initial = c.initial1 AND (coalesce(c.initial2, '') = '' OR p.mid_initial = c.initial2)"
_SAME = "(c.initial1 = '' OR p.first_initial = c.initial1)"
_LAST = f"p.last_norm = c.lastname AND (c.fullname = c.lastname OR {_SAME})"
_XML_RULES = (f"{_FULL} AND {_HERE}", f"{_INIT} AND {_HERE}", _FULL, _INIT, f"{_LAST} AND {_HERE} AND {_TIME}", f"{_LAST} AND {_HERE}")
_BARE = f"p.last_norm = c.bare AND c.bare <> '' AND c.bare <> c.lastname AND {_SAME} AND {_HERE}"
_HTML_RULES = (*_XML_RULES, f"{_LAST} AND {_TIME}", _LAST, f"p.last_norm = c.fullname AND c.fullname <> c.lastname AND {_HERE}", f"{_BARE} AND {_TIME}", _BARE)


def _ladder_sql(names: str, rules: tuple[str, ...], branch: str) -> str:
    tiers = ", ".join(f"CASE WHEN {r} THEN {k} END" for k, r in enumerate(rules, 1))
    start, in_source, in_label, no_source, no_label = AU.BRANCHES[branch]
    told = []
    for k, (name, *_, number) in enumerate(AU.TIERS[: len(rules)], 1):
        short = "suffix_stripped_same_court" if k > 9 else name
        for one in (True, False):
            who = lambda where, one=one, k=k: "judge" if one and k in where else "gender"
            told.append(f"({k}, {one}, '{start}{short}_unique_{who(in_source)}', {6 if k == 1 and not one else number}, '{branch}_{short}_unique_{who(in_label)}')")
    return f"""met AS (SELECT c.opinion_id, p.judge_id, p.gender, least({tiers}) AS tier FROM {names} c CROSS JOIN pool p WHERE c.lastname <> ''),
best AS (SELECT opinion_id, tier AS priority, count(DISTINCT judge_id) AS n_judges, count(DISTINCT gender) AS n_genders, string_agg(DISTINCT judge_id, ' | ' ORDER BY judge_id) AS ids, min(gender) AS g FROM met WHERE tier IS NOT NULL
  GROUP BY opinion_id, tier QUALIFY row_number() OVER (PARTITION BY opinion_id ORDER BY tier) = 1),
told(priority, one, source, quality, label) AS (VALUES {", ".join(told)}),
matched AS (SELECT c.opinion_id, c.author_name, b.priority, coalesce(n_judges, 0) AS n_judges, coalesce(n_genders, 0) AS n_genders, ids, CASE WHEN n_genders = 1 THEN g END AS gender, coalesce(n_genders = 1, false) AS gender_resolved,
  CASE WHEN n_genders = 1 THEN t.source WHEN n_genders > 1 THEN '{start}ambiguous_multiple_genders' ELSE '{no_source}' END AS source,
  CASE WHEN n_genders = 1 THEN t.quality WHEN n_genders > 1 THEN 90 ELSE 99 END AS quality_tier,
  CASE WHEN n_genders = 1 THEN t.label WHEN n_genders > 1 THEN '{branch}_ambiguous_multiple_genders' ELSE '{no_label}' END AS label
  FROM {names} c LEFT JOIN best b USING (opinion_id) LEFT JOIN told t ON t.priority = b.priority AND t.one = (b.n_judges = 1))"""


_MATCHED = ("opinion_id", "author_name", "priority", "n_judges", "n_genders", "ids", "gender", "gender_resolved", "source", "quality_tier", "label")


@query(f"WITH {_POOL_SQL}, {_XML_SQL}, {_ladder_sql('xml_names', _XML_RULES, 'xml')} SELECT {', '.join(_MATCHED)} FROM matched")
def q85_xml_ladder(t):
    return AU.match_names(AU.xml_names(M.OPINIONS.df(t.spark)), _pool(t), "xml").select(*_MATCHED)


@query(f"WITH {_POOL_SQL}, {M.ctes(M.OPINIONS)}, {_HTML_SQL}, {_ladder_sql('html_names', _HTML_RULES, 'html')} SELECT {', '.join(_MATCHED)} FROM matched")
def q86_html_ladder(t):
    return AU.match_names(AU.html_names(M.OPINIONS.df(t.spark)), _pool(t), "html").select(*_MATCHED)


_PREV = M.Mini("previous", "opinion_id int, gender string, gender_resolved boolean, source string, quality_tier int, label string", [
    (1, "f", True, "author_id", 1, "structured_author_id"), (4, None, False, "no_fjc_match", 9, "no_fjc_match"), (13, None, False, None, None, None), (20, "m", True, "author_str_fjc_unique_judge", 2, "exact_author_str_unique_judge"),
])


def _branch_sql(name: str, names: str, rules: tuple[str, ...]) -> str:
    """A branch's ladder with its names told apart from the other's."""
    out = _ladder_sql(names, rules, name)
    for word in ("met", "best", "told", "matched"):
        out = out.replace(f"{word} AS (", f"{name}_{word} AS (").replace(f"FROM {word} ", f"FROM {name}_{word} ").replace(f"JOIN {word} ", f"JOIN {name}_{word} ").replace(f"{word}(priority", f"{name}_{word}(priority")
    return out


@query(f"""WITH {_POOL_SQL}, {_XML_SQL}, {_HTML_SQL}, {_branch_sql("xml", "xml_names", _XML_RULES)}, {_branch_sql("html", "html_names", _HTML_RULES)}, {M.ctes(_PREV)},
stages AS (
  SELECT opinion_id, 1 AS k, 'previous_final' AS channel, gender, gender_resolved, source, quality_tier, label FROM previous
  UNION ALL SELECT opinion_id, 2, 'xml_author_tag', m.gender, coalesce(m.gender_resolved, false), m.source, coalesce(m.quality_tier, 99), coalesce(m.label, 'xml_no_judge_match') FROM opinions LEFT JOIN xml_matched m USING (opinion_id)
  UNION ALL SELECT opinion_id, 3, 'html_extraction', m.gender, coalesce(m.gender_resolved, false), m.source, coalesce(m.quality_tier, 99), coalesce(m.label, 'html_no_judge_match') FROM opinions LEFT JOIN html_matched m USING (opinion_id)),
won AS (SELECT * FROM stages WHERE gender_resolved QUALIFY row_number() OVER (PARTITION BY opinion_id ORDER BY k) = 1),
said AS (SELECT opinion_id, arg_min(source, k) FILTER (WHERE source IS NOT NULL) AS source, arg_min(quality_tier, k) FILTER (WHERE quality_tier IS NOT NULL) AS tier, arg_min(label, k) FILTER (WHERE label IS NOT NULL) AS label FROM stages GROUP BY 1)
SELECT opinion_id, won.gender, won.gender IS NOT NULL AS gender_resolved, CAST(coalesce(won.quality_tier, said.tier) AS INTEGER) AS quality_tier, coalesce(won.label, said.label) AS quality_label,
  coalesce(won.source, said.source, CASE WHEN author_id IS NULL AND coalesce(trim(author_str), '') = '' THEN 'no_author_id_or_author_str' ELSE 'unknown' END) AS gender_source,
  coalesce(won.channel, 'unresolved') AS channel, CAST(coalesce(won.k, 99) AS INTEGER) AS channel_priority FROM opinions LEFT JOIN won USING (opinion_id) LEFT JOIN said USING (opinion_id)""")
def q87_final_cascade(t):
    opinions = M.OPINIONS.df(t.spark)
    out = AU.final_cascade(opinions.select("opinion_id", "author_id", "author_str"), _PREV.df(t.spark), AU.text_attribution(opinions, _pool(t)))
    return out.select("opinion_id", "gender", "gender_resolved", "quality_tier", "quality_label", "gender_source", "channel", "channel_priority")


# Case records.
_CODES = ", ".join(f"('{k}', '{v}')" for k, v in AP.CIRCUITS.items())
_CLEAN = ", ".join(f"nullif(trim({raw}), '') AS {name}" for raw, name in AP.COLUMNS.items())
_CASES_SQL = f"""{M.ctes(M.OLD, M.NEW)},
raw AS (SELECT '1971to2007' AS source_period, * FROM old_raw UNION ALL SELECT '2008plus', * FROM new_raw), clean AS (SELECT source_period, {_CLEAN} FROM raw), codes(fjc_circuit_code, court_id) AS (VALUES {_CODES}),
cases AS (SELECT row_number() OVER (ORDER BY source_period, {", ".join(f"{c} NULLS LAST" for c in AP.COLUMNS.values())}) AS fjc_appeal_id, * FROM clean JOIN codes USING (fjc_circuit_code)),
dated AS (SELECT *, lpad(fjc_docket_raw, 7, '0') AS docket, CASE WHEN regexp_matches(judgment_date_raw, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN CAST(try_strptime(judgment_date_raw, '%m/%d/%Y') AS DATE) END AS judged FROM cases)"""


def _cases(t):
    return AP.normalise({"1971to2007": M.OLD.df(t.spark), "2008plus": M.NEW.df(t.spark)})


@query(f"WITH {_CASES_SQL} SELECT * FROM cases")
def q88_case_records(t):
    return _cases(t)


@query(f"""WITH {_CASES_SQL}, g AS (SELECT court_id, docket, count(*) AS n_appeals, count(DISTINCT judged) AS n_judgment_dates, count(DISTINCT trim(appellant)) AS a, count(DISTINCT trim(appellee)) AS b, count(DISTINCT outcome_code) AS n_outcomes,
  min(judged) AS first_judgment_date, max(judged) AS last_judgment_date FROM dated GROUP BY 1, 2)
SELECT court_id, docket, n_appeals, n_judgment_dates, n_outcomes, first_judgment_date, last_judgment_date,
  CASE WHEN n_appeals = 1 THEN 'single_fjc_appeal' WHEN greatest(a, b) <= 1 THEN 'multiple_rows_same_parties' ELSE 'multiple_rows_different_or_missing_parties' END AS group_type FROM g""")
def q89_docket_groups(t):
    return AP.docket_groups(_cases(t)).select("court_id", "docket", "n_appeals", "n_judgment_dates", "n_outcomes", "first_judgment_date", "last_judgment_date", "group_type")


_KEYS_SQL = r"""keyed AS (SELECT *, CASE WHEN regexp_matches(docket_number, '^\s*(?:No\.\s*)?[0-9]{2}-[0-9]') THEN 'lead' WHEN regexp_matches(docket_number, '[Dd]ocket\s*(?:No\.\s*)?[0-9]{2}-[0-9]') THEN 'docket_keyword' ELSE 'unparseable' END AS parse_rule,
  nullif(regexp_extract(docket_number, CASE parse_rule WHEN 'lead' THEN '^\s*(?:No\.\s*)?([0-9]{2}-[0-9]{1,5})' ELSE '[Dd]ocket\s*(?:No\.\s*)?([0-9]{2}-[0-9]{1,5})' END, 1), '') AS part,
  split_part(part, '-', 1) || lpad(split_part(part, '-', 2), 5, '0') AS docket_key FROM docket_opinions)"""


def _opinions(t):
    key, rule = E.docket_key(F.col("docket_number"))
    return M.DOCKETS.df(t.spark).withColumns({"docket_key": key, "parse_rule": rule})


@query(f"WITH {M.ctes(M.DOCKETS)}, {_KEYS_SQL} SELECT opinion_id, docket_key, parse_rule FROM keyed")
def q90_docket_keys(t):
    return _opinions(t).select("opinion_id", "docket_key", "parse_rule")


_MEET_SQL = f"""{_CASES_SQL}, {M.ctes(M.DOCKETS)}, {_KEYS_SQL},
near AS (SELECT k.opinion_id, k.opinion_date, k.docket_key, d.fjc_appeal_id, abs(date_diff('day', k.opinion_date, d.judged)) AS gap FROM keyed k LEFT JOIN dated d ON d.court_id = k.court_id AND d.docket = k.docket_key)"""


@query(f"""WITH {_MEET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY gap NULLS LAST, fjc_appeal_id) AS place, count(fjc_appeal_id) OVER (PARTITION BY opinion_id) AS n FROM near)
SELECT opinion_id, fjc_appeal_id AS appeal_id, gap, n > 1 AS was_ambiguous, coalesce(gap <= 7, false) AS match_eligible,
  CASE WHEN docket_key IS NULL THEN 'not_parseable' WHEN fjc_appeal_id IS NULL THEN 'no_fjc_match' WHEN gap IS NULL THEN 'matched_no_date' WHEN gap = 0 THEN 'exact_date' WHEN gap <= 7 THEN 'near_date_7' WHEN gap <= 30 THEN 'within_30'
  ELSE 'over_30_review' END AS match_tier FROM r WHERE place = 1""")
def q91_docket_matches(t):
    cases = _cases(t).select(F.col("fjc_appeal_id").alias("appeal_id"), "court_id", F.col("fjc_docket_raw").alias("docket"), AP.raw_date(F.col("judgment_date_raw")).alias("judgment_date"))
    return L.match_dockets(M.DOCKETS.df(t.spark), cases).select("opinion_id", "appeal_id", F.col("gap").cast("long").alias("gap"), "was_ambiguous", "match_eligible", "match_tier")


_CONF_SQL = f"""{_MEET_SQL}, s AS (SELECT opinion_id, any_value(opinion_date) AS day, any_value(docket_key) AS docket_key, count(fjc_appeal_id) AS n, min(gap) AS least FROM near GROUP BY 1),
tied AS (SELECT opinion_id, count(*) AS n_best, min(fjc_appeal_id) AS best FROM near JOIN s USING (opinion_id) WHERE fjc_appeal_id IS NOT NULL AND gap IS NOT DISTINCT FROM least GROUP BY 1),
status AS (SELECT s.*, n_best, best, CASE WHEN docket_key IS NULL THEN 'not_parseable' WHEN n = 0 THEN 'no_match' WHEN n = 1 THEN 'unique_match' ELSE 'ambiguous_match' END AS match_status,
  CASE WHEN least IS NULL THEN NULL WHEN least = 0 THEN 0 WHEN least <= 7 THEN 1 WHEN least <= 30 THEN 2 ELSE 3 END AS step FROM s LEFT JOIN tied USING (opinion_id)),
conf AS (SELECT *, CASE WHEN day < DATE '1971-01-01' THEN 'rejected_before_1971' WHEN match_status <> 'unique_match' THEN match_status
    ELSE coalesce(['tier_a_exact_date', 'tier_b_within_7_days', 'tier_c_within_30_days', 'review_over_30_days'][step + 1], 'review_missing_date') END AS confidence_tier,
  CASE WHEN match_status = 'ambiguous_match' AND day >= DATE '1971-01-01' THEN CASE WHEN n_best > 1 THEN 'tie_for_best_date'
    ELSE ['resolved_exact_date', 'resolved_within_7_days', 'resolved_within_30_days', 'best_candidate_over_30_days'][step + 1] END END AS resolution FROM status)"""


def _confident(t):
    opinions = _opinions(t)
    return AP.match_confidence(opinions, AP.candidates(opinions, _cases(t)))


@query(f"WITH {_CONF_SQL} SELECT opinion_id, n AS n_candidates, match_status, CASE WHEN n = 1 THEN best END AS fjc_appeal_id, confidence_tier, resolution FROM conf")
def q92_match_confidence(t):
    return _confident(t).select("opinion_id", "n_candidates", "match_status", "fjc_appeal_id", "confidence_tier", "resolution")


_FINAL_SQL = f"""{_CONF_SQL}, final AS (SELECT *, coalesce(day < DATE '1971-01-01', false) AS early, resolution LIKE 'resolved%' AS settled,
  CASE WHEN early THEN NULL WHEN match_status = 'unique_match' THEN best WHEN settled THEN best END AS selected_appeal_id,
  CASE WHEN early THEN 'rejected_before_1971' WHEN match_status = 'unique_match' THEN 'selected_unique_docket' WHEN settled THEN 'selected_unique_best_date' WHEN match_status = 'ambiguous_match' THEN 'unresolved_ambiguous' ELSE match_status END AS final_status,
  CASE WHEN early OR match_status = 'unique_match' THEN confidence_tier WHEN settled THEN ['tier_a_exact_date', 'tier_b_within_7_days', 'tier_c_within_30_days'][step + 1] || '_ambiguous_resolved' ELSE final_status END AS final_tier FROM conf)"""


@query(f"WITH {_FINAL_SQL} SELECT opinion_id, selected_appeal_id, final_status, final_tier FROM final")
def q93_final_match(t):
    return AP.final_match(_confident(t)).select("opinion_id", "selected_appeal_id", "final_status", "final_tier")


@query(f"""WITH {_FINAL_SQL}, g AS (SELECT docket_id, count(DISTINCT opinion_id) AS n_opinions, count(DISTINCT selected_appeal_id) AS k, count(selected_appeal_id) AS hit FROM docket_opinions JOIN final USING (opinion_id) GROUP BY 1)
SELECT ['no_selected_fjc_appeal', 'one_selected_fjc_appeal', 'conflicting_multiple_fjc_appeals'][least(k, 2) + 1] AS mapping_status, CASE WHEN n_opinions = 1 THEN '1' WHEN n_opinions < 4 THEN '2-3' ELSE '4-10' END AS size,
  count(*) AS n_groups, sum(n_opinions)::BIGINT AS n_opinions, count(*) FILTER (WHERE hit > 0 AND hit < n_opinions) AS n_mixed FROM g GROUP BY 1, 2""")
def q94_docket_consistency(t):
    return AP.consistency_summary(AP.consistency(AP.final_match(_confident(t)), "docket_id"))


_REQUESTED = M.Mini("requested", "opinion_id int", [(1,), (1,), (2,), (3,), (7,), (9,), (12,), (99,), (6,)])


@query(f"""WITH {_FINAL_SQL}, {M.ctes(_REQUESTED)} SELECT result, count(*) AS n FROM (SELECT DISTINCT r.opinion_id, CASE WHEN o.opinion_id IS NULL THEN 'not_found' WHEN o.court_id NOT IN ('ca1', 'ca2', 'ca5', 'ca9') THEN 'unsupported_court'
  WHEN f.match_status = 'not_parseable' THEN 'not_parseable' WHEN f.match_status = 'no_match' THEN 'no_match' ELSE f.final_status END AS result FROM requested r LEFT JOIN docket_opinions o USING (opinion_id) LEFT JOIN final f USING (opinion_id)) GROUP BY 1""")
def q95_requested_ids(t):
    final = AP.final_match(_confident(t))
    confidence = F.when(F.col("match_status").isin("no_match", "not_parseable"), F.col("match_status")).otherwise(F.col("final_status"))
    matches = final.select("opinion_id", "parse_rule", confidence.alias("confidence"), F.col("selected_appeal_id").alias("appeal_id"))
    return AP.requested(_REQUESTED.df(t.spark), final.select("opinion_id", "court_id"), matches, ("ca1", "ca2", "ca5", "ca9")).groupBy("result").agg(F.count("*").alias("n"))


_CLASSES = ", ".join(f"('{k}', '{v}')" for k, v in AP.CASE_CLASSES.items())


@query(f"""WITH {_MEET_SQL}, {M.ctes(M.OUTCOMES, M.DISPOSITIONS, M.DOMAINS)}, classes(appeal_type_code, case_class) AS (VALUES {_CLASSES}),
hit AS (SELECT opinion_id, opinion_date, fjc_appeal_id FROM near WHERE fjc_appeal_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY opinion_id ORDER BY gap NULLS LAST, fjc_appeal_id) = 1)
SELECT opinion_id, year(opinion_date)::INTEGER AS year_filed, (year(opinion_date) // 10 * 10)::INTEGER AS decade, coalesce(case_class, 'other') AS case_class, coalesce(outcome_label, 'unmapped') AS outcome_label, coalesce(outcome_class, 'other') AS outcome_class,
  coalesce(disposition_label, 'unmapped') AS disposition_label, CASE case_class WHEN 'criminal' THEN CASE WHEN offense_code IN {_in(AP.IMMIGRATION_OFFENSES)} THEN 'immigration' ELSE 'criminal' END
  WHEN 'civil' THEN coalesce((SELECT any_value(rq2_domain) FROM domain_codes WHERE code_kind = 'nature_of_suit' AND code_value = nature_of_suit_code), 'other')
  WHEN 'administrative' THEN coalesce((SELECT any_value(rq2_domain) FROM domain_codes WHERE code_kind = 'agency' AND code_value = agency_code), 'other') ELSE 'other' END AS rq2_domain
FROM hit JOIN dated USING (fjc_appeal_id) LEFT JOIN classes USING (appeal_type_code) LEFT JOIN outcome_codes USING (outcome_code) LEFT JOIN disposition_codes USING (disposition_code)""")
def q96_covariates(t):
    cases = _cases(t)
    found = L.match_dockets(M.DOCKETS.df(t.spark), cases.select(F.col("fjc_appeal_id").alias("appeal_id"), "court_id", F.col("fjc_docket_raw").alias("docket"), AP.raw_date(F.col("judgment_date_raw")).alias("judgment_date")))
    matches = found.select("opinion_id", "opinion_date", "match_tier", F.col("appeal_id").alias("fjc_appeal_id")).join(cases.drop("court_id"), "fjc_appeal_id", "left")
    out = AP.covariates(matches, M.OUTCOMES.df(t.spark), M.DISPOSITIONS.df(t.spark), M.DOMAINS.df(t.spark).drop("note"))
    return out.select("opinion_id", "year_filed", "decade", "case_class", "outcome_label", "outcome_class", "disposition_label", "rq2_domain")


def _flag_sql(table: dict[str, tuple[str, ...]]) -> str:
    return ", ".join("(" + " OR ".join(f"regexp_matches(ending, {_re('(?i)' + p)})" for p in ps) + f") AS {n}" for n, ps in table.items())


def _codes_sql(labels: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in labels.items())


_TEXT_SQL = f"{M.ctes(M.ENDINGS)}, texts AS (SELECT *, regexp_replace(regexp_replace(coalesce(nullif(plain_text, ''), regexp_replace(html_with_citations, '<[^>]+>', ' ', 'g'), ''), '[\\n\\r\\t\\f]+', ' ', 'g'), ' {{2,}}', ' ', 'g') AS txt FROM endings)"


@query(f"""WITH {_TEXT_SQL}, f AS (SELECT *, right(txt, 8000) AS ending, {_flag_sql(OC.MENTIONS)} FROM texts), labels(outcome_code, l) AS (VALUES {_codes_sql(OC.LABELS_1)}),
j AS (SELECT f.*, coalesce(l, '{OC.OTHER_LABEL}') AS coded_outcome FROM f LEFT JOIN labels USING (outcome_code))
SELECT id, coded_outcome, CASE WHEN txt = '' THEN NULL ELSE list_filter([CASE WHEN mentions_affirmed AND mentions_reversed THEN 'affirmed_in_part_reversed_in_part' END, CASE WHEN strong_reversal THEN 'reversed_or_vacated' END,
    CASE WHEN strong_affirmance THEN 'affirmed_or_enforced' END, CASE WHEN strong_remand THEN 'remanded' END, CASE WHEN strong_dismissal THEN 'dismissed' END, CASE WHEN mentions_reversed THEN 'possible_reversed_or_vacated' END,
    CASE WHEN mentions_affirmed THEN 'possible_affirmed_or_enforced' END, CASE WHEN mentions_remanded THEN 'possible_remanded' END, CASE WHEN mentions_dismissed THEN 'possible_dismissed' END, 'outcome_not_detected'], lambda x: x IS NOT NULL)[1] END AS text_outcome,
  CASE WHEN txt = '' THEN 'review_no_opinion_text' WHEN CASE coded_outcome WHEN 'affirmed_or_enforced' THEN strong_affirmance OR (mentions_affirmed AND NOT strong_reversal) WHEN 'reversed_or_vacated' THEN strong_reversal OR (mentions_reversed AND NOT strong_affirmance)
    WHEN 'affirmed_in_part_reversed_in_part' THEN mentions_affirmed AND mentions_reversed WHEN 'dismissed_frivolous' THEN mentions_dismissed AND mentions_frivolous WHEN 'remanded' THEN strong_remand OR mentions_remanded ELSE false END THEN 'text_supports_fjc'
  WHEN coded_outcome = 'dismissed_frivolous' AND mentions_dismissed THEN 'review_dismissed_but_frivolous_not_found' WHEN coded_outcome IN ('other', 'missing_or_invalid', '{OC.OTHER_LABEL}') THEN 'manual_review_nonstandard_outcome'
  WHEN CASE coded_outcome WHEN 'affirmed_or_enforced' THEN strong_reversal AND NOT strong_affirmance WHEN 'reversed_or_vacated' THEN strong_affirmance AND NOT strong_reversal WHEN 'remanded' THEN (strong_affirmance OR strong_reversal) AND NOT mentions_remanded ELSE false END
  THEN 'possible_fjc_text_conflict' ELSE 'review_outcome_phrase_not_found' END AS "check" FROM j""")
def q97_outcome_mentions(t):
    rows = M.ENDINGS.df(t.spark)
    return OC.detect_mentions(rows, OC.opinion_text(rows)).select("id", "coded_outcome", "text_outcome", "check")


@query(f"""WITH {_TEXT_SQL}, f AS (SELECT * REPLACE (trim(txt) AS txt), right(trim(txt), 3000) AS ending, {_flag_sql(OC.OPERATIVE)} FROM texts), labels(outcome_code, l) AS (VALUES {_codes_sql(OC.LABELS_2)}),
j AS (SELECT f.*, coalesce(l, '{OC.OTHER_LABEL}') AS coded_outcome, op_mixed::INT AS x, op_affirmed::INT AS a, op_reversed::INT AS r, op_remanded::INT AS m, op_dismissed::INT AS d, op_coa_denied::INT AS c FROM f LEFT JOIN labels USING (outcome_code))
SELECT id, coded_outcome, CASE WHEN txt = '' THEN NULL WHEN x = 1 THEN 'affirmed_in_part_reversed_or_vacated_in_part' WHEN r + a > 0 THEN CASE WHEN r = 1 THEN 'reversed_or_vacated' WHEN m = 1 THEN 'affirmed' ELSE 'affirmed_or_enforced' END || CASE WHEN m = 1 THEN '_and_remanded' ELSE '' END
    WHEN m = 1 THEN 'remanded_only' WHEN d = 1 THEN 'dismissed_on_merits' WHEN c = 1 THEN 'certificate_of_appealability_denied' ELSE 'outcome_not_detected' END AS text_outcome,
  CASE WHEN txt = '' THEN 'review_no_opinion_text' WHEN disposition_code NOT IN ('1', '2', '3') AND outcome_code <> '-8' THEN 'review_outcome_outside_merits_context'
  WHEN CASE outcome_code WHEN '1' THEN a > x + r WHEN '2' THEN r > x + a WHEN '3' THEN x = 1 OR a + r = 2 WHEN '5' THEN d = 1 WHEN '6' THEN m = 1 AND x + a + r + d = 0 WHEN '9' THEN c = 1 ELSE false END THEN 'text_supports_fjc'
  WHEN coded_outcome IN ('other_merits_outcome', 'missing', '{OC.OTHER_LABEL}') THEN 'manual_review_nonstandard_outcome'
  WHEN CASE outcome_code WHEN '1' THEN r + x > a * 2 WHEN '2' THEN a + x > r * 2 WHEN '3' THEN a <> r AND x = 0 WHEN '5' THEN a + r + m + x > 0 AND d = 0 WHEN '6' THEN a + r + x + d > 0 WHEN '9' THEN a + r + m + d + x > 0 AND c = 0 ELSE false END THEN 'possible_fjc_text_conflict'
  ELSE 'review_outcome_phrase_not_found' END AS "check" FROM j""")
def q98_outcome_operative(t):
    rows = M.ENDINGS.df(t.spark)
    return OC.detect_operative(rows, OC.opinion_text(rows)).select("id", "coded_outcome", "text_outcome", "check")


# Statistics.
_OWNED, _EDGES = M.citations()


@query(f"""WITH {M.ctes(M.CLUSTERS, M.CITED)}, c AS (SELECT coalesce(n, 0) AS n FROM clusters LEFT JOIN cited USING (cluster_id) WHERE year(date_filed) BETWEEN 1950 AND 2010)
SELECT CASE WHEN n = 0 THEN '0 (never cited)' WHEN n < 6 THEN '1-5' WHEN n < 21 THEN '6-20' WHEN n < 101 THEN '21-100' ELSE '100+' END AS bucket, count(*) AS n_clusters FROM c GROUP BY 1""")
def q99_citation_buckets(t):
    return ST.citation_buckets(M.CLUSTERS.df(t.spark), _OWNED.df(t.spark), _EDGES.df(t.spark))


_PARTY_SQL = """parties AS (SELECT person_id, CASE count(DISTINCT nullif(trim(political_party), '')) WHEN 0 THEN 'Missing' WHEN 1 THEN coalesce(map {'d': 'Democratic', 'r': 'Republican'}[min(nullif(trim(political_party), ''))], 'Other') ELSE 'Multiple' END AS party
  FROM affiliations WHERE person_id IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {M.ctes(M.PERSONS, M.POSITIONS, M.AFFILIATIONS)}, {_PARTY_SQL}, active AS (SELECT DISTINCT person_id FROM positions WHERE person_id IS NOT NULL AND date_termination IS NULL AND date_retirement IS NULL)
SELECT CASE gender WHEN 'm' THEN 'Male' WHEN 'f' THEN 'Female' ELSE 'Missing' END AS gender, coalesce(party, 'Missing') AS party, count(*) AS n_active_judges FROM active LEFT JOIN persons ON id = person_id LEFT JOIN parties USING (person_id) GROUP BY 1, 2""")
def q100_active_roster(t):
    return ST.active_roster(M.PERSONS.df(t.spark), M.POSITIONS.df(t.spark), M.AFFILIATIONS.df(t.spark))


@query(f"""WITH {M.ctes(M.PERSONS, M.POSITIONS)} SELECT CASE gender WHEN 'm' THEN 'Male' WHEN 'f' THEN 'Female' ELSE 'Missing' END AS gender, (year(date_start) // 10 * 10)::INTEGER AS decade, count(DISTINCT person_id) AS n
FROM positions LEFT JOIN persons ON id = person_id WHERE year(date_start) BETWEEN 1920 AND 2025 GROUP BY 1, 2""")
def q101_appointments_decade(t):
    return ST.appointments_by_decade(M.PERSONS.df(t.spark), M.POSITIONS.df(t.spark))


@query(f"""WITH {M.ctes(M.POSITIONS, M.AFFILIATIONS)}, {_PARTY_SQL} SELECT year(date_start)::INTEGER AS year, party, count(DISTINCT person_id) AS n_appointments FROM positions JOIN parties USING (person_id)
WHERE party IN ('Democratic', 'Republican') AND year(date_start) BETWEEN 1900 AND 2024 GROUP BY 1, 2""")
def q102_appointments_party(t):
    return ST.appointments_by_party(M.POSITIONS.df(t.spark), M.AFFILIATIONS.df(t.spark))


_TIER_SQL = " ".join(f"WHEN jurisdiction IN {_in([j for j, x in ST.TIERS.items() if x == v])} THEN '{v}'" for v in dict.fromkeys(ST.TIERS.values()))


@query(f"""WITH {M.ctes(M.COURTS, M.CLUSTERS, M.CASE_DOCKETS)} SELECT CASE {_TIER_SQL} ELSE 'State Trial/Other' END AS court_category, year(date_filed)::INTEGER AS year, count(*) AS n
FROM clusters c JOIN case_dockets d ON d.id = docket_id JOIN courts k ON k.id = court_id WHERE year(date_filed) BETWEEN 1950 AND 2026 GROUP BY 1, 2""")
def q103_clusters_by_tier(t):
    return ST.clusters_by_tier(M.CLUSTERS.df(t.spark), M.CASE_DOCKETS.df(t.spark), M.COURTS.df(t.spark))


@query(f"""WITH {M.ctes(M.CLUSTERS)} SELECT year(date_filed)::INTEGER AS year, count(*) AS n_total, count(*) FILTER (WHERE contains(source, 'C')) AS n_court_website, count(*) FILTER (WHERE contains(source, 'U')) AS n_harvard,
count(*) FILTER (WHERE contains(source, 'G')) AS n_recap, count(*) FILTER (WHERE translate(source, 'ZLRMADQS', '') <> source) AS n_other_archives FROM clusters WHERE year(date_filed) BETWEEN 1950 AND 2026 GROUP BY 1""")
def q104_provenance(t):
    return ST.provenance_by_year(M.CLUSTERS.df(t.spark))


@query(f"""WITH {M.ctes(M.COURTS, M.CLUSTERS, M.CASE_DOCKETS)} SELECT year(date_filed)::INTEGER AS year, count(*) AS n_total, count(*) FILTER (WHERE d.source % 2 = 0) AS n_stays, count(*) FILTER (WHERE d.source % 2 = 1) AS n_moves
FROM clusters c JOIN case_dockets d ON d.id = docket_id JOIN courts k ON k.id = court_id WHERE (k.id = 'scotus' OR jurisdiction = 'F') AND year(date_filed) BETWEEN 2010 AND 2025 GROUP BY 1""")
def q105_source_split(t):
    return ST.source_split(M.CLUSTERS.df(t.spark), M.CASE_DOCKETS.df(t.spark), M.COURTS.df(t.spark))


_FILED = M.Mini("filed_cases", "case_id int, person_id int, filed date", [(1, 1, M._D(1980, 1, 1)), (2, 1, M._D(1985, 1, 1)), (3, 2, M._D(1990, 1, 1)), (4, 5, M._D(1980, 1, 1)), (5, 6, M._D(2000, 1, 1)), (6, None, M._D(2000, 1, 1)), (7, 8, M._D(2000, 1, 1)), (8, 7, M._D(1970, 1, 1)), (9, 4, M._D(1979, 1, 1)), (10, 1, None), (11, 3, M._D(1991, 1, 1))])


@query(f"""WITH {M.ctes(_FILED, M.AFFILIATIONS)}, held AS (SELECT case_id, a.* FROM filed_cases c JOIN affiliations a USING (person_id) WHERE a.date_start <= filed AND coalesce(a.date_end >= filed, true) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY a.date_start DESC, a.id DESC) = 1),
per AS (SELECT person_id, count(*) AS n_records, any_value(political_party) AS lone FROM affiliations GROUP BY 1), newest AS (SELECT person_id, political_party FROM affiliations QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY date_start DESC NULLS LAST, id DESC) = 1)
SELECT c.case_id, c.person_id, c.filed, coalesce(h.political_party, CASE WHEN n_records = 1 THEN lone END) AS party_code, map {{'d': 'Democratic', 'r': 'Republican', 'i': 'Independent', 'w': 'Whig'}}[party_code] AS party,
  CASE WHEN h.political_party IS NOT NULL THEN 'in_force_at_filing' WHEN n_records = 1 AND lone IS NOT NULL THEN 'single_undated_record' WHEN c.person_id IS NULL THEN 'no_person' WHEN n_records IS NULL THEN 'no_affiliation_recorded' WHEN filed IS NULL THEN 'no_filing_date' ELSE 'filing_outside_recorded_periods' END AS resolution,
  n_records, h.date_start AS period_start, h.date_end AS period_end, newest.political_party AS latest_code
FROM filed_cases c LEFT JOIN held h USING (case_id) LEFT JOIN per ON per.person_id = c.person_id LEFT JOIN newest ON newest.person_id = c.person_id""")
def q106_party_as_of(t):
    return L.affiliation_as_of(_FILED.df(t.spark), M.AFFILIATIONS.df(t.spark))


_NAMED = M.Mini("named_opinions", "opinion_id int, court_id string, author_id int, author_str string, per_curiam boolean", [
    (1, "ca2", 1, "Hand", None), (2, "ca9", None, "By Judge Fletcher, Circuit", False), (3, "ca1", None, "John SMITH", False), (4, "ca3", None, "Smith", False), (5, "ca5", None, "Van Graafeiland", False), (6, "ca5", None, "Nobody", False), (7, "ca5", None, "Nobody", None),
    (8, "ca5", 9, None, False), (9, "ca5", None, " ", False), (10, "ca4", None, "Jones", False), (11, "ca4", None, "Paul Nelson", False), (12, "ca9", 2, "Betty Fletcher", False), (13, "ca2", 2, "Graafeiland", False), (14, "ca9", 5, "fletcher", None),
])


def _names_pool(t):
    pool = _pool(t).where(F.col("court_id").isin(*C.COURTS))
    return pool.select("judge_id", "gender", "court_id").join(M.PERSONS.df(t.spark).select(F.col("id").cast("string").alias("judge_id"), E.norm_space(F.col("name_last")).alias("name_norm")), "judge_id")


_PLACES = f"'{', '.join(C.COURTS)}'"


@query(f"""WITH {M.ctes(_NAMED, M.PERSONS, M.POSITIONS)}, pool AS (SELECT DISTINCT id::VARCHAR AS judge_id, gender, court_id, lower(trim(regexp_replace(replace(name_last, '.', ' '), '\\s+', ' ', 'g'))) AS nm FROM persons JOIN positions ON person_id = id
  WHERE gender IN ('m', 'f') AND position_type IN {_in(L.POSITION_TYPES)} AND court_id IN {_in(C.COURTS)}),
asked AS (SELECT opinion_id, court_id, lower(trim(regexp_replace(regexp_replace(trim(author_str), '(?i)^(opinion by|by|judge|justice)\\s+', ''), ',.*$', ''))) AS nm FROM named_opinions WHERE author_id IS NULL AND per_curiam = false AND trim(author_str) <> ''),
met AS (SELECT opinion_id, judge_id, gender, CASE WHEN p.nm = a.nm THEN 1 ELSE 2 END + CASE WHEN p.court_id = a.court_id THEN 0 ELSE 2 END AS tier FROM asked a JOIN pool p ON p.nm IN (a.nm, string_split(a.nm, ' ')[-1])),
best AS (SELECT opinion_id, tier, count(DISTINCT judge_id) AS n, count(DISTINCT gender) AS g, min(gender) AS one FROM met GROUP BY opinion_id, tier QUALIFY row_number() OVER (PARTITION BY opinion_id ORDER BY tier) = 1),
two AS (SELECT opinion_id, CASE WHEN g = 1 THEN one END AS gender, CASE WHEN tier IS NULL THEN 'no_fjc_match' WHEN g > 1 THEN CASE WHEN tier % 2 = 0 THEN 'ambiguous_suffix_multiple_genders' ELSE 'ambiguous_multiple_genders' END
  WHEN tier = 1 THEN CASE WHEN n = 1 THEN 'author_str_fjc_unique_judge' ELSE 'author_str_fjc_multiple_judges_same_gender' END WHEN tier = 2 THEN 'author_str_fjc_suffix_unique_gender'
  ELSE 'author_str_any_court_' || CASE WHEN tier = 4 THEN 'suffix_' ELSE '' END || CASE WHEN n = 1 THEN 'unique_judge' ELSE 'unique_gender' END END AS source FROM asked LEFT JOIN best USING (opinion_id)),
steps AS (SELECT o.opinion_id, o.author_id, o.author_str, p.gender AS g1, two.gender AS g2, two.source AS s2 FROM named_opinions o LEFT JOIN persons p ON p.id = o.author_id LEFT JOIN two USING (opinion_id)),
quality(gender_source, quality_tier, quality_label) AS (VALUES {", ".join(f"('{k}', {n}, '{v}')" for k, (n, v) in L.QUALITY.items())}),
done AS (SELECT opinion_id, author_id, author_str, coalesce(g1, g2) AS gender, gender IS NOT NULL AS gender_resolved, CASE WHEN g1 IS NOT NULL THEN 'author_id' WHEN author_id IS NOT NULL THEN 'author_id_not_resolved' WHEN s2 IS NOT NULL THEN s2 WHEN coalesce(trim(author_str), '') = '' THEN 'no_author_id_or_author_str' ELSE 'unknown' END AS gender_source FROM steps)
SELECT done.*, coalesce(quality_tier, 99) AS quality_tier, coalesce(quality_label, 'unknown') AS quality_label FROM done LEFT JOIN quality USING (gender_source)""")
def q107_steps_1_2(t):
    return RS.ladder_and_combine(_NAMED.df(t.spark), M.PERSONS.df(t.spark), _names_pool(t))


_CONFLICT_SQL = f"""{M.ctes(_NAMED, M.PERSONS, M.POSITIONS)}, linked AS (SELECT o.*, p.gender AS link_gender, p.name_last AS link_last, lower(regexp_replace(regexp_replace(author_str, '[^A-Za-z\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS nm
  FROM named_opinions o JOIN persons p ON p.id = author_id WHERE trim(author_str) <> ''), conflict AS (SELECT * FROM linked WHERE NOT contains(nm, lower(link_last)))"""


@query(f"WITH {_CONFLICT_SQL} SELECT (SELECT count(*) FROM linked) AS n_both, (SELECT count(*) FROM conflict) AS n_conflicts, round(100.0 * (SELECT count(*) FROM conflict)::DOUBLE / (SELECT count(*) FROM linked)::DOUBLE, 1) AS pct_conflict")
def q108_author_conflicts(t):
    return ST.author_conflicts(_NAMED.df(t.spark), M.PERSONS.df(t.spark))


@query(f"WITH {_CONFLICT_SQL} SELECT author_str, link_last, count(*) AS n FROM conflict GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def q109_conflict_pairs(t):
    return ST.conflict_pairs(_NAMED.df(t.spark), M.PERSONS.df(t.spark))


@query(f"""WITH {_CONFLICT_SQL}, seen AS (SELECT c.opinion_id, any_value(link_gender) AS l, count(DISTINCT j.gender) AS k, min(j.gender) AS g FROM conflict c JOIN positions s ON s.court_id = c.court_id JOIN persons j ON j.id = s.person_id AND lower(j.name_last) = c.nm WHERE j.gender IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_named, count(*) FILTER (WHERE k = 1 AND g = l) AS same_gender, count(*) FILTER (WHERE k = 1 AND g <> l) AS different_gender, count(*) FILTER (WHERE k > 1) AS ambiguous FROM seen""")
def q110_conflict_genders(t):
    return ST.conflict_genders(_NAMED.df(t.spark), M.PERSONS.df(t.spark), M.POSITIONS.df(t.spark))


@query(f"""WITH {M.ctes(_NAMED, M.PERSONS, M.POSITIONS)}, pool AS (SELECT DISTINCT gender, court_id, lower(name_last) AS nm FROM persons JOIN positions ON person_id = id WHERE gender IN ('m', 'f') AND position_type IN {_in(L.POSITION_TYPES)} AND court_id IN {_in(C.COURTS)}),
names AS (SELECT court_id, lower(trim(author_str)) AS author_norm, string_split(author_norm, ' ')[-1] AS w FROM named_opinions WHERE trim(author_str) <> ''),
judged AS (SELECT author_norm, (SELECT count(DISTINCT gender) FROM pool WHERE nm = w AND pool.court_id = names.court_id) AS here, (SELECT count(DISTINCT gender) FROM pool WHERE nm = w) AS anywhere FROM names)
SELECT author_norm, count(*) AS n_opinions, count(*) FILTER (WHERE here = 1) AS n_same_court, count(*) FILTER (WHERE here = 0 AND anywhere = 1) AS n_any_court, count(*) FILTER (WHERE here > 1 OR here = 0 AND anywhere > 1) AS n_ambiguous, count(*) FILTER (WHERE anywhere = 0) AS n_none FROM judged GROUP BY 1""")
def q111_unresolved_names(t):
    cases = _NAMED.df(t.spark).select("court_id", F.lower(F.trim("author_str")).alias("author_norm"))
    return RS.unresolved_names(cases, _names_pool(t))


_LOST = M.Mini("lost", "opinion_id int, name_in_earlier string, html_with_citations string", [(1, "SMITH", "<pre class=\"inline\">Before: A\n  Smith, Circuit Judge:\n</pre>"), (2, "JONES", "<pre class=\"inline\">SMITH, Circuit Judge. x</pre>"), (3, "X", "<pre>none</pre>"), (4, "X", None)])


@query(f"""WITH {M.ctes(_LOST)}, f AS (SELECT name_in_earlier, nullif(trim(regexp_extract(regexp_replace(html_with_citations, '<[^>]+>', ' ', 'g'), '(?im)^\\s*(?:[_ \\t]+)?([A-Z][A-Za-z.'' \\t-]{{2,80}}),\\s*(?:Chief\\s+|Senior\\s+)?Circuit\\s+Judge\\s*[:.](?:\\s|$)', 1)), '') AS v FROM lost)
SELECT count(*) AS n_lost, count(v) AS found_without_guard, count(*) FILTER (WHERE upper(v) = name_in_earlier) AS same_name, count(*) - count(v) AS still_none FROM f""")
def q112_guard_cost(t):
    return AU.guard_cost(_LOST.df(t.spark))
