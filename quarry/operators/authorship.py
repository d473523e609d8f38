"""Authors named in XML tags and HTML texts, matched against a dated pool of judges by ladders of tiers.

Names are read row by row with built-in functions (lines are arrays, the pick is the least of an array of structs).  A ladder
is one hash join: each name has up to four keys and each judge two, and a tier is the first rule that a pair meets.  Patterns are in
the Java dialect; where the published results rest on a quirk of the source dialect, `compat` keeps it (the default) and
`compat=False` does what the pattern means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import first_match, nullif_blank
from quarry.operators.corpus import COURTS
from quarry.operators.linkage import POSITION_TYPES

_L = r"\p{IsAlphabetic}"

# Titles after a name in an author tag, and tags that name no author.
_TITLES = ("chief district judge", "chief judge", "senior district judge", "senior circuit judge", "circuit judge", "district judge", "associate justice", "chief justice", "justice", "judge")
_NO_AUTHOR = (
    rf"(^|[^{_L}])per[\s.]+curiam([^{_L}]|$)",
    rf"(^|[^{_L}])by\s+the\s+court([^{_L}]|$)",
    rf"(^|[^{_L}])by\s+the\s+panel([^{_L}]|$)",
    rf"(^|[^{_L}])memorandum([^{_L}]|$)",
    r"^\s*order\.?\s*$",
    r"^\s*summary\s+order\.?\s*$",
    r"dissenting\s+opinion\s+filed\s+by",
    r"concurring\s+opinion\s+filed\s+by",
    r"opinion\s+for\s+the\s+court\s+filed\s+by",
    r"opinion\s+filed\s+by",
)
_NO_XML_NAME = (
    r"(^|\s)(Circuit|District|Judge|Justice|Chief|Senior|Associate|U\.S\.D\.J\.)(\s|$)",
    r"opinion\s+for\s+the\s+court",
    r"opinion\s+filed\s+by",
    r"dissenting\s+opinion",
    r"concurring\s+opinion",
    r"by\s+the\s+court",
    r"by\s+the\s+panel",
)
# Entities in the order in which they are decoded.
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'))
# Name, priority, scope and pattern of the HTML patterns.  A line's capture ends before blanks and one mark.
_NAME = r"[A-Z][A-Za-z.' \t-]"
_LINE_START = r"(?i)^\s*(?:[_ \t]+)?"
_HARVARD = r"<p[^>]+class=\"indent\"[^>]*>\s*([A-Z][A-Za-z\s.',-]{2,80}?),\s*(?:Chief\s+)?(?:Senior\s+)?(?:Circuit|District|Senior)\s+Judge\s*[.:]?\s*</p>"
PATTERNS = (
    ("A1_opinion_by_judge_name", 10, "line", rf"(?i)^\s*Opinion\s+by\s+(?:Chief\s+|Senior\s+)?(?:Circuit\s+)?Judge\s+({_NAME}{{1,60}})"),
    ("A2_opinion_by_name_circuit_or_district_judge", 20, "line", rf"(?i)^\s*Opinion\s+by\s+({_NAME}{{2,60}}),\s*(?:Chief\s+|Senior\s+)?(?:Circuit|District)\s+Judge"),
    ("A6_judge_delivered_opinion", 30, "flat", r"(?i)\bJudge\s+([A-Z][A-Za-z.'\s-]{2,60}?)\s+delivered\s+the\s+opinion\b"),
    ("A3_name_circuit_or_district_judge_line_non_pre_inline", 40, "weak", rf"{_LINE_START}({_NAME}{{2,80}}),\s*(?:Chief\s+|Senior\s+)?(?:Circuit|District)\s+Judge\s*[:.](?:\s|$)"),
    ("A3_circuit_judge_line_pre_inline", 41, "weak_pre", rf"{_LINE_START}({_NAME}{{2,80}}),\s*(?:Chief\s+|Senior\s+)?Circuit\s+Judge\s*[:.](?:\s|$)"),
    ("A4_name_chief_senior_judge_line_non_pre_inline", 50, "weak", rf"{_LINE_START}({_NAME}{{2,80}}),\s*(?:Chief|Senior)\s+Judge\s*[:.](?:\s|$)"),
    ("A10_harvard_opinion_indent", 60, "harvard", rf"(?is)<p[^>]*>\s*OPINION\s*</p>\s*(?:<[^>]+>\s*)*{_HARVARD}"),
    ("A11_harvard_first_indent", 70, "harvard", rf"(?is){_HARVARD}"),
)
GUARD, GUARD_LINES = r"(?i)^Before\s*:", 5
FIRST_CHARS, FIRST_HARVARD_CHARS = 8000, 15000
_AND, _LIST_END = r"(?i)(^|\s)and\s", r"(?i),\s*(Jr\.?|Sr\.?|II|III|IV|V)$"
_PANEL = rf"(?i)(^|[^{_L}])(Before|Circuit Judges|District Judges)([^{_L}]|$)"
_COLLECTIVE = r"(?i)^\s*(PER CURIAM|MEMORANDUM|ORDER|THE COURT|OPINION|DISSENT|CONCURRENCE|SYLLABUS|SUMMARY)\s*$"
_PARTY = r"(?i)\b(plaintiff|defendant|appellant|appellee|petitioner|respondent|united\s+states|commission|board|department)\b"
_TITLE_END = r"(?i),?\s*(?:Chief\s+)?(?:Senior\s+)?(?:Circuit|District|Senior)\s+Judge[.:]?\s*$"

# The tiers of the HTML ladder in order (the XML ladder has the first six): name, which name is compared, and
# whether court and period must agree; then the number in the published quality scale.
TIERS = (
    ("exact_full_name_same_court", "full", True, False, 5),
    ("initials_last_name_same_court", "initials", True, False, 7),
    ("exact_full_name_any_court", "full", False, False, 8),
    ("initials_last_name_any_court", "initials", False, False, 9),
    ("last_name_same_court_active_period", "last", True, True, 11),
    ("last_name_same_court", "last", True, False, 12),
    ("last_name_any_court_active_period", "last", False, True, 16),
    ("last_name_any_court", "last", False, False, 17),
    ("compound_last_same_court", "compound", True, False, 13),
    ("suffix_stripped_last_same_court_active_period", "stripped", True, True, 14),
    ("suffix_stripped_last_same_court", "stripped", True, False, 15),
)
XML_TIERS = TIERS[:6]
# By branch, the start of source codes and labels, the tiers whose source and label tell one judge from several,
# and the source where a name meets no judge.
_SHORT = {"suffix_stripped_last_same_court_active_period": "suffix_stripped_same_court", "suffix_stripped_last_same_court": "suffix_stripped_same_court"}
BRANCHES = {
    "xml": ("xml_author_tag_fjc_", (1, 2, 3, 4, 5, 6), (1, 2), "xml_author_tag_judge_no_match", "xml_no_judge_match"),
    "html": ("html_judge_", (1, 2, 3, 4, 9, 10, 11), (1,), "html_no_judge_match", "html_no_judge_match"),
}
AMBIGUOUS, WITHOUT_GENDER, UNMATCHED = 90, 91, 99


def letters(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, rf"[^{_L}]", ""))


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(x.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def dated_pool(persons: DataFrame, positions: DataFrame, bio: DataFrame, service: DataFrame, court_map: DataFrame, supplement: DataFrame) -> DataFrame:
    """(judge_id, last_norm, full_norm, display_name, first_initial, mid_initial, gender, court_id, start_date, end_date).

    Registry persons by court, from their first start to their last end, at all courts; service records whose judge the registry
    does not place at the same court; and a supplement.
    """
    trimmed = lambda *xs: F.concat_ws(" ", *(nullif_blank(F.col(x)) for x in xs))
    head = lambda x: F.lower(F.left(x, F.lit(1)))
    seats = positions.where(F.col("position_type").isin(*POSITION_TYPES) & F.col("court_id").isNotNull()).select("person_id", "court_id", "date_start", "date_termination")
    known = persons.where(F.col("gender").isin("m", "f")).join(seats, F.col("id") == F.col("person_id"))
    names = ("name_first", "name_middle", "name_last")
    first = known.groupBy("id", *names, "gender", "court_id").agg(F.min("date_start").alias("start_date"), F.max("date_termination").alias("end_date"))
    covered = known.where("fjc_id IS NOT NULL").select(F.col("fjc_id").alias("jid"), "court_id").distinct()
    served = bio.where((F.trim("gender") != "") & F.col("last_name").isNotNull()).join(service, "nid").join(court_map.select("court_id", F.col("fjc_court_name").alias("court_name")), "court_name")
    second = served.join(covered, ["jid", "court_id"], "left_anti")
    own = lambda df, judge_id: df.select(
        judge_id.alias("judge_id"), letters(F.coalesce("name_last", F.lit(""))).alias("last_norm"), letters(trimmed(*names)).alias("full_norm"), F.trim(trimmed("name_first", "name_last")).alias("display_name"),
        head(nullif_blank(F.col("name_first"))).alias("first_initial"), head(nullif_blank(F.col("name_middle"))).alias("mid_initial"), "gender", "court_id", "start_date", "end_date",
    )
    records = second.select(
        F.col("nid").cast("string").alias("judge_id"), letters(F.col("last_name")).alias("last_norm"), letters(F.concat_ws(" ", "first_name", "middle_name", "last_name")).alias("full_norm"),
        F.trim(F.concat_ws(" ", "first_name", "last_name")).alias("display_name"), head(F.coalesce("first_name", F.lit(""))).alias("first_initial"), head(F.coalesce("middle_name", F.lit(""))).alias("mid_initial"),
        "gender", "court_id", F.col("commission_date").alias("start_date"), F.col("termination_date").alias("end_date"),
    )
    return own(first, F.col("id").cast("string")).unionByName(records).unionByName(own(supplement, F.concat(F.lit("sup_"), F.col("sup_id").cast("string"))))


def _without_suffix(name: Column) -> Column:
    return nullif_blank(F.regexp_replace(name, r"(?i),?\s+(Jr|Sr|II|III|IV|V)\.?$", ""))


def _initials(name: Column, surname: str) -> dict[str, Column]:
    """The first letter, whether the name is initials and a surname, and the middle initial where it has one."""
    two = rf"(?i)^[{_L}][.]?\s*([{_L}])[.]?\s+"
    return {
        "first_initial": F.lower(F.left(F.regexp_replace(name, rf"^[^{_L}]+", ""), F.lit(1))),
        "middle_initial": F.lower(F.coalesce(first_match(name, rf"^[{_L}][.]([{_L}])[.]\s+"), first_match(name, two))),
        "is_initial_name": F.coalesce(name.rlike(rf"(?i)^[{_L}][.]?\s*[{_L}]?[.]?\s+[{surname}]+$"), F.lit(False)),
    }


def xml_tag(xml: Column) -> Column:
    """The content of the author tag (up to the last closing tag), without markup, entities and leading numbers; null if empty."""
    out = F.regexp_replace(first_match(xml, r"(?s)<author[^>]*>(.*)</author>"), r"<[^>]+>", " ")
    for entity, by in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(by))
    return nullif_blank(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[*\s0-9]+", ""))


def xml_name(tag: Column) -> Column:
    """The name before a title; null without a title, and for tags that name no author.  Titles count with a small or capital
    first letter; others (all capitals) are no titles in the published results."""
    any_case = "|".join(t.replace(" ", r"\s+") for t in _TITLES)
    as_read = "|".join(r"\s+".join(f"[{w[0].upper()}{w[0]}]{w[1:]}" for w in t.split()) for t in _TITLES)
    start = rf"^[{_L}][{_L}.'\- ]+"
    comma = tag.rlike(rf"(?i){start}(,\s*(jr|sr|ii|iii|iv|v)\.?)?,\s*({any_case})")
    blank = tag.rlike(rf"(?i){start}\s+({any_case})")
    before_comma = first_match(tag, rf"^([^,]+(?:,\s*(?:[Jj][Rr]|[Ss][Rr]|II|III|IV|V)\.?)?),\s*(?:{as_read})")
    return F.when(~_any(tag, _NO_AUTHOR), F.when(comma, F.trim(before_comma)).when(blank, F.trim(first_match(tag, rf"^(.+?)\s+(?:{as_read})"))))


def xml_names(base: DataFrame, xml: str = "xml_harvard") -> DataFrame:
    """Rows of base whose author tag names somebody, with the name, its forms for the ladder, and the cleaned tag."""
    named = base.where(F.col(xml).ilike("%<author%")).withColumn("author_tag", xml_tag(F.col(xml))).withColumn("author_name", xml_name(F.col("author_tag")))
    good = named.where(~_any(F.col("author_name"), _NO_XML_NAME) & F.length("author_name").between(3, 80) & F.col("author_name").rlike(f"[{_L}]"))
    name = F.col("author_name")
    bare = _without_suffix(name)
    forms = {
        "full": letters(F.coalesce(bare, name)),
        "last": letters(first_match(bare, r"(\S+)$")),
        **_initials(name, f"{_L}'-"),
    }
    return good.drop(xml).withColumns(forms)


def html_layout(html: Column) -> Column:
    """The kind of markup that decides which patterns are read."""
    return (
        F.when(html.rlike(r'(?i)class="indent"'), "harvard_structured").when(html.rlike(r"(?i)^\s*<\?xml"), "xml_inline")
        .when(html.rlike(r'(?i)^\s*<pre\s[^>]*class="inline"'), "pre_inline").otherwise("plain_html")
    )


def html_lines(html: Column) -> Column:
    """The first FIRST_CHARS characters of the text, with a line for each block."""
    return F.left(F.regexp_replace(F.regexp_replace(html, r"(?i)</p>|</div>|<br\s*/?>|</blockquote>|</center>", "\n"), r"<[^>]+>", " "), F.lit(FIRST_CHARS))


def html_flat(html: Column) -> Column:
    """The same text in one line, cut after blanks are joined."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)</p>|</div>|<br\s*/?>|</blockquote>|</center>", "\n"), r"<[^>]+>", " ")
    return F.left(F.regexp_replace(text, r"\s+", " "), F.lit(FIRST_CHARS))


def _not_a_list(x: Column) -> Column:
    return ~x.rlike(_AND) & ~x.contains(";") & (~x.contains(",") | x.rlike(_LIST_END))


def html_author(base: DataFrame, html: str = "html_with_citations", compat: bool = True, guard: bool = True) -> DataFrame:
    """base with html_layout, found_name and found_pattern: the candidate of the least priority, then the least line.

    Weak patterns hold only on lines with no "Before:" line among the GUARD_LINES lines up to them (guard=False leaves that
    out, which tells what the guard costs).
    """
    layout, numbered = F.col("html_layout"), F.col("_lines")
    free = lambda r: ~F.exists("_guards", lambda g: (g <= r["n"]) & (r["n"] - g <= GUARD_LINES)) if guard else F.lit(True)

    def found(name: str, priority: int, scope: str, pattern: str) -> Column:
        row = lambda line, v: F.struct(F.lit(priority).alias("priority"), line.alias("line"), F.trim(v).alias("v"), F.lit(name).alias("pattern"))
        if scope in ("harvard", "flat"):
            whole = F.left(F.col(html), F.lit(FIRST_HARVARD_CHARS)) if scope == "harvard" else html_flat(F.col(html))
            pattern = pattern.replace(r"\b", r"\x08") if compat else pattern
            right = layout == "harvard_structured" if scope == "harvard" else layout != "harvard_structured"
            return F.when(right, F.array(row(F.lit(1 << 30), first_match(whole, pattern))))
        hit = lambda r: r["x"].rlike(pattern)
        if scope != "line":
            hit = lambda r: r["x"].rlike(pattern) & free(r)
        # what a greedy capture took of the blanks and the mark after a name
        v = lambda r: F.regexp_replace(F.regexp_extract(r["x"], pattern, 1), r"\s*[:.]?\s*$", "") if name.startswith("A1_") else F.regexp_extract(r["x"], pattern, 1)
        rows = F.transform(F.filter(numbered, hit), lambda r: row(r["n"], v(r)))
        layouts = {"line": ("plain_html", "xml_inline", "pre_inline"), "weak": ("plain_html", "xml_inline"), "weak_pre": ("pre_inline",)}[scope]
        return F.when(layout.isin(*layouts), rows)

    candidates = F.flatten(F.array(*(F.coalesce(found(*p), F.array().cast("array<struct<priority:int,line:int,v:string,pattern:string>>")) for p in PATTERNS)))
    good = F.filter(candidates, lambda r: F.coalesce((r["v"] != "") & _not_a_list(r["v"]) & ~r["v"].rlike(_PANEL), F.lit(False)))
    lines = F.transform(F.split(html_lines(F.col(html)), "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.trim(x).alias("x")))
    rows = base.withColumn("html_layout", html_layout(F.col(html))).withColumn("_lines", lines)
    rows = rows.withColumn("_guards", F.transform(F.filter("_lines", lambda r: r["x"].rlike(GUARD)), lambda r: r["n"])).withColumn("_best", F.array_min(good))
    return rows.select(*base.columns, "html_layout", F.col("_best.v").alias("found_name"), F.col("_best.pattern").alias("found_pattern"))


def html_names(base: DataFrame, html: str = "html_with_citations", compat: bool = True) -> DataFrame:
    """Rows of base from 1960 on whose text names an author, with the name and its forms for the ladder."""
    rows = html_author(base.where((F.col("year_filed") >= 1960) & (F.trim(html) != "")), html, compat)
    v = F.trim("found_name")
    ok = F.length(v).between(3, 80) & v.rlike(f"[{_L}]") & ~v.rlike(_COLLECTIVE) & ~v.rlike(r"(?i)^\s*Before[\s:]") & _not_a_list(v)
    if not compat:
        ok = ok & ~v.rlike(_PARTY)
    rows = rows.where(ok).withColumn("_line", F.trim(F.regexp_replace(v, r"(?s)^.*\n\s*", "")))
    line = F.col("_line")
    bare = line if compat else F.regexp_replace(line, r"(?i)\s*,?\s*\b(?:Jr\.?|Sr\.?|II|III|IV|V)\s*$", "")
    name = F.trim(F.regexp_replace(line, _TITLE_END, ""))
    stripped = F.regexp_replace(name, r"(?i),?\s+(Jr\.?|Sr\.?|II|III|IV|V|2nd|3rd)\s*$", "")
    forms = _initials(line, _L)
    one = F.lower(first_match(line, rf"(?i)^[{_L}][.]?\s*([{_L}])[.]?\s+"))
    return rows.where(_not_a_list(line)).withColumns(
        {
            "author_name": name, "full": letters(line), "compound": letters(line), "last": F.lower(F.regexp_replace(F.element_at(F.split(bare, " "), -1), "[^a-zA-Z]", "")),
            "stripped": letters(F.coalesce(first_match(stripped, r"(\S+)\s*$"), F.lit(""))), **forms, "middle_initial": one, "first_initial": F.lower(F.left(F.regexp_replace(line, "^[^a-zA-Z]+", ""), F.lit(1))),
        }
    ).drop("_line", html)


def _rules(tiers: tuple) -> Column:
    """The number of the first tier that a name (unprefixed columns) and a judge (columns j_*) meet."""
    full, last, first, middle = (F.col(x) for x in ("full", "last", "first_initial", "middle_initial"))
    none = lambda x: x.isNull() | (x == "")
    agree = none(first) | (F.col("j_first_initial") == first)
    kind = {
        "full": F.col("j_full_norm") == full,
        "initials": F.col("is_initial_name") & (F.col("j_last_norm") == last) & (F.col("j_first_initial") == first) & (none(middle) | (F.col("j_mid_initial") == middle)),
        "last": (F.col("j_last_norm") == last) & ((full == last) | agree),
    }
    if any(t[1] == "compound" for t in tiers):
        kind["compound"] = (F.col("j_last_norm") == F.col("compound")) & (F.col("compound") != last)
        kind["stripped"] = (F.col("j_last_norm") == F.col("stripped")) & (F.col("stripped") != "") & (F.col("stripped") != last) & agree
    here = F.col("j_court_id") == F.col("court_id")
    start, end = F.year("j_start_date"), F.year("j_end_date")
    active = (start.isNull() | (start <= F.col("year_filed"))) & (end.isNull() | (end >= F.col("year_filed")))
    out = None
    for n, (_, what, same_court, in_period, _) in enumerate(tiers, 1):
        rule = kind[what]
        rule = rule & here if same_court else rule
        rule = rule & active if in_period else rule
        out = F.when(rule, n) if out is None else out.when(rule, n)
    return out


def match_names(names: DataFrame, pool: DataFrame, branch: str) -> DataFrame:
    """names (opinion_id, court_id, year_filed, author_name and the forms) with the consensus of each name's best tier: priority,
    n_judges, n_genders, names, ids, genders, gender, gender_resolved, source, quality_tier and label."""
    tiers = XML_TIERS if branch == "xml" else TIERS
    key = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))
    keys = [key("full", F.col("full")), key("last", F.col("last"))]
    if branch == "html":
        keys += [key("last", F.col("compound")), key("last", F.when(F.col("stripped") != "", F.col("stripped")))]
    cases = names if branch == "xml" else names.where(F.col("last") != "")
    asked = cases.withColumn("_k", F.explode(F.array_distinct(F.array(*keys)))).where("_k.key IS NOT NULL")
    judges = pool.select(*(F.col(c).alias(f"j_{c}") for c in pool.columns))
    judges = judges.withColumn("_k", F.explode(F.array(key("full", F.col("j_full_norm")), key("last", F.col("j_last_norm")))))
    met = asked.join(judges, "_k").withColumn("tier", _rules(tiers)).where("tier IS NOT NULL")
    one = F.struct("tier", F.struct("j_judge_id", "j_display_name", "j_gender").alias("j"))
    sets = met.groupBy("opinion_id").agg(F.collect_set(one).alias("all"), F.min("tier").alias("priority"))  # a name's candidates: some of the pool
    best = F.transform(F.filter("all", lambda r: r["tier"] == F.col("priority")), lambda r: r["j"])
    some = lambda f: F.sort_array(F.array_distinct(F.filter(F.transform("best", lambda j: j[f]), lambda x: x.isNotNull())))
    genders = F.filter(some("j_gender"), lambda g: F.trim(g) != "")
    joined = lambda x: F.when(F.size(x) > 0, F.array_join(x, " | "))
    told = sets.withColumn("best", best).select(
        "opinion_id", "priority", F.size(some("j_judge_id")).alias("n_judges"), F.size(genders).alias("n_genders"), joined(some("j_display_name")).alias("names"),
        joined(some("j_judge_id")).alias("ids"), joined(some("j_gender")).alias("genders"), F.when(F.size(genders) == 1, genders[0]).alias("gender"),
    )
    out = names.select("opinion_id", "author_name").join(told, "opinion_id", "left")
    out = out.withColumns({"n_judges": F.coalesce("n_judges", F.lit(0)), "n_genders": F.coalesce("n_genders", F.lit(0))})
    source, quality, label = labels(branch)
    return out.withColumns({"gender_resolved": F.col("n_genders") == 1, "source": source, "quality_tier": quality, "label": label})


def labels(branch: str) -> tuple[Column, Column, Column]:
    """Source code, quality tier and label, from priority, n_judges, n_genders and author_name."""
    start, told_in_source, told_in_label, no_source, no_label = BRANCHES[branch]
    tiers = XML_TIERS if branch == "xml" else TIERS
    alone, n = F.col("n_judges") == 1, F.col("priority")
    source = label = quality = None
    for k, (name, _, _, _, number) in enumerate(tiers, 1):
        short = _SHORT.get(name, name)
        who = lambda told, k=k: F.when(alone, "judge").otherwise("gender") if k in told else F.lit("gender")
        at = (n == k) & (F.col("n_genders") == 1)
        own = (F.concat(F.lit(f"{start}{short}_unique_"), who(told_in_source)), F.concat(F.lit(f"{branch}_{short}_unique_"), who(told_in_label)), F.when(alone, number).otherwise(6) if k == 1 else F.lit(number))
        source, label, quality = ((F.when(at, v) if c is None else c.when(at, v)) for c, v in zip((source, label, quality), own, strict=True))
    several, without = (F.col("n_judges") > 0) & (F.col("n_genders") > 1), (F.col("n_judges") > 0) & (F.col("n_genders") == 0)
    source = source.when(several, f"{start}ambiguous_multiple_genders").when(without, f"{start}candidates_without_gender").when(F.col("author_name").isNotNull(), no_source)
    label = label.when(several, f"{branch}_ambiguous_multiple_genders").when(without, f"{branch}_candidates_without_gender").otherwise(no_label)
    return source, quality.when(several, AMBIGUOUS).when(without, WITHOUT_GENDER).otherwise(UNMATCHED), label


_TOLD = ("gender", "gender_resolved", "source", "quality_tier", "label", "author_name", "n_judges", "n_genders", "names", "ids", "priority")


def text_attribution(base: DataFrame, pool: DataFrame, compat: bool = True) -> DataFrame:
    """One row for each opinion of base with what its XML tag and its HTML text tell (columns xml_* and html_*)."""
    out = base.select("opinion_id")
    for branch, names in (("xml", xml_names(base)), ("html", html_names(base, compat=compat))):
        told = match_names(names, pool, branch)
        extra = ["author_tag"] if branch == "xml" else ["html_layout", "found_pattern"]
        told = told.join(names.select("opinion_id", *extra), "opinion_id")
        out = out.join(told.select("opinion_id", *(F.col(c).alias(f"{branch}_{c}") for c in (*_TOLD, *extra))), "opinion_id", "left")
    for branch in BRANCHES:
        unmatched = BRANCHES[branch][4]
        out = out.withColumns(
            {
                f"{branch}_n_judges": F.coalesce(f"{branch}_n_judges", F.lit(0)), f"{branch}_n_genders": F.coalesce(f"{branch}_n_genders", F.lit(0)), f"{branch}_gender_resolved": F.coalesce(f"{branch}_gender_resolved", F.lit(False)),
                f"{branch}_quality_tier": F.coalesce(f"{branch}_quality_tier", F.lit(UNMATCHED)), f"{branch}_label": F.coalesce(f"{branch}_label", F.lit(unmatched)),
            }
        )
    return out


#: Channels of the final cascade in order: prefix of the columns, name and priority (fixed values).
CHANNELS = (("prev", "previous_final", 1), ("xml", "xml_author_tag", 2), ("html", "html_extraction", 3))


def final_cascade(opinions: DataFrame, previous: DataFrame, text: DataFrame) -> DataFrame:
    """Opinions (opinion_id, author_id, author_str) with the gender of the first channel that resolves it, that channel's source, tier
    and label (or, where none does, those of the first channel that has them), and all channels' columns beside."""
    own = ("gender", "gender_resolved", "source", "quality_tier", "label")
    rows = opinions.join(previous.select("opinion_id", *(F.col(c).alias(f"prev_{c}") for c in own)), "opinion_id", "left").join(text, "opinion_id", "left")
    resolved = [(F.coalesce(f"{p}_gender_resolved", F.lit(False)), p, name, n) for p, name, n in CHANNELS]
    silent = F.col("author_id").isNull() & F.coalesce(F.trim("author_str") == "", F.lit(True))

    def first(column: str, missing, unknown) -> Column:
        out = None
        for ok, p, _, _ in resolved:
            out = F.when(ok, F.col(f"{p}_{column}")) if out is None else out.when(ok, F.col(f"{p}_{column}"))
        for _, p, _, _ in resolved if missing is not None else ():
            out = out.when(F.col(f"{p}_{column}").isNotNull(), F.col(f"{p}_{column}"))
        return out if missing is None else out.when(silent, missing).otherwise(unknown)

    channel = priority = None
    for ok, _, name, n in resolved:
        channel, priority = (F.when(ok, name), F.when(ok, n)) if channel is None else (channel.when(ok, name), priority.when(ok, n))
    return rows.withColumns(
        {
            "gender": first("gender", None, None), "gender_resolved": channel.isNotNull(), "gender_source": first("source", "no_author_id_or_author_str", "unknown"),
            "quality_tier": first("quality_tier", 10, 99), "quality_label": first("label", "no_author_information", "unknown"),
            "channel": channel.otherwise("unresolved"), "channel_priority": priority.otherwise(99),
        }
    )


def guard_cost(rebuilt: DataFrame, html: str = "html_with_citations") -> DataFrame:
    """Of opinions (name_in_earlier, html) that an earlier release resolved by the pre_inline line pattern: how many the pattern finds
    without the guard, with the same name or not."""
    pattern = rf"(?im)^\s*(?:[_ \t]+)?({_NAME}{{2,80}}),\s*(?:Chief\s+|Senior\s+)?Circuit\s+Judge\s*[:.](?:\s|$)"
    free = nullif_blank(first_match(html_lines(F.coalesce(F.col(html), F.lit(""))), pattern))
    rows = rebuilt.withColumn("_free", free)
    same = F.upper(F.trim("_free")) == F.upper(F.trim("name_in_earlier"))
    return rows.agg(F.count("*").alias("n_lost"), F.count("_free").alias("found_without_guard"), F.count_if(same).alias("same_name"), F.count_if(F.col("_free").isNull()).alias("still_none"))
