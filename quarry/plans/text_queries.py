"""Queries about text: flags, names, keys, markup, line patterns, outcomes, casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import exprs as E
from quarry.operators import authorship as AU
from quarry.plans.registry import query


@query("""SELECT doc_id, lang, text IS NOT NULL AND trim(text) <> '' AS has_text, length(text) AS text_length, n_chars BETWEEN 100 AND 1000 AS is_short FROM documents""")
def q03_meta_flags(t):
    return t.documents.select("doc_id", "lang", (~E.is_blank(F.col("text"))).alias("has_text"), F.length("text").cast("long").alias("text_length"), F.col("n_chars").between(100, 1000).alias("is_short"))


@query("""SELECT c_custkey, lpad(regexp_extract(c_name, '#0*([0-9]+)$', 1), 7, '0') AS key, CASE WHEN regexp_matches(c_name, '#[0-9]+$') THEN 'hash' ELSE 'unparseable' END AS rule FROM customer""")
def q53_key_parser(t):
    number = E.first_match(F.col("c_name"), "#0*([0-9]+)$")
    return t.customer.select("c_custkey", F.lpad(number, 7, "0").alias("key"), F.when(F.col("c_name").rlike("#[0-9]+$"), "hash").otherwise("unparseable").alias("rule"))


@query("""SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS alpha, lower(trim(regexp_replace(regexp_replace(replace(text, '.', ' '), '[^A-Za-z\\-\\s'']', '', 'g'), '\\s+', ' ', 'g'))) AS spaced FROM documents""")
def q54_norm_names(t):
    return t.documents.select("doc_id", E.norm_alpha(F.col("text")).alias("alpha"), E.norm_space(F.col("text")).alias("spaced"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(replace(p_name, '.', ' '), '[^A-Za-z\\-\\s'']', '', 'g'), '\\s+', ' ', 'g'))) AS spaced, string_split(spaced, ' ')[-1] AS last_token FROM part""")
def q54b_part_names(t):
    spaced = E.norm_space(F.col("p_name"))
    return t.part.select("p_partkey", spaced.alias("spaced"), E.final_token(spaced).alias("last_token"))


@query("""SELECT layout, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(html, '(?i)class="indent"') THEN 'harvard_structured' WHEN regexp_matches(html, '(?i)^\\s*<\\?xml') THEN 'xml_inline'
WHEN regexp_matches(html, '(?i)^\\s*<pre\\s[^>]*class="inline"') THEN 'pre_inline' ELSE 'plain_html' END AS layout FROM pages) GROUP BY 1""")
def q55_html_layout(t):
    return t.pages.groupBy(AU.html_layout(F.col("html")).alias("layout")).agg(F.count("*").alias("n"))


_STRIP = (
    r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|article|nav|ul)>', chr(10), 'g'), '<[^>]*>', '', 'g')"
)


_BLOCKS = r"regexp_replace(regexp_replace(html, '(?i)</p>|</div>|<br\s*/?>|</blockquote>|</center>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"


@query(f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace({_STRIP}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def q56_html_strip(t):
    return t.pages.select("page_id", E.flat(E.strip_tags(F.col("html"))).alias("text"))


@query(f"""SELECT page_id, left(regexp_replace({_BLOCKS}, '\\s+', ' ', 'g'), {AU.FIRST_CHARS}) AS flat, left({_BLOCKS}, {AU.FIRST_CHARS}) AS lines FROM pages""")
def q56b_html_first(t):
    """The first characters are the operator's own: an author stands at the start of an opinion."""
    return t.pages.select("page_id", AU.html_flat(F.col("html")).alias("flat"), AU.html_lines(F.col("html")).alias("lines"))


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<title>([^<]*)</title>') THEN regexp_extract(html, '(?s)<title>([^<]*)</title>', 1) END AS title FROM pages""")
def q57_title_extract(t):
    return t.pages.select("page_id", E.first_match(F.col("html"), "(?s)<title>([^<]*)</title>").alias("title"))


_LINE_RULES = ((10, "License"), (20, r"^[A-Z][a-z]+\.$"), (30, "^The "))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, x, CASE {" ".join(f"WHEN regexp_matches(x, '{p}') THEN {k}" for k, p in _LINE_RULES)} END AS priority FROM l)
SELECT doc_id, CAST(priority AS INTEGER) AS priority, CAST(n AS INTEGER) AS line, x FROM c WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority, n) = 1""")
def q58_line_patterns(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(_priority(x).alias("priority"), (i + 1).alias("line"), x.alias("x")))
    best = F.array_min(F.filter(lines, lambda r: r["priority"].isNotNull()))
    return t.documents.select("doc_id", best.alias("b")).where("b IS NOT NULL").select("doc_id", "b.priority", "b.line", "b.x")


def _priority(x):
    out = None
    for k, p in _LINE_RULES:
        out = F.when(x.rlike(p), k) if out is None else out.when(x.rlike(p), k)
    return out


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
m AS (SELECT *, max(CASE WHEN regexp_matches(x, 'License') THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS last_marker FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last_marker IS NULL OR n - last_marker > 5) AS n_open FROM m GROUP BY 1""")
def q59_guarded_lines(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("n"), x.alias("x")))
    marks = F.transform(F.filter("_l", lambda r: r["x"].rlike("License")), lambda r: r["n"])
    ok = F.filter("_l", lambda r: ~F.exists("_m", lambda m: (m <= r["n"]) & (r["n"] - m <= 5)))
    rows = t.documents.select("doc_id", lines.alias("_l")).withColumn("_m", marks)
    return rows.select("doc_id", F.size("_l").cast("long").alias("n_lines"), F.size(ok).cast("long").alias("n_open"))


@query("""SELECT count(id) AS n_ids, sum(id)::BIGINT AS total, count(*) - count(id) AS n_other FROM (SELECT try_cast(CASE WHEN p_partkey % 4 = 0 THEN 'sup_' || p_partkey ELSE p_partkey::VARCHAR END AS BIGINT) AS id FROM part)""")
def q62_try_cast_guard(t):
    mixed = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("sup_"), "p_partkey")).otherwise(F.col("p_partkey").cast("string"))
    return t.part.select(mixed.try_cast("bigint").alias("id")).agg(F.count("id").alias("n_ids"), F.sum("id").alias("total"), (F.count("*") - F.count("id")).alias("n_other"))


@query("""SELECT o_orderkey, strftime(try_strptime(s, '%m/%d/%Y'), '%Y-%m-%d') AS day FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '13/45/1999' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS s FROM orders)""")
def q71_date_parse(t):
    s = F.when(F.col("o_orderkey") % 6 == 0, "13/45/1999").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return t.orders.select("o_orderkey", F.date_format(F.try_to_date(s, "MM/dd/yyyy"), "yyyy-MM-dd").alias("day"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def q72_json_prop(t):
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(h) > 20 THEN left(h, 20) || '...' ELSE h END AS label, md5(text) AS digest FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS h FROM documents)""")
def q78_labels(t):
    return t.documents.select("doc_id", E.shorten(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 20).alias("label"), F.md5("text").alias("digest"))
