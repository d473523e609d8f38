"""Queries of scans, filters, orders, checks and published views that the other catalogues leave open."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import exprs as E
from quarry.operators import aggregates as A
from quarry.operators import appeals as AP
from quarry.operators import presentation as P
from quarry.operators import quality as Q
from quarry.operators import relational as R
from quarry.operators import resolution as RS
from quarry.operators import stats as ST
from quarry.plans import miniatures as M
from quarry.plans.registry import query
from quarry.sources import tables as S


@query("SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND CAST(o_orderdate AS DATE) < DATE '1996-07-01' GROUP BY 1")
def q113_half_open_range(t):
    return t.orders.where(E.in_days(F.col("o_orderdate"), "1995-01-01", "1996-07-01")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


_IDS = M.Mini("wanted", "id long", [(1,), (2,), (2,), (5,), (9,), (77,), (None,), (123456789,)])


@query(f"WITH {M.ctes(_IDS)} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = ANY (SELECT id FROM wanted)")
def q114_by_id_list(t):
    return S.by_ids(t.lineitem, "l_orderkey", _IDS.df(t.spark)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY first_order IS NULL, first_order, c_custkey) AS place FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def q115_dated_first(t):
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first_order"))
    rows = t.customer.select("c_custkey", "c_nationkey").join(first, "c_custkey", "left")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("first_order").isNull(), "first_order", "c_custkey"))
    return rows.select("c_custkey", place.cast("long").alias("place"))


@query("SELECT p_partkey, substring(p_name, 2, 4) AS middle, substring(p_name, 5) AS rest, left(p_name, 1) AS head FROM part")
def q116_substring(t):
    name = F.col("p_name")
    return t.part.select("p_partkey", E.part_of(name, 2, 4).alias("middle"), E.part_of(name, 5).alias("rest"), E.part_of(name, 1, 1).alias("head"))


@query("SELECT lang, count(*) AS n_rows, count(n_chars) AS n_values, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median, count(DISTINCT n_chars) AS n_distinct FROM documents GROUP BY 1")
def q117_group_statistics(t):
    return A.group_statistics(t.documents, ["lang"], "n_chars")


def _map_sql(table: str, columns: tuple[str, ...]) -> str:
    one = "SELECT '{t}' AS table_name, '{c}' AS variable_name, count(*) AS total_rows, count(*) FILTER (WHERE coalesce(trim(CAST({c} AS VARCHAR)), '') = '') AS missing_count FROM {t}"
    return " UNION ALL ".join(one.format(t=table, c=c) for c in columns)


_CHOSEN = {
    "customer": ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_name", "s_nationkey", "s_acctbal"), "part": ("p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "nation": ("n_name", "n_regionkey"), "region": ("r_name",),
    "orders": ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "documents": ("text", "lang", "source", "n_chars"), "labels": ("quality", "toxic"), "pages": ("url", "html"), "events": ("ts", "user_id", "event_type", "value", "props"), "conversations": ("turn", "role", "text"),
}


@query(f"""SELECT *, round(100.0 * missing_count::DOUBLE / total_rows, 2) AS missing_pct, round(100.0 * (total_rows - missing_count)::DOUBLE / total_rows, 2) AS completeness_pct FROM ({" UNION ALL ".join(_map_sql(k, v) for k, v in _CHOSEN.items())})""")
def q118_completeness_map(t):
    return A.completeness_map({name: (getattr(t, name), list(columns)) for name, columns in _CHOSEN.items()})


@query("""WITH a AS (SELECT p_partkey, p_name AS k1, split_part(p_name, ' ', 2) AS k2 FROM part WHERE p_size = 1), b AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size = 2 UNION SELECT 'widget')
SELECT p_partkey, name FROM a LEFT JOIN b ON name = k1 OR name = k2""")
def q119_disjunctive_left_join(t):
    a = t.part.where("p_size = 1").select("p_partkey", F.col("p_name").alias("k1"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("k2"))
    b = t.part.where("p_size = 2").select(F.col("p_name").alias("name")).unionByName(t.spark.createDataFrame([("widget",)], "name string")).distinct()
    return R.or_join(a, b, [F.col("k1"), F.col("k2")], F.col("name"), how="left").select("p_partkey", "name")


@query("""SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers, date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS span FROM lineitem GROUP BY 1 HAVING n_lines > 6 OR n_suppliers > 5 OR span > 2300""")
def q120_suspicious_groups(t):
    span = F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("long")
    g = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers"), span.alias("span"))
    return g.where((F.col("n_lines") > 6) | (F.col("n_suppliers") > 5) | (F.col("span") > 2300))


@query("""WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT 'first' AS side, k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT 'second', k FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)""")
def q121_differences_both_ways(t):
    return Q.differences_both_ways(t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@query("""SELECT 'orders_pkey' AS constraint_name, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS n_rows UNION ALL SELECT 'lineitem_pkey', (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem)
UNION ALL SELECT 'lineitem_l_orderkey_fkey', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'labels_doc_id_fkey', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en'))
UNION ALL SELECT 'positive_price', (SELECT count(*) FROM orders WHERE o_totalprice <= 0) UNION ALL SELECT 'small_quantity', (SELECT count(*) FROM lineitem WHERE l_quantity > 40)""")
def q122_constraints(t):
    tables = {"orders": t.orders, "lineitem": t.lineitem, "labels": t.labels, "documents": t.documents.where("lang = 'en'")}
    foreign = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")]
    return Q.constraint_faults(tables, {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}, foreign, {"positive_price": ("orders", F.col("o_totalprice") > 0), "small_quantity": ("lineitem", F.col("l_quantity") <= 40)})


@query("""WITH d AS (SELECT doc_id, lang, source, quality FROM documents LEFT JOIN labels USING (doc_id)), g AS (
SELECT 'overall' AS dimension, 'all' AS value, count(*) AS n, count(quality) AS n_resolved FROM d UNION ALL SELECT 'lang', coalesce(lang, 'Missing'), count(*), count(quality) FROM d GROUP BY lang UNION ALL SELECT 'source', coalesce(source, 'Missing'), count(*), count(quality) FROM d GROUP BY source)
SELECT *, round(100.0 * n_resolved::DOUBLE / n::DOUBLE, 2) AS pct FROM g""")
def q123_coverage_report(t):
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    return Q.coverage(rows, F.col("quality").isNotNull(), ["lang", "source"])


@query(f"""WITH {M.ctes(M.OUTCOMES, M.DOMAINS)} SELECT 'crosswalk_outcome' AS view_name, outcome_code AS a, outcome_label AS b, outcome_class AS c FROM outcome_codes UNION ALL SELECT 'crosswalk_case_domain', code_kind, code_value, rq2_domain FROM domain_codes""")
def q124_published_views(t):
    P.register({"fjc_outcome_crosswalk": M.OUTCOMES.df(t.spark), "fjc_domain_crosswalk": M.DOMAINS.df(t.spark)})
    return t.spark.sql("""SELECT 'crosswalk_outcome' AS view_name, outcome_code AS a, outcome_label AS b, outcome_class AS c FROM crosswalk_outcome
      UNION ALL SELECT 'crosswalk_case_domain', code_kind, code_value, case_domain FROM crosswalk_case_domain""")


@query("""SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END), ''), nullif(trim(source), ''), 'none') AS label, CASE WHEN doc_id % 3 = 0 THEN 'source' ELSE 'lang' END AS field FROM documents WHERE source IS NOT NULL""")
def q125_first_filled(t):
    rows = t.documents.where("source IS NOT NULL").withColumn("l", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")))
    return rows.select("doc_id", F.coalesce(E.first_filled(F.col("l"), F.col("source")), F.lit("none")).alias("label"), F.when(E.is_blank(F.col("l")), "source").otherwise("lang").alias("field"))


@query("SELECT doc_id, regexp_replace(text, '[aeiou]+', '*') AS first_only, md5(regexp_replace(text, '[aeiou]+', '*', 'g')) AS all_of_them FROM documents")
def q126_replace_first(t):
    text = F.col("text")
    return t.documents.select("doc_id", E.replace_first(text, "[aeiou]+", "*").alias("first_only"), F.md5(F.regexp_replace(text, "[aeiou]+", "*")).alias("all_of_them"))


@query(r"""SELECT doc_id, md5(regexp_replace(t, '[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}\x{200B}-\x{200F}\x{FEFF}\x{E000}-\x{F8FF}]', '', 'g')) AS digest, length(t) - length(regexp_replace(t, '[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}\x{200B}-\x{200F}\x{FEFF}\x{E000}-\x{F8FF}]', '', 'g')) AS n_out
FROM (SELECT doc_id, text || chr(7) || chr(8203) || 'x' || chr(57344) AS t FROM documents)""")
def q127_without_controls(t):
    dirty = F.concat("text", F.lit("\u0007​x"))
    clean = E.without_controls(dirty)
    return t.documents.select("doc_id", F.md5(clean).alias("digest"), (F.length(dirty) - F.length(clean)).cast("long").alias("n_out"))


@query("""SELECT period, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1994-01-01' THEN 'before 1994' WHEN o_orderdate < DATE '1997-01-01' THEN '1994-1996' ELSE 'from 1997' END AS period FROM orders) GROUP BY 1""")
def q128_periods(t):
    day = lambda x: F.lit(x).cast("date")
    period = F.when(F.col("o_orderdate") < day("1994-01-01"), "before 1994").when(F.col("o_orderdate") < day("1997-01-01"), "1994-1996").otherwise("from 1997")
    return t.orders.groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""WITH s AS (SELECT conv_id, count(*) AS panel_size FROM conversations GROUP BY 1) SELECT panel_size, count(*) AS cluster_frequency FROM s GROUP BY 1""")
def q129_panel_sizes(t):
    return ST.panel_sizes(t.conversations.withColumnRenamed("conv_id", "opinioncluster_id"))


@query("""WITH x AS (SELECT o_custkey AS person_id, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT l_suppkey AS person_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT person_id, coalesce(x.n, 0) AS n_authored, coalesce(y.n, 0) AS n_panels, n_authored + n_panels AS n_total FROM x FULL JOIN y USING (person_id) ORDER BY n_total DESC, person_id LIMIT 25""")
def q130_top_both(t):
    return ST.top_both(t.orders.select(F.col("o_custkey").alias("person_id")), t.lineitem.select(F.col("l_suppkey").alias("person_id"))).select("person_id", "n_authored", "n_panels", "n_total")


@query("""WITH drawn AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || 'audit'), doc_id) AS draw_rank FROM documents), sizes AS (SELECT lang, count(*) AS stratum_size FROM documents GROUP BY 1)
SELECT doc_id, lang, draw_rank, stratum_size, left(text, 100) AS excerpt FROM drawn JOIN sizes USING (lang) WHERE draw_rank <= CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 4 ELSE 0 END""")
def q131_validation_sample(t):
    texts = t.documents.select("doc_id", "text")
    return RS.validation_sample(t.documents.select("doc_id", "lang"), "doc_id", "lang", {"en": 6, "de": 4}, "audit", texts, 100).select("doc_id", "lang", "draw_rank", "stratum_size", "excerpt")


@query("""SELECT o.doc_id, coalesce(CASE WHEN o.doc_id % 2 = 0 THEN 'kept ' || o.doc_id END, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END) AS verdict FROM labels o WHERE toxic IS NOT NULL""")
def q132_upsert(t):
    prior = t.labels.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("kept "), "doc_id").alias("verdict"))
    fresh = t.labels.where("toxic IS NOT NULL").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("verdict"))
    return S.upsert(prior, fresh, "doc_id", ["verdict"])


@query("""SELECT t.o_orderkey, t.o_custkey FROM orders t WHERE o_custkey = 7 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-17' - 400 AND DATE '1995-06-17' + 400""")
def q133_neighbourhood(t):
    rows = t.orders.select(F.col("o_orderkey").alias("opinion_id"), F.col("o_custkey").alias("docket_id"), F.to_date("o_orderdate").alias("date_filed"), F.col("o_orderpriority").alias("plain_text"))
    return AP.neighbourhood(rows, 7, "1995-06-17", 400).select(F.col("opinion_id").alias("o_orderkey")).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")


@query("""SELECT table_name, variable_name, completeness_pct FROM (SELECT 'documents' AS table_name, 'lang' AS variable_name, round(100.0 * count(lang)::DOUBLE / count(*)::DOUBLE, 2) AS completeness_pct FROM documents
UNION ALL SELECT 'labels', 'quality', round(100.0 * count(quality)::DOUBLE / count(*)::DOUBLE, 2) FROM labels) UNION ALL SELECT 'labels', 'nothing', NULL""")
def q134_core_subset(t):
    long = A.completeness_map({"documents": (t.documents, ["lang", "source"]), "labels": (t.labels, ["quality", "toxic"])})
    chosen = t.spark.createDataFrame([("documents", "lang"), ("labels", "quality"), ("labels", "nothing")], "table_name string, variable_name string")
    found, lacking = A.core_subset(long, chosen)
    columns = ["table_name", "variable_name", "completeness_pct"]
    return found.select(columns).unionByName(lacking.withColumn("completeness_pct", F.lit(None).cast("double")))


@query("SELECT n_name, n_orders FROM (SELECT n_name, count(*) AS n_orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY n_orders DESC, n_name LIMIT 15)")
def q135_recut_top(t):
    """The first 15 of an export of the first 25."""
    base = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("n_orders"))
    return base.orderBy(F.desc("n_orders"), "n_name").limit(25).orderBy(F.desc("n_orders"), "n_name").limit(15)
