"""Queries about counts, audits, distributions and release checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import exprs as E
from quarry.operators import aggregates as A
from quarry.operators import quality
from quarry.plans.registry import query

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in _TABLES))
def q04_table_counts(t):
    return A.table_counts({n: getattr(t, n) for n in _TABLES})


_KEYS = (("orders", "o_orderkey"), ("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("documents", "doc_id"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n, count(DISTINCT {k}) AS n_distinct, count(*) - count(DISTINCT {k}) AS n_duplicates FROM {n}" for n, k in _KEYS))
def q06_duplicate_ids(t):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [A.duplicate_count(getattr(t, n), k).withColumn("table_name", F.lit(n)) for n, k in _KEYS])


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS n_large, count(DISTINCT l_partkey) FILTER (WHERE l_discount = 0) AS n_parts, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_quantity,
min(l_shipmode) AS m FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def q21_filter_aggs(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("n_large"), F.countDistinct(F.when(F.col("l_discount") == 0, F.col("l_partkey"))).alias("n_parts"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("open_quantity"), F.min("l_linestatus").alias("m"),
    )


@query("""SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median_quantity, quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_discount > 0.05) AS median_discounted FROM lineitem GROUP BY 1""")
def q22_percentile(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("median_quantity"), F.percentile(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")), F.lit(0.5)).alias("median_discounted"))


@query("SELECT p_type, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def q23_string_agg(t):
    return t.part.groupBy("p_type").agg(A.distinct_list(F.col("p_brand")).alias("brands"))


@query("""SELECT l_orderkey, string_agg(l_partkey || ':' || l_returnflag, '; ' ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY 1""")
def q24_string_agg_ordered(t):
    return t.lineitem.groupBy("l_orderkey").agg(A.ordered_list([F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")], F.concat_ws(":", "l_partkey", "l_returnflag")).alias("lines"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def q25_having_dups(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT min(n) AS min_n, max(n) AS max_n, CAST(avg(n) AS DECIMAL(12, 2))::DOUBLE AS avg_n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def q26_summary_of_counts(t):
    return A.group_sizes(t.orders, "o_custkey").withColumn("avg_n", F.col("avg_n").cast("decimal(12,2)").cast("double"))


@query("SELECT size, count(*) AS frequency FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def q27_freq_of_freq(t):
    return A.frequency_of_frequency(t.lineitem, "l_orderkey")


@query("""SELECT bucket, count(*) AS n FROM (SELECT o_orderkey, count(l_orderkey) AS k, CASE WHEN k = 0 THEN '0' WHEN k <= 2 THEN '1-2' WHEN k <= 5 THEN '3-5' ELSE '6+' END AS bucket FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1""")
def q28_buckets(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return A.histogram(t.orders.select("o_orderkey").join(n, "o_orderkey", "left"), E.bucket(k, [(0, "0"), (2, "1-2"), (5, "3-5")], "6+"), k)


@query("SELECT o_orderstatus, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS pct FROM (SELECT o_orderstatus, count(*)::DOUBLE AS n FROM orders GROUP BY 1)")
def q29_pct_total(t):
    return A.share_of_total(t.orders, ["o_orderstatus"]).withColumn("n", F.col("n").cast("double"))


_AUDIT = "SELECT d.doc_id, nullif(CASE WHEN d.doc_id % 5 = 0 THEN ' ' ELSE d.lang END, '') AS lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def _audit(t):
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("lang")).alias("lang")).join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query(f"SELECT count(*) AS total_rows, count(*) FILTER (WHERE lang IS NULL) AS missing_lang, count(*) FILTER (WHERE quality IS NULL) AS missing_quality, count(*) FILTER (WHERE toxic IS NULL) AS missing_toxic FROM ({_AUDIT})")
def q30_missing_row(t):
    return _audit(t).agg(F.count("*").alias("total_rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("lang", "quality", "toxic")])


_VARIABLES = ("doc_id", "lang", "quality", "toxic")
_LONG = " UNION ALL ".join(
    f"SELECT 'audit' AS table_name, '{v}' AS variable_name, count(*) AS total_rows, count(*) FILTER (WHERE {v} IS NULL OR trim({v}::VARCHAR) = '') AS missing_count FROM audit" for v in _VARIABLES
)
_LONG = f"WITH audit AS ({_AUDIT}), counted AS ({_LONG}) SELECT *, round(100.0 * missing_count::DOUBLE / total_rows, 2) AS missing_pct, round(100.0 * (total_rows - missing_count)::DOUBLE / total_rows, 2) AS completeness_pct FROM counted"


@query(_LONG)
def q31_completeness(t):
    return A.completeness(_audit(t), "audit")


@query(f"""SELECT table_name, count(*) AS n_variables_checked, avg(completeness_pct) AS avg_completeness_pct, quantile_cont(completeness_pct, 0.5) AS median_completeness_pct, min(completeness_pct) AS min_completeness_pct,
max(completeness_pct) AS max_completeness_pct, count(*) FILTER (WHERE completeness_pct < 50) AS n_below_50_pct, count(*) FILTER (WHERE completeness_pct = 100) AS n_full_100_pct FROM ({_LONG}) GROUP BY 1""")
def q32_table_rollup(t):
    return A.completeness_rollup(A.completeness(_audit(t), "audit"))


_FIELDS = (("documents", "text"), ("pages", "html"), ("conversations", "text"))


@query(" UNION ALL ".join(
    f"""SELECT '{t}.{c}' AS field_name, count(*) AS total_rows, count(*) FILTER (WHERE trim({c}) <> '') AS non_empty_rows, avg(length({c})) FILTER (WHERE trim({c}) <> '') AS avg_length,
    round(100.0 * (count(*) FILTER (WHERE trim({c}) <> ''))::DOUBLE / count(*), 2) AS non_empty_pct FROM {t}""" for t, c in _FIELDS
))
def q33_text_audit(t):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [A.text_audit(getattr(t, n), n, [c]) for n, c in _FIELDS])


@query("""SELECT c_custkey, CASE count(DISTINCT o_orderpriority) WHEN 0 THEN 'Missing' WHEN 1 THEN min(o_orderpriority) ELSE 'Multiple' END AS priority FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def q34_multi_category(t):
    open_orders = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return t.customer.select("c_custkey").join(open_orders, "c_custkey", "left").groupBy("c_custkey").agg(A.one_or_category(F.col("o_orderpriority")).alias("priority"))


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d <= 30 THEN '0-30' WHEN d <= 365 THEN '31-365' WHEN d <= 1460 THEN '1-4y' ELSE '4y+' END AS bucket FROM (SELECT date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS d FROM orders GROUP BY o_custkey)) GROUP BY 1""")
def q35_date_span(t):
    spans = t.orders.groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("d"))
    return A.histogram(spans, E.bucket(F.col("d"), [(30, "0-30"), (365, "31-365"), (1460, "1-4y")], "4y+"), F.col("d"))


@query("SELECT event_type, count(*) FILTER (WHERE (event_id & 1) = 1) AS odd, count(*) FILTER (WHERE (event_id & 1) = 0) AS even, count(*) FILTER (WHERE (event_id & 6) = 6) AS both_bits FROM events GROUP BY 1")
def q51_bitwise(t):
    bit = lambda n: F.col("event_id").bitwiseAND(n)
    return t.events.groupBy("event_type").agg(F.count_if(bit(1) == 1).alias("odd"), F.count_if(bit(1) == 0).alias("even"), F.count_if(bit(6) == 6).alias("both_bits"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END AS label, count(*) AS n FROM orders GROUP BY 1")
def q52_case_recode_map(t):
    return t.orders.groupBy(E.recode(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "partial").alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT bucket, count(*) AS n FROM (SELECT p_partkey, count(x.a) AS k, CASE WHEN k = 0 THEN 'never' WHEN k <= 50 THEN '1-50' WHEN k <= 100 THEN '51-100' ELSE '100+' END AS bucket FROM part LEFT JOIN (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey) x ON x.a = p_partkey GROUP BY 1) GROUP BY 1""")
def q66_degree_concentration(t):
    held = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct()  # a part counts once an order
    a, b = held, held.withColumnRenamed("p_partkey", "b")
    degree = a.join(b, "l_orderkey").where("p_partkey <> b").select("p_partkey", "b").distinct().groupBy("p_partkey").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return A.histogram(t.part.select("p_partkey").join(degree, "p_partkey", "left"), E.bucket(k, [(0, "never"), (50, "1-50"), (100, "51-100")], "100+"), k)


@query("SELECT c_mktsegment, coalesce(o_orderpriority, 'Missing') AS priority, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def q67_cross_tab(t):
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_mktsegment", E.clean_category(F.col("o_orderpriority")).alias("priority")).agg(F.count("*").alias("n"))


_Z = 1.959963984540054


@query(f"""SELECT lang, n, k, (p + {_Z * _Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n) AS low, (p + {_Z * _Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n) AS high
FROM (SELECT lang, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE quality = 1))::DOUBLE AS k, k / n AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1)""")
def q68_wilson(t):
    n = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("quality") == 1).cast("double").alias("k"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return n.select("lang", "n", "k", low.alias("low"), high.alias("high"))


@query("""SELECT sum(p * w) / sum(w) AS weighted, sum(k)::DOUBLE / sum(n)::DOUBLE AS pooled FROM (SELECT d.lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k, k::DOUBLE / n AS p, any_value(w) AS w FROM labels JOIN documents d USING (doc_id) JOIN (SELECT lang, count(*)::DOUBLE AS w FROM documents GROUP BY 1) s ON s.lang = d.lang GROUP BY 1)""")
def q68b_weighted_precision(t):
    weights = t.documents.groupBy("lang").agg(F.count("*").cast("double").alias("w"))
    n = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    return n.join(weights, "lang").agg(A.weighted_mean(F.col("k") / F.col("n"), F.col("w")).alias("weighted"), (F.sum("k") / F.sum("n")).alias("pooled"))


@query("""SELECT max(abs(a - b)) AS ks FROM (SELECT sum(n1) OVER (ORDER BY v) / sum(n1) OVER () AS a, sum(n2) OVER (ORDER BY v) / sum(n2) OVER () AS b FROM (SELECT l_quantity AS v, (count(*) FILTER (WHERE l_returnflag = 'R'))::DOUBLE AS n1, (count(*) FILTER (WHERE l_returnflag = 'A'))::DOUBLE AS n2 FROM lineitem GROUP BY 1))""")
def q68c_ks(t):
    return A.ks_statistic(t.lineitem.where("l_returnflag = 'R'").select("l_quantity"), t.lineitem.where("l_returnflag = 'A'").select("l_quantity"), "l_quantity")


@query("""SELECT count(*) AS n_groups, count(*) FILTER (WHERE s > 1) AS n_conflicting, max(s) AS most FROM (SELECT l_orderkey, l_partkey, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY ALL)""")
def q69_consistency_audit(t):
    return t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.countDistinct("l_suppkey").alias("s")).agg(F.count("*").alias("n_groups"), F.count_if(F.col("s") > 1).alias("n_conflicting"), F.max("s").alias("most"))


@query("""SELECT unnest(['ship_before_order', 'negative_price', 'bad_status']) AS check_name, unnest([count(*) FILTER (WHERE l_shipdate < o_orderdate), count(*) FILTER (WHERE l_extendedprice < 0), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P'))]) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q70_impossible_states(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.violations(rows, {"ship_before_order": F.col("l_shipdate") < F.col("o_orderdate"), "negative_price": F.col("l_extendedprice") < 0, "bad_status": ~F.col("o_orderstatus").isin("F", "O", "P")})


@query("""SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders""")
def q75_release_vector(t):
    return quality.count_vector(t.orders, {"n_rows": F.count("*"), "n_customers": F.countDistinct("o_custkey"), "n_finished": F.count_if(F.col("o_orderstatus") == "F"), "last_day": F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")})
