"""Queries about windows, order, samples and time series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import exprs as E
from quarry.operators import relational as R
from quarry.operators import windows as W
from quarry.plans.registry import query


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key FROM lineitem""")
def q36_total_order_key(t):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return W.surrogate_key(t.lineitem.select(*order), order, "key").drop("l_shipdate")


@query("""SELECT lang, doc_id, draw_rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || 'draw-1'), doc_id) AS draw_rank FROM documents)
WHERE draw_rank <= CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 10 ELSE 5 END""")
def q37_md5_sample(t):
    return W.stratified_sample(t.documents.select("lang", "doc_id"), "lang", "doc_id", {"en": 20, "de": 10}, "draw-1", otherwise=5).select("lang", "doc_id", "draw_rank")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def q37b_hashed_sample(t):
    return W.hashed_sample(t.documents.select("doc_id"), "doc_id", 25)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(n_best AS BIGINT) AS n_best, CAST(rank AS INTEGER) AS rank FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rank,
count(*) FILTER (WHERE l_quantity = best) OVER (PARTITION BY l_orderkey) AS n_best FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best FROM lineitem)) WHERE rank <= 2""")
def q38_dense_rank_ties(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return W.ties_at_best(rows, ["l_orderkey"], "l_quantity").where("rank <= 2").drop("l_quantity")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events""")
def q39_running_marker(t):
    out = W.running_marker(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.struct("ts", "event_id"), "e", F.to_date("ts"))
    return out.select("event_id", F.col("e.event_id").alias("last_error"))


@query("""SELECT month, n, CASE WHEN count(n) OVER w >= 3 THEN avg(n) OVER w END AS rolling FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)
WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def q40_rolling_mean(t):
    months = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return W.rolling_mean(months, "month", "n", 5, 3)


@query("SELECT user_id, event_type, n, n / sum(n) OVER (PARTITION BY user_id) AS share FROM (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL)")
def q41_within_group_pct(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    return W.share_within(n, ["user_id"], "n")


@query("SELECT n_name, count(*) AS n_orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY n_orders DESC, n_name LIMIT 10")
def q42_topk(t):
    base = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    return base.groupBy("n_name").agg(F.count("*").alias("n_orders")).orderBy(F.desc("n_orders"), "n_name").limit(10)


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def q44_distinct_on(t):
    return R.first_per_key(t.orders, ["o_custkey"], [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderstatus, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS INTEGER) AS place FROM orders GROUP BY 1""")
def q45_custom_order(t):
    by = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    n = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))  # three rows
    return n.withColumn("place", F.row_number().over(Window.orderBy(by)))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def q63_year_series(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).orderBy("year")


@query("SELECT CAST(year(l_shipdate) // 10 * 10 AS INTEGER) AS decade, l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY ALL")
def q64_decade(t):
    return t.lineitem.groupBy(E.decade(F.col("l_shipdate")).alias("decade"), "l_returnflag").agg(F.countDistinct("l_suppkey").alias("n_suppliers"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def q65_pivot_year_cat(t):
    from quarry.operators.aggregates import pivot_counts

    return pivot_counts(t.orders.select(F.year("o_orderdate").alias("year"), "o_orderstatus"), "year", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def q76_tumbling_window(t):
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT user_id, count(*) FILTER (WHERE new) AS n_sessions FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS new FROM events) GROUP BY 1""")
def q77_sessions(t):
    return t.events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("n_sessions"))
