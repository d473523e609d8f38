"""Queries about joins, matching and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.exprs import days_apart, final_token
from quarry.operators import aggregates as A
from quarry.operators import linkage, quality
from quarry.operators import relational as R
from quarry.plans.registry import query

NATIONS = (1, 2, 3, 5, 8, 13, 21)


@query(f"""SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders,
  count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_nationkey IN {NATIONS} GROUP BY ALL""")
def q01_corpus_flagship(t):
    chosen = t.nation.where(F.col("n_nationkey").isin(*NATIONS))
    base = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(chosen, F.col("c_nationkey") == F.col("n_nationkey"))
    return base.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n_lines"), F.countDistinct("o_orderkey").alias("n_orders"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"),
    )


@query("""SELECT p_partkey, p_name, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'low' WHEN p_type = 'LARGE' THEN 'bulk' ELSE 'other' END AS category
FROM part WHERE p_name ILIKE '%RING%' AND p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')""")
def q02_excluded_universe(t):
    kind = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "low").when(F.col("p_type") == "LARGE", "bulk").otherwise("other")
    return t.part.where(F.col("p_name").ilike("%RING%") & ~F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select("p_partkey", "p_name", kind.alias("category"))


@query("""SELECT 'lineitem' AS child, count(*) AS n_orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'customer', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)
UNION ALL SELECT 'orders_without_lines', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)""")
def q05_fk_orphans(t):
    parts = {
        "lineitem": quality.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey"), "orders": quality.orphans(t.orders, "o_custkey", t.customer, "c_custkey"),
        "customer": quality.orphans(t.customer, "c_nationkey", t.nation, "n_nationkey"), "orders_without_lines": quality.orphans(t.orders, "o_orderkey", t.lineitem, "l_orderkey"),
    }
    return A.table_counts(parts).select(F.col("table_name").alias("child"), F.col("row_count").alias("n_orphans"))


@query("SELECT count(*) AS n, count(l.doc_id) AS n_joined, count(*) - count(l.doc_id) AS n_missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def q07_join_coverage(t):
    return R.join_coverage(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 'active' ELSE 'not_active' END AS status FROM customer")
def q08_exists_flag(t):
    open_orders = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return R.exists_flag(t.customer.select("c_custkey"), open_orders, ["c_custkey"], "open").select("c_custkey", F.when(F.col("open"), "active").otherwise("not_active").alias("status"))


@query("""SELECT p_brand, s_nationkey, count(*) AS n FROM (SELECT DISTINCT p_partkey, p_brand, s_suppkey, s_nationkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R') x
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = x.p_partkey AND l.l_suppkey = x.s_suppkey AND l.l_returnflag = 'A') GROUP BY ALL""")
def q09_not_exists_multi(t):
    pair = [F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")]
    returned = t.lineitem.where("l_returnflag = 'R'").select(*pair).distinct()
    kept = returned.join(t.lineitem.where("l_returnflag = 'A'").select(*pair).distinct(), ["p_partkey", "s_suppkey"], "left_anti")
    return kept.join(t.part, "p_partkey").join(t.supplier, "s_suppkey").groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"))


_SEGMENTS = (("segment", "BUILDING", "construction"), ("segment", "MACHINERY", "industry"), ("segment", "AUTOMOBILE", "industry"), ("status", "O", "open"))


@query(f"""SELECT coalesce(x.domain, 'unmapped') AS domain, count(*) AS n FROM customer LEFT JOIN (VALUES {", ".join(map(str, _SEGMENTS))}) x(kind, value, domain)
ON x.kind = 'segment' AND x.value = c_mktsegment GROUP BY 1""")
def q10_left_const_on(t):
    codes = t.spark.createDataFrame(_SEGMENTS, "kind string, c_mktsegment string, domain string").where("kind = 'segment'")
    return t.customer.join(codes, "c_mktsegment", "left").groupBy(F.coalesce("domain", F.lit("unmapped")).alias("domain")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand, count(*) AS n_pairs, count(DISTINCT a.p_partkey) AS n_left FROM part a JOIN (SELECT DISTINCT p_brand AS b, string_split(p_name, ' ')[-1] AS token, p_name AS whole FROM part) r
ON a.p_brand = r.b AND (a.p_name = r.whole OR string_split(a.p_name, ' ')[-1] = r.whole OR string_split(a.p_name, ' ')[-1] = r.token) GROUP BY 1""")
def q11_or_join(t):
    right = t.part.select(F.col("p_brand").alias("b"), F.col("p_name").alias("whole"), final_token(F.col("p_name")).alias("token")).distinct()
    keyed = right.withColumn("k", F.explode(F.array_distinct(F.array(F.concat(F.lit("w:"), "whole"), F.concat(F.lit("t:"), "token")))))
    keys = [F.concat(F.lit("w:"), "p_name"), F.concat(F.lit("w:"), final_token(F.col("p_name"))), F.concat(F.lit("t:"), final_token(F.col("p_name")))]
    pairs = R.or_join(t.part, keyed, keys, F.col("k"), F.col("p_brand") == F.col("b")).select("p_brand", "p_partkey", "whole", "token").distinct()
    return pairs.groupBy("p_brand").agg(F.count("*").alias("n_pairs"), F.countDistinct("p_partkey").alias("n_left"))


@query("""WITH c AS (SELECT a.p_partkey, b.p_partkey AS other, b.p_type AS value,
  CASE WHEN a.p_name = b.p_name AND a.p_brand = b.p_brand THEN 1 WHEN a.p_brand = b.p_brand THEN 2 WHEN a.p_name = b.p_name THEN 3 ELSE 4 END AS tier
  FROM part a JOIN part b ON string_split(a.p_name, ' ')[-1] = string_split(b.p_name, ' ')[-1] AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey),
best AS (SELECT p_partkey, min(tier) AS tier FROM c GROUP BY 1)
SELECT p_partkey, tier, count(DISTINCT other) AS n_members, count(DISTINCT value) AS n_values, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS agreed,
  string_agg(DISTINCT CAST(other AS VARCHAR), '|' ORDER BY CAST(other AS VARCHAR)) AS members
FROM c JOIN best USING (p_partkey, tier) GROUP BY ALL""")
def q12_tier_ladder(t):
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_type", final_token(F.col("p_name")).alias("k"))
    within = ["k", "p_size"]
    return R.tier_groups(rows, "p_partkey", [[*within, "p_name", "p_brand"], [*within, "p_brand"], [*within, "p_name"], within], "p_type")


@query("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND p.ts = m.mts) AS prior_click
FROM events e LEFT JOIN LATERAL (SELECT max(c.ts) AS mts FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts < e.ts) m ON true WHERE e.event_type = 'purchase'""")
def q13_asof_join(t):
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = t.events.where("event_type = 'click'").select(F.col("event_id").alias("click"), "user_id", F.col("ts").alias("at"))
    return R.asof_join(bought, clicks, "user_id", "ts", "at", ["click"], span=F.to_date).select("event_id", F.col("asof_click").alias("prior_click"))


@query("""SELECT o_orderkey, n AS n_candidates, CAST(gap AS INTEGER) AS gap, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN gap IS NULL THEN 'no_match' WHEN gap = 0 THEN 'exact' WHEN gap <= 7 THEN 'near_7' WHEN gap <= 30 THEN 'within_30' ELSE 'over_30' END AS tier
FROM (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS gap, count(l_orderkey) OVER (PARTITION BY o_orderkey) AS n,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY gap NULLS LAST, l_linenumber, l_partkey, l_suppkey) AS r FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey) WHERE r = 1""")
def q14_nearest_date(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    best = R.nearest_join(t.orders.select("o_orderkey", "o_orderdate"), lines, ["o_orderkey"], ["o_orderkey"], days_apart(F.col("o_orderdate"), F.col("l_shipdate")), ["l_linenumber", "l_partkey", "l_suppkey"], [])
    g = F.col("gap")
    return best.withColumn("tier", F.when(g.isNull(), "no_match").when(g == 0, "exact").when(g <= 7, "near_7").when(g <= 30, "within_30").otherwise("over_30"))


@query("""SELECT a.o_custkey, count(*) AS n_pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 30 GROUP BY 1""")
def q15_within_30d(t):
    a = t.orders.select("o_custkey", F.col("o_orderkey").alias("k1"), F.col("o_orderdate").alias("d1"))
    b = t.orders.select("o_custkey", F.col("o_orderkey").alias("k2"), F.col("o_orderdate").alias("d2"))
    return R.within_days(a, b, "o_custkey", "d1", "d2", 30).where("k1 < k2").groupBy("o_custkey").agg(F.count("*").alias("n_pairs"))


@query("""SELECT o_orderkey, m.l_partkey, m.l_extendedprice FROM orders, LATERAL (SELECT l_partkey, l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_extendedprice DESC, l_partkey LIMIT 1) m""")
def q16_lateral_top1(t):
    top = F.max(F.struct("l_extendedprice", (-F.col("l_partkey")).alias("k"))).alias("m")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(top)
    return lines.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", (-F.col("m.k")).alias("l_partkey"), F.col("m.l_extendedprice").alias("l_extendedprice"))


@query("SELECT (SELECT count(*) FROM customer) AS n_customers, (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) / (SELECT count(*)::DOUBLE FROM orders) AS ratio")
def q17_cross_scalars(t):
    both = t.customer.agg(F.count("*").alias("n_customers")).crossJoin(t.orders.agg(F.count("*").alias("n_orders")))  # one row each
    return both.withColumn("ratio", F.col("n_customers") / F.col("n_orders"))


@query("""SELECT n_name, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT o_orderkey) AS n_orders
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def q18_fanout_distinct(t):
    base = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    return base.groupBy("n_name").agg(F.count("*").alias("n_rows"), F.countDistinct("c_custkey").alias("n_customers"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("""SELECT 'real' AS key, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND year(l_shipdate) = year(o_orderdate))
UNION ALL SELECT 'shifted_year', count(*) FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND year(l_shipdate) = year(o_orderdate) + 3)
UNION ALL SELECT 'rotated_key', count(*) FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey + 1 AND year(l_shipdate) = year(o_orderdate))""")
def q19_negative_control(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("k"), F.year("l_shipdate").alias("y")).distinct()
    keys = {"real": (F.col("o_orderkey"), F.year("o_orderdate")), "shifted_year": (F.col("o_orderkey"), F.year("o_orderdate") + 3), "rotated_key": (F.col("o_orderkey") + 1, F.year("o_orderdate"))}
    hits = {n: t.orders.select(k.alias("k"), y.alias("y")).join(lines, ["k", "y"], "left_semi") for n, (k, y) in keys.items()}
    return A.table_counts(hits).select(F.col("table_name").alias("key"), F.col("row_count").alias("n"))


@query("SELECT o_orderkey, (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem WHERE l_orderkey = o_orderkey) AS last_ship FROM orders")
def q20_scalar_correlated(t):
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("d"))
    return t.orders.select("o_orderkey").join(last, "o_orderkey", "left").select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("last_ship"))


@query("""SELECT n_name, n_orders, avg_price FROM (SELECT n_nationkey, n_name, count(*) AS n_orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY n_orders DESC, n_name LIMIT 5) top
JOIN (SELECT c_nationkey, avg(o_totalprice) AS avg_price FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) p ON c_nationkey = n_nationkey""")
def q43_topk_joinback(t):
    base = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    by = base.groupBy("c_nationkey").agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"))
    return by.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).orderBy(F.desc("n_orders"), "n_name").limit(5).select("n_name", "n_orders", "avg_price")


_SUPP, _CUST = "SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal > 5000", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9500"


def _sides(t):
    return t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey")), t.customer.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("nationkey"))


@query(f"SELECT 'supplier' AS side, nationkey FROM ({_SUPP}) UNION ALL SELECT 'customer', nationkey FROM ({_CUST})")
def q46_union_all(t):
    s, c = _sides(t)
    return s.select(F.lit("supplier").alias("side"), "nationkey").unionByName(c.select(F.lit("customer").alias("side"), "nationkey"))


@query(f"{_CUST} EXCEPT {_SUPP}")
def q47_except(t):
    s, c = _sides(t)
    return c.subtract(s)


@query(f"{_CUST} EXCEPT ALL {_SUPP}")
def q48_except_all(t):
    s, c = _sides(t)
    return c.exceptAll(s)


@query(f"SELECT DISTINCT nationkey FROM ({_CUST})")
def q49_distinct(t):
    return _sides(t)[1].distinct()


@query(f"({_CUST}) INTERSECT ({_SUPP})")
def q49b_intersect(t):
    s, c = _sides(t)
    return c.intersect(s)


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE a.c_acctbal IS DISTINCT FROM CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE a.c_acctbal END) AS diff_c_acctbal,
count(*) FILTER (WHERE a.c_mktsegment IS DISTINCT FROM CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE a.c_mktsegment END) AS diff_c_mktsegment FROM customer a""")
def q50_null_safe_diff(t):
    changed = t.customer.withColumns({"c_acctbal": F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_custkey") % 11 == 0, "X").otherwise(F.col("c_mktsegment"))})
    return quality.column_differences(t.customer, changed, "c_custkey", ["c_acctbal", "c_mktsegment"])


@query("""SELECT event_type, domain, source, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'browse' WHEN event_type IN ('purchase', 'signup') THEN 'convert' ELSE 'other' END AS kind,
CASE WHEN kind = 'convert' AND value >= 50 THEN 'large' ELSE kind END AS domain, CASE WHEN kind = 'browse' THEN 'props' WHEN kind = 'convert' THEN 'value' END AS source FROM events) GROUP BY ALL""")
def q61_router_domain(t):
    kinds = t.spark.createDataFrame([("click", "browse", "props"), ("view", "browse", "props"), ("purchase", "convert", "value"), ("signup", "convert", "value")], "event_type string, kind string, source string")
    routed = t.events.join(kinds, "event_type", "left").withColumn("kind", F.coalesce("kind", F.lit("other")))
    return routed.groupBy("event_type", F.when((F.col("kind") == "convert") & (F.col("value") >= 50), "large").otherwise(F.col("kind")).alias("domain"), "source").agg(F.count("*").alias("n"))


@query("""SELECT valid, count(*) AS n FROM (SELECT d.key IS NULL OR l.doc_id IS NOT NULL AS valid FROM (SELECT CASE WHEN doc_id % 9 <> 0 THEN doc_id END AS key FROM documents) d LEFT JOIN labels l ON l.doc_id = d.key) GROUP BY 1""")
def q73_split_valid_rejected(t):
    rows = t.documents.select(F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")).alias("key"))
    return R.valid_reference(rows, "key", t.labels, "doc_id").groupBy("valid").agg(F.count("*").alias("n"))


@query("""SELECT channel, resolved, count(*) AS n FROM (SELECT coalesce(a, b, c) AS resolved, CASE WHEN a IS NOT NULL THEN 'label' WHEN b IS NOT NULL THEN 'source' WHEN c IS NOT NULL THEN 'length' ELSE 'unresolved' END AS channel FROM (
SELECT CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS a, CASE WHEN d.source IN ('src1', 'src2', 'src3') THEN 'good' END AS b, CASE WHEN d.n_chars < 500 THEN 'poor' END AS c FROM documents d LEFT JOIN labels l USING (doc_id))) GROUP BY ALL""")
def q74_final_cascade(t):
    rows = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left")
    steps = [("label", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")), ("source", F.when(F.col("source").isin("src1", "src2", "src3"), "good")), ("length", F.when(F.col("n_chars") < 500, "poor"))]
    return linkage.cascade(rows, steps).groupBy("channel", "resolved").agg(F.count("*").alias("n"))
