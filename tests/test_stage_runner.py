"""Stages, published views, constraints and lookups."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import presentation as P
from quarry.operators import quality as Q
from quarry.operators import relational as R
from quarry.operators import windows as W
from quarry.plans import catalogue
from quarry.sources import tables as S

SF = "/root/testdata/sf0.001"


def test_stage_is_replaced_when_whole(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    first = S.write_stage(spark.range(5), path)
    assert first.count() == 5
    with pytest.raises(Exception):  # noqa: B017  whatever the failing job raises
        S.write_stage(spark.range(9).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 5
    assert S.write_stage(spark.range(7), path).count() == 7
    assert S.exists(spark, path) and S.first_existing(spark, f"{path}.none", path) == path
    with pytest.raises(FileNotFoundError):
        S.first_existing(spark, f"{path}.none")


def test_named_stages_run_once(spark, tmp_path):
    runs = []

    def base(st):
        runs.append("base")
        return st.spark.range(10)

    stages = S.Stages(spark, f"file://{tmp_path}", "trial")
    even = stages.run("even", lambda st: st.run("base", base).where("id % 2 = 0"))
    stages.run("odd", lambda st: st.run("base", base).where("id % 2 = 1"))
    assert runs == ["base"] and stages.counts() == {"base": 10, "even": 5, "odd": 5} and stages["even"] is even
    assert (tmp_path / "trial" / "even").exists()
    for name in ("x; drop", "1a", "a.b", ""):
        with pytest.raises(ValueError):
            S.Stages(spark, "x", name)


def test_comments_and_lookups(spark, tmp_path):
    told = S.described(spark.range(1), {"id": "a number"})
    told.write.parquet(f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").schema["id"].metadata == {"comment": "a number"}
    seed = spark.createDataFrame([("a", 1)], "k string, v int")
    assert S.appended(seed, spark.createDataFrame([("b", 2)], "k string, v int"), "k").count() == 2
    with pytest.raises(ValueError):
        S.appended(seed, seed, "k")
    want = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("w", T.LongType())])
    assert S.schema_faults(seed, want) == [("w", "missing"), ("v", "int instead of bigint")]
    assert S.data_dictionary({"t": seed}) == [("t", 1, "k", "string"), ("t", 2, "v", "int")] and "CREATE TABLE t" in S.ddl(seed, "t")


def test_published_views(spark):
    assert len(P.VIEWS) == 18
    final = spark.createDataFrame([(1, "f"), (2, None)], "opinion_id int, gender string")
    resolved = spark.createDataFrame([(1, True, "7")], "opinion_id int, person_unique boolean, judge_id string")
    rows = P.attribution_with_persons(final, resolved).collect()
    assert {r["opinion_id"]: (r["person_unique"], r["judge_id"]) for r in rows} == {1: (True, "7"), 2: (False, None)}
    for _, (_, columns) in P.VIEWS.items():
        if columns != "*":
            old = [c.split("=")[-1] for c in columns.split()]
            new = [c.split("=")[0] for c in columns.split()]
            assert P.view(spark.createDataFrame([tuple("x" for _ in old)], old), columns).columns == new and len(set(new)) == len(new)
    with pytest.raises(Exception):  # noqa: B017
        P.view(final, "opinion_id nothing").collect()


def test_constraints_count_nulls(spark):
    t = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "id int")
    assert {r["constraint_name"]: r["n_rows"] for r in Q.constraint_faults({"t": t}, {"t": ["id"]}).collect()} == {"t_pkey": 3}
    assert {r["constraint_name"]: r["n_rows"] for r in Q.constraint_faults({"t": t.limit(0)}, {"t": ["id"]}).collect()} == {"t_pkey": 0}


def test_carried_values_cross_spans(spark):
    rows = spark.createDataFrame([(k, t, (k * 7 + t * 5) % 4) for k in range(3) for t in range(30)], "k int, t int, m int")
    got = {(r["k"], r["t"]): r["seen"] for r in W.last_so_far(rows, "k", F.floor(F.col("t") / 4), ["t"], F.when(F.col("m") == 0, F.col("t")), "seen").collect()}
    for k in range(3):
        last = None
        for t in range(30):
            last = t if (k * 7 + t * 5) % 4 == 0 else last
            assert got[k, t] == last


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_plans_of_keys_samples_and_asof(spark):
    query = catalogue.queries()
    plan = executed(query["q36_total_order_key"](spark, SF))
    assert plan.count("rangepartitioning") <= 2 and "hashpartitioning(_part" not in plan.split("rangepartitioning")[0]
    assert "ReusedExchange" in plan or plan.count("rangepartitioning") == 1
    assert "WindowGroupLimit" in executed(query["q37_md5_sample"](spark, SF))
    assert "_span" in executed(query["q13_asof_join"](spark, SF))
    assert "NestedLoop" not in executed(query["q119_disjunctive_left_join"](spark, SF))
    date = executed(query["q113_half_open_range"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in date and "LessThan(o_orderdate" in date


def test_left_or_join_keeps_repeated_rows(spark):
    left = spark.createDataFrame([("a", "a"), ("a", "a"), ("z", None), ("z", None)], "k1 string, k2 string")
    right = spark.createDataFrame([("a",)], "key string")
    out = R.or_join(left, right, [F.col("k1"), F.col("k2")], F.col("key"), how="left").select("k1", "key").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [("a", "a")] * 2 + [("z", None)] * 2))
