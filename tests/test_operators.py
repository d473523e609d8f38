"""Reference-shaped miniature cases: names, ladders, dockets, dates, affiliations, extraction, sources, checks."""

import bz2
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import exprs as E
from quarry.functions.patterns import to_java
from quarry.operators import aggregates as A
from quarry.operators import authorship as AU
from quarry.operators import linkage as L
from quarry.operators import quality as Q
from quarry.operators import relational as R
from quarry.operators import windows as W
from quarry.sources import tables as S
from quarry.streaming import events as ST


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value,want", [("Van Oosterhout", "van oosterhout"), ("St.Eve", "st eve"), ("By Judge  O'Neil, Circuit", "judge o'neil"), (None, None)])
def test_names(spark, value, want):
    assert one(spark, E.norm_author, value) == want


def test_blanks_and_matches(spark):
    assert [one(spark, E.is_blank, v) for v in (None, "", "  ", "a")] == [True, True, True, False]
    assert one(spark, lambda x: E.first_match(x, "(\\d+)"), "none") is None
    assert one(spark, lambda x: E.replace_first(x, "a", "b"), "xaxa") == "xbxa"
    assert to_java(r"\mjudge\M[[:space:]]") == r"(?s)\bjudge\b[\s]"
    assert to_java(r"a\b") == r"(?s)a\x08" and to_java(r"a\b", word_boundary_is_backspace=False) == r"(?s)a\b"


@pytest.mark.parametrize("value,want", [
    ("15-40079", ("1540079", "lead")), ("18-2952", ("1802952", "lead")), ("15-2025P", ("1502025", "lead")), ("No. 15-3313-cr; 16", ("1503313", "lead")),
    ("1163, Docket 80-1065", ("8001065", "docket_keyword")), ("Docket No. 02-7708", ("0207708", "docket_keyword")), ("none", (None, "unparseable")),
])
def test_docket_keys(spark, value, want):
    row = spark.createDataFrame([(value,)], "x string").select(*E.docket_key(F.col("x"))).first()
    assert tuple(row) == want


def test_name_ladder(spark):
    pool = spark.createDataFrame(
        [("1", "Smith", "m", "ca1"), ("2", "Van Orsdel", "m", "ca2"), ("3", "Jones", "f", "ca3"), ("4", "Jones", "m", "ca3"), ("5", "Lee", "f", "ca4"), ("6", "Lee", "f", "ca4")],
        "judge_id string, name_last string, gender string, court_id string",
    ).withColumn("name_norm", E.norm_space(F.col("name_last")))
    cases = spark.createDataFrame([(1, "ca1", "SMITH"), (2, "ca9", "Smith"), (3, "ca3", "Jones, J."), (4, "ca4", "Lee"), (5, "ca1", "Nobody"), (6, "ca1", "John Smith"), (7, "ca2", "Van Orsdel")], "case_id int, court_id string, author string")
    got = {r["case_id"]: (r["match_type"], r["gender"], r["n_judges"], r["quality_tier"]) for r in L.name_ladder(cases, pool).collect()}
    assert got == {
        1: ("exact_same_court", "m", 1, 2), 2: ("exact_any_court", "m", 1, 5), 3: ("exact_same_court", None, 2, 8), 4: ("exact_same_court", "f", 2, 4),
        5: (None, None, 0, 9), 6: ("suffix_same_court", "m", 1, 3), 7: ("exact_same_court", "m", 1, 2),
    }


def test_judge_pool(spark):
    persons = spark.createDataFrame([(1, 11, "Smith", "m"), (2, None, "Gray", None)], "id int, fjc_id int, name_last string, gender string")
    positions = spark.createDataFrame([(1, "jud", "ca1"), (2, "jud", "ca1")], "person_id int, position_type string, court_id string")
    service = spark.createDataFrame([(11, "Smith", "m", "First"), (12, "Hall", "f", "First")], "jid int, last_name string, gender string, court_name string")
    courts = spark.createDataFrame([("First", "ca1")], "court_name string, court_id string")
    extra = spark.createDataFrame([(1, "Extra", "f", "ca1")], "sup_id int, name_last string, gender string, court_id string")
    assert {r["judge_id"] for r in L.judge_pool(persons, positions, service, courts, extra, ["ca1"]).collect()} == {"1", "12", "sup_1"}


def test_nearest_dockets(spark):
    day = dt.date(2000, 1, 10)
    opinions = spark.createDataFrame([(i, "ca1", n, day) for i, n in enumerate(["15-1", "15-2", "15-3", "15-4", "15-5", "bad", "15-7"])], "opinion_id int, court_id string, docket_number string, opinion_date date")
    later = lambda n: day + dt.timedelta(n)
    appeals = spark.createDataFrame(
        [(1, "ca1", "1500001", later(0)), (2, "ca1", "1500001", later(0)), (3, "ca1", "1500002", later(7)), (4, "ca1", "1500003", later(-8)), (5, "ca1", "1500004", later(31)), (6, "ca1", "1500005", None)],
        "appeal_id long, court_id string, docket string, judgment_date date",
    )
    got = {r["opinion_id"]: (r["appeal_id"], r["match_tier"], r["match_eligible"]) for r in L.match_dockets(opinions, appeals).collect()}
    assert got == {0: (1, "exact_date", True), 1: (3, "near_date_7", True), 2: (4, "within_30", False), 3: (5, "over_30_review", False), 4: (6, "matched_no_date", False), 5: (None, "not_parseable", False), 6: (None, "no_fjc_match", False)}


def test_affiliation_as_of(spark):
    d = dt.date
    cases = spark.createDataFrame([(1, 1, d(1959, 1, 1)), (2, 1, d(1970, 1, 1)), (3, 2, d(1970, 1, 1)), (4, 3, d(1970, 1, 1)), (5, None, d(1970, 1, 1)), (6, 1, d(1950, 1, 1))], "case_id int, person_id int, filed date")
    rows = [(1, 1, "r", d(1954, 1, 1), d(1964, 1, 1)), (2, 1, "d", d(1964, 1, 1), None), (3, 2, "i", None, None)]
    got = {r["case_id"]: (r["party_code"] and r["party_code"].upper(), r["resolution"]) for r in L.affiliation_as_of(cases, spark.createDataFrame(rows, "id int, person_id int, political_party string, date_start date, date_end date")).collect()}
    assert got == {1: ("R", "in_force_at_filing"), 2: ("D", "in_force_at_filing"), 3: ("I", "single_undated_record"), 4: (None, "no_affiliation_recorded"), 5: (None, "no_person"), 6: (None, "filing_outside_recorded_periods")}


def test_asof_against_brute_force(spark):
    left = spark.createDataFrame([(i, i % 3, i * 7 % 20) for i in range(40)], "id int, k int, t int")
    right = spark.createDataFrame([(i, i % 4, i * 5 % 20) for i in range(40)], "v int, k int, t int")
    for strict, span in ((True, None), (False, None), (True, lambda t: F.floor(t / 3)), (False, lambda t: F.floor(t / 3))):
        got = {r["id"]: r["asof_v"] for r in R.asof_join(left, right, "k", "t", "t", ["v"], strict, span).collect()}
        for i in range(40):
            ok = [(j * 5 % 20, j) for j in range(40) if j % 4 == i % 3 and (j * 5 % 20 < i * 7 % 20 or not strict and j * 5 % 20 == i * 7 % 20)]
            assert got[i] == (max(ok)[1] if ok else None)


def test_disjunctive_left_join(spark):
    left = spark.createDataFrame([(1, "a", "b"), (2, "a", "z"), (3, "x", None), (4, None, None), (5, "b", "b")], "id int, k1 string, k2 string")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("b", 30), (None, 40)], "key string, v int")
    want = [(i, *r) for i, k1, k2 in left.collect() for r in ([tuple(x) for x in right.collect() if x[0] is not None and x[0] in (k1, k2)] or [(None, None)])]
    key = lambda x: str(x)
    got = R.or_join(left, right, [F.col("k1"), F.col("k2")], F.col("key"), how="left").select("id", "key", "v")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    some = R.or_join(left, right, [F.col("k1"), F.col("k2")], F.col("key"), extra=F.col("v") > 10, how="left").select("id", "key", "v")
    want = [(i, *r) for i, k1, k2 in left.collect() for r in ([tuple(x) for x in right.collect() if x[0] is not None and x[0] in (k1, k2) and x[1] > 10] or [(None, None)])]
    assert sorted(((i, v) for i, _, v in map(tuple, some.collect())), key=key) == sorted(((i, v) for i, _, v in want), key=key)
    inner = R.or_join(left, right, [F.col("k1"), F.col("k2")], F.col("key")).count()
    assert inner == sum(1 for i, k, v in map(tuple, got.collect()) if v is not None)


def test_patterns_as_meant(spark):
    """compat=False reads a pattern's word ends as such."""
    base = spark.createDataFrame([(1, 1990, "<p>Judge Kearse delivered the opinion of the court</p>"), (2, 1990, "<p>UNITED STATES BOARD, Circuit Judge.</p>"), (3, 1990, "<p>GRAY Jr., Circuit Judge.</p>")], "opinion_id int, year_filed int, html_with_citations string")
    names = lambda compat: {r["opinion_id"]: (r["author_name"], r["last"]) for r in AU.html_names(base, compat=compat).collect()}
    assert names(True) == {2: ("UNITED STATES BOARD", "board"), 3: ("GRAY Jr.", "jr")}
    assert names(False) == {1: ("Kearse", "kearse"), 3: ("GRAY Jr.", "gray")}


def test_windows_and_aggregates(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 10).alias("g"))
    keyed = W.surrogate_key(rows, ["v"], "key").collect()
    assert all(r["key"] == r["v"] + 1 for r in keyed)
    assert W.stratified_sample(rows, "g", "v", 3).count() == 30
    assert W.hashed_sample(rows, "v", 5).collect() == W.hashed_sample(rows.repartition(7), "v", 5).collect()
    assert A.group_sizes(rows, "g").first().asDict() == {"min_n": 100, "max_n": 100, "avg_n": 100.0}
    long = {r["variable_name"]: r["missing_count"] for r in A.completeness(spark.createDataFrame([(1, " "), (None, "a")], "a int, b string"), "t").collect()}
    assert long == {"a": 1, "b": 1}


def test_quality(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert Q.column_differences(a, b, "k", ["v"]).first()["diff_v"] == 1
    assert not Q.same_rows(a, b) and Q.same_rows(a, a)
    Q.assert_vector(Q.count_vector(a, {"n": F.count("*")}), {"n": 2})
    with pytest.raises(Q.ReleaseError):
        Q.assert_vector(Q.count_vector(a, {"n": F.count("*")}), {"n": 3})


def test_tier_ladder(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    names, brands, types = ("a x", "b x", "x", "c y", "", None), ("B1", "B2", None), ("T1", "T2", "T3", None)
    rows = [(i % 100, names[i * 7 % 11 % 6], brands[i * 5 % 13 % 3], types[i * 3 % 7 % 4], (1, 2, None)[i % 17 % 3]) for i in range(130)]  # keys of two rows, too
    rows += [(200, "q z", "B1", "T1", 1), (201, "r z", "B2", "T1", 1), (202, "s z", None, None, 1), (200, "v w", "B1", "T9", 1), (203, "u w", "B3", "T2", 1), (200, "v w", "B1", "T8", 1), (None, "q z", "B1", "T7", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = queries()["q12_tier_ladder"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = c.execute(oracle_sql()["q12_tier_ladder"]).fetchall()
    assert {r[1] for r in want} == {1, 2, 3, 4} and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_tier_ladder_broadcasts_nothing(spark, tmp_path):
    from __spark_entry__ import queries

    spark.range(2000).selectExpr("id p_partkey", "concat('n', id % 7, ' t', id % 3) p_name", "concat('B', id % 5) p_brand", "concat('T', id % 4) p_type", "cast(id % 2 as int) p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = queries()["q12_tier_ladder"](spark, str(tmp_path))  # small files, and many times their size once the groups are exploded
    assert got.count() == 2000 and "Broadcast" not in got._jdf.queryExecution().toString()


def test_tier_groups(spark):
    tiers = [["k", "a"], ["k", "b"], ["k", "c"], ["k"]]  # no tier has all columns
    rows = [(None if i % 29 == 0 else i % 70, i * 7 % 3 if i % 8 else None, i * 5 % 11 if i % 5 else None, i * 3 % 13 if i % 7 else None, i % 9 % 6 if i % 31 else None, "vwxyz"[i * 11 % 17 % 5] if i % 6 else None) for i in range(90)] + [(500 + i, 10 + i // 5, None, i, None, "v") for i in range(12)] + [(900, 99, 1, 1, 1, "v"), (900, 99, 2, 1, 1, "w")]
    df = spark.createDataFrame(rows, "p long, k int, a int, b int, c int, v string")
    best, same = {}, lambda x, y, columns: all(x["pkabcv".index(c)] == y["pkabcv".index(c)] is not None for c in columns)
    for x in rows:
        for y in rows:
            if None not in (x[0], y[0]) and x[0] != y[0] and same(x, y, ["k"]):
                best.setdefault(x[0], {}).setdefault(next(i for i, columns in enumerate(tiers, 1) if same(x, y, columns)), []).append(y)
    want = set()
    for p, found in best.items():
        others = found[min(found)]
        members, values = {str(y[0]) for y in others}, {y[5] for y in others} - {None}
        want.add((p, min(found), len(members), len(values), min(values) if len(values) == 1 else None, "|".join(sorted(members))))
    got = R.tier_groups(df, "p", tiers, "v").collect()
    assert {r[1] for r in want} == {1, 2, 3, 4} and len(got) == len(want) and set(map(tuple, got)) == want


def test_sources(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('id,t\n1,""\n2,\n3,"two\nlines \\"q\\""\n4,"\\."\n')
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("t", T.StringType())])
    got = {r["id"]: r["t"] for r in S.read_csv(spark, str(f), schema).collect()}
    assert got[1] == "" and got[2] is None and got[3] == 'two\nlines "q"'
    assert {r["id"]: r["t"] for r in S.read_csv(spark, str(f), schema, empty_is_null=True).collect()}[1] is None
    df = spark.range(20).select("id", (F.col("id") % 3).alias("m"))
    one_, two = S.dump(df, str(tmp_path / "d1"), ["m", "id"]), S.dump(df.repartition(5), str(tmp_path / "d2"), ["m", "id"])
    assert one_["rows"] == 20 and one_["sha256"] == two["sha256"]
    S.split_rows(df, F.col("m") == 1, str(tmp_path / "ok"), str(tmp_path / "no"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() + spark.read.parquet(str(tmp_path / "no")).count() == 20
    assert S.copy_table(df, str(tmp_path / "c")) == 20 and S.copy_table(df, str(tmp_path / "c")) == 20
    assert "id bigint" in S.ddl(df, "t")
    parts = [tmp_path / "p1", tmp_path / "p2"]
    parts[0].write_bytes(b"ab")
    parts[1].write_bytes(b"cd")
    assert open(S.joined_parts(list(map(str, parts)), str(tmp_path / "whole")), "rb").read() == b"abcd"
    prior = spark.createDataFrame([(1, "yes")], "id long, v string")
    new = spark.createDataFrame([(1, None), (2, None)], "id long, v string")
    assert sorted(map(tuple, S.upsert(prior, new, "id", ["v"]).collect())) == [(1, "yes"), (2, None)]


def test_dump_does_not_depend_on_partitions(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.xxhash64("id").cast("string")).alias("v"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("z"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # more ranges than one, as in large tables
    try:
        whole, again = S.dump(rows, str(tmp_path / "w"), ["k"]), S.dump(rows.repartition(11), str(tmp_path / "v"), ["k"])
        assert whole == again
        told = [S.dump(rows.repartition(n), str(tmp_path / f"t{n}"), ["k"], part_rows=700) for n in (3, 11)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert told[0] == told[1] and told[0]["rows"] == 3000 and len(told[0]["sha256"]) == 5
    lines = lambda name: [x for f in sorted((tmp_path / name).glob("part-*")) for x in bz2.decompress(f.read_bytes()).decode().splitlines()[1:]]
    assert lines("t3") == lines("w") and len(whole["sha256"]) == 1
    assert [x.split(",")[0] for x in lines("w")] == [str(k) for k in range(7) for _ in range(429 if k < 4 else 428)]
    assert S.dump(rows.where("k > 9"), str(tmp_path / "none"))["rows"] == 0


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "events"))
    q = ST.windowed_counts(ST.read_events(spark, str(tmp_path / "events")), "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 1000
