"""Stages of the court-records pipeline on miniature tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import appeals as AP
from quarry.operators import corpus as C
from quarry.operators import resolution as RS
from quarry.operators import stats as ST

DAY = dt.date(2000, 1, 1)


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_courts(spark):
    courts = spark.createDataFrame([(c, "F", "n", "US Court of Appeals") for c in C.COURTS] + [("bap1", "FB", "BAP", "Bankruptcy Appellate Panel"), ("nyapp", "SA", "N.Y. App", "New York Court of Appeals"), ("dist", "FD", "D", "District")], "id string, jurisdiction string, short_name string, full_name string")
    assert C.select_courts(courts).count() == 13
    with pytest.raises(ValueError):
        C.select_courts(courts.where("id != 'ca1'"))
    assert by(C.excluded_courts(courts), "id", "exclusion_category") == {"nyapp": ("state_court",)}


def test_corpus(spark):
    courts = spark.createDataFrame([("ca1", "First")], "id string, short_name string")
    dockets = spark.createDataFrame([(1, "ca1", "15-1"), (2, "xx", "15-2")], "id int, court_id string, docket_number string")
    clusters = spark.createDataFrame([(10, 1, DAY, "A v. B", "Published", 3), (11, 2, DAY, "C", "Published", 0)], "id int, docket_id int, date_filed date, case_name string, precedential_status string, citation_count int")
    opinions = spark.createDataFrame([(100, 10, "text", None, "<author>X</author>", None), (101, 10, "  ", "<p>y</p>", None, False), (102, 11, "z", None, None, True)], "id int, cluster_id int, plain_text string, html_with_citations string, xml_harvard string, per_curiam boolean")
    corpus = C.build_corpus(opinions, clusters, dockets, courts)
    assert by(corpus, "opinion_id", "year_filed", "has_plain_text", "plain_text_length", "has_html_with_citations", "html_with_citations_length") == {100: (2000, True, 4, False, None), 101: (2000, False, 2, True, 8)}
    assert "plain_text" not in C.without_text(corpus).columns
    resolved = spark.createDataFrame([(100, False), (101, True)], "opinion_id int, gender_resolved boolean")
    assert [r["opinion_id"] for r in C.need_text_extraction(corpus, resolved).collect()] == [100]


def test_resolution(spark):
    persons = spark.createDataFrame([(1, "f", "Gray", "Ann"), (2, None, "Hall", "Bo")], "id int, gender string, name_last string, name_first string")
    opinions = spark.createDataFrame([(1, 1, None, None), (2, 2, None, False), (3, None, "SMITH", False), (4, None, "SMITH", None), (5, None, " ", False)], "opinion_id int, author_id int, author_str string, per_curiam boolean")
    step1 = RS.by_author_id(opinions, persons)
    assert by(step1, "opinion_id", "gender_resolved") == {1: (True,), 2: (False,), 3: (False,), 4: (False,), 5: (False,)}
    assert [r["opinion_id"] for r in RS.open_for_names(opinions).collect()] == [3]
    step2 = spark.createDataFrame([(3, "m", "author_str_fjc_unique_judge"), (4, None, "no_fjc_match")], "opinion_id int, gender string, gender_source string")
    assert by(RS.combine(opinions.drop("per_curiam"), step1, step2), "opinion_id", "gender", "gender_source", "quality_tier") == {
        1: ("f", "author_id", 1), 2: (None, "author_id_not_resolved", 99), 3: ("m", "author_str_fjc_unique_judge", 2), 4: (None, "no_fjc_match", 9), 5: (None, "no_author_id_or_author_str", 10),
    }
    rows = spark.createDataFrame([(1, 1, 5, "1"), (2, 2, 1, "sup_1"), (3, 2, 2, "7|8"), (4, 3, 1, "77")], "id int, step int, n_judges int, judges string")
    unique = RS.person_unique(rows)
    assert by(unique, "id", "person_unique", "judge_id") == {1: (True, "1"), 2: (True, "sup_1"), 3: (False, None), 4: (True, "77")}
    bio = spark.createDataFrame([(77,)], "nid int")
    assert by(RS.person_registry(F.col("judge_id"), persons, bio, unique), "id", "registry") == {1: ("person",), 2: ("supplemental",), 3: ("unmapped",), 4: ("service_record",)}
    assert by(RS.unique_summary(unique), "step", "resolved", "person_unique") == {1: (1, 1), 2: (2, 1), 3: (1, 1)}


def test_appointing_party(spark):
    d = dt.date
    cases = spark.createDataFrame([(1, 7, "ca1", d(1990, 1, 1)), (2, 7, "ca2", d(1990, 1, 1)), (3, 9, "ca1", d(1990, 1, 1))], "case_id int, person_key int, court_id string, filed date")
    service = spark.createDataFrame([(7, "ca1", d(1980, 1, 1), None, "D"), (7, "dist", d(1995, 1, 1), None, "R")], "person_key int, court_id string, commission_date date, termination_date date, party string")
    assert by(RS.appointing_party(cases, service), "case_id", "party", "fit") == {1: ("D", 1), 2: ("R", 3), 3: (None, None)}


def test_precision(spark):
    rows = spark.createDataFrame([(i, i % 2 + 1) for i in range(100)], "id int, step int")
    drawn = RS.validation_sample(rows, "id", "step", {1: 20, 2: 10}, "x")
    assert by(drawn.groupBy("step").count(), "step", "count") == {1: (20,), 2: (10,)} and drawn.first()["stratum_size"] == 50
    judged = drawn.withColumn("verdict", F.when(F.col("draw_rank") <= 9, "correct").otherwise("wrong"))
    per = RS.precision(judged, "step")
    got = by(per, "step", "n", "k", "precision")
    assert got == {1: (20, 9, 0.45), 2: (10, 9, 0.9), None: (30, 18, 0.6)}
    low, high = by(per, "step", "low", "high")[1]
    assert abs(low - 0.2582) < 1e-3 and abs(high - 0.6579) < 1e-3
    assert abs(RS.weighted_precision(per, drawn.select("step", "stratum_size").distinct(), "step").first()[0] - 0.675) < 1e-9


def test_appeals(spark):
    old = spark.createDataFrame([("1", "1500001", " ", "x"), ("CIRCUIT", "DOCKET", "", ""), ("13", "1500002", "a", "y"), ("02", "1500002", "a", "y")], "circuit string, docket string, appellan string, outcome string")
    new = spark.createDataFrame([("2", "1500003", "b")], "circuit string, docket string, appellan string")
    out = AP.normalise({"1971to2007": old, "2008plus": new}, {"circuit": "circuit", "docket": "docket", "appellan": "appellant", "outcome": "outcome_code"})
    assert by(out, "fjc_appeal_id", "court_id", "appellant", "outcome_code") == {1: ("ca1", None, "x"), 2: ("ca2", "b", None)}
    assert spark.createDataFrame([("01/31/2000",), ("13/45/2000",), ("1/31/2000",), ("x",)], "x string").select(AP.raw_date(F.col("x")).alias("d")).where("d IS NOT NULL").count() == 1
    texts = spark.createDataFrame([(1, 5, DAY, "we affirm " * 400), (2, 5, DAY + dt.timedelta(29), "x"), (3, 5, DAY + dt.timedelta(31), "y"), (4, 6, DAY, "z")], "opinion_id int, docket_id int, date_filed date, plain_text string")
    near = AP.neighbourhood(texts, 5, "2000-01-01")
    assert [(r["opinion_id"], r["gap"], len(r["ending"])) for r in near.collect()] == [(1, 0, 1500), (2, 29, 1)]


def test_stats(spark):
    persons = spark.createDataFrame([(1, "f", "Ann", "Gray"), (2, "m", "Bo", "Hall"), (3, None, "Cy", "Iles")], "id int, gender string, name_first string, name_last string")
    positions = spark.createDataFrame([(1, "jud", DAY, None, None), (2, "jud", DAY, DAY, None), (3, "jud", None, None, None), (2, "pres", DAY, None, None)], "person_id int, position_type string, date_start date, date_termination date, date_retirement date")
    parties = spark.createDataFrame([(1, "d"), (2, "r"), (2, "d")], "person_id int, political_party string")
    roster = ST.active_roster(persons, positions, parties)
    assert by(roster, "gender", "party", "n_active_judges") == {"Female": ("Democratic", 1), "Missing": ("Missing", 1), "Male": ("Multiple", 1)}
    assert by(ST.female_share(roster), "party", "female_share_pct") == {"Democratic": (100.0,), "Missing": (0.0,), "Multiple": (0.0,)}
    assert by(ST.appointments_by_decade(persons, positions), "gender", "decade", "n") == {"Female": (2000, 1), "Male": (2000, 1)}
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 2)], "citing_opinion_id int, cited_opinion_id int")
    clusters = spark.createDataFrame([(1, DAY), (2, DAY), (3, dt.date(1900, 1, 1))], "cluster_id int, date_filed date")
    opinions = spark.createDataFrame([(2, 1), (3, 3)], "opinion_id int, cluster_id int")
    assert [tuple(r) for r in ST.citation_buckets(clusters, opinions, edges).collect()] == [("0 (never cited)", 1), ("1-5", 1)]
    assert ST.out_degree(edges).first()["max_outdegree"] == 2
    assert by(ST.top_judges(edges.withColumnRenamed("citing_opinion_id", "person_id"), persons, parties), "person_id", "n", "full_name", "party") == {1: (2, "Ann Gray", "Democratic")}
    assert ST.career_cross_tab(positions, parties).agg(F.sum("n")).first()[0] == 6  # two parties by two positions count four times
    assert [tuple(r) for r in ST.distribution(persons, "gender").collect()] == [("Missing", 1), ("f", 1), ("m", 1)]


def test_panels_and_faults(spark):
    panel = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2)], "opinioncluster_id int, person_id int")
    assert by(ST.panel_sizes(panel), "panel_size", "cluster_frequency") == {1: (1,), 2: (1,), 3: (1,)}
    status = spark.createDataFrame([(1, "Published"), (2, " "), (3, "Published")], "cluster_id int, precedential_status string")
    assert by(ST.panel_sizes(panel, status), "status", "n_clusters", "avg_panel_size") == {"Published": (2, 2.5), "Missing": (1, 1.0)}
    both = ST.top_both(spark.createDataFrame([(1,), (1,), (9,)], "person_id int"), panel.select("person_id"))
    assert [tuple(r)[:3] for r in both.collect()] == [(1, 2, 3), (2, 0, 2), (3, 0, 1), (9, 1, 0)]
    sample = spark.createDataFrame([(1, "correct"), (1, "wrong"), (2, None), (3, "maybe")], "id int, verdict string")
    assert tuple(RS.sample_faults(sample, "id").first()) == (1, 1, 1)
    rows = spark.createDataFrame([(i, i % 2) for i in range(20)], "id int, step int")
    texts = spark.createDataFrame([(i, "t" * 2000) for i in range(20)], "id int, text string")
    drawn = RS.validation_sample(rows, "id", "step", {0: 2, 1: 3}, "x", texts)
    assert drawn.count() == 5 and {len(r["excerpt"]) for r in drawn.collect()} == {1500}
