"""Queries that go through files and stages: delimited text, raw scans, dumps, copies, splits; and the stages around them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import exprs as E
from quarry.operators import corpus as C
from quarry.operators import linkage as L
from quarry.operators import resolution as RS
from quarry.operators import stats as ST
from quarry.plans import miniatures as M
from quarry.plans.registry import query
from quarry.sources import tables as S


def _place(t) -> str:
    """A folder of this run that driver and executors share; a temporary one on a local master."""
    conf = t.spark.sparkContext.getConf()
    shared = t.spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not shared and not t.spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(shared or f'file://{tempfile.gettempdir()}/quarry-io').rstrip('/')}/io-{uuid.uuid4().hex}"
    atexit.register(S.remove, t.spark, path)
    return path


_HARD = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN '' WHEN p_partkey % 7 = 2 THEN p_name || chr(10) || 'x, "y"' ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN p_size END AS p_size FROM part"""


def _hard(t):
    k = F.col("p_partkey") % 7
    name = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, F.concat("p_name", F.lit('\nx, "y"'))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", name.alias("p_name"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"))


@query(_HARD)
def q140_csv_round_trip(t):
    """Nulls, empty and quoted fields with line ends survive a delimited file."""
    path = _place(t)
    rows = _hard(t)
    S.write_csv(rows, path, order=["p_partkey"])
    return S.read_csv(t.spark, path, rows.schema)


@query("SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS keys, count(*) FILTER (WHERE c_nationkey < 5) AS low FROM customer GROUP BY 1")
def q141_raw_text_scan(t):
    """A headerless file read as text alone; types come afterwards."""
    path = _place(t)
    S.write_csv(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), path, header=False, compression="gzip")
    raw = S.read_csv(t.spark, path, S.all_text(["a", "b", "c"]), header=False, multi_line=False)
    return raw.groupBy(F.col("b").alias("c_mktsegment")).agg(F.count("*").alias("n"), F.sum(F.col("a").cast("long")).alias("keys"), F.count_if(F.col("c").cast("int") < 5).alias("low"))


@query("SELECT count(*) AS n_rows, true AS same_bytes, true AS has_parts FROM orders")
def q142_ordered_dump(t):
    """Two dumps of the same rows in other partitions have the same manifest."""
    rows, path = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), _place(t)
    one, two = S.dump(rows, f"{path}/a", ["o_orderkey"]), S.dump(rows.repartition(7), f"{path}/b", ["o_orderkey"])
    return t.spark.createDataFrame([(one["rows"], one["sha256"] == two["sha256"] and one["bytes"] == two["bytes"], len(one["sha256"]) > 0)], "n_rows long, same_bytes boolean, has_parts boolean")


@query("SELECT 'accepted' AS part, count(*) FILTER (WHERE o_totalprice > 100000) AS n, coalesce(sum(o_orderkey) FILTER (WHERE o_totalprice > 100000), 0)::BIGINT AS keys FROM orders UNION ALL SELECT 'rejected', count(*) FILTER (WHERE NOT coalesce(o_totalprice > 100000, false)), coalesce(sum(o_orderkey) FILTER (WHERE NOT coalesce(o_totalprice > 100000, false)), 0)::BIGINT FROM orders")
def q143_copy_and_split(t):
    """A table copied once (a second copy finds as many rows and does nothing), then split in two."""
    path = _place(t)
    n = S.copy_table(t.orders, f"{path}/copy")
    assert S.copy_table(t.orders, f"{path}/copy") == n
    S.split_rows(t.spark.read.parquet(f"{path}/copy"), F.col("o_totalprice") > 100000, f"{path}/yes", f"{path}/no")
    told = lambda name, part: t.spark.read.parquet(f"{path}/{part}").agg(F.count("*").alias("n"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("keys")).select(F.lit(name).alias("part"), "n", "keys")
    return told("accepted", "yes").unionByName(told("rejected", "no"))


@query("SELECT n_name AS name, n_regionkey::BIGINT AS region, NULL::VARCHAR AS note, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def q144_staged_join(t):
    """Two stages, each written and read again, in the columns of a schema that one of them lacks a column of."""
    stages = S.Stages(t.spark, _place(t))
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("region", T.LongType()), T.StructField("note", T.StringType())])
    stages.run("regions", lambda st: t.region)
    out = stages.run("nations", lambda st: S.with_columns_of(t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), schema).join(st["regions"], F.col("region") == F.col("r_regionkey")))
    return out.select("name", "region", "note", "r_name")


@query(f"WITH {M.ctes(M.COURTS)} SELECT id, short_name FROM courts WHERE id IN ('ca1', 'cadc')")
def q145_select_courts(t):
    return C.select_courts(M.COURTS.df(t.spark), ("ca1", "cadc")).select("id", "short_name")


_RAW = M.Mini("raw_opinions", "id int, cluster_id int, plain_text string, html_with_citations string, xml_harvard string, per_curiam boolean", [
    (1, 2, "text", None, "<AUTHOR>X</AUTHOR>", None), (2, 3, "  ", "<p>y</p>", None, False), (3, 5, None, " ", None, True), (4, 9, "z", "<p>w</p>", None, None), (5, 8, "q", "<p>r</p>", "<x/>", None), (6, 4, "q", "<p>r</p>", "<author/>", None), (7, 99, "q", None, None, None),
    (8, 9, "", "<p>v</p>", None, False),
])
_RESOLVED = M.Mini("resolved", "opinion_id int, gender_resolved boolean", [(4, True), (1, False)])
_CORPUS_SQL = f"""{M.ctes(_RAW, M.CLUSTERS, M.CASE_DOCKETS, M.COURTS, _RESOLVED)}, corpus AS (SELECT o.id AS opinion_id, o.*, c.date_filed, c.precedential_status, year(c.date_filed)::INTEGER AS year_filed, k.id AS court_id, k.short_name AS court_short_name
  FROM raw_opinions o JOIN clusters c ON c.cluster_id = o.cluster_id JOIN case_dockets d ON d.id = c.docket_id JOIN courts k ON k.id = d.court_id WHERE k.id IN ('ca1', 'cadc', 'scotus', 'nysd'))"""


def _corpus(t):
    courts = C.select_courts(M.COURTS.df(t.spark), ("ca1", "cadc", "nysd", "scotus"))
    clusters = M.CLUSTERS.df(t.spark).select(F.col("cluster_id").alias("id"), "docket_id", "date_filed", F.lit("A v. B").alias("case_name"), "precedential_status", F.lit(0).alias("citation_count"))
    dockets = M.CASE_DOCKETS.df(t.spark).select("id", "court_id", F.lit("15-1").alias("docket_number"))
    return C.build_corpus(_RAW.df(t.spark), clusters, dockets, courts)


@query(f"""WITH {_CORPUS_SQL} SELECT opinion_id, court_id, court_short_name, year_filed, coalesce(trim(plain_text) <> '', false) AS has_plain_text, length(plain_text)::INTEGER AS plain_text_length,
coalesce(trim(html_with_citations) <> '', false) AS has_html_with_citations, length(html_with_citations)::INTEGER AS html_with_citations_length FROM corpus""")
def q146_corpus(t):
    return C.without_text(_corpus(t)).select("opinion_id", "court_id", "court_short_name", "year_filed", "has_plain_text", "plain_text_length", "has_html_with_citations", "html_with_citations_length")


@query(f"""WITH {_CORPUS_SQL} SELECT opinion_id FROM corpus WHERE opinion_id NOT IN (SELECT opinion_id FROM resolved WHERE gender_resolved) AND precedential_status = 'Published' AND NOT coalesce(per_curiam, false)
AND (coalesce(lower(xml_harvard) LIKE '%<author%', false) OR (year_filed >= 1960 AND coalesce(trim(html_with_citations), '') <> ''))""")
def q147_need_text(t):
    return C.need_text_extraction(_corpus(t), _RESOLVED.df(t.spark)).select("opinion_id")


_BIO2 = M.Mini("bio_appeals", "jid int, last_name string, gender string, court_name string", [(11, "Kearse", "f", "Second Circuit"), (30, "Hand", "m", "Second Circuit"), (12, "Fletcher", "f", "First Circuit"), (99, "Far", "m", "Elsewhere")])
_EXTRA = M.Mini("extra_judges", "sup_id int, name_last string, gender string, court_id string", [(1, "St. Eve", "f", "ca7")])


@query(f"""WITH {M.ctes(M.PERSONS, M.POSITIONS, _BIO2, M.COURT_MAP, _EXTRA)}, seats AS (SELECT DISTINCT id, fjc_id, name_last, gender, court_id FROM persons JOIN positions ON person_id = id WHERE gender IN ('m', 'f') AND position_type IN ('jud', 'ret-senior-jud', 'c-jus') AND court_id LIKE 'ca%')
SELECT judge_id, name_last, gender, court_id, lower(trim(replace(name_last, '.', ' '))) AS raw FROM (SELECT id::VARCHAR AS judge_id, name_last, gender, court_id FROM seats UNION SELECT jid::VARCHAR, last_name, b.gender, m.court_id FROM bio_appeals b JOIN court_map m ON fjc_court_name = court_name
WHERE NOT EXISTS (SELECT 1 FROM seats s WHERE s.fjc_id = jid AND s.court_id = m.court_id) UNION SELECT 'sup_' || sup_id, name_last, gender, court_id FROM extra_judges)""")
def q148_judge_pool(t):
    courts = M.COURT_MAP.df(t.spark).withColumnRenamed("fjc_court_name", "court_name")
    pool = L.judge_pool(M.PERSONS.df(t.spark), M.POSITIONS.df(t.spark), _BIO2.df(t.spark), courts, _EXTRA.df(t.spark), list(C.COURTS))
    return pool.select("judge_id", "name_last", "gender", "court_id", F.lower(F.trim(F.replace("name_last", F.lit("."), F.lit(" ")))).alias("raw"))


_STEPS = M.Mini("steps", "id int, step int, n_judges int, judges string", [(1, 1, 5, "1"), (2, 2, 1, "sup_1"), (3, 2, 2, "7|8"), (4, 3, 1, "110"), (5, 4, 1, "99999"), (6, 3, None, None), (7, 1, 0, None), (8, 2, 1, "5")])


@query(f"""WITH {M.ctes(_STEPS, M.PERSONS, M.BIO)}, u AS (SELECT *, step = 1 OR coalesce(n_judges = 1, false) AS person_unique, CASE WHEN person_unique THEN string_split(judges, '|')[1] END AS judge_id FROM steps)
SELECT u.id, person_unique, judge_id, CASE WHEN judge_id LIKE 'sup\\_%' ESCAPE '\\' THEN 'supplemental' WHEN try_cast(judge_id AS INTEGER) IN (SELECT id FROM persons) THEN 'person' WHEN try_cast(judge_id AS INTEGER) IN (SELECT nid FROM bio) THEN 'service_record' ELSE 'unmapped' END AS registry FROM u""")
def q149_person_registry(t):
    unique = RS.person_unique(_STEPS.df(t.spark))
    return RS.person_registry(F.col("judge_id"), M.PERSONS.df(t.spark), M.BIO.df(t.spark), unique).select("id", "person_unique", "judge_id", "registry")


_CASES = M.Mini("party_cases", "case_id int, person_key int, court_id string, filed date", [(1, 7, "ca1", M._D(1990, 1, 1)), (2, 7, "ca2", M._D(1990, 1, 1)), (3, 9, "ca1", M._D(1990, 1, 1)), (4, 7, "ca1", M._D(1970, 1, 1)), (5, 8, "ca1", M._D(2000, 1, 1))])
_SERVED = M.Mini("served", "person_key int, court_id string, commission_date date, termination_date date, party string", [
    (7, "ca1", M._D(1980, 1, 1), None, "D"), (7, "dist", M._D(1995, 1, 1), None, "R"), (8, "ca1", M._D(1990, 1, 1), M._D(1995, 1, 1), "R"), (8, "ca1", M._D(1996, 1, 1), M._D(2001, 1, 1), "D"), (8, "ca1", M._D(1997, 1, 1), None, "X"),
])


@query(f"""WITH {M.ctes(_CASES, _SERVED)}, fits AS (SELECT case_id, s.party, s.commission_date, CASE WHEN s.court_id <> c.court_id THEN 3 WHEN s.commission_date <= filed AND coalesce(s.termination_date >= filed, true) THEN 1 ELSE 2 END AS fit FROM party_cases c JOIN served s USING (person_key)),
best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY fit, commission_date DESC) = 1) SELECT case_id, party, fit FROM party_cases LEFT JOIN best USING (case_id)""")
def q150_appointing_party(t):
    return RS.appointing_party(_CASES.df(t.spark), _SERVED.df(t.spark)).select("case_id", "party", "fit")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k, (count(*) FILTER (WHERE quality = 1))::DOUBLE / count(*)::DOUBLE AS precision FROM labels JOIN documents USING (doc_id) WHERE quality IN (0, 1) GROUP BY ROLLUP (lang)""")
def q151_precision(t):
    judged = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("verdict", F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "wrong"))
    return RS.precision(judged, "lang").select("lang", "n", "k", "precision")


@query("""SELECT year, open, done, coalesce(round(100.0 * open / nullif(open + done, 0), 2), 0)::DOUBLE AS open_pct FROM (SELECT year(o_orderdate)::INTEGER AS year, (count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')))::DOUBLE AS open, (count(*) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE AS done
FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1997 GROUP BY 1 UNION ALL SELECT 1998, 0, 0)""")
def q152_plot_shares(t):
    """Years filtered, statuses collapsed to two, pivoted to columns, shares of each year, and a row for a year without orders."""
    kind = E.recode(F.col("o_orderstatus"), {"O": "open", "P": "open", "F": "done"})
    rows = t.orders.where(F.year("o_orderdate").between(1993, 1997)).select(F.year("o_orderdate").alias("year"), kind.alias("kind"))
    wide = rows.groupBy("year").pivot("kind", ["open", "done"]).agg(F.count(F.lit(1)).cast("double")).na.fill(0.0)
    whole = wide.unionByName(t.spark.createDataFrame([(1998, 0.0, 0.0)], "year int, open double, done double"))
    return whole.withColumn("open_pct", F.coalesce(E.percent(F.col("open"), F.col("open") + F.col("done")), F.lit(0.0)))


@query("SELECT coalesce(nullif(trim(lang), ''), 'Missing') AS lang, count(*) AS n FROM documents GROUP BY 1")
def q153_distribution(t):
    return ST.distribution(t.documents, "lang")


@query("""WITH e AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT min(n) AS min_outdegree, max(n) AS max_outdegree, avg(n)::DECIMAL(12, 2)::DOUBLE AS avg_outdegree FROM e""")
def q154_out_degree(t):
    return ST.out_degree(t.lineitem.select(F.col("l_orderkey").alias("citing_opinion_id"))).withColumn("avg_outdegree", F.col("avg_outdegree").cast("double"))


_FILED = M.Mini("party_filed", "case_id int, person_id int, filed date", [(1, 1, M._D(1980, 1, 1)), (2, 1, M._D(1990, 1, 1)), (3, 2, M._D(1990, 1, 1)), (4, 8, M._D(2000, 1, 1)), (5, None, M._D(2000, 1, 1)), (6, 3, M._D(1995, 1, 1))])
_APPOINTED = M.Mini("appointed", "case_id int, appointing_party string", [(1, "Republican"), (2, "None (assignment)"), (3, None), (4, "None (reassignment)"), (5, "Democratic"), (6, "")])


@query(f"""WITH {M.ctes(_FILED, _APPOINTED, M.AFFILIATIONS)}, own AS (SELECT case_id, arg_max(political_party, (a.date_start, a.id)) AS code FROM party_filed f JOIN affiliations a USING (person_id) WHERE a.date_start <= filed AND coalesce(a.date_end >= filed, true) GROUP BY 1),
only_one AS (SELECT person_id, any_value(political_party) AS code FROM affiliations GROUP BY 1 HAVING count(*) = 1),
named AS (SELECT f.case_id, appointing_party, map {{'d': 'Democratic', 'r': 'Republican', 'i': 'Independent', 'w': 'Whig'}}[coalesce(own.code, only_one.code)] AS registered FROM party_filed f JOIN appointed USING (case_id) LEFT JOIN own USING (case_id) LEFT JOIN only_one ON only_one.person_id = f.person_id)
SELECT case_id, registered, coalesce(CASE WHEN appointing_party NOT LIKE 'None%' THEN nullif(appointing_party, '') END, registered) AS party, CASE WHEN appointing_party NOT LIKE 'None%' THEN 'appointing_president' WHEN registered IS NOT NULL THEN 'registered_affiliation' END AS measure FROM named""")
def q155_party_convenience(t):
    rows = L.affiliation_as_of(_FILED.df(t.spark), M.AFFILIATIONS.df(t.spark)).select("case_id", F.col("party").alias("registered")).join(_APPOINTED.df(t.spark), "case_id")
    party, measure = L.party_convenience(F.col("appointing_party"), F.col("registered"))
    return rows.select("case_id", "registered", party.alias("party"), measure.alias("measure"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(f"SELECT table_name, CAST(ordinal_position AS INTEGER) AS position, column_name FROM information_schema.columns WHERE table_name IN {_TABLES}")
def q156_data_dictionary(t):
    rows = S.data_dictionary({name: getattr(t, name) for name in _TABLES})
    return t.spark.createDataFrame([r[:3] for r in rows], "table_name string, position int, column_name string")
