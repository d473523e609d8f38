"""Descriptive statistics of courts, opinions, citations and judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import bucket, clean_category, decade, in_days, is_blank, nullif_blank, percent, recode
from quarry.operators.aggregates import one_or_category


def distribution(df: DataFrame, column: str, missing: str = "Missing") -> DataFrame:
    return df.groupBy(clean_category(F.col(column).cast("string"), missing).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def by_year(df: DataFrame, date: str, also: list[str] | None = None) -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year"), *(also or [])).agg(F.count("*").alias("n")).orderBy("year")


# Buckets of incoming citations, and the years counted.
CITATION_BUCKETS, MANY_CITATIONS, CITATION_YEARS = [(0, "0 (never cited)"), (5, "1-5"), (20, "6-20"), (100, "21-100")], "100+", (1950, 2010)


def citation_buckets(clusters: DataFrame, opinions: DataFrame, edges: DataFrame) -> DataFrame:
    """Clusters by the number of citations that their opinions receive, zero included."""
    received = edges.groupBy(F.col("cited_opinion_id").alias("opinion_id")).agg(F.count("*").alias("_k"))
    own = opinions.select("opinion_id", "cluster_id").join(received, "opinion_id").groupBy("cluster_id").agg(F.sum("_k").alias("k"))
    rows = clusters.where(F.year("date_filed").between(*CITATION_YEARS)).select("cluster_id").join(own, "cluster_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return rows.groupBy(bucket(F.col("k"), CITATION_BUCKETS, MANY_CITATIONS).alias("bucket")).agg(F.count("*").alias("n_clusters"), F.min("k").alias("_o")).orderBy("_o").drop("_o")


def out_degree(edges: DataFrame) -> DataFrame:
    n = edges.groupBy("citing_opinion_id").agg(F.count("*").alias("outdegree"))
    return n.agg(F.min("outdegree").alias("min_outdegree"), F.max("outdegree").alias("max_outdegree"), F.avg("outdegree").cast("decimal(12,2)").alias("avg_outdegree"))


# Labels of genders and parties.
GENDERS, PARTIES = {"m": "Male", "f": "Female"}, {"d": "Democratic", "r": "Republican"}


def gender_label(gender: Column, other: str = "Other") -> Column:
    return F.when(is_blank(gender), "Missing").otherwise(recode(F.lower(F.trim(gender)), GENDERS, other))


def is_active(positions: DataFrame) -> DataFrame:
    """Persons with a position that neither ended nor was retired from."""
    return positions.where("person_id IS NOT NULL AND date_termination IS NULL AND date_retirement IS NULL").select("person_id").distinct()


def party_of(affiliations: DataFrame) -> DataFrame:
    """One label a person: of the only party, or Missing, Multiple, Other."""
    known = affiliations.where("person_id IS NOT NULL").groupBy("person_id").agg(one_or_category(nullif_blank(F.col("political_party"))).alias("p"))
    return known.select("person_id", F.when(F.col("p").isin("Missing", "Multiple"), F.col("p")).otherwise(recode(F.col("p"), PARTIES, "Other")).alias("party"))


def active_roster(persons: DataFrame, positions: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Active judges by gender and party."""
    genders = persons.select(F.col("id").alias("person_id"), gender_label(F.col("gender")).alias("gender"))
    rows = is_active(positions).join(genders, "person_id", "left").join(party_of(affiliations), "person_id", "left")
    missing = lambda x: F.coalesce(x, F.lit("Missing")).alias(x)
    return rows.groupBy(missing("gender"), missing("party")).agg(F.count("*").alias("n_active_judges"))


def female_share(roster: DataFrame) -> DataFrame:
    g = roster.groupBy("party").agg(F.sum("n_active_judges").alias("total"), F.sum(F.when(F.col("gender") == "Female", F.col("n_active_judges")).otherwise(0)).alias("female"))
    return g.withColumn("female_share_pct", percent(F.col("female"), F.col("total")))


def appointments_by_decade(persons: DataFrame, positions: DataFrame, first: int = 1920, last: int = 2025) -> DataFrame:
    """Distinct persons by gender and decade of a position's start; a person counts once a decade, unknown ones as Missing."""
    rows = positions.where(in_days(F.col("date_start"), f"{first}-01-01", f"{last + 1}-01-01")).join(persons.select(F.col("id").alias("person_id"), "gender"), "person_id", "left")
    return rows.groupBy(F.coalesce(gender_label(F.col("gender"), "Missing"), F.lit("Missing")).alias("gender"), decade(F.col("date_start")).alias("decade")).agg(F.countDistinct("person_id").alias("n"))


def appointments_by_party(positions: DataFrame, affiliations: DataFrame, first: int = 1900, last: int = 2024) -> DataFrame:
    """Distinct persons by year of a position's start and party, of the two large parties."""
    parties = party_of(affiliations).where(F.col("party").isin(*PARTIES.values()))
    rows = positions.where(in_days(F.col("date_start"), f"{first}-01-01", f"{last + 1}-01-01")).join(parties, "person_id")
    return rows.groupBy(F.year("date_start").alias("year"), "party").agg(F.countDistinct("person_id").alias("n_appointments"))


# Court categories by jurisdiction; one court is told by its id.
_FEDERAL, _SPECIAL, _STATE, _REST = "U.S. Supreme Court/Federal Appeals", "Federal District/Bankruptcy/Special", "State Supreme/Appellate", "State Trial/Other"
TIERS = {"F": _FEDERAL, "FD": _SPECIAL, "FB": _SPECIAL, "FBP": _SPECIAL, "FS": _SPECIAL, "S": _STATE, "SA": _STATE}
#: Years of the two yearly exports (fixed values), and letters of sources in a cluster's merged source code.
EXPORT_YEARS = (1950, 2026)
SOURCES = {"n_court_website": "C", "n_harvard": "U", "n_recap": "G", "n_other_archives": "[ZLRMADQS]"}


def court_tier(court_id: Column, jurisdiction: Column) -> Column:
    return F.when(court_id == "scotus", _FEDERAL).otherwise(recode(jurisdiction, TIERS, _REST))


def clusters_by_tier(clusters: DataFrame, dockets: DataFrame, courts: DataFrame) -> DataFrame:
    """Clusters by year and court category."""
    where = dockets.select(F.col("id").alias("docket_id"), "court_id").join(courts.select(F.col("id").alias("court_id"), court_tier(F.col("id"), F.col("jurisdiction")).alias("court_category")), "court_id")
    rows = clusters.where(F.year("date_filed").between(*EXPORT_YEARS)).select("docket_id", F.year("date_filed").alias("year")).join(where, "docket_id")
    return rows.groupBy("court_category", "year").agg(F.count("*").alias("n"))


def provenance_by_year(clusters: DataFrame) -> DataFrame:
    """Clusters by year and where they come from; a merged record counts for each of its sources."""
    rows = clusters.where(F.year("date_filed").between(*EXPORT_YEARS))
    return rows.groupBy(F.year("date_filed").alias("year")).agg(F.count("*").alias("n_total"), *(F.count_if(F.col("source").rlike(p)).alias(n) for n, p in SOURCES.items()))


def source_split(clusters: DataFrame, dockets: DataFrame, courts: DataFrame, first: int = 2010, last: int = 2025) -> DataFrame:
    """Clusters of the supreme court and the appellate courts by year: all, and with the docket's lowest source bit off and on."""
    federal = courts.where((F.col("id") == "scotus") | (F.col("jurisdiction") == "F")).select(F.col("id").alias("court_id"))
    bits = dockets.join(federal, "court_id").select(F.col("id").alias("docket_id"), F.col("source").bitwiseAND(1).alias("bit"))
    rows = clusters.where(F.year("date_filed").between(first, last)).select("docket_id", F.year("date_filed").alias("year")).join(bits, "docket_id")
    return rows.groupBy("year").agg(F.count("*").alias("n_total"), F.count_if(F.col("bit") == 0).alias("n_stays"), F.count_if(F.col("bit") == 1).alias("n_moves"))


def top_judges(links: DataFrame, persons: DataFrame, affiliations: DataFrame, n: int = 25) -> DataFrame:
    """The persons with most links (person_id), ties by id, with name and party."""
    top = links.where("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person_id").limit(n)
    name = F.concat_ws(" ", *(nullif_blank(F.col(x)) for x in ("name_first", "name_middle", "name_last", "name_suffix") if x in persons.columns))
    return top.join(persons.select(F.col("id").alias("person_id"), name.alias("full_name")), "person_id").join(party_of(affiliations), "person_id", "left").withColumn("party", F.coalesce("party", F.lit("Missing")))


def top_both(authored: DataFrame, panels: DataFrame, n: int = 25) -> DataFrame:
    """Persons by authored opinions and panel seats together (0 where they have none of one kind), most of both first, ties by id."""
    count = lambda df, name: df.where("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias(name))
    both = count(authored, "n_authored").join(count(panels, "n_panels"), "person_id", "full").na.fill(0, ["n_authored", "n_panels"])
    return both.withColumn("n_total", F.col("n_authored") + F.col("n_panels")).orderBy(F.desc("n_total"), "person_id").limit(n)


def career_cross_tab(positions: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Party by position type; a person with several of either counts for each pair."""
    rows = positions.select("person_id", "position_type").join(affiliations.select("person_id", "political_party"), "person_id", "left")
    return rows.groupBy(clean_category(F.col("political_party")).alias("party"), clean_category(F.col("position_type")).alias("position_type")).agg(F.count("*").alias("n"))


def panel_sizes(panel: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """How many clusters have panels of each size; with clusters also by their status."""
    sizes = panel.groupBy("opinioncluster_id").agg(F.count("*").alias("panel_size"))
    if clusters is None:
        return sizes.groupBy("panel_size").agg(F.count("*").alias("cluster_frequency"))
    status = clusters.select(F.col("cluster_id").alias("opinioncluster_id"), clean_category(F.col("precedential_status")).alias("status"))
    return sizes.join(status, "opinioncluster_id").groupBy("status").agg(F.count("*").alias("n_clusters"), F.avg("panel_size").alias("avg_panel_size"))


def _conflicting(attributed: DataFrame, persons: DataFrame) -> DataFrame:
    known = persons.select(F.col("id").alias("author_id"), F.col("gender").alias("link_gender"), F.col("name_last").alias("link_last"))
    rows = attributed.where(~is_blank(F.col("author_str"))).join(known, "author_id")
    norm = F.lower(F.regexp_replace(F.regexp_replace("author_str", r"[^A-Za-z\s-]", ""), r"\s+", " "))
    return rows.withColumn("str_norm", norm).withColumn("conflict", ~F.col("str_norm").contains(F.lower("link_last")))


def author_conflicts(attributed: DataFrame, persons: DataFrame) -> DataFrame:
    """Opinions with a linked person and a recorded name: how many, and in how many the name does not hold the surname."""
    rows = _conflicting(attributed, persons)
    return rows.agg(F.count("*").alias("n_both"), F.count_if("conflict").alias("n_conflicts")).withColumn("pct_conflict", percent(F.col("n_conflicts"), F.col("n_both"), 1))


def conflict_pairs(attributed: DataFrame, persons: DataFrame, n: int = 20) -> DataFrame:
    """The recorded names and linked surnames that disagree most often, ties by name."""
    return _conflicting(attributed, persons).where("conflict").groupBy("author_str", "link_last").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author_str", "link_last").limit(n)


def conflict_genders(attributed: DataFrame, persons: DataFrame, positions: DataFrame) -> DataFrame:
    """Of conflicting opinions (opinion_id, court_id) whose recorded name is a judge of that court: whether the gender would differ."""
    named = persons.where("gender IS NOT NULL").select(F.col("id").alias("person_id"), F.lower("name_last").alias("str_norm"), F.col("gender").alias("_g"))
    seats = positions.select("person_id", "court_id").join(named, "person_id").select("court_id", "str_norm", "_g").distinct()
    rows = _conflicting(attributed, persons).where("conflict").join(seats, ["court_id", "str_norm"]).groupBy("opinion_id", "link_gender").agg(F.count("_g").alias("k"), F.min("_g").alias("g"))
    one = F.col("k") == 1
    return rows.agg(F.count("*").alias("n_named"), F.count_if(one & (F.col("g") == F.col("link_gender"))).alias("same_gender"), F.count_if(one & (F.col("g") != F.col("link_gender"))).alias("different_gender"), F.count_if(F.col("k") > 1).alias("ambiguous"))
