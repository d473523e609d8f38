"""Corpus selection: courts, what was left out and why, and the joined opinion table with its text-free twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import is_blank, recode

# The appellate courts.
COURTS = ("ca1", "ca2", "ca3", "ca4", "ca5", "ca6", "ca7", "ca8", "ca9", "ca10", "ca11", "cadc", "cafc")


def select_courts(courts: DataFrame, ids: tuple[str, ...] = COURTS) -> DataFrame:
    """The listed courts; an error unless each is there once."""
    out = courts.where(F.col("id").isin(*ids))
    found = sorted(r["id"] for r in out.select("id").collect())
    if found != sorted(ids):
        raise ValueError(f"expected {len(ids)} courts, found {found}")
    return out


# Categories of courts that are left out, by jurisdiction.
EXCLUDED = {
    "SA": "state_court", "S": "state_court", "ST": "state_court", "TRA": "tribal_court", "TA": "territorial_court", "MA": "military_court",
    "FS": "specialized_federal_court", "F": "historical_or_non_target_federal_court",
}


def excluded_courts(courts: DataFrame, ids: tuple[str, ...] = COURTS) -> DataFrame:
    """Courts called a court of appeals that are not in the universe, with a category by jurisdiction."""
    named = F.col("full_name").ilike("%Court of Appeals%") & ~F.col("id").isin(*ids)
    kind = recode(F.col("jurisdiction"), EXCLUDED, "other_non_target_court")
    return courts.where(named).select("id", "short_name", "full_name", "jurisdiction", kind.alias("exclusion_category"))


def build_corpus(opinions: DataFrame, clusters: DataFrame, dockets: DataFrame, courts: DataFrame) -> DataFrame:
    """One row for each opinion of the courts, with dates, names, flags and lengths of its texts.

    The three narrow tables meet first; opinions, which carry the texts, are joined last and once.
    """
    narrow = dockets.select(F.col("id").alias("docket_id"), "court_id", "docket_number").join(courts.select(F.col("id").alias("court_id"), F.col("short_name").alias("court_short_name")), "court_id")
    cases = clusters.select(F.col("id").alias("cluster_id"), "docket_id", "date_filed", "case_name", "precedential_status", "citation_count").join(narrow, "docket_id")
    out = opinions.withColumnRenamed("id", "opinion_id").join(cases, "cluster_id").withColumn("year_filed", F.year("date_filed"))
    for c in ("plain_text", "html_with_citations"):
        out = out.withColumn(f"has_{c}", ~is_blank(F.col(c))).withColumn(f"{c}_length", F.length(c))
    return out


def without_text(corpus: DataFrame, texts: tuple[str, ...] = ("plain_text", "html_with_citations", "xml_harvard")) -> DataFrame:
    return corpus.drop(*texts)


def need_text_extraction(corpus: DataFrame, resolved: DataFrame) -> DataFrame:
    """Published opinions, not per curiam (null counts as not), that no earlier step resolved and that have an author tag or, from 1960
    on, marked-up text."""
    open_ = corpus.join(resolved.where("gender_resolved").select("opinion_id"), "opinion_id", "left_anti")
    tag = F.coalesce(F.col("xml_harvard").ilike("%<author%"), F.lit(False))
    html = (F.col("year_filed") >= 1960) & ~is_blank(F.col("html_with_citations"))
    return open_.where((F.col("precedential_status") == "Published") & ~F.coalesce("per_curiam", F.lit(False)) & (tag | F.coalesce(html, F.lit(False))))
