"""Record linkage: name pools, tier ladders with consensus, docket keys, nearest dates, as-of affiliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import days_apart, docket_key, final_token, norm_author, norm_space, recode
from quarry.operators.relational import best_tier, consensus, nearest_join

# Position types that count as a seat on the bench, and the tiers of the name ladder.
POSITION_TYPES = ("jud", "ret-senior-jud", "c-jus")
TIERS = ("exact_same_court", "suffix_same_court", "exact_any_court", "suffix_any_court")


def judge_pool(persons: DataFrame, positions: DataFrame, service: DataFrame, court_map: DataFrame, supplement: DataFrame, courts: list[str]) -> DataFrame:
    """(judge_id, name_last, name_norm, gender, court_id) of registry persons, of service records whose judge the registry does
    not already place at the same court, and of a supplement."""
    seats = positions.where(F.col("position_type").isin(*POSITION_TYPES) & F.col("court_id").isin(*courts)).select("person_id", "court_id").distinct()
    registry = persons.where(F.col("gender").isin("m", "f")).join(seats, persons["id"] == seats["person_id"])
    first = registry.select(F.col("id").cast("string").alias("judge_id"), "fjc_id", "name_last", "gender", "court_id")
    mapped = service.join(court_map, "court_name").where(F.col("court_id").isin(*courts))
    covered = first.where("fjc_id IS NOT NULL").select(F.col("fjc_id").alias("jid"), "court_id").distinct()
    second = mapped.join(covered, ["jid", "court_id"], "left_anti").select(F.col("jid").cast("string").alias("judge_id"), F.col("last_name").alias("name_last"), "gender", "court_id")
    third = supplement.select(F.concat(F.lit("sup_"), F.col("sup_id")).alias("judge_id"), "name_last", "gender", "court_id")
    pool = first.drop("fjc_id").unionByName(second).unionByName(third).distinct()
    return pool.withColumn("name_norm", norm_space(F.col("name_last")))


def name_ladder(cases: DataFrame, pool: DataFrame) -> DataFrame:
    """Cases (case_id, court_id, author) with the consensus of their best tier of candidates.

    A candidate's surname equals the whole normalised author or its last word; both are keys of one hash join.
    """
    named = cases.withColumn("author_norm", norm_author(F.col("author"))).where("author_norm != ''").withColumn("last_token", final_token(F.col("author_norm")))
    keyed = named.withColumn("_key", F.explode(F.array_distinct(F.array("author_norm", "last_token"))))
    found = keyed.join(pool.select(F.col("name_norm").alias("_key"), "judge_id", "gender", F.col("court_id").alias("judge_court")), "_key")
    exact, here = F.col("_key") == F.col("author_norm"), F.col("judge_court") == F.col("court_id")
    tier = F.when(exact & here, 1).when(here, 2).when(exact, 3).otherwise(4)
    candidates = best_tier(found.withColumn("tier", tier), ["case_id"], "tier")
    agreed = consensus(candidates, ["case_id", "tier"], "gender", "judge_id")
    label = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier"))
    out = cases.join(agreed, "case_id", "left")
    return out.select(
        *cases.columns, "tier", F.when(F.col("tier").isNotNull(), label).alias("match_type"), F.col("agreed").alias("gender"),
        F.coalesce("n_members", F.lit(0)).alias("n_judges"), F.coalesce("n_values", F.lit(0)).alias("n_genders"), F.col("members").alias("judges"), gender_source().alias("gender_source"), quality_of(gender_source())[0].alias("quality_tier"),
    )


# By tier, the source codes for one judge, several of one gender, and several genders; then quality tier and
# label of the codes.
SOURCES = {
    1: ("author_str_fjc_unique_judge", "author_str_fjc_multiple_judges_same_gender", "ambiguous_multiple_genders"),
    2: ("author_str_fjc_suffix_unique_gender", "author_str_fjc_suffix_unique_gender", "ambiguous_suffix_multiple_genders"),
    3: ("author_str_any_court_unique_judge", "author_str_any_court_unique_gender", "ambiguous_multiple_genders"),
    4: ("author_str_any_court_suffix_unique_judge", "author_str_any_court_suffix_unique_gender", "ambiguous_suffix_multiple_genders"),
}
NO_MATCH = "no_fjc_match"
QUALITY = {
    "author_id": (1, "structured_author_id"),
    "author_str_fjc_unique_judge": (2, "exact_author_str_unique_judge"),
    "author_str_fjc_suffix_unique_gender": (3, "suffix_author_str_unique_gender"),
    "author_str_fjc_multiple_judges_same_gender": (4, "exact_author_str_multiple_judges_same_gender"),
    "author_str_any_court_unique_judge": (5, "any_court_author_str_unique_judge"),
    "author_str_any_court_suffix_unique_judge": (5, "any_court_author_str_unique_judge"),
    "author_str_any_court_unique_gender": (6, "any_court_author_str_unique_gender"),
    "author_str_any_court_suffix_unique_gender": (6, "any_court_author_str_unique_gender"),
    "ambiguous_multiple_genders": (8, "ambiguous_multiple_genders"),
    "ambiguous_suffix_multiple_genders": (8, "ambiguous_suffix_multiple_genders"),
    "no_fjc_match": (9, "no_fjc_match"),
    "no_author_id_or_author_str": (10, "no_author_information"),
}


def gender_source() -> Column:
    """The published source code, from tier, n_members and n_values."""
    one, alone, t = F.col("n_values") == 1, F.col("n_members") == 1, F.col("tier")
    out = F.when(t.isNull(), NO_MATCH)
    for k, (single, several, ambiguous) in SOURCES.items():
        out = out.when(t == k, F.when(~one, ambiguous).when(alone, single).otherwise(several))
    return out


def quality_of(source: Column) -> tuple[Column, Column]:
    """Quality tier and label of a source code; 99 and unknown for others."""
    tier = recode(source, {k: str(n) for k, (n, _) in QUALITY.items()}, "99").cast("int")
    return tier, recode(source, {k: label for k, (_, label) in QUALITY.items()}, "unknown")


def match_dockets(opinions: DataFrame, appeals: DataFrame) -> DataFrame:
    """Opinions (opinion_id, court_id, docket_number, opinion_date) with the appeal (appeal_id, court_id, docket, judgment_date) of
    the same court and docket key that is nearest in time, and the tier of the match."""
    key, rule = docket_key(F.col("docket_number"))
    keyed = opinions.withColumn("docket_key", key).withColumn("parse_rule", rule)
    right = appeals.select("court_id", F.lpad("docket", 7, "0").alias("docket_key"), "appeal_id", "judgment_date", F.coalesce("judgment_date", F.lit("9999-12-31").cast("date")).alias("_d"))
    gap = F.when(F.col("appeal_id").isNotNull(), F.coalesce(days_apart(F.col("opinion_date"), F.col("judgment_date")), F.lit(1 << 30)))
    best = nearest_join(keyed, right, ["court_id", "docket_key"], ["opinion_id"], gap, ["appeal_id"], ["judgment_date"]).withColumn("gap", F.when(F.col("gap") < (1 << 30), F.col("gap")))
    out = keyed.join(best, "opinion_id", "left")
    g = F.col("gap")
    tier = (
        F.when(F.col("parse_rule") == "unparseable", "not_parseable").when(F.col("appeal_id").isNull(), "no_fjc_match").when(g.isNull(), "matched_no_date")
        .when(g == 0, "exact_date").when(g <= 7, "near_date_7").when(g <= 30, "within_30").otherwise("over_30_review")
    )
    return out.withColumn("match_tier", tier).withColumn("match_eligible", F.coalesce(g <= 7, F.lit(False))).withColumn("was_ambiguous", F.coalesce(F.col("n_candidates") > 1, F.lit(False)))


# Letters of recorded parties.
PARTIES = {
    "d": "Democratic", "r": "Republican", "i": "Independent", "g": "Green", "l": "Libertarian", "f": "Federalist", "w": "Whig", "j": "Jeffersonian Republican", "u": "National Union", "z": "Reform Party",
}


def affiliation_as_of(cases: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Cases (case_id, person_id, filed) with the latest affiliation (id, person_id, political_party, date_start, date_end) in force
    when filed, ties by the largest id; a person's only record counts where no dated one does.  Beside it the latest record whatever the day."""
    a = affiliations.select("person_id", F.col("id").alias("_id"), "political_party", "date_start", "date_end")
    dated = cases.join(a.where("date_start IS NOT NULL"), "person_id").where((F.col("date_start") <= F.col("filed")) & (F.col("date_end").isNull() | (F.col("date_end") >= F.col("filed"))))
    held = dated.groupBy("case_id").agg(F.max(F.struct("date_start", "_id", "political_party", "date_end")).alias("h"))
    latest = F.max(F.struct(F.col("date_start").isNotNull().alias("dated"), "date_start", "_id", "political_party")).alias("l")
    single = a.groupBy("person_id").agg(F.count("*").alias("n_records"), F.min("political_party").alias("_only"), latest)
    out = cases.join(held, "case_id", "left").join(single, "person_id", "left")
    only = F.when(F.col("n_records") == 1, F.col("_only"))
    code = F.coalesce("h.political_party", only)
    how = (
        F.when(F.col("h.political_party").isNotNull(), "in_force_at_filing").when(only.isNotNull(), "single_undated_record").when(F.col("person_id").isNull(), "no_person")
        .when(F.col("n_records").isNull(), "no_affiliation_recorded").when(F.col("filed").isNull(), "no_filing_date").otherwise("filing_outside_recorded_periods")
    )
    return out.select(
        *cases.columns, code.alias("party_code"), recode(code, PARTIES).alias("party"), how.alias("resolution"), "n_records", F.col("h.date_start").alias("period_start"), F.col("h.date_end").alias("period_end"),
        F.col("l.political_party").alias("latest_code"),
    )


def party_convenience(appointing: Column, registered: Column) -> tuple[Column, Column]:
    """The appointing president's party where there is one, else the judge's own; and which of the two it is."""
    none = appointing.isNull() | appointing.startswith("None")
    return F.coalesce(F.when(~none & (appointing != ""), appointing), registered), F.when(~none, "appointing_president").when(registered.isNotNull(), "registered_affiliation")


def cascade(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """`resolved` from the first step with a value, and `channel`, its name."""
    out = None
    for name, value in steps:
        out = F.when(value.isNotNull(), name) if out is None else out.when(value.isNotNull(), name)
    return df.withColumn("resolved", F.coalesce(*[v for _, v in steps])).withColumn("channel", out.otherwise("unresolved"))
