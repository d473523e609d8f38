"""Case records: two raw snapshots normalised into one, docket groups, match confidence and consistency, requested ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import bucket, decade, first_match, nullif_blank, recode
from quarry.operators.windows import surrogate_key

# Circuit codes of the snapshots, and their columns in the order of the key.
CIRCUITS = {"0": "cadc", "1": "ca1", "2": "ca2", "3": "ca3", "4": "ca4", "5": "ca5", "6": "ca6", "7": "ca7", "8": "ca8", "9": "ca9", "10": "ca10", "11": "ca11"}
COLUMNS = {
    "circuit": "fjc_circuit_code", "docket": "fjc_docket_raw", "dktdate": "docket_date_raw", "judgdate": "judgment_date_raw", "reopen": "reopen_code", "appellan": "appellant", "appellee": "appellee",
    "apptype": "appeal_type_code", "agency": "agency_code", "juris": "jurisdiction_code", "nos": "nature_of_suit_code", "offense": "offense_code", "othtype": "other_type_code",
    "disp": "disposition_code", "outcome": "outcome_code", "opinion": "opinion_code", "tapeyear": "tape_year_raw",
}
#: Opinions before this day are not looked for among the records (fixed value).
FIRST_DAY = "1971-01-01"


def raw_date(x: Column) -> Column:
    """MM/DD/YYYY with all digits, or null."""
    return F.try_to_date(first_match(x, r"^([0-9]{2}/[0-9]{2}/[0-9]{4})$"), "MM/dd/yyyy")


def normalise(snapshots: dict[str, DataFrame], columns: dict[str, str] = COLUMNS) -> DataFrame:
    """Raw all-text snapshots as one table: blanks to null, header rows and other circuits out, court ids, and a key in a total
    order of all columns (nulls last).

    columns maps raw names to names of the result; a snapshot that lacks one gives null.
    """
    parts = []
    for period, df in snapshots.items():
        rows = df.where(F.upper(F.trim("circuit")) != "CIRCUIT")
        parts.append(rows.select(F.lit(period).alias("source_period"), *[(nullif_blank(F.col(raw)) if raw in df.columns else F.lit(None).cast("string")).alias(name) for raw, name in columns.items()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    code = F.col(columns["circuit"])
    kept = out.where(code.isin(*CIRCUITS)).withColumn("court_id", recode(code, CIRCUITS))
    return surrogate_key(kept, ["source_period", *columns.values()], "fjc_appeal_id")


def docket_groups(appeals: DataFrame) -> DataFrame:
    """Groups of rows with one court and padded docket: distinct appeals, dates, parties and outcomes, and a type."""
    dated = appeals.withColumns({"_filed": raw_date(F.col("docket_date_raw")), "_judged": raw_date(F.col("judgment_date_raw"))})
    g = dated.groupBy("court_id", F.lpad("fjc_docket_raw", 7, "0").alias("docket")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("fjc_appeal_id").alias("n_appeals"), F.countDistinct("_filed").alias("n_docket_dates"), F.countDistinct("_judged").alias("n_judgment_dates"),
        F.countDistinct(nullif_blank(F.col("appellant"))).alias("n_appellants"), F.countDistinct(nullif_blank(F.col("appellee"))).alias("n_appellees"), F.countDistinct("disposition_code").alias("n_dispositions"),
        F.countDistinct("outcome_code").alias("n_outcomes"), F.min("_filed").alias("first_docket_date"), F.max("_filed").alias("last_docket_date"), F.min("_judged").alias("first_judgment_date"), F.max("_judged").alias("last_judgment_date"),
    )
    kind = (
        F.when(F.col("n_appeals") == 1, "single_fjc_appeal").when((F.col("n_appeals") > 1) & (F.col("n_appellants") <= 1) & (F.col("n_appellees") <= 1), "multiple_rows_same_parties")
        .when(F.col("n_appeals") > 1, "multiple_rows_different_or_missing_parties").otherwise("unclassified")
    )
    return g.withColumn("group_type", kind)


def candidates(opinions: DataFrame, appeals: DataFrame) -> DataFrame:
    """(opinion_id, fjc_appeal_id, gap) of records with an opinion's court and docket key: opinions (opinion_id, court_id, docket_key,
    opinion_date), appeals (fjc_appeal_id, court_id, fjc_docket_raw, judgment_date_raw)."""
    right = appeals.select("court_id", F.lpad("fjc_docket_raw", 7, "0").alias("docket_key"), "fjc_appeal_id", raw_date(F.col("judgment_date_raw")).alias("_judged"))
    met = opinions.join(right, ["court_id", "docket_key"])
    return met.select("opinion_id", "fjc_appeal_id", F.abs(F.datediff("opinion_date", "_judged")).alias("gap"))


def match_confidence(opinions: DataFrame, found: DataFrame) -> DataFrame:
    """opinions with how many records they meet, the one where it is one, its distance in days, and a tier; and for several
    the one that is alone at the least distance, with how that was settled."""
    least = found.groupBy("opinion_id").agg(F.count("*").alias("n"), F.min("gap").alias("gap"), F.min("fjc_appeal_id").alias("first"))
    ties = found.join(least.select("opinion_id", F.col("gap").alias("_least")), "opinion_id").where(F.col("gap").eqNullSafe(F.col("_least")))
    ties = ties.groupBy("opinion_id").agg(F.count("*").alias("n_best"), F.min("fjc_appeal_id").alias("best"))
    out = opinions.join(least, "opinion_id", "left").join(ties, "opinion_id", "left").withColumn("n_candidates", F.coalesce("n", F.lit(0)))
    n, gap = F.col("n_candidates"), F.col("gap")
    status = F.when(F.col("docket_key").isNull(), "not_parseable").when(n == 0, "no_match").when(n == 1, "unique_match").otherwise("ambiguous_match")
    early = F.col("opinion_date") < F.lit(FIRST_DAY).cast("date")
    days = lambda names: F.when(gap == 0, names[0]).when(gap.between(1, 7), names[1]).when(gap.between(8, 30), names[2]).when(gap > 30, names[3])
    unique = F.coalesce(days(("tier_a_exact_date", "tier_b_within_7_days", "tier_c_within_30_days", "review_over_30_days")), F.lit("review_missing_date"))
    tier = F.when(early, "rejected_before_1971").when(status == "unique_match", unique).otherwise(status)
    alone = F.col("n_best") == 1
    settled = F.when(alone, days(("resolved_exact_date", "resolved_within_7_days", "resolved_within_30_days", "best_candidate_over_30_days"))).when(F.col("n_best") > 1, "tie_for_best_date")
    several = (status == "ambiguous_match") & (F.col("opinion_date") >= F.lit(FIRST_DAY).cast("date"))
    return out.select(
        *opinions.columns, "n_candidates", status.alias("match_status"), F.when(n == 1, F.col("first")).alias("fjc_appeal_id"), F.when(n == 1, gap).alias("gap"), tier.alias("confidence_tier"),
        F.when(several & alone, F.col("best")).alias("best_appeal_id"), F.when(several, gap).alias("best_gap"), F.when(several, settled).alias("resolution"),
    )


def final_match(confident: DataFrame) -> DataFrame:
    """match_confidence's rows with the selected record: a unique one, or of several the one alone at the least distance of at
    most 30 days; none before FIRST_DAY."""
    early = F.coalesce(F.col("opinion_date") < F.lit(FIRST_DAY).cast("date"), F.lit(False))
    one, several = F.col("match_status") == "unique_match", F.col("match_status") == "ambiguous_match"
    settled = F.coalesce(F.col("best_appeal_id").isNotNull() & (F.col("best_gap") <= 30), F.lit(False))
    how = (
        F.when(early, "rejected_before_1971").when(one, "selected_unique_docket").when(several & settled, "selected_unique_best_date").when(several, "unresolved_ambiguous")
        .otherwise(F.col("match_status"))
    )
    names = {"resolved_exact_date": "tier_a_exact_date", "resolved_within_7_days": "tier_b_within_7_days", "resolved_within_30_days": "tier_c_within_30_days"}
    tier = F.when(early, "rejected_before_1971").when(one, F.col("confidence_tier")).when(several & settled, F.concat(recode(F.col("resolution"), names), F.lit("_ambiguous_resolved"))).otherwise(how)
    return confident.withColumns(
        {
            "selected_appeal_id": F.when(~early, F.when(one, F.col("fjc_appeal_id")).when(several & settled, F.col("best_appeal_id"))),
            "selected_gap": F.coalesce(F.when(settled, F.col("best_gap")), F.col("gap")), "final_status": how, "final_tier": tier,
        }
    )


def consistency(matches: DataFrame, group: str) -> DataFrame:
    """By docket (or cluster, key): opinions, clusters, courts, parsed keys, selected records, matched and unmatched opinions and
    the days they span, with whether the group's opinions agree on one record."""
    g = matches.groupBy(group).agg(
        F.countDistinct("opinion_id").alias("n_opinions"), F.countDistinct("cluster_id").alias("n_clusters"), F.countDistinct("court_id").alias("n_courts"), F.countDistinct("docket_key").alias("n_keys"),
        F.countDistinct("selected_appeal_id").alias("n_selected"), F.count("selected_appeal_id").alias("n_matched"), F.count_if(F.col("selected_appeal_id").isNull()).alias("n_unmatched"),
        F.datediff(F.max("opinion_date"), F.min("opinion_date")).alias("span_days"),
    )
    status = F.when(F.col("n_selected") == 0, "no_selected_fjc_appeal").when(F.col("n_selected") == 1, "one_selected_fjc_appeal").otherwise("conflicting_multiple_fjc_appeals")
    mixed = (F.col("n_matched") > 0) & (F.col("n_unmatched") > 0)
    return g.withColumns({"mapping_status": status, "is_mixed": mixed, "size": bucket(F.col("n_opinions"), [(1, "1"), (3, "2-3"), (10, "4-10"), (25, "11-25")], "26+")})


def consistency_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("mapping_status", "size").agg(F.count("*").alias("n_groups"), F.sum("n_opinions").alias("n_opinions"), F.count_if("is_mixed").alias("n_mixed"))


def requested(ids: DataFrame, opinions: DataFrame, matches: DataFrame, courts: tuple[str, ...]) -> DataFrame:
    """One row for each requested opinion_id with what became of it."""
    rows = ids.select("opinion_id").distinct().join(opinions.select("opinion_id", "court_id"), "opinion_id", "left").join(matches.select("opinion_id", "parse_rule", "confidence", "appeal_id"), "opinion_id", "left")
    result = (
        F.when(F.col("court_id").isNull(), "not_found").when(~F.col("court_id").isin(*courts), "unsupported_court").when(F.col("parse_rule") == "unparseable", "not_parseable")
        .when(F.coalesce("confidence", F.lit("no_match")) == "no_match", "no_match").otherwise(F.col("confidence"))
    )
    return rows.withColumn("result", result)


# Case classes by appeal type, and the offenses that make a criminal appeal one of immigration.
CASE_CLASSES = {
    **dict.fromkeys(("3", "4", "7"), "civil"), **dict.fromkeys(("5", "8", "13", "14", "15", "16", "17", "18", "19", "20", "21"), "criminal"), **dict.fromkeys(("1", "2"), "administrative"),
    "6": "original_proceeding", **dict.fromkeys(("9", "10", "11", "12"), "bankruptcy"),
}
IMMIGRATION_OFFENSES = ("8710", "8720", "8730", "8740", "8750")


def covariates(matches: DataFrame, outcomes: DataFrame, dispositions: DataFrame, domains: DataFrame) -> DataFrame:
    """Matches with class, domain, outcome and disposition of their record.

    The class decides which detail field is read: offenses in criminal, the agency in administrative, the nature of suit in civil
    appeals; all other classes, and codes that the crosswalks lack, are of domain 'other' ('unmapped' labels).
    """
    kind = recode(F.col("appeal_type_code"), CASE_CLASSES, "other")
    rows = matches.where(~F.col("match_tier").isin("not_parseable", "no_fjc_match")).withColumns({"case_class": kind, "year_filed": F.year("opinion_date"), "decade": decade(F.col("opinion_date"))})
    field = F.when(F.col("case_class") == "civil", F.struct(F.lit("nature_of_suit").alias("k"), F.col("nature_of_suit_code").alias("v"))).when(F.col("case_class") == "administrative", F.struct(F.lit("agency").alias("k"), F.col("agency_code").alias("v")))
    codes = domains.select(F.struct(F.col("code_kind").alias("k"), F.col("code_value").alias("v")).alias("_field"), F.col("rq2_domain").alias("_domain"))
    out = rows.withColumn("_field", field).join(codes, "_field", "left").join(outcomes, "outcome_code", "left").join(dispositions, "disposition_code", "left")
    criminal = F.when(F.col("offense_code").isin(*IMMIGRATION_OFFENSES), "immigration").otherwise("criminal")
    return out.withColumns(
        {
            "rq2_domain": F.when(F.col("case_class") == "criminal", criminal).otherwise(F.coalesce("_domain", F.lit("other"))), "is_civil": F.col("case_class") == "civil",
            "outcome_label": F.coalesce("outcome_label", F.lit("unmapped")), "outcome_class": F.coalesce("outcome_class", F.lit("other")), "disposition_label": F.coalesce("disposition_label", F.lit("unmapped")),
        }
    ).drop("_field", "_domain")


def neighbourhood(opinions: DataFrame, docket_id: int, day: str, days: int = 30, last: int = 1500) -> DataFrame:
    """Opinions of a docket within some days of a date, nearest first, with the text's ending."""
    gap = F.abs(F.datediff("date_filed", F.lit(day)))
    near = opinions.where((F.col("docket_id") == docket_id) & F.col("date_filed").between(F.date_sub(F.lit(day), days), F.date_add(F.lit(day), days)))
    return near.select("opinion_id", "date_filed", gap.alias("gap"), F.right("plain_text", F.lit(last)).alias("ending")).orderBy("gap", "opinion_id")
