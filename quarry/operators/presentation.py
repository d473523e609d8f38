"""The published face of the derived tables: views with neutral names that leave internal columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# View, table behind it, and its columns; "new=old" renames, * keeps all.
VIEWS: dict[str, tuple[str, str]] = {
    "appellate_court": ("federal_appeal_courts", "court_id=id short_name full_name jurisdiction inclusion_reason"),
    "appellate_court_excluded": ("excluded_appeals_named_courts", "court_id=id short_name full_name jurisdiction exclusion_category exclusion_reason"),
    "appellate_opinion": ("federal_appeal_opinion_meta", "*"),
    "judge_biography": ("fjc_judge_bio", "judge_nid=nid jid last_name first_name middle_name suffix gender race_or_ethnicity"),
    "judge_service": (
        "fjc_judge_court",
        "service_id=id judge_nid=nid appointment_seq judge_name court_type court_name appointment_title appointing_president party_of_appointing_president commission_date termination termination_date",
    ),
    "judge_court_name_map": ("fjc_court_name_map", "court_id court_short_name court_full_name fjc_court_name mapping_note"),
    "judge_supplemental": ("supplemental_judges", "supplemental_id=sup_id name_first name_middle name_last gender court_id start_date end_date reason"),
    "opinion_author_attribution": (
        "attribution_with_persons",
        "opinion_id cluster_id docket_id court_id date_filed year_filed opinion_type precedential_status per_curiam gender gender_resolved attribution_step match_tier=gender_match_quality_tier"
        " match_tier_label=gender_match_quality_label n_candidate_judges person_unique judge_id id_registry cl_person_id fjc_nid judge_display_name",
    ),
    "opinion_author_attribution_diagnostics": (
        "author_gender_final_with_html",
        "opinion_id linked_author_id=author_id recorded_author_string=author_str assignment_channel=final_gender_assignment_channel name_stage_gender=previous_final_gender"
        " name_stage_source=previous_final_gender_source name_stage_tier=previous_final_gender_match_quality_tier name_stage_surname_norm=previous_final_author_last_name_norm"
        " name_stage_n_candidates=previous_final_n_candidate_judges name_stage_candidates=previous_final_candidate_names xml_stage_gender=xml_gender xml_stage_source=xml_gender_source"
        " xml_stage_tier=xml_gender_match_quality_tier xml_stage_author_tag=xml_clean_author_tag xml_stage_extracted_name=xml_extracted_author_name xml_stage_n_candidates=xml_n_candidate_judges"
        " xml_stage_candidates=xml_candidate_names html_stage_gender=html_gender html_stage_source=html_gender_source html_stage_tier=html_gender_match_quality_tier"
        " html_stage_source_format=html_html_type html_stage_pattern=html_extraction_pattern html_stage_extracted_name=html_extracted_author_name html_stage_n_candidates=html_n_candidate_judges"
        " html_stage_candidates=html_candidate_names",
    ),
    "opinion_author_party": (
        "author_party_timeaware",
        "opinion_id court_id date_filed year_filed judge_id cl_person_id fjc_nid appointing_president_party appointing_match_quality registered_party registered_party_code"
        " registered_party_resolution registered_n_records registered_period_start registered_period_end party_convenience party_convenience_source",
    ),
    "fjc_appellate_raw_1971to2007": ("fjc_appellate_raw_1971to2007", "*"),
    "fjc_appellate_raw_2008plus": ("fjc_appellate_raw_2008plus", "*"),
    "fjc_appellate_case": ("fjc_appellate_normalized", "*"),
    "opinion_fjc_match": ("fjc_opinion_match", "*"),
    "opinion_case_covariates": (
        "opinion_fjc_covariates",
        "opinion_id cluster_id court_id opinion_date year_filed decade match_tier date_diff_days was_ambiguous fjc_appeal_id case_class is_civil case_domain=rq2_domain appeal_type_code"
        " nature_of_suit_code offense_code agency_code jurisdiction_code outcome_code outcome_label outcome_class disposition_code disposition_label analysis_eligible",
    ),
    "crosswalk_case_domain": ("fjc_domain_crosswalk", "code_kind code_value case_domain=rq2_domain note"),
    "crosswalk_outcome": ("fjc_outcome_crosswalk", "outcome_code outcome_label outcome_class"),
    "crosswalk_disposition": ("fjc_disposition_crosswalk", "disposition_code disposition_label"),
}


def view(df: DataFrame, columns: str) -> DataFrame:
    """The columns of a view; one that the table lacks is an error."""
    if columns == "*":
        return df
    pairs = [c.split("=") if "=" in c else (c, c) for c in columns.split()]
    return df.select(*(F.col(old).alias(new) for new, old in pairs))


def attribution_with_persons(final: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row for each opinion, with the person where the match means exactly one."""
    new = [c for c in resolved.columns if c == "opinion_id" or c not in final.columns]
    return final.join(resolved.select(*new), "opinion_id", "left").withColumn("person_unique", F.coalesce("person_unique", F.lit(False)))


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The views whose tables are there."""
    have = dict(tables)
    if "author_gender_final_with_html" in have and "author_person_resolved" in have:
        have["attribution_with_persons"] = attribution_with_persons(have["author_gender_final_with_html"], have["author_person_resolved"])
    return {name: view(have[table], columns) for name, (table, columns) in VIEWS.items() if table in have}


def register(tables: dict[str, DataFrame]) -> list[str]:
    """Temporary views under the published names."""
    out = views(tables)
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return sorted(out)
