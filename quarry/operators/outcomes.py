"""Outcomes that the endings of opinions state, in two versions, held against coded outcomes.

A detector is a table of phrases (flags over the ending), an order of outcomes, and an order of checks against the code; all are
expressions of one row.  Word ends are written as the Java dialect has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import recode

_THING = r"(judgment|order|decision|conviction|sentence)"
_ASKED = r"(petition|application|motion)"
_COURT = r"(district court|agency|board|bia|lower court)"
_REVIEW = r"\b(petition for review|petition|application)\b"
_COA = r"\b(certificate of appealability|coa)\b"
_IS = r"\b(is|are|be)\b"
_STOP = r"\b\s*[.!]?(\s*[0-9]+)?\s*$"

# Flags of the first version, over the last 8,000 characters.
MENTIONS = {
    "mentions_affirmed": (r"\b(affirm|affirmed|affirming|enforce|enforced|enforcing)\b", rf"{_ASKED}[^.;]{{0,120}}\b(denied|deny)\b", rf"\b(denied|deny)\b[^.;]{{0,120}}{_ASKED}"),
    "mentions_reversed": (r"\b(reverse|reversed|reversing|vacate|vacated|vacating)\b",),
    "mentions_remanded": (r"\b(remand|remanded|remanding)\b",),
    "mentions_dismissed": (r"\b(dismiss|dismissed|dismissing)\b",),
    "mentions_frivolous": (r"\bfrivolous\b",),
    "strong_affirmance": (rf"{_THING}[^.;]{{0,150}}{_IS}[^.;]{{0,50}}\b(affirmed|enforced)\b", r"\bwe\b[^.;]{0,80}\b(affirm|enforce)\b"),
    "strong_reversal": (rf"{_THING}[^.;]{{0,150}}{_IS}[^.;]{{0,50}}\b(reversed|vacated)\b", r"\bwe\b[^.;]{0,80}\b(reverse|vacate)\b"),
    "strong_remand": (r"\bwe\b[^.;]{0,120}\bremand\b", rf"\bremanded\b[^.;]{{0,120}}{_COURT}", rf"{_COURT}[^.;]{{0,120}}\bremanded\b"),
    "strong_dismissal": (r"\bwe\b[^.;]{0,100}\bdismiss\b", r"(appeal|petition|application|case)[^.;]{0,120}\b(is|are)\b[^.;]{0,50}\bdismissed\b"),
}
# Flags of the second version, over the last 3,000 characters.
OPERATIVE = {
    "op_mixed": (
        r"\b(affirm|affirmed)\b[^.;]{0,120}\bin part\b[^.;]{0,180}\b(reverse|reversed|vacate|vacated)\b[^.;]{0,120}\bin part\b",
        r"\b(reverse|reversed|vacate|vacated)\b[^.;]{0,120}\bin part\b[^.;]{0,180}\b(affirm|affirmed)\b[^.;]{0,120}\bin part\b",
    ),
    "op_affirmed": (
        r"\bwe\b[^.;]{0,50}\b(affirm|enforce)\b", rf"\b{_THING}\b[^.;]{{0,100}}{_IS}[^.;]{{0,30}}\b(affirmed|enforced)\b", rf"\b(affirmed|enforced){_STOP}",
        rf"{_REVIEW}[^.;]{{0,100}}{_IS}[^.;]{{0,30}}\bdenied\b", rf"\bwe\b[^.;]{{0,80}}\bdeny\b[^.;]{{0,80}}{_REVIEW}",
    ),
    "op_reversed": (
        r"\bwe\b[^.;]{0,50}\b(reverse|vacate)\b", rf"\b{_THING}\b[^.;]{{0,100}}{_IS}[^.;]{{0,30}}\b(reversed|vacated)\b", rf"\b(reversed|vacated){_STOP}",
        rf"{_REVIEW}[^.;]{{0,100}}{_IS}[^.;]{{0,30}}\bgranted\b", rf"\bwe\b[^.;]{{0,80}}\bgrant\b[^.;]{{0,80}}{_REVIEW}",
    ),
    "op_remanded": (
        r"\bwe\b[^.;]{0,70}\bremand\b", rf"\b(case|matter|proceedings|petition)\b[^.;]{{0,100}}{_IS}[^.;]{{0,30}}\bremanded\b",
        r"\bremanded\b[^.;]{0,100}\b(for|to)\b[^.;]{0,80}\b(further proceedings|district court|agency|board|bia)\b", rf"\bremanded{_STOP}",
    ),
    "op_dismissed": (r"\bwe\b[^.;]{0,70}\bdismiss\b", rf"\b(appeal|petition|application|case)\b[^.;]{{0,100}}{_IS}[^.;]{{0,30}}\bdismissed\b", rf"\bdismissed{_STOP}"),
    "op_coa_denied": (rf"{_COA}[^.;]{{0,120}}{_IS}[^.;]{{0,30}}\bdenied\b", rf"\bwe\b[^.;]{{0,80}}\bdeny\b[^.;]{{0,80}}{_COA}", rf"{_COA}[^.;]{{0,120}}\bdenied\b"),
}
# Coded outcomes in the two versions, and codes of dispositions on the merits.
LABELS_1 = {"1": "affirmed_or_enforced", "2": "reversed_or_vacated", "3": "affirmed_in_part_reversed_in_part", "5": "dismissed_frivolous", "6": "remanded", "7": "other", "-8": "missing_or_invalid"}
LABELS_2 = {
    "1": "affirmed_or_enforced", "2": "reversed_or_vacated", "3": "affirmed_in_part_reversed_or_vacated_in_part", "5": "dismissed_on_merits", "6": "remanded_only", "7": "other_merits_outcome",
    "9": "certificate_of_appealability_denied", "-8": "missing",
}
MERITS = ("1", "2", "3")
OTHER_LABEL = "unknown_or_not_applicable"
ENDING_1, ENDING_2 = 8000, 3000


def opinion_text(df: DataFrame, plain: str = "plain_text", markup: tuple[str, ...] = ("html_with_citations",)) -> Column:
    """The plain text, or the first of the marked-up ones without tags, that is not empty; line ends and runs of blanks as one blank."""
    texts = [F.nullif(F.col(plain), F.lit("")), *(F.nullif(F.regexp_replace(F.col(m), "<[^>]+>", " "), F.lit("")) for m in markup if m in df.columns)]
    return F.regexp_replace(F.regexp_replace(F.coalesce(*texts, F.lit("")), r"[\n\r\t\f]+", " "), " {2,}", " ")


def _flags(ending: Column, table: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    return {name: ending.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) for name, patterns in table.items()}


def _first(*cases: tuple[Column, str], otherwise: str) -> Column:
    out = None
    for when, label in cases:
        out = F.when(when, label) if out is None else out.when(when, label)
    return out.otherwise(otherwise)


def detect_mentions(df: DataFrame, text: Column) -> DataFrame:
    """The first version: df (outcome_code) with its flags, coded_outcome, text_outcome and check."""
    rows = df.withColumn("_text", text).withColumns(_flags(F.right("_text", F.lit(ENDING_1)), MENTIONS))
    f = {n: F.col(n) for n in MENTIONS}
    affirm, reverse, remand, dismiss = (f[n] for n in ("strong_affirmance", "strong_reversal", "strong_remand", "strong_dismissal"))
    said_affirm, said_reverse, said_remand, said_dismiss = (f[n] for n in ("mentions_affirmed", "mentions_reversed", "mentions_remanded", "mentions_dismissed"))
    found = _first(
        (said_affirm & said_reverse, "affirmed_in_part_reversed_in_part"), (reverse, "reversed_or_vacated"), (affirm, "affirmed_or_enforced"), (remand, "remanded"), (dismiss, "dismissed"),
        (said_reverse, "possible_reversed_or_vacated"), (said_affirm, "possible_affirmed_or_enforced"), (said_remand, "possible_remanded"), (said_dismiss, "possible_dismissed"), otherwise="outcome_not_detected",
    )
    rows = rows.withColumn("coded_outcome", recode(F.col("outcome_code").cast("string"), LABELS_1, OTHER_LABEL))
    coded = lambda x: F.col("coded_outcome") == x
    supports = (
        (coded("affirmed_or_enforced") & (affirm | (said_affirm & ~reverse))) | (coded("reversed_or_vacated") & (reverse | (said_reverse & ~affirm)))
        | (coded("affirmed_in_part_reversed_in_part") & said_affirm & said_reverse) | (coded("dismissed_frivolous") & said_dismiss & f["mentions_frivolous"]) | (coded("remanded") & (remand | said_remand))
    )
    conflicts = (coded("affirmed_or_enforced") & reverse & ~affirm) | (coded("reversed_or_vacated") & affirm & ~reverse) | (coded("remanded") & (affirm | reverse) & ~said_remand)
    check = _first(
        (F.col("_text") == "", "review_no_opinion_text"), (supports, "text_supports_fjc"), (coded("dismissed_frivolous") & said_dismiss, "review_dismissed_but_frivolous_not_found"),
        (F.col("coded_outcome").isin("other", "missing_or_invalid", OTHER_LABEL), "manual_review_nonstandard_outcome"), (conflicts, "possible_fjc_text_conflict"), otherwise="review_outcome_phrase_not_found",
    )
    return rows.withColumns({"text_outcome": F.when(F.col("_text") != "", found), "check": check}).drop("_text")


def detect_operative(df: DataFrame, text: Column) -> DataFrame:
    """The second version: df (outcome_code, disposition_code) with its flags, coded_outcome, text_outcome and check."""
    rows = df.withColumn("_text", F.trim(text)).withColumns(_flags(F.right("_text", F.lit(ENDING_2)), OPERATIVE))
    mixed, affirm, reverse, remand, dismiss, coa = (F.col(n) for n in OPERATIVE)
    found = _first(
        (mixed, LABELS_2["3"]), (reverse & remand, "reversed_or_vacated_and_remanded"), (affirm & remand, "affirmed_and_remanded"), (reverse, LABELS_2["2"]), (affirm, LABELS_2["1"]), (remand, LABELS_2["6"]),
        (dismiss, LABELS_2["5"]), (coa, LABELS_2["9"]), otherwise="outcome_not_detected",
    )
    code = F.col("outcome_code").cast("string")
    rows = rows.withColumn("coded_outcome", recode(code, LABELS_2, OTHER_LABEL))
    coded = lambda k: F.col("coded_outcome") == LABELS_2[k]
    supports = (
        (coded("1") & affirm & ~mixed & ~reverse) | (coded("2") & reverse & ~mixed & ~affirm) | (coded("3") & (mixed | (affirm & reverse))) | (coded("5") & dismiss)
        | (coded("6") & remand & ~mixed & ~affirm & ~reverse & ~dismiss) | (coded("9") & coa)
    )
    conflicts = (
        (coded("1") & (reverse | mixed) & ~affirm) | (coded("2") & (affirm | mixed) & ~reverse) | (coded("3") & (affirm != reverse) & ~mixed) | (coded("5") & (affirm | reverse | remand | mixed) & ~dismiss)
        | (coded("6") & (affirm | reverse | mixed | dismiss)) | (coded("9") & (affirm | reverse | remand | dismiss | mixed) & ~coa)
    )
    outside = ~F.col("disposition_code").cast("string").isin(*MERITS) & (code != "-8")
    check = _first(
        (F.col("_text") == "", "review_no_opinion_text"), (outside, "review_outcome_outside_merits_context"), (supports, "text_supports_fjc"),
        (F.col("coded_outcome").isin(LABELS_2["7"], LABELS_2["-8"], OTHER_LABEL), "manual_review_nonstandard_outcome"), (conflicts, "possible_fjc_text_conflict"), otherwise="review_outcome_phrase_not_found",
    )
    return rows.withColumns({"text_outcome": F.when(F.col("_text") != "", found), "check": check}).drop("_text")
