"""Column expressions: blanks, patterns, names, keys, dates and small statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(x: Column) -> Column:
    """Null, empty or spaces only; never null itself."""
    return F.coalesce(F.trim(x) == "", F.lit(True))


def nullif_blank(x: Column) -> Column:
    return F.when(~is_blank(x), F.trim(x))


def first_filled(*xs: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[nullif_blank(x) for x in xs])


def first_match(x: Column, pattern: str, group: int = 1) -> Column:
    """A capture group of the first match, or null where nothing matches."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def replace_first(x: Column, pattern: str, by: str = "") -> Column:
    """Replace the first match only (regexp_replace replaces all)."""
    return F.when(x.rlike(pattern), F.regexp_replace(x, f"(?s)^(.*?)(?:{pattern})", f"$1{by}")).otherwise(x)


def norm_space(x: Column) -> Column:
    """Dots to blanks, only letters, hyphens, quotes and blanks, single blanks, lower case."""
    y = F.regexp_replace(F.regexp_replace(x, r"\.", " "), r"[^A-Za-z\-\s']", "")
    return F.lower(F.trim(F.regexp_replace(y, r"\s+", " ")))


def norm_author(x: Column) -> Column:
    """norm_space without a leading role and without what follows the first comma."""
    y = F.regexp_replace(F.trim(x), r"(?i)^(opinion by|by|judge|justice)\s+", "")
    return norm_space(F.regexp_replace(y, r"(?s),.*$", ""))


def norm_alpha(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\p{IsAlphabetic}]", ""))


def part_of(x: Column, start: int, length: int | None = None) -> Column:
    """Characters from a place (from 1) on, at most `length` of them; null stays null."""
    return F.substring(x, start, length) if length is not None else F.substring(x, F.lit(start), F.length(x))


def final_token(x: Column) -> Column:
    return F.element_at(F.split(x, " "), -1)


def initial(x: Column) -> Column:
    return F.left(norm_alpha(x), F.lit(1))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(100.0 * part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"), digits)


def decade(d: Column) -> Column:
    return (F.floor(F.year(d) / 10) * 10).cast("int")


def in_days(d: Column, first: str, after: str) -> Column:
    """Whether a date or instant is in the half-open range [first, after): a plain comparison, so that it reaches the scan."""
    return (d >= F.lit(first).cast("date")) & (d < F.lit(after).cast("date"))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def recode(x: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def clean_category(x: Column, missing: str = "Missing") -> Column:
    return F.when(is_blank(x) | (F.lower(F.trim(x)) == "nan"), missing).otherwise(F.trim(x))


def shorten(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def bucket(x: Column, steps: list[tuple[int, str]], last: str) -> Column:
    """Labels by upper bounds: the first (bound, label) with x <= bound, else last."""
    out = None
    for bound, label in steps:
        out = F.when(x <= bound, label) if out is None else out.when(x <= bound, label)
    return out.otherwise(last)


def strip_tags(x: Column) -> Column:
    """Text of markup: scripts, styles and comments out, block ends to line breaks, tags out, six entities decoded."""
    y = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    y = F.regexp_replace(y, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|article|nav|ul)>", "\n")
    y = F.regexp_replace(y, r"<[^>]*>", "")
    for entity, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'), ("&amp;", "&")):
        y = F.replace(y, F.lit(entity), F.lit(by))
    return y


def flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def without_controls(x: Column) -> Column:
    """No control, zero-width or private-use characters."""
    return F.regexp_replace(x, r"[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}\x{200B}-\x{200F}\x{FEFF}\x{E000}-\x{F8FF}]", "")


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null for n = 0."""
    k, m = successes.cast("double"), F.nullif(n, F.lit(0)).cast("double")
    p = k / m
    middle, scale = p + z * z / (2 * m), 1 + z * z / m
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return (middle - half) / scale, (middle + half) / scale


def docket_key(x: Column) -> tuple[Column, Column]:
    """A two-digit year and a number of up to five digits as one padded key, and the rule that found it."""
    # A leading number, or one after the word Docket.
    lead, word = r"^\s*(?:No\.\s*)?([0-9]{2})-([0-9]{1,5})", r"[Dd]ocket\s*(?:No\.\s*)?([0-9]{2})-([0-9]{1,5})"
    at = lambda p: F.concat(F.regexp_extract(x, p, 1), F.lpad(F.regexp_extract(x, p, 2), 5, "0"))
    key = F.when(x.rlike(lead), at(lead)).when(x.rlike(word), at(word))
    return key, F.when(x.rlike(lead), "lead").when(x.rlike(word), "docket_keyword").otherwise("unparseable")


def hash_order(x: Column, salt: str = "") -> Column:
    """A reproducible order: the MD5 digest of a key and a salt."""
    return F.md5(F.concat(x.cast("string"), F.lit(salt)))
