"""Data quality: orphans, duplicates, impossible states, differences, and fail-loud release checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import percent


class ReleaseError(AssertionError):
    """A release check found other figures than it expects."""


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key (not null) the parent lacks."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def constraint_faults(tables: dict[str, DataFrame], primary: dict[str, list[str]], foreign: list[tuple[str, str, str, str]] = (), checks: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """(constraint_name, n_rows): rows that break a primary key (repeated or null), a reference (child, key, parent, parent key), or a
    check (name to table and the condition that must not be false).  All are counted, none stops at the first."""
    rows = []
    for name, keys in primary.items():
        groups = tables[name].groupBy(*keys).agg(F.count("*").alias("n"))
        null = None
        for k in keys:
            null = F.col(k).isNull() if null is None else null | F.col(k).isNull()
        rows.append(groups.agg(F.coalesce(F.sum(F.when(null, F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("n_rows")).select(F.lit(f"{name}_pkey").alias("constraint_name"), "n_rows"))
    for child, key, parent, parent_key in foreign:
        rows.append(orphans(tables[child], key, tables[parent], parent_key).agg(F.count("*").alias("n_rows")).select(F.lit(f"{child}_{key}_fkey").alias("constraint_name"), "n_rows"))
    for name, (table, condition) in (checks or {}).items():
        rows.append(tables[table].agg(F.count_if(~condition).alias("n_rows")).select(F.lit(name).alias("constraint_name"), "n_rows"))
    return reduce(DataFrame.unionAll, rows)


def coverage(df: DataFrame, resolved: Column, keys: list[str]) -> DataFrame:
    """Rows, resolved rows and their share, overall and by each of keys (court, year, status): (dimension, value, n, n_resolved, pct)."""
    parts = []
    for dimension, by in (("overall", None), *((k, F.col(k)) for k in keys)):
        value = F.lit("all") if by is None else F.coalesce(by.cast("string"), F.lit("Missing"))
        parts.append(df.groupBy(F.lit(dimension).alias("dimension"), value.alias("value")).agg(F.count("*").alias("n"), F.count_if(resolved).alias("n_resolved")))
    return reduce(DataFrame.unionAll, parts).withColumn("pct", percent(F.col("n_resolved"), F.col("n")))


def differences_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has (as often as it has more of them), with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row for each check: how many rows break it."""
    wide = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_rows")) for n in checks])).alias("r")).select("r.*")


def column_differences(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows on both sides by key, and how many differ in each column (nulls equal)."""
    left, right = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns]), b.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = left.join(right, key)
    return joined.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"diff_{c}") for c in columns])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def count_vector(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in counts.items()])


def assert_vector(df: DataFrame, expected: dict[str, int]) -> None:
    """Raise unless the one-row table has exactly the expected figures."""
    got = df.select(*expected).first().asDict()
    wrong = {k: (got[k], v) for k, v in expected.items() if got[k] != v}
    if wrong:
        raise ReleaseError(f"found and expected: {wrong}")
