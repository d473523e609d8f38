"""Aggregations: audits, histograms, completeness, shares and ordered lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.exprs import is_blank, percent


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_distinct"), (F.count("*") - F.countDistinct(key)).alias("n_duplicates"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Least, largest and average group size."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("avg_n"))


def frequency_of_frequency(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("frequency"))


def histogram(df: DataFrame, label: Column, raw: Column) -> DataFrame:
    """Counts by label, in the order of the labels' least raw value."""
    return df.select(label.alias("bucket"), raw.alias("_raw")).groupBy("bucket").agg(F.count("*").alias("n"), F.min("_raw").alias("_first")).orderBy("_first").drop("_first")


def share_of_total(df: DataFrame, keys: list[str]) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_total"))  # one row
    return n.crossJoin(total).withColumn("pct", percent(F.col("n"), F.col("_total"))).drop("_total")


def completeness(df: DataFrame, name: str, blank: bool = True) -> DataFrame:
    """A row for each column: total, missing (null, or blank too) and percentages, from one scan."""
    missing = {c: F.count_if(is_blank(F.col(c).cast("string")) if blank else F.col(c).isNull()).alias(c) for c in df.columns}
    wide = df.agg(F.count("*").alias("_total"), *missing.values())
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable_name"), F.col(c).alias("missing_count")) for c in df.columns]))
    long = wide.select("_total", pairs.alias("p")).select(F.lit(name).alias("table_name"), "p.variable_name", F.col("_total").alias("total_rows"), "p.missing_count")
    return long.withColumn("missing_pct", percent(F.col("missing_count"), F.col("total_rows"))).withColumn("completeness_pct", percent(F.col("total_rows") - F.col("missing_count"), F.col("total_rows")))


def completeness_rollup(long: DataFrame) -> DataFrame:
    c = F.col("completeness_pct")
    return long.groupBy("table_name").agg(
        F.count("*").alias("n_variables_checked"), F.avg(c).alias("avg_completeness_pct"), F.percentile(c, F.lit(0.5)).alias("median_completeness_pct"),
        F.min(c).alias("min_completeness_pct"), F.max(c).alias("max_completeness_pct"), F.count_if(c < 50).alias("n_below_50_pct"), F.count_if(c == 100).alias("n_full_100_pct"),
    )


def text_audit(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """For each text column: rows, filled rows, share and average length of the filled."""
    filled = {c: ~is_blank(F.col(c)) for c in columns}
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(filled[c]).alias(f"n_{c}") for c in columns], *[F.avg(F.when(filled[c], F.length(c))).alias(f"l_{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("field_name"), F.col(f"n_{c}").alias("non_empty_rows"), F.col(f"l_{c}").alias("avg_length")) for c in columns]))
    out = wide.select("_n", rows.alias("r")).select("r.field_name", F.col("_n").alias("total_rows"), "r.non_empty_rows", "r.avg_length")
    return out.withColumn("non_empty_pct", percent(F.col("non_empty_rows"), F.col("total_rows")))


def distinct_list(x: Column, sep: str = ", ") -> Column:
    return F.array_join(F.sort_array(F.collect_set(x)), sep)


def ordered_list(order: list[Column], x: Column, sep: str = "; ") -> Column:
    """x of all rows, in an order of other columns."""
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.alias("x"))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), sep)


def one_or_category(x: Column, missing: str = "Missing", several: str = "Multiple") -> Column:
    n = F.countDistinct(x)
    return F.when(n == 0, missing).when(n == 1, F.min(x)).otherwise(several)


def pivot_counts(df: DataFrame, row: str, category: str, order: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(category, order).agg(F.count(F.lit(1))).na.fill(0)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def ks_statistic(a: DataFrame, b: DataFrame, x: str) -> DataFrame:
    """Largest distance of the two empirical distribution functions, on grouped values.

    Values are range-partitioned and summed up within partitions; sums of the partitions before make the running sums whole.
    """
    both = a.select(F.col(x), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(F.col(x), F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = both.groupBy(x).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = steps.repartitionByRange(x).withColumn("_part", F.spark_partition_id())
    sums = parts.groupBy("_part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"), F.max(x).alias("_last"))
    earlier, all_ = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))  # one row a partition
    offsets = sums.select("_part", *(F.coalesce(F.sum(f"p{k}").over(earlier), F.lit(0)).alias(f"o{k}") for k in "ab"), *(F.sum(f"p{k}").over(all_).alias(f"n{k}") for k in "ab"), "_last")
    upto = Window.partitionBy("_part").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    running = parts.select("_part", x, *(F.sum(k).over(upto).alias(f"s{k}") for k in "ab")).join(F.broadcast(offsets), "_part").where(F.col(x) <= F.col("_last"))
    gap = F.abs((F.col("oa") + F.col("sa")) / F.col("na") - (F.col("ob") + F.col("sb")) / F.col("nb"))
    return running.agg(F.max(gap).alias("ks"))


def group_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, filled values, mean, median and distinct values of each group."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count(x).alias("n_values"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.countDistinct(x).alias("n_distinct"))


def completeness_map(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Completeness of the chosen variables of several tables, each from one scan."""
    return reduce(DataFrame.unionAll, [completeness(df.select(*columns), name) for name, (df, columns) in tables.items()])


def core_subset(long: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a completeness table for the chosen (table_name, variable_name), and the chosen ones that it lacks (to warn of)."""
    on = ["table_name", "variable_name"]
    return long.join(chosen, on, "left_semi"), chosen.join(long, on, "left_anti")
