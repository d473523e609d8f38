"""Window operators: surrogate keys, samples, ties, running markers, rolling means, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.exprs import hash_order


def surrogate_key(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Numbers 1, 2, ... in a total order of columns (nulls last, where they are told by name).

    One shuffle: rows are range-partitioned, sorted where they are, and numbered by their place in the partition plus the sizes
    of the partitions before it.  The sizes are counted from the same exchange (every column is read there too, so that the
    two sides share it).
    """
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    parts = parts.withColumns({"_part": F.shiftright("_at", 33), "_n": F.col("_at").bitwiseAND((1 << 33) - 1) + 1})  # partition above, place in it below
    sizes = parts.groupBy("_part").agg(F.max("_n").alias("_size"), F.max(F.xxhash64(*df.columns)).alias("_all")).where("_all IS NOT NULL")
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    placed = parts.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return placed.withColumn(name, (F.col("_before") + F.col("_n")).cast("long")).drop("_at", "_part", "_n", "_before")


def last_so_far(df: DataFrame, key: str, span: Column, order: list, value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row in an order by key, where values grow with the order.

    A key's rows are cut into spans (a function that never falls along the order, a day of a time, say); each span is
    a window of its own, and what the spans before it end with is carried into it.  So a hot key is spread over its spans.
    """
    rows = df.withColumns({"_span": span, "_value": value})
    upto = Window.partitionBy(key, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(key, "_span").agg(F.max("_value").alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one short row a span
    carried = ends.select(F.col(key).alias("_k2"), F.col("_span").alias("_s2"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    within = rows.withColumn("_within", F.last("_value", ignorenulls=True).over(upto))
    out = within.join(carried, F.col(key).eqNullSafe(F.col("_k2")) & F.col("_span").eqNullSafe(F.col("_s2")), "left")
    return out.withColumn(name, F.coalesce("_within", "_carried")).drop("_span", "_value", "_within", "_k2", "_s2", "_carried")


def stratified_sample(df: DataFrame, stratum: str, key: str, sizes: int | dict, salt: str = "", otherwise: int = 0) -> DataFrame:
    """The first rows of each stratum by a salted hash of the key, with the draw rank; sizes is one number, or one by stratum
    (`otherwise` for those it lacks).  The largest size is a limit that is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(F.col(key), salt), F.col(key)))
    most, own = sizes, F.lit(sizes) if isinstance(sizes, int) else None
    if isinstance(sizes, dict):
        most = max([otherwise, *sizes.values()])
        for k, n in sizes.items():
            own = F.when(F.col(stratum) == k, n) if own is None else own.when(F.col(stratum) == k, n)
        own = F.lit(otherwise) if own is None else own.otherwise(otherwise)
    return df.withColumn("draw_rank", rank).where(F.col("draw_rank") <= most).where(F.col("draw_rank") <= own)


def hashed_sample(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    return df.orderBy(hash_order(F.col(key), salt), key).limit(n)


def ties_at_best(df: DataFrame, keys: list[str], value: str, largest: bool = True) -> DataFrame:
    """The rows at each group's best value, and how many there are; dense_rank of all rows comes along."""
    by = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    best = (F.max if largest else F.min)(value).over(Window.partitionBy(*keys))
    ranked = df.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(by))).withColumn("_best", best)
    return ranked.withColumn("n_best", F.sum(F.when(F.col(value) == F.col("_best"), 1).otherwise(0)).over(Window.partitionBy(*keys))).drop("_best")


def running_marker(df: DataFrame, key: str, order: list[str], marker: Column, value: Column, name: str, span: Column) -> DataFrame:
    """The value of the last marked row so far, by key; values grow with the order.  span cuts a key's rows (see last_so_far)."""
    return last_so_far(df, key, span, order, F.when(marker, value), name)


def rolling_mean(df: DataFrame, order: str, value: str, width: int, at_least: int, keys: list[str] | None = None) -> DataFrame:
    """Centred mean over rows; null where fewer than at_least rows are there."""
    half = width // 2
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order).rowsBetween(-half, half)  # over grouped rows
    return df.withColumn("rolling", F.when(F.count(value).over(w) >= at_least, F.avg(value).over(w)))


def share_within(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*keys)))
