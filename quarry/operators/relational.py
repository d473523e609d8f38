"""Joins beyond equality: alternatives, as-of, nearest, windows of days, tiers, coverage and existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.windows import last_so_far


def or_join(left: DataFrame, right: DataFrame, left_keys: list[Column], right_key: Column, extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows of left and right where any of left_keys equals right_key, each pair once; with how="left" also left rows without one.

    The alternatives are exploded into one key column, so that the plan is a hash or merge join, never a nested loop.  A left
    row without a pair comes from one more alternative that no right row has, and stays only where its row met nothing.
    """
    keys = F.array_distinct(F.filter(F.array(*left_keys), lambda k: k.isNotNull()))
    if how == "inner":
        out = left.withColumn("_key", F.explode(keys)).join(right.withColumn("_right_key", right_key), F.col("_key") == F.col("_right_key"))
        return (out if extra is None else out.where(extra)).drop("_key", "_right_key")
    rows = left.withColumn("_i", F.monotonically_increasing_id()).withColumn("_key", F.explode(F.concat(keys.cast("array<string>"), F.array(F.lit(None).cast("string")))))
    met = rows.join(right.withColumn("_right_key", right_key).withColumn("_met", F.lit(True)), F.col("_key") == F.col("_right_key").cast("string"), "left")
    if extra is not None:
        met = met.withColumn("_met", F.col("_met") & F.coalesce(extra, F.lit(False)))
    any_ = F.max(F.coalesce("_met", F.lit(False))).over(Window.partitionBy("_i"))
    kept = met.withColumn("_any", any_).where(F.coalesce("_met", F.lit(False)) | (~F.col("_any") & F.col("_key").isNull()))
    return kept.select(*left.columns, *right.columns)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], strict: bool = True, span=None) -> DataFrame:
    """Each row of left with the values of the last row of right before (or, not strict, up to) its time, by key.

    Both sides are laid out by key and time, and the last right row is carried forward; no pair is ever made.  Among right
    rows of one time the largest values win.  span(time column) cuts a key's rows, so that a hot key is no single task.
    """
    side = F.lit(0 if strict else 1)
    a = left.select(F.struct(*left.columns).alias("_l"), F.col(key).alias("_k"), F.col(left_at).alias("_t"), side.alias("_s"))
    b = right.select(F.struct(F.col(right_at), *values).alias("_r"), F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.lit(1 if strict else 0).alias("_s"))
    both = a.unionByName(b, allowMissingColumns=True)
    cut = span(F.col("_t")) if span else F.lit(0)
    seen = last_so_far(both, "_k", cut, ["_t", "_s", F.col("_r").asc_nulls_first()], F.col("_r"), "_seen")
    return seen.where("_l IS NOT NULL").select("_l.*", *[F.col(f"_seen.{v}").alias(f"asof_{v}") for v in values])


def interval_join(left: DataFrame, right: DataFrame, key: str, at: Column, start: Column, end: Column, order: list[Column]) -> DataFrame:
    """The first right row by `order` whose validity interval (open ends allowed) holds the left row's date, by key."""
    ranged = left.withColumn("_row", F.monotonically_increasing_id())
    held = ranged.join(right, key).where((start.isNull() | (start <= at)) & (end.isNull() | (end >= at)))
    place = F.row_number().over(Window.partitionBy("_row").orderBy(*order))
    return held.withColumn("_at", place).where("_at = 1").drop("_at", "_row")


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], left_key: list[str], gap: Column, ties: list[str], values: list[str]) -> DataFrame:
    """For each left key the right row with the least gap, ties by the named columns, and the number of candidates.

    The choice is a minimum of structs, combined before the shuffle; no group is sorted.
    """
    best = F.min(F.when(gap.isNotNull(), F.struct(gap.alias("gap"), *ties, *[v for v in values if v not in ties])))
    joined = left.join(right, on, "left")
    out = joined.groupBy(*left_key).agg(best.alias("_b"), F.count(gap).alias("n_candidates"))
    return out.select(*left_key, "n_candidates", F.col("_b.gap").alias("gap"), *[F.col(f"_b.{v}").alias(v) for v in dict.fromkeys([*ties, *values])])


def within_days(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, days: int) -> DataFrame:
    """Pairs with the same key at most `days` apart.

    Dates are cut into spans of `days` + 1; each left row looks into three spans, so that the join has two equalities and a hot
    key is spread over its dates.
    """
    span = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / (days + 1)).cast("int")
    a = left.withColumn("_span", F.explode(F.sequence(span(left_at) - 1, span(left_at) + 1)))
    b = right.withColumn("_span", span(right_at))
    return a.join(b, [key, "_span"]).where(F.abs(F.datediff(F.col(left_at), F.col(right_at))) <= days).drop("_span")


def best_tier(candidates: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """Only the candidates of each key's lowest tier."""
    return candidates.withColumn("_best", F.min(tier).over(Window.partitionBy(*keys))).where(F.col(tier) == F.col("_best")).drop("_best")


def tier_groups(rows: DataFrame, key: str, tiers: list[list[str]], value: str) -> DataFrame:
    """For each key with a candidate, the consensus of its best tier, as `consensus` tells it; candidates of tier i are the rows of
    other keys that agree on the columns tiers[i - 1] and on those of no earlier tier.  The last tier's columns are among
    those of every tier.

    A key's best tier is its first group that holds another key, and all other keys of that group are of this tier.  So each
    group is listed once and a key takes its own name out of the list: no pair of keys is made.  Rows that agree on all columns
    go together until groups are chosen; among several keys of such rows the first tier is the best.  Windows and sums do it
    all: the exploded groups are many times what Spark's size checks see in the files, and a join may broadcast them.
    """
    used = list(dict.fromkeys(c for columns in tiers for c in columns))
    masked = lambda i, columns: F.struct(F.lit(i).alias("tier"), *(F.col(c) if c in columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in used))
    whole = [F.when(F.greatest(*(F.col(c).isNull() for c in columns), F.lit(False)), None).otherwise(masked(i, columns)) for i, columns in enumerate(tiers, 1)]
    alike = rows.where(F.col(key).isNotNull() & F.coalesce(*whole).isNotNull()).select(F.struct(F.col(key).alias("_key"), F.col(value).alias("_value")).alias("_row"), *used).groupBy(*used).agg(F.min("_row._key").alias("_a"), F.max("_row._key").alias("_b"), F.collect_set("_row").alias("_rows"))
    each = alike.select("_a", "_b", "_rows", F.coalesce(*whole)["tier"].alias("_first"), F.explode(F.array(*whole)).alias("_group")).where("_group IS NOT NULL")
    group, of_key = Window.partitionBy("_group"), Window.partitionBy("_key")
    several, asked = F.min("_a").over(group) != F.max("_b").over(group), F.bool_or((F.col("_a") == F.col("_b")) | (F.col("_group.tier") == F.col("_first"))).over(group)
    held = each.withColumn("_held", several & asked).where("_held").select("_group", F.inline("_rows"))
    own = held.withColumn("_own", F.col("_group.tier") == F.min("_group.tier").over(of_key)).withColumn("_n", F.count_if("_own").over(of_key))
    values = own.repartition("_group").groupBy("_group", "_value").agg(
        F.min("_key").alias("_a"), F.max("_key").alias("_b"), F.collect_set(F.col("_key").cast("string")).alias("_keys"),
        F.collect_list(F.when(F.col("_own") & (F.col("_n") == 1), F.col("_key"))).alias("_once"), F.collect_set(F.when(F.col("_own") & (F.col("_n") > 1), F.col("_key"))).alias("_more"),
    )
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    lists = values.groupBy("_group").agg(F.collect_list(F.struct("_value", "_a", "_b")).alias("_values"), F.sort_array(flat("_keys")).alias("_members"), F.flatten(F.collect_list("_once")).alias("_once"), flat("_more").alias("_more"))
    others = F.transform(F.filter("_values", lambda v: v["_value"].isNotNull() & ((v["_a"] != F.col("_key")) | (v["_b"] != F.col("_key")))), lambda v: v["_value"])
    found = lambda keys: lists.select("_group", "_values", "_members", F.explode(keys).alias("_key")).select("_key", F.col("_group.tier").alias("_tier"), F.array_remove("_members", F.col("_key").cast("string")).alias("_members"), others.alias("_values"))
    repeated = found("_more").groupBy("_key", "_tier").agg(F.sort_array(flat("_members")).alias("_members"), flat("_values").alias("_values"))  # keys of several rows
    n = F.size("_values").cast("long")
    return found("_once").unionByName(repeated).select(
        F.col("_key").alias(key), F.col("_tier").alias("tier"), F.size("_members").cast("long").alias("n_members"), n.alias("n_values"),
        F.when(n == 1, F.get("_values", F.lit(0))).alias("agreed"), F.array_join("_members", "|").alias("members"),
    )


def consensus(candidates: DataFrame, keys: list[str], value: str, member: str) -> DataFrame:
    """The value that all candidates of a key agree on, else null; with counts and an ordered list of members."""
    n = F.countDistinct(value)
    return candidates.groupBy(*keys).agg(
        F.countDistinct(member).alias("n_members"), n.alias("n_values"), F.when(n == 1, F.min(value)).alias("agreed"),
        F.array_join(F.sort_array(F.collect_set(F.col(member).cast("string"))), "|").alias("members"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", place).where("_at = 1").drop("_at")


def exists_flag(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """Every left row with whether right has its key."""
    keys = right.select(*on).distinct().withColumn(name, F.lit(True))
    return left.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def join_coverage(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left, rows that join, and rows that do not."""
    marked = exists_flag(left, right, on, "_hit")
    return marked.agg(F.count("*").alias("n"), F.count_if("_hit").alias("n_joined"), F.count_if(~F.col("_hit")).alias("n_missing"))


def valid_reference(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """df with `valid`: the key is null, or the parent has it."""
    keys = parent.select(F.col(parent_key).alias(key)).distinct().withColumn("_hit", F.lit(True))
    return df.join(keys, key, "left").withColumn("valid", F.col(key).isNull() | F.coalesce("_hit", F.lit(False))).drop("_hit")
