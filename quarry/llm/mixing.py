"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length.  A source's target is its share of the budget (weights,
with at most `most_repeats` times the source itself; what is above is shared again by weight).  Whole
passes over the source are taken first; the rest of the target is fitted by lengths: of each length the same
share of its documents, and at the end a bounded knapsack over the counts left finds the subset whose sum comes nearest to
the last KNAPSACK tokens or fewer.  The fit works on the length
histogram of one source, never on its documents; the result, a number of documents for each length, is
turned into documents by a seeded order of those that have that length.

That order is a rank of hashes within (source, length).  A group may hold a third of all rows, so no group is ever
sorted whole: n documents are cut into sqrt(n) ranges of the hash, counts of ranges find the one range where the
group's last taken document lies, and only the rows of that range are ranked, for the hash at which taking ends.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in
order; rows that repeat both doc_id and text within a source share one decision, ties between them are not broken (the fit may
then miss by their sizes); a very long text is one document of its length; a null doc_id is one like any other; an empty table
gives an empty result.  Extra columns are kept, whatever their names, by `mix`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import common as c
from quarry.operators.windows import surrogate_key

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_REPEATS = 2
KNAPSACK = 1 << 16  #: the budget that is left to the dynamic programme, in tokens
SEED = 20


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, budget: float = BUDGET, most: float = MOST_REPEATS) -> list[float]:
    """Targets of sources in their order: shares of budget * sum(sizes) by weight, none above most * its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), budget * sum(sizes)
    while free:
        total = sum(w[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * w[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
        left = budget * sum(sizes) - sum(out)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length make up a sum near budget (never above it)."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.zeros_like(counts)
    if budget > KNAPSACK:  # of each length the same share, with half of the knapsack left for the exact part
        take = (counts.astype(object) * (budget - KNAPSACK // 2) // total).astype(np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):  # what rounding left, by the largest lengths
        n = int(lengths[i])
        if n <= 0 or left <= KNAPSACK:
            break
        more = min(int(counts[i] - take[i]), (left - KNAPSACK // 2) // n)
        take[i] += more
        left -= more * n
    return take + knapsack(lengths, np.minimum(counts - take, np.where(lengths > 0, left // np.maximum(lengths, 1), 0)), left)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: how many of each length reach the largest sum up to budget.

    reached[k] is a bit set of the sums that the first k pieces make; a count n is cut into 1, 2, 4, ... pieces.
    """
    take = np.zeros_like(counts)
    pieces, reached, full = [], [1], (1 << (budget + 1)) - 1
    for i in np.argsort(-lengths, kind="stable"):
        n, step = int(counts[i]), 1
        while n > 0 and not reached[-1] >> budget & 1:
            k = min(step, n)
            n, step = n - k, step * 2
            if k * int(lengths[i]) <= budget:
                pieces.append((int(i), k))
                reached.append((reached[-1] | reached[-1] << (k * int(lengths[i]))) & full)
    at = reached[-1].bit_length() - 1
    for (i, k), before in zip(reversed(pieces), reversed(reached[:-1]), strict=True):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return take


def _fit_source(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("_size")
    take = fit(rows["_size"].to_numpy(), rows["_n"].to_numpy(), rows["_rest"][0].as_py())
    return rows.select(["_sid", "_size", "_n"]).append_column("_take", pa.array(take, pa.int64()))


def source_plan(histogram: DataFrame, scratch: c.Scratch, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST_REPEATS) -> DataFrame:
    """(_source, _sid, _source_size, _target, _passes, _rest) of each source; histogram has _source, _size, _n.

    Sources are numbered in the order of their code points by a range shuffle, and the share of the free ones is found by
    sums over the sources, once for each time that some of them reach their limit: `targets` for any number of sources.
    """
    sizes = histogram.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_source_size"))
    numbered = surrogate_key(sizes, ["_source"], "_number").withColumn("_sid", (F.col("_number") - 1).cast("int"))
    own = F.element_at(F.array(*map(F.lit, weights)), (F.col("_sid") % len(weights) + 1).cast("int"))
    rows = scratch.save(numbered.select("_source", "_sid", "_source_size", own.alias("_weight")), "sources")
    limit = F.col("_source_size") * F.lit(most)
    sums = rows.agg(F.sum("_weight").alias("w"), F.sum("_source_size").alias("t")).collect()[0]
    total, whole = sums["w"] or 0, budget * (sums["t"] or 0)
    left = whole
    share = lambda: F.lit(float(left)) * F.col("_weight") / F.lit(float(total))
    while total:
        free = share() <= limit
        got = rows.agg(F.coalesce(F.sum(F.when(free, F.col("_weight"))), F.lit(0)).alias("w"), F.coalesce(F.sum(F.when(~free, limit)), F.lit(0.0)).alias("t")).collect()[0]
        if got["w"] == total:
            break
        total, left = got["w"], whole - float(got["t"])
    target = F.least(share(), limit.cast("double")) if total else limit.cast("double")
    planned = rows.withColumn("_target", target).withColumn("_passes", F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0).cast("int"))
    rest = F.greatest(F.rint(F.col("_target") - F.col("_passes") * F.col("_source_size")), F.lit(0)).cast("long")
    return scratch.save(planned.select("_source", "_sid", "_source_size", "_target", "_passes", rest.alias("_rest")), "source_plan")


def _own() -> dict[str, Column]:
    """_size, _source, and two hashes that name and order a row, from the columns of documents."""
    return {"_size": size_of(F.col("text")), "_source": F.col("source"), "_h": F.xxhash64(F.lit(SEED), "doc_id", "text"), "_h2": F.xxhash64("text", "doc_id", F.lit(SEED))}


def _group_plan(narrow: DataFrame, sources: DataFrame, histogram: DataFrame, scratch: c.Scratch) -> DataFrame:
    """(_sid, _size, _all, _last) for lengths of which documents are taken: all, or those whose (_h, _h2) is up to _last."""
    same = histogram["_source"].eqNullSafe(sources["_source"])
    lengths = histogram.join(sources, same).where((F.col("_size") > 0) & (F.col("_rest") > 0)).select("_sid", "_size", "_n", "_rest")
    groups = scratch.save(lengths.groupBy("_sid").applyInArrow(_fit_source, "_sid int, _size long, _n long, _take long").where("_take > 0"), "groups")
    part = groups.where(F.col("_take") < F.col("_n")).withColumn("_ranges", F.ceil(F.sqrt("_n")).cast("long"))
    hb = F.floor((F.shiftright("_h", 33) + (1 << 30)) * F.col("_ranges") / float(1 << 31)).cast("long")
    ranged = narrow.join(part, ["_sid", "_size"]).withColumn("_range", hb)
    counts = ranged.groupBy("_sid", "_size", "_range").agg(F.count("*").alias("_k"), F.first("_take").alias("_take"))
    below = F.sum("_k").over(Window.partitionBy("_sid", "_size").orderBy("_range")) - F.col("_k")
    edge = counts.withColumn("_rank", F.col("_take") - below).where((F.col("_rank") > 0) & (F.col("_rank") <= F.col("_k")))
    edge = scratch.save(edge.select("_sid", "_size", "_range", "_rank"), "edges")
    place = F.row_number().over(Window.partitionBy("_sid", "_size", "_range").orderBy("_h", "_h2"))
    last = ranged.join(edge, ["_sid", "_size", "_range"]).withColumn("_at", place).where(F.col("_at") == F.col("_rank")).select("_sid", "_size", F.struct("_h", "_h2").alias("_last"))
    return scratch.save(groups.join(last, ["_sid", "_size"], "left").select("_sid", "_size", (F.col("_take") == F.col("_n")).alias("_all"), "_last"), "plan")


def _decided(rows: DataFrame, sources: DataFrame, plan: DataFrame) -> DataFrame:
    extra = F.coalesce(F.col("_all") | (F.struct("_h", "_h2") <= F.col("_last")), F.col("_all"), F.lit(False)).cast("int")
    out = rows.join(sources.withColumnRenamed("_source", "_name"), F.col("_source").eqNullSafe(F.col("_name"))).join(plan, ["_sid", "_size"], "left")
    return out.withColumn("_taken", F.when(F.col("_size") > 0, F.col("_size") * (F.col("_passes") + extra)).otherwise(0).cast("long"))


def _results() -> list[Column]:
    return [F.col(f"_{n}").alias(n) for n in ("size", "source_size", "target", "taken")]


def _planned(docs: DataFrame, scratch: c.Scratch, options: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    narrow = scratch.save(docs.select("doc_id", *(x.alias(n) for n, x in _own().items())), "sizes")
    histogram = scratch.save(narrow.groupBy("_source", "_size").agg(F.count("*").alias("_n")), "histogram")
    sources = source_plan(histogram, scratch, **options)
    with_sid = narrow.join(sources.select("_sid", F.col("_source").alias("_name")), F.col("_source").eqNullSafe(F.col("_name"))).select("_sid", "_size", "_h", "_h2")
    return narrow, sources, _group_plan(with_sid, sources, histogram, scratch)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every row of docs as the struct `row`, with size, source_size, target and taken (tokens that the mix takes of the row,
    repeats counted)."""
    _, sources, plan = _planned(docs, c.Scratch(docs.sparkSession), options)
    return _decided(c.nested(docs, **_own()), sources, plan).select("row", *_results())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow, sources, plan = _planned(c.table(spark, sf_dir, "documents"), c.Scratch(spark), {})
    return _decided(narrow, sources, plan).select("doc_id", *_results())
