"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are lifted by one coordinate (sqrt(M^2 - |x|^2), M the largest norm; queries are brought to length M and lifted by 0), which
turns the largest inner product into the least distance, and projected onto DIMENSIONS random directions, anew for each curve, with a random shift.  A
Hilbert curve through the projections gives each vector a key; Spark range-partitions the keys of all curves in one shuffle, and
counts of partitions turn sorted places into ranks.  Ranks are cut into blocks; a query visits the blocks that its window
of ranks touches, each visit keeps its best, and the windows of all curves are merged and ranked again by the inner product in
double precision.

The number of curves, the window's width and the block's size are fitted, not set: for FIT_QUERIES sampled queries the true
neighbours are found by comparing them with every row (a fixed number of queries against all rows, in blocks), one more scan
counts their ranks along MOST_CURVES curves, and of all numbers of curves the one is taken whose windows hold GOAL of the
true neighbours with the fewest rows visited.  On data with clusters that is a small share of the rows; on directions without
any structure no order of the rows helps, and the windows grow until they hold most rows.

Equal vectors are one point of the index (with their K + 1 least ids), so that a vector with very many copies neither
fills windows nor hides the copies with the least ids.

Defined results: vectors that are null, zero, or hold null, NaN or infinite components, and rows with a null id, take no part;
so do vectors whose length is not the most frequent one (ties: the shortest); ties in nearness go to smaller ids; repeated ids are
candidates each; fewer than K candidates are all returned; long vectors are read whole; an empty table gives an empty result; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import common as c

K = 20
QUERY_STEP = 20
MOST_CURVES, CURVES = 24, (1, 2, 3, 4, 6, 8, 12, 16, 24)  #: of which the fit takes one number
DIMENSIONS = 4
BITS = 8
LEAST_BLOCK, MOST_BLOCK = 64, 8192  #: rows that are held together: 4 MB at 64 dimensions
FIT_QUERIES = 64
FIT_ROWS = 10_000  #: rows whose projections set the grid
GOAL = 0.95
SEED = 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points on a grid (rows of DIMENSIONS cells below 2**bits)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Projections, shifts and grids of all curves, fitted on a sample of rows."""

    def __init__(self, sample: np.ndarray, most: float, curves: int = MOST_CURVES) -> None:
        rng, self.most = np.random.default_rng(SEED), most
        width = sample.shape[1] + 1
        self.maps, self.low, self.step = [], [], []
        lifted = self.lift(sample)
        for _ in range(curves):
            m = np.linalg.qr(rng.standard_normal((width, min(DIMENSIONS, width))))[0]
            y = lifted @ m
            low, high = y.min(0), y.max(0)
            span = np.maximum(high - low, 1e-12)
            self.maps.append(m)
            self.low.append(low - span * rng.random(len(low)) * 0.5)  # the shift
            self.step.append(span * 1.5 / (1 << BITS))

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Points on a sphere of radius `most`; queries, whose length changes no order, at its equator."""
        norm = np.sqrt((x * x).sum(1))
        if query:
            return np.column_stack([x * (self.most / np.maximum(norm, 1e-300))[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(self.most**2 - norm**2, 0))])

    def keys(self, curve: int, x: np.ndarray, query: bool = False) -> np.ndarray:
        y = (self.lift(x, query) @ self.maps[curve] - self.low[curve]) / self.step[curve]
        return hilbert(np.clip(np.floor(y), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def best(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list]:
    """For each row of x the k rows of y with the largest inner products, ties to smaller ids: scores and ids."""
    s = x @ y.T
    scores, found = [], []
    cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
    for row, least in zip(s, cut, strict=True):
        own = np.flatnonzero(row >= least)
        own = own[np.lexsort((ids[own], -row[own]))][:k]
        scores.append(row[own])
        found.append(ids[own])
    return scores, found


_LISTS = "query long, scores array<double>, points array<long>"


def _lists(query, scores: list, points: list) -> pa.RecordBatch:
    lists = [pa.array(x, t) for x, t in ((scores, pa.list_(pa.float64())), (points, pa.list_(pa.int64())))]
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), *lists], names=["query", "scores", "points"])


def _merged(k: int):
    def run(table: pa.Table) -> pa.Table:
        scores = table.column("scores").combine_chunks().flatten().to_numpy()
        points, first = np.unique(table.column("points").combine_chunks().flatten().to_numpy(), return_index=True)
        order = np.lexsort((points, -scores[first]))[:k]
        return pa.Table.from_batches([_lists([table.column("query")[0].as_py()], [scores[first][order]], [points[order]])])

    return run


def _points(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(h1, h2, point, x, ids): distinct usable vectors, each with its k + 1 least ids, of which point is the first; the
    usable rows (id, h1, h2); and the number of components."""
    rows = vectors.where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    widths = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    width = widths[0]["n"] if widths else 0
    rows = rows.where(F.size("x") == width).withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    least = rows.withColumn("r", place).where(F.col("r") <= k + 1)  # a limit for each group, applied before the shuffle as well
    points = least.groupBy("h1", "h2").agg(F.min("id").alias("point"), F.first("x").alias("x"), F.sort_array(F.collect_list("id")).alias("ids"))
    return points, rows.select("id", "h1", "h2"), width


def _ranked(rows: DataFrame, model, curves: int, n: int, width: int, scratch: c.Scratch) -> DataFrame:
    """(curve, point, x, is_query, rank) of rows (point, x, is_query) along each curve; a query has the rank of the point before it.

    One shuffle for all curves: as each curve has the same n points, a place in the order of all is a place in its curve.
    """
    kind = rows.schema["x"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, q = matrix(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
            for curve in range(curves):
                keys = np.where(q, model.value.keys(curve, x, True), model.value.keys(curve, x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), curve, np.int32)), *batch.columns, pa.array(keys)], names=["curve", "point", "x", "is_query", "key"])

    keyed = rows.mapInArrow(c.lean(run), f"curve int, point long, x {kind}, is_query boolean, key long")
    order = ["curve", "key", "point", "is_query"]
    parts = scratch.save(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "curves")
    one = F.when(F.col("is_query"), 0).otherwise(1)
    start, offsets = 0, []
    for r in parts.groupBy("part").agg(F.sum(one).alias("n")).orderBy("part").collect():
        offsets.append((r["part"], start))
        start += r["n"]
    table = rows.sparkSession.createDataFrame(offsets, "part int, start long")  # one short row for each partition
    within = F.sum(one).over(Window.partitionBy("part").orderBy(*order))
    out = scratch.save(parts.join(table, "part").select("curve", "point", "x", "is_query", (F.col("start") + within - 1 - F.col("curve") * F.lit(n)).alias("rank")), "ranks")
    scratch.drop(parts)
    return out


def _truth(points: DataFrame, asked: list, width: int, k: int) -> dict[int, list[int]]:
    """The k nearest points of each asked (point, x), by comparing it with every point."""
    own = points.sparkSession.sparkContext.broadcast((np.array([p for p, _ in asked], np.int64), np.array([x for _, x in asked], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, x = own.value
                yield _lists(names, *best(x, matrix(batch.column(1), width), batch.column(0).to_numpy(), k))

    got = points.select("point", "x").mapInArrow(c.lean(run), _LISTS).groupBy("query").applyInArrow(_merged(k), _LISTS)
    return {r["query"]: r["points"] for r in got.collect()}


def _fitted_ranks(points: DataFrame, model, asked: np.ndarray, near: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest ranks that the asked queries and the points near (both rows of components) may have along
    MOST_CURVES curves: one scan of all points counts how many keys lie below each of theirs, and up to it."""
    keys = np.stack([np.concatenate([model.value.keys(k, asked, True), model.value.keys(k, near)]) for k in range(MOST_CURVES)])
    edges = np.sort(np.concatenate([keys, keys + 1], axis=1), axis=1)
    shared = points.sparkSession.sparkContext.broadcast(edges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, total = shared.value, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), width)
                own = np.stack([np.bincount(np.searchsorted(e, model.value.keys(k, x), side="right"), minlength=len(e) + 1) for k, e in enumerate(edges)])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(MOST_CURVES, dtype=np.int32)), pa.array([r.astype(np.int64).tobytes() for r in total])], names=["curve", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"curve": table.column("curve").slice(0, 1), "counts": pa.array([total.tobytes()])})

    schema = "curve int, counts binary"
    got = {r["curve"]: np.frombuffer(r["counts"], np.int64) for r in points.select("x").mapInArrow(c.lean(count), schema).groupBy("curve").applyInArrow(add, schema).collect()}  # MOST_CURVES rows of a fixed size
    low, high = (np.stack([np.cumsum(got[k])[np.searchsorted(edges[k], keys[k] + d)] for k in range(MOST_CURVES)]) for d in (0, 1))
    return low, high


def plan(gaps: np.ndarray, n: int, goal: float) -> tuple[int, int, int]:
    """The number of curves, the half-window and the block that visit the fewest of n rows while the windows hold a share of `goal`;
    gaps: distances of ranks by curve (rows) of true neighbours (columns)."""
    if not gaps.size:
        return 1, 0, LEAST_BLOCK
    best = None
    for curves in CURVES:
        near = np.sort(gaps[:curves].min(0))
        reach = int(near[min(len(near) - 1, int(np.ceil(goal * len(near))))])
        block = min(MOST_BLOCK, max(LEAST_BLOCK, 1 << (reach // 2).bit_length()))
        visited = curves * min(n, 2 * reach + block)
        if best is None or visited < best[0]:
            best = (visited, curves, reach, block)
    return best[1:]


def _visit(width: int, k: int):
    """Rows come by block, its points first; the queries that visit a block stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            q = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (q[1:] != q[:-1])])) if len(blocks) else []
            for start, end in zip(edges, [*edges[1:], len(blocks)], strict=True):
                part = batch.slice(start, end - start)
                if blocks[start] != block:
                    block, parts, held = blocks[start], [], None
                ids, x = part.column(2).to_numpy(), matrix(part.column(3), width)
                if not q[start]:
                    parts.append((ids, x))
                elif parts:
                    held = held or tuple(map(np.concatenate, zip(*parts, strict=True)))
                    for at in range(0, len(ids), 256):
                        yield _lists(ids[at : at + 256], *best(x[at : at + 256], held[1], held[0], k))

    return run


def search(vectors: DataFrame, is_query, k: int = K, goal: float = GOAL, scratch: c.Scratch | None = None, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of vectors (id, x) found for the rows where is_query(id) holds; told gets
    the fitted number of curves, half-window, block and number of points."""
    spark, scratch = vectors.sparkSession, scratch or c.Scratch(vectors.sparkSession)
    points, rows, width = _points(vectors.select(F.col("id").cast("long").alias("id"), "x"), k)
    points = scratch.save(points, "points")
    asks = scratch.save(rows.where(is_query(F.col("id"))).join(points.select("h1", "h2", "point"), ["h1", "h2"]).select("id", "point"), "asks")
    queries = scratch.save(points.join(asks.select("point").distinct(), "point", "left_semi").select("point", "x"), "queries")
    asked = queries.orderBy(F.xxhash64("point")).limit(FIT_QUERIES).collect()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    stats = points.agg(F.max(norm).alias("m"), F.count("*").alias("n")).collect()[0]
    n = stats["n"]
    part = min(1.0, FIT_ROWS / n)
    sample = points.where(F.pmod(F.xxhash64("point", F.lit("fit")), F.lit(1 << 30)) < int(part * (1 << 30))).select("x")
    fitted = np.array([r["x"] for r in sample.collect()] or [r["x"] for r in asked], np.float64)  # about FIT_ROWS rows
    model = spark.sparkContext.broadcast(Curves(fitted, float(stats["m"])))
    truth = _truth(points, [(r["point"], r["x"]) for r in asked], width, k + 1)
    wanted = spark.createDataFrame([(p,) for p in sorted({p for near in truth.values() for p in near})], "point long")
    found = {r["point"]: r["x"] for r in points.join(F.broadcast(wanted), "point").select("point", "x").collect()}  # of the sampled queries only
    near = sorted(found)
    low, high = _fitted_ranks(points, model, np.array([r["x"] for r in asked], np.float64), np.array([found[p] for p in near], np.float64), width)
    place = {p: len(asked) + i for i, p in enumerate(near)}
    pairs = np.array([(i, place[p]) for i, r in enumerate(asked) for p in truth.get(r["point"], ()) if p != r["point"]], np.int64).reshape(-1, 2)
    asks_at, near_at = pairs.T
    curves, reach, block = plan(np.maximum(high[:, near_at] - low[:, asks_at], high[:, asks_at] - low[:, near_at]), n, goal)
    if told is not None:
        told.update(curves=curves, reach=reach, block=block, points=n)
    both = points.select("point", "x", F.lit(False).alias("is_query")).unionByName(queries.withColumn("is_query", F.lit(True)))
    ranked = _ranked(both, model, curves, n, width, scratch)
    last = (n - 1) // block
    low, high = (F.least(F.greatest(F.floor((F.col("rank") + d) / block), F.lit(0)), F.lit(last)).cast("long") for d in (-reach, reach))
    at = F.explode(F.when(F.col("is_query"), F.sequence(low, high)).otherwise(F.array(F.floor(F.col("rank") / block).cast("long"))))
    visits = ranked.select("curve", at.alias("block"), "is_query", "point", "x").withColumn("block", F.col("block") + F.col("curve") * F.lit(last + 1)).drop("curve")
    met = visits.repartition("block").sortWithinPartitions("block", "is_query").mapInArrow(c.lean(_visit(width, k + 1)), _LISTS)
    nearest = scratch.save(met.groupBy("query").applyInArrow(_merged(k + 1), _LISTS), "nearest")
    scratch.drop(ranked, queries)
    found = nearest.select("query", F.explode(F.arrays_zip("scores", "points")).alias("f")).select("query", F.col("f.scores").alias("score"), F.col("f.points").alias("point"))
    named = scratch.save(found.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id")), "named")
    out = asks.select(F.col("id").alias("query_id"), F.col("point").alias("query")).distinct().join(named, "query").where("vec_id != query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = c.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return search(vectors, lambda i: i % QUERY_STEP == 0)
