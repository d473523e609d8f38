"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Texts are compared as weighted sets of five-word shingles (a text of fewer words is one shingle); the weight of a
shingle is (1 + ln tf) * (1 + ln(1 + N / df) / ln(1 + N)), with df counted over all documents in a sketch of two rows of
counters that never counts too low and whose error stays the same share of N at every size.  The damped
inverse frequency (a factor of 1 to 2) keeps passages that many documents share from filling buckets, but does not let
the edits of a text with thousands of near copies outweigh the text.  Texts with the same words in the same order are
one node (a 128-bit hash) from the start.  Each node draws BANDS * ROWS consistent weighted samples; ROWS
samples make a band, and nodes that agree on a band share a bucket.

No bucket is ever expanded into all its pairs: its least node is compared with each of the others.  In buckets whose members
do not end up in one class (texts that share a passage, say, and agree on little else) a second node, the least by a hash of those
outside the first one's class, is compared with the others that are not in its own.  These two rounds find most links with at
most 2 * BANDS comparisons a node.

Members of buckets that are mixed even then are settled by an exact join.  Their shingles are put in one order, those with
the largest inverse document frequency first.  If two texts are alike to the threshold t, the first shingle they share has little
weight before it: at most 1 - 2t / (1 + t) of the lighter text's and 1 - t of the heavier one's, and what follows it is
enough for the overlap t asks for.  Pairs of different classes that meet this at some shingle are compared, so no two texts in
a mixed bucket are left apart unseen, and texts that share a template alone are not paired, as its shingles come too late.

Pairs whose samples agree in less than LIKELY of all cases (five standard deviations below the threshold) are left, and so are
those that cannot be alike: each node has the parities of its distinct rare shingles (an inverse document frequency of RARE or
more) and of the others in MAP_BITS cells each, and as each cell that differs holds a shingle of at least that weight which only one
text has, the total weights bound the similarity from above.  For the rest the exact weighted Jaccard similarities of the whole texts are computed.  Pairs of SIMILARITY or more, by these weights or
by term frequency alone, are links, and classes are their connected components, found by spreading the least label over the
links.

All intermediate tables are narrow (hashes), except for the texts of nodes that share a bucket.  Joins are on
written tables, so that adaptive execution can split a hot bucket, centre or class.

Defined results: texts without words are never duplicates of anything; rows with a null doc_id are not compared and have
a null class; rows that repeat a doc_id are compared each, and the class is told by doc_id (ties: the least doc_id names a class);
very long texts are compared whole; an empty table gives an empty result; extra columns are not read by `classes` and kept,
whatever their names, by `drop_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import common as c

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SIEVE_BITS, MAX_SIEVE = 16, 1 << 28  #: bits for each wanted document, and in all (32 MB), of the sieve that keeps other texts out of a shuffle
MAP_BITS, FOLDED = 1024, 256  #: cells of the parities that bound a similarity, and of those that a join looks at
RARE = 1.5
LIKELY = 0.5  #: least share of equal samples for a pair whose texts are compared
SKETCH, SKETCH_ROWS, SKETCH_PARTS = 1 << 18, 2, 16

_R = np.random.default_rng(2)
_TABLE = 1 << 16
_GAMMA = _R.gamma(2, 1, _TABLE).astype(np.float32)
_BETA = _R.random(_TABLE, np.float32)
_LOG_C = np.log(_R.gamma(2, 1, _TABLE)).astype(np.float32)
_PER_GAMMA, _SHIFT = 1 / _GAMMA, _GAMMA * (_BETA - 1)
_MULA, _MULB = (_R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << c.U64(1) | c.U64(1) for _ in range(2))


def nodes_of(h: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """The name of each text: a hash of its words' hashes in order, null without words."""
    return [xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else None for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


_SHORT = c.U64(24)  #: bits that the sketch and sorting leave out of a shingle's hash


def cells(short: np.ndarray) -> list[np.ndarray]:
    return [(c.mix(short + c.U64(k + 1)) & c.U64(SKETCH - 1)).astype(np.int64) for k in range(SKETCH_ROWS)]


def weighted(h: np.ndarray, starts: np.ndarray, idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their weights, and where each text starts."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(owner.astype(c.U64) << c.U64(40) | h >> _SHORT)
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    out = h[first]
    return out, (1 + np.log(times)) * idf(out) if idf else 1 + np.log(times), np.searchsorted(owner[first], np.arange(len(starts)))


class Idf:
    def __init__(self, sketch: np.ndarray, n: int) -> None:
        self.table = (1 + np.log1p(n / np.maximum(sketch, 1)) / max(math.log1p(n), 1e-9)).astype(np.float32)  # of counters, not of shingles

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = None
        for row, at in zip(self.table, cells(h >> _SHORT), strict=True):
            out = row[at] if out is None else np.maximum(out, row[at])  # the lower count
        return out


def samples(h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text with shingles, 16 bits of each consistent weighted sample (shingle, quantised weight), and BANDS keys."""
    some = np.flatnonzero(np.diff(starts) > 0)
    at, log_w = starts[some], np.log(w).astype(np.float32)
    n = np.diff(np.append(at, len(h)))
    keys, short = np.zeros((BANDS, len(some)), c.U64), np.zeros((BANDS * ROWS, len(some)), np.uint16)
    x, y = np.empty_like(h), np.empty_like(h)
    for j in range(BANDS * ROWS):
        np.multiply(h, _MULA[j], out=x)
        np.right_shift(x, c.U64(32), out=y)
        y ^= h
        y *= _MULB[j]
        ia, ib = ((z >> c.U64(48)).astype(np.intp) for z in (x, y))
        t = _PER_GAMMA.take(ia)
        t *= log_w
        t += _BETA.take(ia)
        np.floor(t, out=t)
        value = _GAMMA.take(ia)
        value *= t
        np.subtract(_SHIFT.take(ia), value, out=value)
        value += _LOG_C.take(ib)
        least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, at), n))
        best = least[np.searchsorted(least, at)]  # the first of each text
        one = c.mix(h[best] + c.mix(t[best].astype(np.int64).view(c.U64) + c.U64(j)))
        keys[j // ROWS] = c.mix(keys[j // ROWS] * c.U64(0x9E3779B97F4A7C15) + one)
        short[j] = one >> c.U64(48)
    return short, keys


_PASS1 = "doc_id long, k1 long, k2 long, node binary, part int, counts binary"


def _nodes_and_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros((SKETCH_ROWS, SKETCH), np.int64)
    names = ["doc_id", "k1", "k2", "node", "part", "counts"]
    for batch in batches:
        for start, texts in c.chunks(batch, "text", 1_000_000):
            words = c.word_hashes(texts)
            h, starts = c.shingle_hashes(*words, WIDTH)
            owner = np.repeat(np.arange(len(texts), dtype=c.U64), np.diff(starts))
            once = np.unique(owner << c.U64(40) | h >> _SHORT) & c.U64((1 << 40) - 1)
            for row, at in zip(sketch, cells(once), strict=True):
                row += np.bincount(at, minlength=SKETCH)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, n) for k in range(3)), pa.array(nodes_of(*words), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    for part, block in enumerate(np.split(sketch, SKETCH_PARTS, axis=1)):
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([part], pa.int32()), pa.array([pa.compress(block.tobytes(), codec="zstd", asbytes=True)])], names=names)


def _block(data: bytes) -> np.ndarray:
    size = SKETCH_ROWS * (SKETCH // SKETCH_PARTS) * 8
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), np.int64)


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each part from each task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums[part] + _block(data) if part in sums else _block(data)
    for part, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pa.compress(total.tobytes(), codec="zstd", asbytes=True)])], names=["part", "counts"])


def _idf(first: DataFrame) -> Idf:
    schema = "part int, counts binary"
    parts = first.where("part IS NOT NULL").select("part", "counts").mapInArrow(c.lean(_add_blocks), schema).repartition(SKETCH_PARTS, "part").mapInArrow(c.lean(_add_blocks), schema)
    sketch = np.zeros((SKETCH_ROWS, SKETCH), np.int64)
    for r in parts.collect():  # SKETCH_PARTS rows of a fixed size
        width = SKETCH // SKETCH_PARTS
        sketch[:, r["part"] * width : (r["part"] + 1) * width] = _block(r["counts"]).reshape(SKETCH_ROWS, -1)
    return Idf(sketch, first.where("node IS NOT NULL").count())


def parities(h: np.ndarray, rarity: np.ndarray, starts: np.ndarray, bits: int = MAP_BITS) -> np.ndarray:
    """For each text 2 * bits bits (as bytes): whether an odd number of its distinct rare shingles falls into each cell, and the same
    of the others."""
    n, few = len(starts) - 1, 1024  # texts counted at a time
    out = np.empty((n, 2 * bits // 8), np.uint8)
    cell = (c.mix(h + c.U64(77)) & c.U64(bits - 1)).astype(np.int64) + (rarity < RARE) * bits + np.repeat(np.arange(n), np.diff(starts)) % few * (2 * bits)
    for at in range(0, n, few):
        end = min(n, at + few)
        odd = np.bincount(cell[starts[at] : starts[end]], minlength=(end - at) * 2 * bits).astype(np.uint8) & 1
        out[at:end] = np.packbits(odd, bitorder="little").reshape(end - at, -1)
    return out


def possible(a: np.ndarray, b: np.ndarray, weights_a: np.ndarray, weights_b: np.ndarray, least: float) -> np.ndarray:
    """Pairs (rows of parities, and both kinds of total weights) that may be alike to `least` by one kind of weights."""
    rare, others = np.bitwise_count(a ^ b).reshape(len(a), 2, -1).sum(2, dtype=np.int64).T
    apart = np.stack([RARE * rare + others, rare + others], 1)
    return (apart <= (weights_a + weights_b) * ((1 - least) / (1 + least) + SLACK) + SLACK).any(1)


_SIGNATURE = "node binary, samples binary, map binary, w0 float, w1 float, keys array<bigint>"


def _signatures(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in batches:
            for _, texts in c.chunks(batch, "text"):
                words, at = c.word_hashes(texts)
                if not len(words):
                    continue
                at = np.append(at[:-1][np.diff(at) > 0], len(words))  # texts with words
                h, tf, starts = weighted(*c.shingle_hashes(words, at, WIDTH), None)
                rarity = weights(h)
                w = tf * rarity
                short, keys = samples(h, w, starts)
                maps, totals = parities(h, rarity, starts), [np.add.reduceat(x, starts[:-1]).astype(np.float32) for x in (w, tf)]
                flat = pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel())
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([pa.array(nodes_of(words, at), pa.binary()), pa.array([x.tobytes() for x in np.ascontiguousarray(short.T)], pa.binary()), pa.array([x.tobytes() for x in maps], pa.binary()), *map(pa.array, totals), keys], names=["node", "samples", "map", "w0", "w1", "keys"])

    return run


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose samples agree often enough, and that may be alike."""
        for batch in batches:
            if batch.num_rows:
                samples_, maps, weights = ([], [], [])
                for side in "ab":
                    own = {n: batch.column(batch.schema.get_field_index(f"{n}_{side}")) for n in ("samples", "map", "w0", "w1")}
                    samples_.append(np.frombuffer(b"".join(own["samples"].to_pylist()), np.uint16).reshape(batch.num_rows, -1))
                    maps.append(np.frombuffer(b"".join(own["map"].to_pylist()), np.uint8).reshape(batch.num_rows, -1))
                    weights.append(np.stack([own[n].to_numpy() for n in ("w0", "w1")], 1))
                good = ((samples_[0] == samples_[1]).mean(1) >= LIKELY) & possible(*maps, *weights, least)
                yield batch.select([0, 1]).filter(pa.array(good))

    return c.lean(run)


def similarity(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """The larger weighted Jaccard similarity of two sets: sorted keys, and two kinds of weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = [np.minimum(x[i], y[j]).sum() for x, y in zip(a[1:], b[1:], strict=True)]
    return max(float(k / (x.sum() + y.sum() - k)) for k, x, y in zip(least, a[1:], b[1:], strict=True))


def _compare(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, memory = idf.value, {}

        def known(node: bytes, text: bytes):
            if node not in memory:
                if len(memory) >= 64:
                    memory.clear()
                h, tf, _ = weighted(*c.shingle_hashes(*c.word_hashes([text]), WIDTH), None)
                memory[node] = (h, tf * weights(h), tf)
            return memory[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = c.as_bytes(batch.column(2)), c.as_bytes(batch.column(3))
            got = [similarity(known(p, x), known(q, y)) for p, q, x, y in zip(a, b, ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["centre", "node", "similarity"])

    return run


_START = "key long, node binary, root binary, place int, light boolean, before0 float, before1 float, weight0 float, weight1 float, map array<bigint>"
EARLIER = 8  #: shingles before one, by which a pair is known to have met
SLACK = 1e-4  #: of a weight, for the rounding of floats


def starts(h: np.ndarray, rarity: np.ndarray, kinds: tuple[np.ndarray, ...], least: float) -> tuple[np.ndarray, ...]:
    """The first shingles of a text in the order of rarity, as far as a text alike to `least` may first share one: hashes,
    whether a text that is no lighter may, and for both kinds the weights before each and in all."""
    order = np.lexsort((h, -rarity))
    total = [float(x.sum()) for x in kinds]
    before = [np.cumsum(x[order]) - x[order] for x in kinds]
    heavy, light = (np.logical_or.reduce([b <= (share + SLACK) * t for b, t in zip(before, total, strict=True)]) for share in (1 - least, 1 - 2 * least / (1 + least)))
    at = np.flatnonzero(heavy)
    return h[order[at]], light[at], *(b[at] for b in before), *(np.full(len(at), t) for t in total)


def _starts(idf, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        names = ["key", "node", "root", "place", "light", "before0", "before1", "weight0", "weight1", "map"]
        for batch in batches:
            keys, light, numbers, maps = [], [], [], []
            for text in c.as_bytes(batch.column(2)):
                h, tf, _ = weighted(*c.shingle_hashes(*c.word_hashes([text]), WIDTH), None)
                rarity = weights(h)
                key, may, *own = starts(h, rarity, (tf * rarity, tf), least)
                keys.append(key.view(np.int64))
                light.append(may)
                numbers.append(np.stack(own).astype(np.float32))
                maps.append(parities(h, rarity, np.array([0, len(h)]), FOLDED)[0].view(np.int64))
            if keys:
                owner = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                folded = pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1, dtype=np.int32) * (FOLDED // 32)), pa.array(np.concatenate(maps)))
                place = np.concatenate([np.arange(len(k), dtype=np.int32) for k in keys])
                columns = [pa.array(np.concatenate(keys)), *(batch.column(k).take(owner) for k in (0, 1)), pa.array(place), pa.array(np.concatenate(light)), *map(pa.array, np.concatenate(numbers, axis=1)), folded.take(owner)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _meeting(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of different roots that share a shingle early enough for a similarity of least, by either kind of weights.

    If a pair meets this at one shingle, it does at the first one it shares, so it is made there alone: not where both have one
    and the same shingle among the EARLIER ones before (of those that several roots have).  Where more lie between two that a pair
    shares, it is made again; it is never left out.
    """
    spread = rows.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("key")
    before = Window.partitionBy("node").orderBy("place").rowsBetween(-EARLIER, -1)
    shared = rows.join(spread, "key").withColumn("earlier", F.collect_list("key").over(before)).drop("place")
    own = [x for x in shared.columns if x != "key"]
    a, b = (shared.select("key", *(F.col(x).alias(f"{side}_{x}") for x in own)) for side in ("a", "b"))
    apart = lambda start: F.aggregate(F.zip_with(*(F.slice(f"{s}_map", start, FOLDED // 64) for s in "ab"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    rare, others = apart(1), apart(FOLDED // 64 + 1)
    enough = F.lit(False)
    for k, differing in enumerate((rare * RARE + others, rare + others)):
        rest, both = F.least(*(F.col(f"{s}_weight{k}") - F.col(f"{s}_before{k}") for s in "ab")), F.col(f"a_weight{k}") + F.col(f"b_weight{k}")
        enough |= (rest >= both * (least / (1 + least) - SLACK)) & (differing <= both * ((1 - least) / (1 + least) + SLACK) + SLACK)
    once = ~F.col("b_light") | (F.col("a_node") < F.col("b_node"))  # a pair that is light on both sides, from one of them
    met = a.where("a_light").join(b, "key").where((F.col("a_root") != F.col("b_root")) & once & enough & ~F.arrays_overlap("a_earlier", "b_earlier"))
    return met.select(F.least("a_node", "b_node").alias("centre"), F.greatest("a_node", "b_node").alias("node")).distinct()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only rows whose text is that of the node."""
    for batch in batches:
        nodes = [x for _, texts in c.chunks(batch, "text") for x in nodes_of(*c.word_hashes(texts))]
        yield batch.filter(pa.array([a == b for a, b in zip(nodes, batch.column(0).to_pylist(), strict=True)], pa.bool_()))


_PAIR = "centre binary, node binary"


def _sieve(wanted: DataFrame):
    """A column function that is false only for doc_ids that wanted lacks: SIEVE_BITS for each row of wanted, MAX_SIEVE at most."""
    cells = max(64, min(MAX_SIEVE, 1 << (SIEVE_BITS * wanted.count() - 1).bit_length()))
    cell = lambda x: F.pmod(F.xxhash64(x), F.lit(cells))
    words = wanted.select(cell(F.col("doc_id")).alias("c")).groupBy(F.floor(F.col("c") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("bits"))
    got, bits = words.toArrow(), np.zeros(cells // 64, np.int64)
    bits[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    shared = wanted.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    @F.arrow_udf("boolean")
    def passes(c: pa.Array) -> pa.Array:
        at = c.to_numpy()
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda x: passes(cell(x))


def _links(docs: DataFrame, first: DataFrame, idf, least: float, scratch: c.Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, root) of nodes that links connect, and the links (centre, node)."""
    signatures = scratch.save(docs.select("text").mapInArrow(c.lean(_signatures(idf)), _SIGNATURE).dropDuplicates(["node"]), "signatures")
    told = ("samples", "map", "w0", "w1")
    shorts = signatures.select("node", *told)
    bands = signatures.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = scratch.save(bands.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1").drop("n"), "buckets")
    members = scratch.save(bands.join(buckets, ["band", "key"]), "members")
    reps = first.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def likely(pairs: DataFrame) -> DataFrame:
        one = scratch.save(pairs.join(shorts, "node").select("centre", "node", *(F.col(n).alias(f"{n}_b") for n in told)), "one_side")
        both = one.join(shorts.select(F.col("node").alias("centre"), *(F.col(n).alias(f"{n}_a") for n in told)), "centre").select("centre", "node", *(f"{n}_{x}" for x in "ab" for n in told))
        out = scratch.save(both.mapInArrow(_likely(least), _PAIR), "likely")
        scratch.drop(one)
        return out

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = scratch.save(nodes.join(reps, "node"), "wanted")
        out = scratch.save(docs.where(_sieve(wanted)(F.col("doc_id"))).join(wanted, "doc_id").select("node", "text").mapInArrow(c.lean(_texts), "node binary, text string"), "texts")
        scratch.drop(wanted)
        return out

    def compared(pairs: DataFrame) -> DataFrame:
        """The links among likely pairs, by their texts."""
        texts = texts_of(pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))).distinct())
        one = scratch.save(pairs.join(texts, "node").select("centre", "node", F.col("text").alias("_b")), "with_one")
        both = one.join(texts.select(F.col("node").alias("centre"), F.col("text").alias("_a")), "centre").select("centre", "node", "_a", "_b")
        out = scratch.save(both.mapInArrow(c.lean(_compare(idf)), f"{_PAIR}, similarity double").where(F.col("similarity") >= least).select("centre", "node"), "links")
        scratch.drop(one, texts, pairs)
        return out

    def mixed(roots: DataFrame) -> DataFrame:
        """(band, key, node, root) of the members of buckets of more than one root."""
        rooted = scratch.save(members.join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root")), "rooted_members")
        several = scratch.save(rooted.groupBy("band", "key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("band", "key"), "several")
        out = scratch.save(rooted.join(several, ["band", "key"]), "split")
        scratch.drop(rooted, several)
        return out

    pairs = members.where(F.col("node") != F.col("centre")).select("centre", "node").distinct()
    links = compared(likely(pairs))
    roots = components(links, scratch)
    split = mixed(roots)
    if split.isEmpty():
        return roots, links
    first_root = F.coalesce("centre_root", "centre")
    centres = buckets.join(roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root")), "centre", "left").select("band", "key", first_root.alias("centre_root"))
    outside = split.join(scratch.save(centres, "centre_roots"), ["band", "key"]).where(F.col("root") != F.col("centre_root"))
    outside = scratch.save(outside, "outside")  # so that heads are combined before the shuffle
    heads = scratch.save(outside.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("band", "node"), "node", "root")).alias("h")).select("band", "key", F.col("h.node").alias("centre"), F.col("h.root").alias("head_root")), "heads")
    more = split.join(heads, ["band", "key"]).where(F.col("root") != F.col("head_root")).select("centre", "node").distinct()
    links = links.unionByName(compared(likely(more.join(pairs, ["centre", "node"], "left_anti"))))
    scratch.drop(split, outside, heads, roots)
    roots = components(links, scratch)
    split = scratch.save(mixed(roots).select("node", "root").distinct(), "mixed_nodes")
    if split.isEmpty():
        return roots, links
    texts = texts_of(split.select("node"))
    rows = split.join(texts, "node").select("node", "root", "text")
    rows = scratch.save(rows.mapInArrow(c.lean(_starts(idf, least)), _START), "starts")
    scratch.drop(texts, split, roots)
    met = scratch.save(_meeting(rows, least), "met")
    scratch.drop(rows)
    links = links.unionByName(compared(likely(met)))
    scratch.drop(met, signatures, buckets, members)
    return components(links, scratch), links


def components(links: DataFrame, scratch: c.Scratch) -> DataFrame:
    """(node, root): the least node of each node's connected component, for nodes with links."""
    edges = scratch.save(links.select(F.col("centre").alias("a"), F.col("node").alias("b")).unionByName(links.select(F.col("node").alias("a"), F.col("centre").alias("b"))), "edges")
    labels = scratch.save(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = scratch.save(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root")), "step")
        scratch.drop(labels)
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = scratch.save(step.join(jump, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("old")).alias("moved")), "labels")
        scratch.drop(step)
        if labels.where("moved").isEmpty():
            scratch.drop(edges)
            return labels


def _keyed(docs: DataFrame) -> dict[str, Column]:
    """Two longs that name a row by its doc_id and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    return {"k1": F.xxhash64(doc_id, text), "k2": F.xxhash64(F.lit("near"), text, doc_id)}


def _rows(docs: DataFrame, least: float, scratch: c.Scratch) -> DataFrame:
    """(doc_id, k1, k2, node, root, copy_id, class_id, n_links) of every row of docs; the last four are null where nothing is compared."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select("doc_id", *(x.alias(n) for n, x in _keyed(docs).items()), "text")
    first = scratch.save(keyed.mapInArrow(c.lean(_nodes_and_sketch), _PASS1), "first")
    idf = spark.sparkContext.broadcast(_idf(first))
    labels, links = _links(docs.where("doc_id IS NOT NULL"), first, idf, least, scratch)
    rows = first.where("part IS NULL").select("doc_id", "k1", "k2", "node")
    copies = rows.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("copy_id"))
    rooted = scratch.save(copies.join(labels.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least_of = scratch.save(rooted.groupBy("root").agg(F.min("copy_id").alias("class_id")), "least")
    each = links.select(F.least("centre", "node").alias("centre"), F.greatest("centre", "node").alias("node")).distinct()
    degree = each.select(F.explode(F.array("centre", "node")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = scratch.save(rooted.join(least_of, "root").join(degree, "node", "left").select("node", "root", "copy_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    return rows.join(named, (rows["node"] == named["node"]) & rows["doc_id"].isNotNull(), "left").select("doc_id", "k1", "k2", rows["node"], "root", "copy_id", "class_id", "n_links")


def classes(docs: DataFrame, least: float = SIMILARITY, scratch: c.Scratch | None = None) -> DataFrame:
    """doc_id, copy_id, class_id and n_links of every row of docs (doc_id, text): the least doc_id with the same words, the
    least doc_id of all documents that links connect with it, and the number of other texts that are linked with its own
    (links that were not needed to tell the classes are not counted)."""
    rows = _rows(docs, least, scratch or c.Scratch(docs.sparkSession))
    own = lambda x: F.when(F.col("doc_id").isNotNull(), x)
    return rows.select("doc_id", own(F.coalesce("copy_id", "doc_id")).alias("copy_id"), own(F.coalesce("class_id", "doc_id")).alias("class_id"), own(F.coalesce("n_links", F.lit(0))).alias("n_links"))


def drop_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class, that of the least doc_id, with all its columns; rows with a null doc_id or without words stay.

    A row goes only for a similar text that stays: rows are told apart by doc_id and text, not by doc_id alone.
    """
    scratch = c.Scratch(docs.sparkSession)
    rows = scratch.save(_rows(docs, least, scratch).where("root IS NOT NULL").select("root", F.struct("doc_id", "k1", "k2").alias("r")), "rows")
    best = scratch.save(rows.groupBy("root").agg(F.min("r").alias("best")), "best")
    told = scratch.save(rows.join(best, "root").groupBy("r.k1", "r.k2").agg(F.first(F.col("r") == F.col("best")).alias("stays"), F.count("*").alias("n")), "told")
    scratch.drop(rows, best)
    twice = told.where("stays AND n > 1").select("k1", "k2")
    keyed = c.nested(docs, **_keyed(docs), known=F.col("doc_id").isNotNull())
    known = keyed.where("known")
    out = known.join(told.where("NOT stays OR n > 1").select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(keyed.where("NOT known").select("k1", "k2", "row", "known"))
    if not twice.isEmpty():
        out = out.unionByName(known.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return out.select("row.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(c.table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
