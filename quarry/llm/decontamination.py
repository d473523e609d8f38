"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document if at least `CONTAINMENT` of its distinct five-word shingles are in it (an item of
fewer than five words is one shingle of all its words).  Items are partitioned by size: class L holds items
of L/2 < n <= L shingles.  For each class a document's shingles are seen through windows of 2 L, one beginning every L: an item's passage lies
whole in one of them, so containment in a document of any length becomes a Jaccard similarity of at least about 0.19
with some window, and each of PROBES MinHash values is a band of its own (a miss has a chance of 0.81 ** PROBES).
Items of at most FEW shingles need all of them at this containment, so they are looked up by one of them, exactly.
Windows of larger classes are minima over those of smaller ones, so all classes cost little more than the first.
Pairs that share a MinHash value are verified by exact containment over the whole document, on the words themselves.

The index goes to the workers in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES of text; a larger benchmark is
searched block after block, so what is broadcast is bounded.  Documents are never shuffled.

Defined results: items without words (null, empty) are never found; texts without words hold no item; repeated items are
found each; repeated documents (ties) are reported each by `find`, null doc_ids as null; very long texts and items are searched
whole; an empty table of documents or items gives an empty result (`drop_contaminated`: all documents); extra columns are not read by
`find` and kept, whatever their names, by `drop_contaminated`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as c

WIDTH = 5
CONTAINMENT = 0.8
PROBES = 48
LEAST_CLASS = 8
FEW = 4  #: shingles of which CONTAINMENT leaves none out
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32_000_000
_MASK = c.U64((1 << 18) - 1)
_R = np.random.default_rng(31)
_XOR = _R.integers(0, 1 << 63, PROBES, dtype=np.uint64)
_MUL = _R.integers(0, 1 << 63, PROBES, dtype=np.uint64) << c.U64(1) | c.U64(1)


def minhash(h: np.ndarray, j: int) -> np.ndarray:
    x = (h ^ _XOR[j]) * _MUL[j]
    return x ^ (x >> c.U64(29))


class Index:
    """By shingle width and size class, the MinHash values of items; and the items' shingles.  Class 0 holds items that are
    found by their least shingle (those of which `least` asks for all shingles)."""

    def __init__(self, items: list[tuple[int, bytes]], least: float = CONTAINMENT) -> None:
        hasher = c.WordHash()
        self.ids, self.words, self.shingles, self.parts = [], [], [], {}
        members: dict[tuple[int, int], list[int]] = {}
        for item, text in items:
            words = c.plain_words(text)
            if not words:
                continue
            width = min(WIDTH, len(words))
            h, _ = c.shingle_hashes(hasher.of(words), np.array([0, len(words)]), width)
            n = len(np.unique(h))
            size = 0 if n <= FEW and n - 1 < least * n else max(LEAST_CLASS, 1 << (len(h) - 1).bit_length())
            members.setdefault((width, size), []).append(len(self.ids))
            self.ids.append(item)
            self.words.append(words)
            self.shingles.append(np.unique(h))
        for (width, size), who in members.items():
            tables = []
            for j in range(PROBES if size else 1):
                values = np.array([minhash(self.shingles[i], j).min() for i in who], c.U64)
                order = np.argsort(values, kind="stable")
                seen = np.zeros(int(_MASK) + 1, bool)
                seen[(values & _MASK).astype(np.int64)] = True
                tables.append((np.packbits(seen, bitorder="little"), values[order], np.array(who)[order]))
            self.parts.setdefault(width, {})[size] = tables

    def candidates(self, width: int, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and items that share a MinHash value in some window; h, starts: the texts' shingles."""
        sizes = self.parts[width]
        n = np.diff(starts)
        some = np.flatnonzero(n > 0)
        texts, items = [], []
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # starts of blocks at each class, as places in the array of the class before
        plans, size, begin, count = [], LEAST_CLASS, starts[:-1][some], n[some]
        per = LEAST_CLASS
        while size <= max(sizes):
            blocks = -(-count // per)
            first = np.concatenate([[0], np.cumsum(blocks)])
            owner = np.repeat(np.arange(len(some)), blocks)
            at = begin[owner] + (np.arange(first[-1]) - first[owner]) * per
            plans.append((size, at, owner, first))
            begin, count, per, size = first[:-1], blocks, 2, size * 2

        def look_up(table: tuple, window: np.ndarray, owner: np.ndarray) -> None:
            seen, values, who = table
            low = (window & _MASK).astype(np.int64)
            hit = np.flatnonzero(seen[low >> 3] >> (low & 7).astype(np.uint8) & 1)
            if len(hit):
                v = window[hit]
                lo, hi = np.searchsorted(values, v), np.searchsorted(values, v, side="right")
                times = hi - lo
                texts.append(np.repeat(some[owner[hit]], times))
                items.append(who[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)])

        if 0 in sizes:
            look_up(sizes[0][0], minhash(h, 0), np.repeat(np.arange(len(some)), n[some]))
        for j in range(PROBES if max(sizes) else 0):
            level = minhash(h, j)
            for size, at, owner, first in plans:
                level = np.minimum.reduceat(level, at)
                if size not in sizes:
                    continue
                window = level.copy()
                same = owner[1:] == owner[:-1]
                window[:-1] = np.where(same, np.minimum(level[:-1], level[1:]), level[:-1])
                look_up(sizes[size][j], window, owner)
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(texts) * len(self.ids) + np.concatenate(items))
        return both // len(self.ids), both % len(self.ids)

    def search(self, texts: list[bytes], hasher: c.WordHash, least: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distinct shingles of the item, those found in the text) of all pairs that hold."""
        lists = [c.plain_words(t) for t in texts]
        h, starts = c.gathered(lists, hasher)
        for width in sorted(self.parts):
            s, s_starts = c.shingle_hashes(h, starts, width)
            at, items = self.candidates(width, s, s_starts)
            for t in np.unique(at):
                own = np.unique(s[s_starts[t] : s_starts[t + 1]])
                exact = None
                for i in items[at == t]:
                    place = np.minimum(np.searchsorted(own, self.shingles[i]), len(own) - 1)
                    if (own[place] == self.shingles[i]).sum() < least * len(self.shingles[i]):
                        continue
                    exact = exact or {tuple(lists[t][k : k + width]) for k in range(len(lists[t]) - width + 1)}
                    wanted = {tuple(self.words[i][k : k + width]) for k in range(len(self.words[i]) - width + 1)}
                    found = len(wanted & exact)
                    if found >= least * len(wanted):
                        yield int(t), int(i), len(wanted), found


def blocks(items: DataFrame, least: float = CONTAINMENT) -> Iterator[Index]:
    """Indexes over the items (item_id, text), each of bounded size."""
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0]
    parts = max(1, math.ceil(total["n"] / (BLOCK_ITEMS / 2)) if total["n"] > BLOCK_ITEMS else 1, math.ceil(total["b"] / (BLOCK_BYTES / 2)) if total["b"] > BLOCK_BYTES else 1)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for k in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield Index([(r["item_id"], (r["text"] or "").encode()) for r in own.collect()], least)


_FOUND = "doc_id long, item_id long, n_shingles int, n_found int, containment double"


def find(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment of every item found in a document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in blocks(items, least):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hasher = shared.value, c.WordHash()
            for batch in batches:
                ids, got = batch.column(0).to_pylist(), []
                for start, texts in c.chunks(batch, "text"):
                    got += [(ids[start + t], index.ids[i], n, k, k / n) for t, i, n, k in index.search(texts, hasher, least)]
                columns = list(zip(*got, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "item_id", "n_shingles", "n_found", "containment"])

        found = rows.mapInArrow(c.lean(run), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    for index in blocks(items, least):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hasher = shared.value, c.WordHash()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for start, texts in c.chunks(batch, "text"):
                    for t, *_ in index.search(texts, hasher, least):
                        clean[start + t] = False
                yield batch.filter(pa.array(clean))

        docs = c.sifted(docs, run)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(c.table(spark, sf_dir, "documents").select("doc_id", "text"), c.table(spark, sf_dir, "benchmark"))


_CLEAN = f"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), '{c.UPPER}', '{c.LOWER}'), '[!-/:-@\\[-`{{-~]', '', 'g'), '[^\\x20\\x09-\\x0D]+')"
OP3_SQL = f"""
WITH item_words AS (SELECT row_number() OVER () AS r, item_id, {_CLEAN} AS w FROM benchmark),
items AS (SELECT *, least({WIDTH}, len(w)) AS k FROM item_words WHERE len(w) > 0),
wanted AS (SELECT DISTINCT r, item_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM items),
sizes AS (SELECT r, item_id, count(*) AS n FROM wanted GROUP BY ALL),
doc_words AS (SELECT row_number() OVER () AS d, doc_id, {_CLEAN} AS w FROM documents),
held AS (
  SELECT DISTINCT d, doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s
  FROM doc_words, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
SELECT held.doc_id, sizes.item_id, CAST(any_value(n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found, count(*) / CAST(any_value(n) AS DOUBLE) AS containment
FROM held JOIN wanted USING (k, s) JOIN sizes USING (r) GROUP BY held.d, held.doc_id, sizes.r, sizes.item_id
HAVING count(*) >= {CONTAINMENT} * any_value(n)
"""
