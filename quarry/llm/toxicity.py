"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of pairs of neighbours, and of pairs with one or
two words between them.  Training is online: one task gets each text of a bounded sample once, keeps its slots
(sorted, delta-coded and compressed) and two arrays of 2**bits floats (per-coordinate sums), and learns epoch after
epoch in a seeded order.  The L1 term leaves few weights; they are collected (at most `2**bits`, in practice some
thousands), broadcast, and each text is scored where it lies: no shuffle of the corpus.

Defined results: a null or empty text has no features and scores the intercept alone (ties in scores are
left as they are); null doc_ids are never trained on and are held out of nothing (held_out is null); labels that are
null, or on rows without a document, are left out; a doc_id with several labels counts as its largest, one with several
texts is learnt from its least text; repeated documents are scored each; a very long text is one text like any other;
without labels of both classes every score is the share of label 1 (0 with no labels); an empty table gives an empty
result.  Extra columns are not read by `score`, and kept by `drop_toxic`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as c

BITS = 24
SAMPLE_PER_CLASS = 6000  #: the bound on labelled rows of each class that training reads (expected number)
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
HOLDOUT = 5
SEED = 1  #: of the order in which epochs see the sample
_GAPS = (1, 2, 3)


def features(h: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of several texts and the text of each, without repeats inside a text."""
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts))
    slots, owners = [c.mix(h) >> c.U64(64 - bits)], [owner]
    for gap in _GAPS:
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = c.mix(h[:-gap][same] * c.U64(0x9E3779B97F4A7C15) + h[gap:][same] + c.U64(gap))
            slots.append(pair >> c.U64(64 - bits))
            owners.append(owner[gap:][same])
    return np.concatenate(slots).astype(np.int64), np.concatenate(owners)


class Ftrl:
    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
        self.bias = self.bias_n = 0.0

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0)

    def learn(self, slots: np.ndarray, label: int) -> None:
        z, n = self.z[slots], self.n[slots]
        w = self.weights(z, n)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + self.bias)))) - label
        self.z[slots] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g
        self.bias_n += g * g
        self.bias -= self.alpha / (self.beta + math.sqrt(self.bias_n)) * g


def _train(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher, held = Ftrl(bits), c.WordHash(), []
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for start, texts in c.chunks(batch, "text"):
                for k, text in enumerate(texts):
                    words = c.plain_words(text)
                    slots = np.unique(features(hasher.of(words), np.array([0, len(words)]), bits)[0])
                    held.append((labels[start + k], len(slots), pa.compress(np.diff(slots, prepend=0).astype(np.int32).tobytes(), codec="lz4", asbytes=True)))
        order = np.random.default_rng(SEED)
        for _ in range(epochs):
            for at in order.permutation(len(held)):
                label, n, data = held[at]
                steps = pa.decompress(data, decompressed_size=4 * n, codec="lz4", asbytes=True)
                model.learn(np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int64), label)
        at = np.flatnonzero(np.abs(model.z) > model.l1)
        w = model.weights(model.z[at], model.n[at]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, model.bias))], names=["slot", "weight"])

    return c.lean(run)


def train(docs: DataFrame, labels: DataFrame, keep=None, bits: int = BITS, per_class: int = SAMPLE_PER_CLASS, epochs: int = EPOCHS) -> dict:
    """Weights learnt from `labels` (doc_id, toxic) of `docs`; keep(doc_id column) says which rows may be learnt from.

    A class with more than per_class rows is thinned by a hash of doc_id to about that many; so a score is the
    probability of label 1 where the classes are as frequent as in the sample, which favours the rarer class.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if keep is not None:
        usable = usable.where(keep(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    share = ones / (ones + zeros) if ones + zeros else 0.0
    if not ones or not zeros:
        return {"bits": bits, "slots": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": 0.0, "constant": share}
    part = F.when(F.col("_label") == 1, min(1.0, per_class / ones)).otherwise(min(1.0, per_class / zeros))
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(order < part)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # at most about 2 * per_class short rows
        .groupBy("doc_id", "_label")
        .agg(F.min("text").alias("text"))  # one text to a sampled doc_id, however often it is repeated
        .repartition(1)
        .sortWithinPartitions(F.xxhash64("doc_id", F.lit("order")), "doc_id")
        .select("text", "_label")
    )
    got = rows.mapInArrow(_train(bits, epochs), "slot long, weight double").toArrow()
    slots, weights = got.column("slot").to_numpy(), got.column("weight").to_numpy()
    bias = float(weights[slots == -1].sum())
    on = slots >= 0
    order = np.argsort(slots[on])
    return {"bits": bits, "slots": slots[on][order], "weights": weights[on][order], "bias": bias, "constant": None}


def margins(model: dict, lists: list[list[bytes]], hasher: c.WordHash, seen: np.ndarray) -> np.ndarray:
    h, starts = c.gathered(lists, hasher)
    slots, owner = features(h, starts, model["bits"])
    hit = seen[slots]
    slots, owner = slots[hit], owner[hit]
    both = np.unique(owner << model["bits"] | slots)
    owner, slots = both >> model["bits"], both & ((1 << model["bits"]) - 1)
    w = model["weights"][np.searchsorted(model["slots"], slots)] if len(slots) else np.zeros(0)
    return np.bincount(owner, w, minlength=len(lists)) + model["bias"]


def _scorer(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = model.value, c.WordHash()
        seen = np.zeros(1 << m["bits"], bool)
        seen[m["slots"]] = True
        for batch in batches:
            score = np.full(batch.num_rows, m["constant"] or 0.0)
            if m["constant"] is None:
                for start, texts in c.chunks(batch, "text"):
                    x = margins(m, [c.plain_words(t) for t in texts], hasher, seen)
                    score[start : start + len(texts)] = 1 / (1 + np.exp(-np.clip(x, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in columns), pa.array(score)], names=[*columns, "score"])

    return c.lean(run)


def score(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row."""
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scorer(shared, ["doc_id"]), "doc_id long, score double")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    model = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model, [])
        for batch in batches:
            for scored in scorer(iter([batch])):
                yield batch.filter(pa.array(scored.column(0).to_numpy() < threshold))

    return c.sifted(docs, run)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HOLDOUT)) == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents, learnt from labels of rows not held out."""
    docs = c.table(spark, sf_dir, "documents")
    model = train(docs, c.table(spark, sf_dir, "labels"), keep=lambda x: ~held_out(x))
    return score(spark, docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
