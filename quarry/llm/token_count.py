"""Token counts of greedy longest-match word pieces, by a linear automaton.

A text is cut at ASCII white space; each word, with one blank put before it, is cut into the longest pieces of a
byte vocabulary from left to right.  The vocabulary's trie gets failure links: where a node's string cannot go on, it is
known beforehand how many pieces are popped from its front and at which node the rest of it stands.  So a word is
read once, byte by byte, and only counts are added: no piece is ever built.  The vocabulary holds all single
bytes (they are added if it does not), so every word can be cut.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter.  It is read by the driver, which builds the
automaton once and broadcasts it as arrays, after a check of its size (MAX_VOCABULARY tokens).  Counts of words are
remembered by each task for up to `MEMORY` words of at most `LONGEST` bytes, which changes nothing but the time.

Defined results: a null or empty text has 0 words, 0 tokens and 0 bytes; repeated rows (ties) are counted each; a null doc_id
is counted like any other; a very long text is counted whole, a very long word without being remembered; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as c

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 2_000_000
MEMORY, LONGEST = 150_000, 64


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    if len(pieces) > MAX_VOCABULARY:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY} tokens")
    return pieces


class Automaton:
    """go[node * 256 + byte] -> node; back[node] and pops[node]: where the rest of the node's string stands, and how many
    pieces go before.  Node 0 is the root; back is -1 for the root only, as each byte is a piece."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        go: dict[int, int] = {}
        is_piece, depth = [False], [0]
        parents: list[tuple[int, int]] = [(0, 0)]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            node = 0
            for b in piece:
                nxt = go.get(node << 8 | b)
                if nxt is None:
                    nxt = go[node << 8 | b] = len(is_piece)
                    is_piece.append(False)
                    depth.append(depth[node] + 1)
                    parents.append((node, b))
                node = nxt
            if node:
                is_piece[node] = True
        self.back, self.pops, self.go = [-1] * len(is_piece), [0] * len(is_piece), go
        for node in sorted(range(1, len(is_piece)), key=depth.__getitem__):
            if is_piece[node]:
                self.back[node], self.pops[node] = 0, 1
                continue
            parent, b = parents[node]
            at, popped = self.back[parent], self.pops[parent]
            while go.get(at << 8 | b) is None:  # ends at the root, which has all bytes
                at, popped = self.back[at], popped + self.pops[at]
            self.back[node], self.pops[node] = go[at << 8 | b], popped

    def __getstate__(self) -> tuple[np.ndarray, ...]:
        return np.fromiter(self.go, np.int64, len(self.go)), np.fromiter(self.go.values(), np.int32, len(self.go)), np.array(self.back, np.int32), np.array(self.pops, np.int32)

    def __setstate__(self, arrays: tuple[np.ndarray, ...]) -> None:
        keys, nodes, back, pops = (x.tolist() for x in arrays)
        self.go, self.back, self.pops = dict(zip(keys, nodes, strict=True)), back, pops

    def count(self, word: bytes) -> int:
        go, back, pops, node, n = self.go, self.back, self.pops, 0, 0
        for b in word:
            nxt = go.get(node << 8 | b)
            while nxt is None:
                n += pops[node]
                node = back[node]
                nxt = go.get(node << 8 | b)
            node = nxt
        while node:
            n += pops[node]
            node = back[node]
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = n
        return n


def count_tokens(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_words and n_tokens of every row of docs (doc_id, text)."""
    shared = spark.sparkContext.broadcast(Automaton(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(shared.value)
        for batch in batches:
            texts = c.as_bytes(batch.column(1))
            out = np.zeros((3, len(texts)), np.int64)
            for i, text in enumerate(texts):
                words = text.split()
                out[:, i] = len(text), len(words), sum(map(counts.__getitem__, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(c.lean(run), "doc_id long, n_bytes long, n_words long, n_tokens long")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, c.table(spark, sf_dir, "documents"))
