"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training counts words and pairs of words of the whole training text: each task counts 64-bit hashes (48 bits of them
for pairs) and ships sorted, delta-coded blocks by hash range, so that the shuffle holds a few bytes for each
distinct n-gram of a task.  Each range is merged once; it yields the exact counts of words and one segment of the
filter.  The number of ranges follows from the bytes of training text (SHARD_BYTES a range), not from the cluster, so that scores
don't depend on its settings and a range's task has the same work at every size.  A count of level q (count >= BASE ** (q - 1))
is stored as q entries of BITS_PER_ENTRY bits; a lookup probes levels until one is missing, so it never falls below the
quantised count.  The filter grows with the entries, without a cap.

A filter of up to BROADCAST_BYTES is broadcast and probed where the texts lie.  A larger one stays in its segments: each
piece of text sends its distinct keys, sorted, to the segments of their ranges, and the levels found come back by piece.  Both ways
read the same bits, so they give the same scores.

The model interpolates the pair estimate (lower quantised count of the pair over upper quantised count of the first
word) with the smoothed word estimate; the weight of each level of the first word's count is fitted by expectation
maximisation on all tokens of the training text, each taken out of its own counts.  A token enters by three levels
(word before, pair, word), so that the fit needs no more than how often each triple of levels occurs.  Levels are looked up once and
kept with the texts' other figures (two bytes a token); the fit and the scores are made from them.

The base score needs exact counts of all words.  Counts of the HOT_WORDS most frequent words are broadcast; all other
words of a text (few of its tokens, and none of them frequent in the training text) are joined with the
counts by hash.  Words are told apart by 64-bit hashes.

Defined results: a null or empty text is the end token alone; a null doc_id is not held out and is learnt from
(held_out false); repeated rows (ties) are learnt from and scored each; a very long text is counted and scored whole; with no
training text all counts are 0 and each token has probability 1 in the base; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as c

HOLDOUT = 10
ALPHA = 0.1
BASE = 1.5
SHARD_BYTES, LEAST_SHARDS = 32 << 20, 16  #: training text to a range of hashes, and the least number of ranges
BROADCAST_BYTES = 128 << 20  #: of a filter that is broadcast; a larger one is asked by range
BITS_PER_ENTRY = 8
HOT_WORDS = 250_000
FLUSH = 4_000_000  #: n-grams that a counting task holds before it ships a block
MAX_LEVEL = 80
RUN_TOKENS = 100_000  #: of texts whose levels are taken at a time
END = b"\n"
_PAIR = c.U64(0x9E3779B97F4A7C15)
_CUT = c.U64(0xFFFFFFFFFFFF0000)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HOLDOUT)) == 0, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(c.LOWER_TABLE).split()


def pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return c.mix(before * _PAIR + word) & _CUT


def level_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(MAX_LEVEL, 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9)).astype(np.int64) * (count > 0)


LOW = np.concatenate([[0.0], np.ceil(BASE ** np.arange(MAX_LEVEL) - 1e-9)])
HIGH = np.concatenate([[0.0], np.maximum(LOW[1:], np.ceil(BASE ** np.arange(1, MAX_LEVEL + 1) - 1e-9) - 1)])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def pack(a: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, place by place, compressed."""
    return pa.compress(a.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(c.U64).reshape(n)


def pack_places(a: np.ndarray) -> bytes:
    return pa.compress(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpack_places(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(np.uint32).reshape(n)


def with_ends(lists: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All tokens, each text's words followed by the end token, and where each text starts (with the end last)."""
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lists])]).astype(np.int64)
    flat: list[bytes] = []
    for x in lists:
        flat += x
        flat.append(END)
    return flat, starts


def _shifted(h: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; the end token before a text's first."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[starts[:-1]] = end
    return out


class _Counter:
    def __init__(self, shards: int) -> None:
        self.bits, self.raw, self.done, self.held = int(math.log2(shards)), {1: [], 2: []}, {1: [], 2: []}, 0

    def add(self, order: int, keys: np.ndarray) -> None:
        self.raw[order].append(keys)
        self.held += len(keys)
        if sum(map(len, self.raw[order])) > 2_000_000:
            self._squeeze(order)

    def _squeeze(self, order: int) -> None:
        if self.raw[order]:
            keys, counts = np.unique(np.concatenate(self.raw[order]), return_counts=True)
            self.raw[order] = []
            self.done[order].append((keys, counts.astype(c.U64)))
        self.held = sum(len(k) for x in self.done.values() for k, _ in x)

    def ship(self) -> Iterator[pa.RecordBatch]:
        for order in (1, 2):
            self._squeeze(order)
            if not self.done[order]:
                continue
            keys, counts = summed(np.concatenate([k for k, _ in self.done[order]]), np.concatenate([n for _, n in self.done[order]]))
            self.done[order] = []
            edges = np.searchsorted(keys, (np.arange(1 << self.bits, dtype=c.U64) << c.U64(64 - self.bits)) if self.bits else np.zeros(1, c.U64))
            edges = np.append(edges, len(keys))
            for s in range(1 << self.bits):
                k, n = keys[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]
                if len(k):
                    block = [s, order, len(k), pack(np.diff(k, prepend=c.U64(0))), pack(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(block, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "order", "n", "keys", "counts"])
        self.held = 0


def _count(shards: int):
    @c.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counter = c.WordHash(), _Counter(shards)
        for batch in batches:
            for _, texts in c.chunks(batch, "text"):
                flat, starts = with_ends([words_of(t) for t in texts])
                h = hasher.of(flat)
                counter.add(1, h)
                counter.add(2, pairs(_shifted(h, starts, hasher[END]), h))
                if counter.held > FLUSH:
                    yield from counter.ship()
        yield from counter.ship()

    return run


def probes(keys: np.ndarray, level: int, n: int) -> Iterator[np.ndarray]:
    for i in range(n):
        yield c.mix(keys ^ c.mix(np.full(1, 1000 * level + i + 1, c.U64))[0])


PROBES = 4


def segment(keys: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> tuple[np.ndarray, int]:
    """The bits that hold the counts, and their number."""
    levels = level_of(counts.astype(np.float64))
    bits = max(64, bits_per_entry * int(levels.sum()))
    on = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= level], levels[levels >= level]
        for at in probes(keys, level, PROBES):
            on[at % c.U64(bits)] = True
    return np.packbits(on, bitorder="little"), bits


_MERGED = "order int, key long, count long, shard int, bits long, data binary"


def _merge(bits_per_entry: int):
    """The counts of the words of a range, and the filter's segment, from all blocks of the range."""

    def run(table: pa.Table) -> pa.Table:
        order, n, packed = table.column("order").to_numpy(), table.column("n").to_numpy(), (table.column("keys"), table.column("counts"))
        keys, counts = {}, {}
        for o in (1, 2):
            parts = [(np.zeros(0, c.U64), np.zeros(0, c.U64))]
            for i in np.flatnonzero(order == o):
                k, times = (unpack(x[int(i)].as_py(), int(n[i])) for x in packed)
                parts.append((np.cumsum(k), times))
                if sum(len(k) for k, _ in parts) > 2 * len(parts[0][0]) + 500_000:
                    parts = [summed(*map(np.concatenate, zip(*parts, strict=True)))]
            keys[o], counts[o] = summed(*map(np.concatenate, zip(*parts, strict=True)))
        data, bits = segment(np.concatenate([keys[1], keys[2]]), np.concatenate([counts[1], counts[2]]), bits_per_entry)
        words, none = len(keys[1]), pa.nulls
        out = pa.table(
            {
                "order": pa.array([1] * words + [0], pa.int32()),
                "key": pa.array(np.append(keys[1].view(np.int64), 0)),
                "count": pa.array(np.append(counts[1].astype(np.int64), 0)),
                "shard": pa.concat_arrays([none(words, pa.int32()), pa.array([table.column("shard")[0].as_py()], pa.int32())]),
                "bits": pa.concat_arrays([none(words, pa.int64()), pa.array([bits])]),
                "data": pa.concat_arrays([none(words, pa.binary()), pa.array([data.tobytes()], pa.binary())]),
            }
        )
        c.give_back()
        return out

    return run


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> c.U64(64 - (shards.bit_length() - 1))).astype(np.int64)


class Filter:
    """The log-frequency Bloom filter: level(keys) is at least each key's quantised count's level."""

    def __init__(self, shards: int, segments: list[tuple[int, int, bytes]]) -> None:
        self.shards, self.bits, self.start = shards, np.zeros(shards, c.U64), np.zeros(shards, np.int64)
        parts, at = [], 0
        for shard, bits, data in sorted(segments, key=lambda x: x[0]):
            self.bits[shard], self.start[shard] = bits, at
            parts.append(np.frombuffer(data, np.uint8))
            at += len(data)
        self.data = np.concatenate([*parts, np.zeros(1, np.uint8)])

    def _holds(self, keys: np.ndarray, level: int) -> np.ndarray:
        shard = shard_of(keys, self.shards)
        bits, start = self.bits[shard], self.start[shard]
        ok = bits > 0
        for at in probes(keys, level, PROBES):
            at = (at % np.maximum(bits, c.U64(1))).astype(np.int64)
            ok &= (self.data[start + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return ok

    def level(self, keys: np.ndarray) -> np.ndarray:
        out, on = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level in range(1, MAX_LEVEL + 1):
            on = on[self._holds(keys[on], level)]
            if not len(on):
                break
            out[on] = level
        return out


class _Words(dict):
    """word -> a number within this task; what is known of a word is looked up once for many texts."""

    def __init__(self, model: dict, limit: int = 150_000) -> None:
        super().__init__()
        self.model, self.limit = model, limit
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[int] = []
        self.hash, self.level, self.hot = np.zeros(0, c.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(c.xxhash.xxh64_intdigest(word))
        return n

    def of(self, flat: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.reset()
        ids = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        if self.fresh:
            h, m = np.array(self.fresh, c.U64), self.model
            self.fresh = []
            hot = np.zeros(len(h), np.int64)
            if len(m["hot_keys"]):
                at = np.minimum(np.searchsorted(m["hot_keys"], h), len(m["hot_keys"]) - 1)
                hot = np.where(m["hot_keys"][at] == h, m["hot_counts"][at], 0)
            level = m["filter"].level(h) if m["filter"] else np.zeros(len(h), np.int64)
            self.hash, self.level, self.hot = np.concatenate([self.hash, h]), np.concatenate([self.level, level]), np.concatenate([self.hot, hot])
        return ids


class _Tokens:
    """The tokens of some texts: numbers of words and of the words before them, and where each text starts."""

    def __init__(self, texts: list[bytes], words: _Words) -> None:
        flat, self.starts = with_ends([words_of(t) for t in texts])
        ids = words.of([*flat, END])
        self.ids, self.words = ids[:-1], words
        self.before = _shifted(self.ids, self.starts, int(ids[-1]))
        self.pairs = pairs(words.hash[self.before], words.hash[self.ids])

    def levels(self) -> np.ndarray:
        """Levels of the words before, of the pairs and of the words, by the broadcast filter."""
        return np.stack([self.words.level[self.before], self.words.model["filter"].level(self.pairs), self.words.level[self.ids]])


def _estimates(m: dict, levels: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pair and word estimates; less: occurrences taken out of every count."""
    before, pair, word = levels
    both = np.maximum(LOW[pair] - less, 0) / np.maximum(HIGH[before] - less, 1)
    alone = (np.maximum(LOW[word] - less, 0) + ALPHA) / (m["tokens"] - less + ALPHA * (m["words"] + 1))
    return np.minimum(both, 1.0), np.minimum(alone, 1.0)


def log_probabilities(m: dict, levels: np.ndarray) -> np.ndarray:
    pair, word = _estimates(m, levels)
    weight = m["weights"][levels[0]]
    return np.log10(np.maximum(weight * pair + (1 - weight) * word, 1e-300))


def fitted(m: dict, levels: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The weight of pairs for each level of the word before, by expectation maximisation over tokens of these levels, each so many times."""
    weights = np.full(MAX_LEVEL + 1, 0.1)
    pair, word = _estimates(m, levels, 1)
    level = levels[0]
    total = np.bincount(level, times, minlength=MAX_LEVEL + 1)
    for _ in range(30):
        w = weights[level]
        got = times * (w * pair / np.maximum(w * pair + (1 - w) * word, 1e-300))
        weights = np.clip((np.bincount(level, got, minlength=MAX_LEVEL + 1) + 0.1) / (total + 1), 1e-6, 0.999)
    return weights if len(times) else np.full(MAX_LEVEL + 1, 0.1)


_DOC = "uid long, doc_id long, held_out boolean, learnt boolean, n_tokens long, hot_known long, hot_base double, rare array<struct<key:long,n:int>>, levels binary"
_DOC_NAMES = ["uid", "doc_id", "held_out", "learnt", "n_tokens", "hot_known", "hot_base", "rare", "levels"]
_RARE = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32())]))


def _two_by_text(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pair's and the word's level of each token are, in bytes that hold each text's pairs and then its words."""
    ends = np.cumsum(n)
    pair = np.arange(ends[-1] if len(n) else 0) + np.repeat(ends - n, n)
    return pair, pair + np.repeat(n, n)


def _kept(pair: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.Array:
    """The levels of each text's pairs and words, as bytes."""
    flat = np.empty(2 * len(pair), np.uint8)
    for at, x in zip(_two_by_text(n), (pair, word), strict=True):
        flat[at] = x
    offsets = np.concatenate([[0], 2 * np.cumsum(n)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of texts of about RUN_TOKENS (a longer text is a run of its own), where each text starts, and levels of words before,
    pairs and words."""
    lengths, row = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy(), 0
    while row < len(lengths):
        part = batch.slice(row, max(1, int(np.searchsorted(np.cumsum(lengths[row:]), RUN_TOKENS, side="right"))))
        n = lengths[row : row + part.num_rows]
        row += part.num_rows
        flat = np.frombuffer(b"".join(part.column(part.schema.get_field_index("levels")).to_pylist()), np.uint8)
        pair, word = (flat[at].astype(np.int64) for at in _two_by_text(n))
        ends = np.cumsum(n)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[ends - n] = word[ends - 1]  # the end token comes before a text's first
        yield part, ends - n, np.stack([before, pair, word])


def _doc_rows(m: dict, part: pa.RecordBatch, t: _Tokens, levels: pa.Array) -> pa.RecordBatch:
    """What is known of the texts of part (uid, doc_id, held_out, learnt) before rare words are joined."""
    hot = t.words.hot[t.ids]
    base = np.where(hot > 0, np.log10((hot + ALPHA) / (m["tokens"] + ALPHA * (m["words"] + 1))), 0.0)
    n, first = np.diff(t.starts), t.starts[:-1]
    owner, key = np.repeat(np.arange(len(n)), n)[hot == 0], t.words.hash[t.ids[hot == 0]].view(np.int64)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    offsets = np.searchsorted(owner[new], np.arange(len(n) + 1))
    rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(key[new]), pa.array(times, pa.int32())], names=["key", "n"]))
    return pa.RecordBatch.from_arrays(
        [*(part.column(k) for k in range(4)), pa.array(n), pa.array(np.add.reduceat((hot > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), rare.cast(_RARE), levels],
        names=_DOC_NAMES,
    )


def _look(model):
    @c.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words = _Words(m)
        for batch in batches:
            for start, texts in c.chunks(batch, "text"):
                t = _Tokens(texts, words)
                yield _doc_rows(m, batch.slice(start, len(texts)), t, _kept(m["filter"].level(t.pairs), words.level[t.ids], np.diff(t.starts)))

    return run


_ASKED = "chunk long, shard int, n long, data binary, docs binary"


def _ask(model):
    """From each piece of text a row (shard -1) with its documents and the places of its tokens' words and pairs, and for each
    range of hashes a row with the distinct keys that it holds, in order; all packed."""

    @c.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words = _Words(m)
        for batch in batches:
            for start, texts in c.chunks(batch, "text", 2_000_000):
                part, t = batch.slice(start, len(texts)), _Tokens(texts, words)
                docs = _doc_rows(m, part, t, pa.nulls(len(texts), pa.binary()))
                keys, places = np.unique(np.concatenate([t.pairs, words.hash[t.ids]]), return_inverse=True)  # the word before is a word, too
                edges = np.searchsorted(shard_of(keys, m["shards"]), np.arange(m["shards"] + 1))
                held = np.flatnonzero(np.diff(edges))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(docs)
                rows = [(-1, len(places), pack_places(places), sink.getvalue().to_pybytes())]
                rows += [(int(k), int(edges[k + 1] - edges[k]), pack(np.diff(keys[edges[k] : edges[k + 1]], prepend=c.U64(0))), None) for k in held]
                shard, n, data, docs = zip(*rows, strict=True)
                chunk = pa.array(np.full(len(rows), part.column(0)[0].as_py()))
                yield pa.RecordBatch.from_arrays([chunk, pa.array(shard, pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary()), pa.array(docs, pa.binary())], names=["chunk", "shard", "n", "data", "docs"])

    return run


_ANSWERED = "chunk long, shard int, n long, data binary, docs binary"


def _answer(shards: int):
    """Rows come by shard, its segment (chunk null) first; the keys asked for stream past it and become levels.  Rows of pieces
    (shard -1) pass through."""

    @c.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = found = None
        for batch in batches:
            out = []
            for chunk, shard, n, data, docs in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if shard < 0:
                    out.append((chunk, shard, n, data, docs))
                elif chunk is None:
                    held, found = shard, Filter(shards, [(shard, n, data)])
                elif shard == held:
                    out.append((chunk, shard, n, found.level(np.cumsum(unpack(data, n))).astype(np.uint8).tobytes(), None))
                else:  # a range without training text
                    out.append((chunk, shard, n, bytes(n), None))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "shard", "n", "data", "docs"])

    return run


@c.lean
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each piece with their levels; rows come by piece, its own (shard -1) first, then levels in order."""
    docs, places, levels = None, None, []

    def whole():
        rows = pa.ipc.open_stream(docs).read_next_batch()
        pair, word = np.frombuffer(b"".join(levels), np.uint8)[places].reshape(2, -1)
        return rows.set_column(len(_DOC_NAMES) - 1, "levels", _kept(pair, word, rows.column(_DOC_NAMES.index("n_tokens")).to_numpy()))

    for batch in batches:
        for shard, n, data, own in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
            if shard >= 0:
                levels.append(data)
                continue
            if docs is not None:
                yield whole()
            docs, places, levels = own, unpack_places(data, n), []
    if docs is not None:
        yield whole()


def _finish(model):
    @c.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, starts, levels in _runs(batch):
                score = np.add.reduceat(log_probabilities(model.value, levels), starts)
                yield part.set_column(part.num_columns - 1, "score", pa.array(score))

    return run


@c.lean
def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each triple of levels occurs in a task."""
    side = MAX_LEVEL + 1
    times = np.zeros(side**3, np.int64)
    for batch in batches:
        for _, _, (before, pair, word) in _runs(batch):
            times += np.bincount((before * side + pair) * side + word, minlength=side**3)
    code = np.flatnonzero(times)
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times[code])], names=["code", "times"])


def _weights(seen: DataFrame, model: dict) -> np.ndarray:
    """The weights fitted to all tokens of the rows (learnt, n_tokens, levels) that were learnt from; (MAX_LEVEL + 1) ** 3 rows at most come to the driver."""
    each = seen.where("learnt").select("n_tokens", "levels").mapInArrow(_triples, "code long, times long")
    got = each.groupBy("code").agg(F.sum("times").alias("times")).orderBy("code").toArrow()
    levels = np.stack(np.unravel_index(got.column("code").to_numpy(), (MAX_LEVEL + 1,) * 3))
    return fitted(model, levels, got.column("times").to_numpy())


def _looked_up(rows: DataFrame, shared, model: dict) -> DataFrame:
    """Pieces of rows (uid, doc_id, held_out, learnt, text) with the levels that the filter's segments hold, by piece.

    One shuffle brings keys to the segments of their ranges (and pieces to any task), one brings levels back to their pieces.
    """
    none = F.lit(None)
    segments = model["segments"].select(none.cast("long").alias("chunk"), "shard", F.col("bits").alias("n"), "data", none.cast("binary").alias("docs"))
    route = F.when(F.col("shard") < 0, F.xxhash64("chunk")).otherwise(F.col("shard"))
    asked = segments.unionByName(rows.mapInArrow(_ask(shared), _ASKED)).withColumn("route", route)
    by_shard = asked.repartition("route").sortWithinPartitions("route", "shard", F.col("chunk").asc_nulls_first()).drop("route")
    return by_shard.mapInArrow(_answer(model["shards"]), _ANSWERED).repartition("chunk").sortWithinPartitions("chunk", "shard")


def _seen(docs: DataFrame, learnt: Column, model: dict) -> DataFrame:
    """The figures (_DOC) of every row of docs (doc_id, text), with the levels of its tokens."""
    doc_id = F.col("doc_id")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), doc_id.cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.coalesce(learnt, F.lit(False)).alias("learnt"), "text")
    shared = _shared(docs.sparkSession, model)
    return rows.mapInArrow(_look(shared), _DOC) if model["filter"] else _looked_up(rows, shared, model).mapInArrow(_gather, _DOC)


def _counted(docs: DataFrame, keep: Column, scratch: c.Scratch, broadcast_bytes: int, bits_per_entry: int) -> tuple[dict, DataFrame]:
    """The model before its weights are fitted, and the exact counts (key, count) of words that are not hot."""
    learn = docs.where(keep)
    size = learn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0]["b"]
    shards = max(LEAST_SHARDS, 1 << max(0, (-(-size // SHARD_BYTES) - 1)).bit_length())
    blocks = learn.select("text").mapInArrow(_count(shards), "shard int, order int, n long, keys binary, counts binary")
    merged = scratch.save(blocks.groupBy("shard").applyInArrow(_merge(bits_per_entry), _MERGED), "counts")
    counts = merged.where("order = 1").select("key", "count")
    bucket = F.floor(F.log2(F.col("count").cast("double")) * 4).cast("int")
    sizes = {r["b"]: (r["n"], r["t"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.sum("count").alias("t")).collect()}
    held, least = 0, None
    for b in sorted(sizes, reverse=True):  # whole buckets of counts, from the top
        held += sizes[b][0]
        if held > HOT_WORDS:
            break
        least = b
    hot = counts.where(bucket >= least).toArrow() if least is not None else pa.table({"key": pa.array([], pa.int64()), "count": pa.array([], pa.int64())})
    keys = hot.column("key").to_numpy().view(c.U64)
    order = np.argsort(keys)
    segments = merged.where("order = 0").select("shard", "bits", "data")
    model = {
        "words": sum(n for n, _ in sizes.values()),
        "tokens": sum(t for _, t in sizes.values()),
        "hot_keys": keys[order],
        "hot_counts": hot.column("count").to_numpy()[order],
        "shards": shards,
        "filter": None,
        "segments": segments,
    }
    total = segments.agg(F.coalesce(F.sum("bits"), F.lit(0)).alias("b")).collect()[0]["b"]
    if total <= 8 * broadcast_bytes:
        got = segments.toArrow()
        model["filter"] = Filter(shards, [(s.as_py(), b.as_py(), d.as_buffer()) for s, b, d in zip(*(got.column(k) for k in ("shard", "bits", "data")), strict=True)])  # copied once
        del got
        c.give_back()
    rare = counts if least is None else counts.where(bucket < least)
    return model, rare


def train(docs: DataFrame, keep: Column, scratch: c.Scratch, broadcast_bytes: int = BROADCAST_BYTES, bits_per_entry: int = BITS_PER_ENTRY) -> tuple[dict, DataFrame]:
    """The model learnt from the rows of docs (doc_id, text) where keep holds, and the exact counts (key, count) of words."""
    model, rare = _counted(docs, keep, scratch, broadcast_bytes, bits_per_entry)
    model["weights"] = _weights(_seen(docs.where(keep), F.lit(True), model), model)
    return model, rare


def _shared(spark: SparkSession, model: dict):
    return spark.sparkContext.broadcast({k: v for k, v in model.items() if k != "segments"})


def score(docs: DataFrame, model: dict, rare: DataFrame, scratch: c.Scratch) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text)."""
    return _scored(scratch.save(_seen(docs, F.lit(False), model), "seen"), model, rare)


def train_and_score(docs: DataFrame, keep: Column, scratch: c.Scratch, broadcast_bytes: int = BROADCAST_BYTES, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """What `score` gives for docs by the model that `train` learns from those where keep holds; levels are looked up once for both."""
    model, rare = _counted(docs, keep, scratch, broadcast_bytes, bits_per_entry)
    seen = scratch.save(_seen(docs, keep, model), "seen")
    model["weights"] = _weights(seen, model)
    return _scored(seen, model, rare)


def _scored(seen: DataFrame, model: dict, rare: DataFrame) -> DataFrame:
    needed = seen.sparkSession.sparkContext.broadcast({k: model[k] for k in ("tokens", "words", "weights")})
    told = ("uid", "doc_id", "held_out", "n_tokens", "hot_known", "hot_base")
    scored = seen.select(*told, "levels").mapInArrow(_finish(needed), "uid long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_base double, score double")
    bottom = model["tokens"] + ALPHA * (model["words"] + 1)
    tokens = seen.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.key").alias("key"), F.col("r.n").alias("n"))
    found = F.coalesce("count", F.lit(0))
    sums = (
        tokens.join(rare, "key", "left")
        .groupBy("uid")
        .agg(F.sum(F.col("n") * F.log10((found + ALPHA) / bottom)).alias("rare_base"), F.sum(F.when(found > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    )
    return scored.join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = c.table(spark, sf_dir, "documents").select("doc_id", "text"), c.Scratch(spark)
    return train_and_score(docs, ~held_out(F.col("doc_id")), scratch)
