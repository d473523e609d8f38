"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the class [\x20\x09-\x0D]; bytes.split() cuts at exactly these.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def nested(df: DataFrame, **own: Column) -> DataFrame:
    """Every row of df as the struct `row`, beside an operator's own columns: no name of df can clash with these."""
    return df.select(F.struct(*(F.col(f"`{n}`") for n in df.columns)).alias("row"), *(x.alias(n) for n, x in own.items()))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  #: of a batch that Spark hands to a Python worker, unless the session says otherwise
PIECE_BYTES = 4 << 20  #: of what a worker turns into Python objects at a time (a longer text is a piece of its own)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they can import it; and bound the bytes
    of their batches, which Spark's default lets grow to 64 MB a task, where the session doesn't set them itself."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if _BATCH not in spark.conf.getAll and not sc.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(sc, "_quarry_shipped", False) or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp()) / "quarry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._quarry_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or on a local master a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/quarry-scratch"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables in the shared folder, written once and read again, so that a lost executor
    costs no more than the stage it ran.  Tables still needed by a lazy result go at interpreter exit."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.number = spark, f"{scratch_dir(spark)}/quarry-{uuid.uuid4().hex}", itertools.count()
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{next(self.number)}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove saved tables that nothing reads any more; other tables are left alone."""
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                drop_path(self.spark, path)

    def close(self) -> None:
        try:
            drop_path(self.spark, self.root)
        except Exception:  # the session may be gone at exit
            pass


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most PIECE_BYTES, without copies; a longer row is a run of its own."""
    if batch.num_rows <= 1 or batch.nbytes <= PIECE_BYTES:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half))
    yield from pieces(batch.slice(half))


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and what they keep lies beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """A task over Arrow batches that sees them in pieces and gives its memory back when it ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(piece for batch in batches for piece in pieces(batch))
        finally:
            give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def sifted(docs: DataFrame, run: Callable) -> DataFrame:
    """The rows of docs that run (Arrow batches to Arrow batches, text among their columns) lets through, whatever docs' columns are called."""
    plain = docs.toDF(*(n if n == "text" else f"c{i}" for i, n in enumerate(docs.columns)))
    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


class WordHash(dict):
    """word -> 64-bit hash, remembered for up to `limit` words of at most `longest` bytes."""

    def __init__(self, limit: int = 150_000, longest: int = 64) -> None:
        super().__init__()
        self.limit, self.longest = limit, longest

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def plain_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased and ASCII punctuation left out: the words that shingles and features are made of."""
    return text.translate(LOWER_TABLE, PUNCTUATION).split()


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 400_000) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in runs of about most_bytes (a longer text is a run of its own), each with its first row.  Arrays of the words of
    so many bytes stay in a core's cache, which counts where all cores of a machine work at once."""
    texts = as_bytes(batch.column(batch.schema.get_field_index(column)))
    lengths = np.array([len(x) for x in texts])
    start = 0
    while start < len(texts):
        total = np.cumsum(lengths[start:])
        n = max(1, int(np.searchsorted(total, most_bytes, side="right")))
        yield start, texts[start : start + n]
        start += n


_SLICE = 1 << 20  #: bytes that are hashed at a time (a longer word is a slice of its own)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANK.encode())] = True
_LETTERS = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) << U64(1) | U64(1)
_LETTERS[_IS_BLANK] = 0
_P = 0xD1B54A32D192ED03  # odd, so it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of _P and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, 1 << 16), x, U64)])) for x in (_P, pow(_P, -1, 1 << 64))]
    return _POWERS


def _hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of an array of bytes starts, and its hash: the sum of its letters' numbers times powers, mixed."""
    blank = _IS_BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    begin, end = edges[::2], edges[1::2]
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(_LETTERS[raw] * power[: len(raw)], out=sums[1:])
    return begin, mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(U64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the plain words of all texts, one text after the other, and where each text starts (with the end last).

    Whole arrays of bytes are hashed at once: in corpora whose words are mostly rare, a memory of words helps little.
    """
    plain = [t.translate(LOWER_TABLE, PUNCTUATION) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in plain])]).astype(np.int64)
    raw = np.frombuffer(b"\n".join([*plain, b""]), np.uint8)
    begins, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + _SLICE)
        if end < len(raw):  # to the next blank
            step = end
            while step < len(raw) and not (hit := np.flatnonzero(_IS_BLANK[raw[step : step + _SLICE]])).size:
                step += _SLICE
            end = min(len(raw), step + int(hit[0])) if step < len(raw) else len(raw)
        begin, h = _hashed_words(raw[at:end])
        begins.append(begin + at)
        hashes.append(h)
        at = end
    begin = np.concatenate([*begins, np.zeros(0, np.int64)])
    return np.concatenate([*hashes, np.zeros(0, U64)]), np.searchsorted(begin, offsets)


def gathered(lists: list[list[bytes]], hasher: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and where each text starts (with the end last)."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    flat = [w for words in lists for w in words]
    return hasher.of(flat), starts


def shingle_hashes(h: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words inside each text; a text with fewer words (but some) is one shorter run."""
    n = np.diff(starts)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_starts = np.concatenate([[0], np.cumsum(count)])
    padded = np.concatenate([h, np.zeros(width, U64)])
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(out_starts[-1]) - out_starts[owner] + starts[owner]
    end = starts[owner + 1]
    acc = np.zeros(len(at), U64)
    short = n[owner] < width if (n < width).any() else None
    for j in range(width):
        x = padded[at + j]
        if short is not None:
            x = np.where(short & (at + j >= end), U64(j + 1), x)
        acc = mix(acc * U64(0x9E3779B97F4A7C15) + x + U64(j + 1))
    return acc, out_starts
