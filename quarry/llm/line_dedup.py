"""Line deduplication from range-partitioned line hashes and per-document keep bitmaps.

A document's lines are its text split at \\n.  A line's key is the line with ASCII white space stripped at both
ends and A-Z lower-cased; keys travel as two 64-bit hashes, never as text.  The occurrences (hash, document,
position) are range-partitioned by hash with a secondary sort by document and position; hashes are uniform, so equal ranges
need no sampling pass over the texts.  A pass over that order streams each document's first occurrences of a key, and these are
counted into the number of documents that hold it.  A salt taken from the document joins the range in the partitioning, so
that a key with a large share of all lines is spread over many partitions and its counts are added up afterwards.

Occurrences of common keys are found by a join of two written tables, so that the common keys are broadcast where they are
few, and adaptive execution splits a hot key where they aren't.  What comes back to a document is a sparse keep bitmap (one
62-bit word for each 62 lines that hold a dropped one), joined by document key; a sieve of bits over these documents keeps the
texts of others out of the shuffle (as long as SIEVE_DOCS or fewer lose lines; beyond that all texts meet the bitmaps).

Defined results: a null or empty text has one empty line; an empty key (fewer than `min_chars` code points) is
never dropped; rows that repeat both doc_id and text count as one document and each get the same result (so do null
doc_ids, told apart by text); a text whose lines all go becomes empty; a very long text costs time in proportion to its lines;
ties (one key in several lines of a document) count once; an empty table gives an empty result.  Extra columns are kept, whatever
their names, by `apply`.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import common as c

MIN_DOCS = 10
MIN_CHARS = 1
WORD = 62  #: lines to a word of a bitmap
RANGE_BITS, SALTS = 16, 64
SIEVE_BITS, SIEVE_DOCS = 16, 1 << 22


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(c.BLANK)), c.UPPER, c.LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def doc_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs that name a document: rows with the same doc_id and text are the same one."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull(), t), F.xxhash64(F.lit("line"), t, doc_id.cast("string"))]


def keep_bitmaps(docs: DataFrame, scratch: c.Scratch, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(d1, d2, keep array<struct<word int, bits bigint>>) of the documents of docs (doc_id, text) that lose lines.

    A key found in at least min_docs documents loses all its lines; with keep_first its first line, in the
    order of document keys and positions, stays.
    """
    d1, d2 = doc_key(F.col("doc_id"), F.col("text"))
    key = line_key(F.col("line"))
    order = ["h1", "h2", "d1", "d2", "pos"]
    occurrences = (
        docs.select(d1.alias("d1"), d2.alias("d2"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), F.pmod("d1", F.lit(SALTS)).alias("salt"), "d1", "d2", "pos", F.length(key).alias("n"))
        .where(F.col("n") >= min_chars)
        .withColumn("range", F.shiftright("h1", 64 - RANGE_BITS))
        .repartition("range", "salt")
        .sortWithinPartitions("range", "salt", *order)
    )
    one = Window.partitionBy("range", "salt").orderBy(*order)
    before = F.lag(F.struct("h1", "h2", "d1", "d2")).over(one)
    marked = occurrences.withColumn("is_first", ~before.eqNullSafe(F.struct("h1", "h2", "d1", "d2")))
    lines = scratch.save(marked.select(*order, "is_first"), "lines")
    common = lines.where("is_first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2", "pos")).alias("origin")).where(F.col("n") >= min_docs)
    common = scratch.save(common.select("h1", "h2", *(["origin"] if keep_first else [])), "common")
    dropped = lines.join(common, ["h1", "h2"])
    if keep_first:
        dropped = dropped.where(F.struct("d1", "d2", "pos") != F.col("origin"))
    words = dropped.groupBy("d1", "d2", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
    keep = F.struct("word", F.expr(f"~bits & {(1 << WORD) - 1}L").alias("bits"))
    bitmaps = scratch.save(words.groupBy("d1", "d2").agg(F.collect_list(keep).alias("keep")), "bitmaps")
    scratch.drop(lines, common)
    return bitmaps


def _dropped(keep: Column) -> Column:
    """Positions of a bitmap's dropped lines."""
    off = lambda w: F.filter(F.sequence(w["word"] * WORD, w["word"] * WORD + (WORD - 1)), lambda i: F.getbit(w["bits"], i % WORD) == 0)
    return F.flatten(F.transform(keep, off))


def _sieve(bitmaps: DataFrame, n: int, scratch: c.Scratch) -> tuple[DataFrame, int]:
    """(cell, cell_bits) of a bit set over the documents of bitmaps, and its size."""
    size = max(64, SIEVE_BITS * n)
    at = F.pmod("d1", F.lit(size))
    words = bitmaps.select(F.floor(at / 64).alias("cell"), F.pmod(at, F.lit(64)).cast("int").alias("bit")).groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("cell_bits"))
    return scratch.save(words, "sieve"), size


def with_kept(docs: DataFrame, **options) -> DataFrame:
    """Every row of docs as the struct `row`, with kept (the text of the lines that stay), n_lines and n_dropped (long)."""
    scratch = c.Scratch(docs.sparkSession)
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), scratch, **options)
    d1, d2 = doc_key(F.col("doc_id"), F.col("text"))
    rows = c.nested(docs, d1=d1, d2=d2)
    n = bitmaps.count()  # of documents that lose lines
    if n <= SIEVE_DOCS:
        cells, size = _sieve(bitmaps, n, scratch)
        at = F.pmod("d1", F.lit(size))
        sieved = rows.withColumn("cell", F.floor(at / 64)).join(F.broadcast(cells), "cell", "left")  # at most SIEVE_BITS * SIEVE_DOCS bits: 8 MB
        maybe = F.coalesce(F.getbit("cell_bits", F.pmod(at, F.lit(64)).cast("int")) == 1, F.lit(False))
        wanted, others = sieved.where(maybe), sieved.where(~maybe).select("row", F.lit(None).cast(bitmaps.schema["keep"].dataType).alias("keep"))
    else:
        wanted, others = rows, None
    joined = wanted.join(bitmaps, ["d1", "d2"], "left").select("row", "keep")
    if others is not None:
        joined = joined.unionByName(others)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = lines_of(F.col("row.text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return joined.withColumns({"lines": lines, "gone": F.coalesce(_dropped(F.col("keep")), F.array().cast("array<int>"))}).select(
        "row",
        F.when(F.col("keep").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
    )


def apply(docs: DataFrame, **options) -> DataFrame:
    """docs with the same columns, text without the dropped lines, and n_chars (where there is one) brought up to date."""
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return with_kept(docs, **options).select(*(new.get(n, F.col(f"row.`{n}`")).alias(n) for n in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_kept(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{c.UPPER}', '{c.LOWER}')"
OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS whole, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
parts AS (
  SELECT doc_id, whole, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM lines),
keyed AS (SELECT doc_id, whole, line, pos, {_KEY} AS k FROM parts),
hot AS (
  SELECT k FROM (SELECT DISTINCT doc_id, whole, k FROM keyed WHERE length(k) >= {MIN_CHARS}) GROUP BY k HAVING count(*) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id, whole
"""
