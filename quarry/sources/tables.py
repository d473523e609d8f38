"""Readers and writers: delimited files with their null rules, ordered dumps with manifests, splits, fallbacks."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.windows import surrogate_key

_NEVER = "\x00"  #: a null marker that no file holds: quoted-empty fields stay empty, unquoted ones become null


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, empty_is_null: bool = False, escape: str = "\\", header: bool = True, multi_line: bool = True) -> DataFrame:
    """Delimited text with backslash escapes, plain or compressed.

    With empty_is_null quoted-empty fields become null as well, as unquoted ones always do.  Files whose quoted fields hold
    no line ends are read with multi_line=False, which lets Spark split a large file (a .bz2 too) into many tasks.
    """
    options = {"header": header, "escape": escape, "quote": '"', "multiLine": multi_line, "encoding": "UTF-8", "mode": "FAILFAST"}
    if not empty_is_null:
        options["nullValue"] = _NEVER
        options["emptyValue"] = ""
    return spark.read.schema(schema).options(**options).csv(path)


def all_text(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the columns of a schema; those it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _path(spark: SparkSession, path: str):
    """A path and its file system, whichever store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that is there; nothing where the session has ended."""
    try:
        p, fs = _path(spark, path)
        fs.delete(p, True)
    except Exception:  # at interpreter exit
        pass


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists (plain file before compressed)."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is in a list of ids (one column); each id counts once, null ids none."""
    wanted = ids.toDF(key).where(F.col(key).isNotNull()).distinct()
    return df.join(wanted, key, "left_semi")


def write_csv(df: DataFrame, path: str, header: bool = True, order: list[str] | None = None, compression: str | None = None) -> None:
    """One ordered file in a folder: for reports and other small results."""
    out = df.orderBy(*[F.col(c).asc_nulls_first() for c in order]) if order else df
    out.coalesce(1).write.mode("overwrite").options(header=header, quoteAll=False, **({"compression": compression} if compression else {})).csv(path)


DUMP_ROWS = 1 << 18  #: of a part of a dump


def dump(df: DataFrame, path: str, keys: list[str] | None = None, part_rows: int = DUMP_ROWS) -> dict:
    """A reproducible ordered dump (part after part, compressed) and its manifest.

    Rows are numbered in the order of the keys, then of the other columns (ties are equal rows), and every part has part_rows of
    them, the last one the rest: parts follow from the rows alone, not from how these lie or from sampled ranges.  Rows are counted
    while they are written; parts are digested where they lie, by the executors.
    """
    seen, n = Observation("dump"), df.count()
    columns = list(dict.fromkeys([*(keys or []), *df.columns]))
    signed = [c for c in columns if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]  # -0.0 and 0.0 tie, but are written apart
    by = [x.asc_nulls_first() for x in (*map(F.col, columns), *(F.col(c).cast("string") for c in signed))]
    parts = surrogate_key(df, by, "_number").repartitionById(max(1, -(-n // part_rows)), F.floor((F.col("_number") - 1) / part_rows).cast("int"))
    parts = parts.sortWithinPartitions("_number").drop("_number")
    parts.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").options(header=True, compression="bzip2").csv(path)
    if (got := seen.get["n"]) != n:
        raise RuntimeError(f"{path}: {got} rows, expected {n}")
    parts = df.sparkSession.read.format("binaryFile").load(path).where(F.col("path").contains("part-")).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path").collect()  # one row a part
    return {"rows": n, "bytes": sum(r["length"] for r in parts), "sha256": [r["sha256"] for r in parts]}


def copy_table(src: DataFrame, path: str) -> int:
    """Copy unless the target already has as many rows; the number of rows."""
    spark, n = src.sparkSession, src.count()
    if exists(spark, path) and spark.read.parquet(path).count() == n:
        return n
    write_stage(src, path)
    if (got := spark.read.parquet(path).count()) != n:
        raise RuntimeError(f"{path}: {got} rows, expected {n}")
    return n


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage's table beside its place and move it there when it is whole, so that readers see the old table or the new
    one; the new table, which cuts the lineage."""
    spark = df.sparkSession
    temp = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(temp)
    (new, fs), (old, _) = _path(spark, temp), _path(spark, path)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise RuntimeError(f"{temp} could not be moved to {path}")
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Named stages, each run once and written under one root (a namespace): run(name, f) gives the table of a stage.

    A stage's f takes this object; the order follows from which stages a stage asks for, and each is a barrier.
    """

    def __init__(self, spark: SparkSession, root: str, namespace: str = "main") -> None:
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", namespace):
            raise ValueError(f"{namespace!r} is no namespace")
        self.spark, self.root, self.done = spark, f"{root.rstrip('/')}/{namespace}", {}

    def run(self, name: str, f) -> DataFrame:
        if name not in self.done:
            self.done[name] = write_stage(f(self), f"{self.root}/{name}")
        return self.done[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.done[name]

    def counts(self) -> dict[str, int]:
        return {n: df.count() for n, df in self.done.items()}


def described(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """df with a comment in the metadata of columns, which Parquet tables and catalogs keep."""
    return df.select(*(F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns))


def appended(seed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A lookup table with further rows; a key that is there already is an error, as in a table with a primary key."""
    out = seed.unionByName(rows)
    if not out.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is repeated")
    return out


def split_rows(df: DataFrame, condition, accepted: str, rejected: str) -> None:
    """Two outputs: rows where the condition holds, and all others (null included)."""
    ok = F.coalesce(condition, F.lit(False))
    df.where(ok).write.mode("overwrite").parquet(accepted)
    df.where(~ok).write.mode("overwrite").parquet(rejected)


def upsert(prior: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """new, with the columns that prior rows of the same key already have."""
    old = prior.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    out = new.join(old, key, "left")
    return out.select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in columns else F.col(c) for c in new.columns])


def ddl(df: DataFrame, name: str) -> str:
    """A CREATE TABLE statement for the columns."""
    body = ",\n".join(f"  {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema)
    return f"CREATE TABLE {name} (\n{body}\n);"


def data_dictionary(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    return [(n, i + 1, f.name, f.dataType.simpleString()) for n, df in tables.items() for i, f in enumerate(df.schema)]


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]


def schema_faults(df: DataFrame, expected: T.StructType) -> list[tuple[str, str]]:
    """(column, fault) where a table's columns are not those expected: missing, unexpected, or of another type."""
    have, want = ({f.name: f.dataType.simpleString() for f in schema} for schema in (df.schema, expected))
    faults = [(n, "missing") for n in want if n not in have] + [(n, "unexpected") for n in have if n not in want]
    return faults + [(n, f"{have[n]} instead of {want[n]}") for n in want if n in have and have[n] != want[n]]


def joined_parts(paths: list[str], target: str, sha256: str | None = None) -> str:
    """Put an archive together from its parts, in order, and check its digest."""
    digest = hashlib.sha256()
    with open(target, "wb") as out:
        for p in paths:
            with open(p, "rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
                    out.write(block)
    if sha256 and digest.hexdigest() != sha256:
        raise ValueError(f"{target}: digest differs")
    return target
