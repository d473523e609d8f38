"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame that
`run` writes as Parquet to the shared folder and reads again as the next stage's docs.  All stages but the last return
the columns of docs.  The last returns them with `copies`: how many times the mix takes the document.

Defined results, for every stage: null and empty texts are kept by all stages but the last, which never takes a text without
words; very long texts are read whole; repeated rows are judged each, and near_dedup keeps one of them; ties go to the least doc_id
there, and to the least hash in mixing; rows with a null doc_id are never compared in near_dedup, and otherwise treated like others;
an empty table gives an empty result; extra columns pass through, whatever their names (but for `copies` in the last stage, which
is its own).  Without labels, or a benchmark, the first and the fourth stage keep all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontamination, line_dedup, mixing, near_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from all labels, scores below 0.5."""
    common.ship(spark)
    return toxicity.drop_toxic(spark, docs, common.table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeats of the lines whose keys ten or more of them hold; the first of each line stays."""
    common.ship(spark)
    return line_dedup.apply(docs, keep_first=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id."""
    common.ship(spark)
    return near_dedup.drop_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    common.ship(spark)
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of times it does."""
    common.ship(spark)
    copies = (F.col("taken") / F.col("size")).cast("int").alias("copies")
    return mixing.mix(docs).where("taken > 0").select(*(F.col(f"row.`{n}`").alias(n) for n in docs.columns if n != "copies"), copies)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: No SQL: training, consistent sampling and the knapsack have no plain SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents in sf_dir."""
    scratch = common.Scratch(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
