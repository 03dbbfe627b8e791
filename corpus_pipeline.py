"""A corpus pipeline of five stages: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
`documents`; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import decontaminate, line_dedup, packing, simhash, store, weak_labels
from knotwork.llm.queries import bpe_path

#: Tables of a stage go when the next one begins: by then its result is written.
SCOPE = "pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    store.clear(spark, SCOPE)
    return weak_labels.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scope=SCOPE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat within one edit go, and documents that lose all of theirs."""
    store.clear(spark, SCOPE)
    out = line_dedup.deduplicate(docs, scope=SCOPE).where("n_lines = 0 or n_kept > 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    store.clear(spark, SCOPE)
    return simhash.keep_one(docs, scope=SCOPE)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    store.clear(spark, SCOPE)
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scope=SCOPE)
    ids = store.written(found.select("doc_id").distinct(), "contaminated", SCOPE).select(F.col("doc_id").alias("found"))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("found")), "left_anti")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 1024 tokens."""
    store.clear(spark, SCOPE)
    return packing.pack(docs, bpe_path(), 1024, 2, scope=SCOPE)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark_free), ("best-fit packing", sequences)]

#: SQL has no tokenizer, SimHash or classifier: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
