"""A corpus pipeline over `documents`: quality, exact copies, near copies, benchmark passages, packing.

Each stage is given the documents that the one before it has kept, with their columns, and returns those that it keeps;
the last returns sequences in batches. Stages drop documents by their rows, not by their ids: rows that share an id, or
have none, are judged on their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table
from marlstone.llm.decontaminate import decontaminate, without_documents
from marlstone.llm.exact_dedup import exact_dedup
from marlstone.llm.jaccard import jaccard_join
from marlstone.llm.packing import pack
from marlstone.llm.quality import classify


def _guarded(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What keep() keeps of docs, with other columns under names that its own can't clash with."""
    safe = [c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(docs.columns)]
    return keep(docs.toDF(*safe)).select(safe).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the quality classifier rejects go."""
    return _guarded(docs, lambda d: classify(d).where("accepted"))


def _kept(docs: DataFrame, name: str, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that judge() keeps, for judges that choose by the smallest id.

    Rows are numbered once, in a table that both the judge and the join read: however a scan is split, or which
    executors come and go, a row keeps its number. Ids that repeat or are missing do no harm. What is dropped is the
    smaller side of the join.
    """
    safe = [c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(docs.columns)]
    rows = table(docs.toDF(*safe).withColumn("__row", F.monotonically_increasing_id()), f"{name}_rows")
    judged = judge(rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__row").alias("row")).alias("place"), "text"))
    drop = judged.where("not kept").select(F.col("place.row").alias("__row"))
    return rows.join(drop, "__row", "left_anti").select(safe).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the document with the smallest id stays."""
    return _kept(docs, "exact", lambda d: exact_dedup(d, id="place"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of documents that links of a Jaccard similarity of 0.8 or more connect, the smallest id stays."""
    return _kept(docs, "near", lambda d: jaccard_join(d, id="place", unique=True))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents with a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _guarded(docs, lambda d: without_documents(decontaminate(d, items)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sequences of the kept documents in length buckets and batches."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near-duplicate join", near),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]

#: The classifier's scores and the boundaries' dynamic programming are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over what the one before has written as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
