"""Several ranked lists as one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.knn import knn
from marlstone.operators.sparse import BM25, bm25_search, sparse_scores, top


def depth(k: int, candidates: int | None = None, pool: int = 0) -> int:
    """The length that each list is cut at before lists are fused."""
    return max(candidates or max(4 * k, 20), pool)


def _checked(lists: Sequence[DataFrame], weights: Sequence[float] | None) -> list[float]:
    weights = list(weights or [1.0] * len(lists))
    if not lists or len(weights) != len(lists) or any(not 0 <= w < float("inf") for w in weights):
        raise ValueError("fusion needs a list at least, and a weight of 0 or more for each")
    return weights


def rrf(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, rrf_k: float = 60.0) -> DataFrame:
    """id, score from lists of rank and id: the sum of weight / (rrf_k + rank). A list of weight 0 still adds its ids."""
    if rrf_k < 0:
        raise ValueError("rrf_k is at least 0")
    parts = [d.select("id", (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("s")) for d, w in zip(lists, _checked(lists, weights))]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("s").alias("score"))


def weighted(lists: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """id, score from lists of id and similarity: weighted sums of similarities scaled to 0..1 within their list, 1 where all are equal."""
    every = Window.partitionBy()
    parts = []
    for d, w in zip(lists, _checked(lists, weights)):
        low, high = F.min("similarity").over(every), F.max("similarity").over(every)
        scaled = F.when(high > low, (F.col("similarity") - low) / (high - low)).otherwise(1.0)
        # a list is cut to its depth, so one task holds it
        parts.append(d.select("id", (scaled * float(w)).alias("s")))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("s").alias("score"))


def hybrid(df: DataFrame, k: int, vector_query=None, text_query: str | None = None, sparse_query: dict | None = None, id: str = "id", vector: str = "vector", text: str = "text", posts: DataFrame | None = None, metric: str = "cosine", flt=None, weights: Sequence[float] | None = None, method: str = "rrf", rrf_k: float = 60.0, candidates: int | None = None, model: BM25 = BM25(), cut: bool = True, index=None) -> DataFrame:
    """rank, id, score and the rank and value of each side. Sides are cut at depth() before they are fused.

    index: stored postings of the texts; without them the texts are scanned.
    """
    n = depth(k, candidates)
    sides: list[tuple[str, DataFrame]] = []
    if vector_query is not None:
        d = knn(df, vector_query, n, metric, id, vector, flt).select("rank", F.col(id).alias("id"), "distance")
        sides.append(("vector", d.withColumn("similarity", -F.col("distance")).withColumnRenamed("distance", "value")))
    if text_query is not None:
        d = bm25_search(df, text_query, n, model, id, text, flt) if index is None else index.search(text_query, n, df, flt).withColumnRenamed("id", id)
        d = d.select("rank", F.col(id).alias("id"), F.col("score").alias("value"))
        sides.append(("text", d.withColumn("similarity", F.col("value"))))
    if sparse_query is not None:
        q = df.sparkSession.createDataFrame([(int(t), float(w)) for t, w in sparse_query.items()], "term long, weight double")
        scores = sparse_scores(posts, q)
        if flt is not None:
            from marlstone.operators.filters import where

            scores = scores.join(where(df, flt).select(F.col(id).alias("id")), "id", "left_semi")
        sides.append(("sparse", top(scores, n).withColumnRenamed("score", "value").withColumn("similarity", F.col("value"))))
    if not sides:
        raise ValueError("a search needs a vector, a text or a sparse query")
    if method not in ("rrf", "weighted"):
        raise ValueError(f"unknown fusion {method!r}")
    lists = [d for _, d in sides]
    fused = rrf(lists, weights, rrf_k) if method == "rrf" else weighted(lists, weights)
    for name, d in sides:
        fused = fused.join(d.select("id", F.col("rank").alias(f"{name}_rank"), F.col("value").alias("vector_distance" if name == "vector" else f"{name}_score")), "id", "left")
    if cut:
        fused = fused.orderBy(F.desc("score"), "id").limit(k)
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumnRenamed("id", id)
