"""Searches with everything that can be asked of them: filters, ids, planning, changed scores, diversity.

dense(), by_text() and hybrid() take the same options and give rank, id, score (and base_score where scores are changed)
with the columns of the rows that were found.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import relevance
from marlstone.operators import fusion, scoring
from marlstone.operators.filters import where
from marlstone.operators.knn import EXACT_MATCHES, EXACT_SHARE, WIDE_SHARE, InvertedLists, knn
from marlstone.operators.payload import PayloadIndex
from marlstone.operators.postings import Postings
from marlstone.operators.sparse import BM25, bm25_search


def allowed(df: DataFrame, predicate: Callable | DataFrame | Sequence[int] | None, id: str = "id") -> DataFrame:
    """The rows whose id is in a table or list, or for which a function of a pandas Series of ids gives true."""
    if predicate is None:
        return df
    if isinstance(predicate, DataFrame):
        return df.join(predicate.select(id).distinct(), id, "left_semi")
    if callable(predicate):
        return df.where(F.pandas_udf(predicate, "boolean")(F.col(id)))
    return df.join(df.sparkSession.createDataFrame([(int(x),) for x in set(predicate)], f"{id} long"), id, "left_semi")


def finish(df: DataFrame, found: DataFrame, k: int, modifiers, diversity: float | None, id: str, vector: str, columns: Sequence[str] | None) -> DataFrame:
    """The k best of found (rank, id, score), a pool that is small, with columns of df; scores changed, or diverse."""
    rules = scoring.as_modifiers(modifiers)
    extra = [c for c in (df.columns if columns is None else columns) if c != id and c not in found.columns]
    needed = [id, *(df.columns if rules["modifiers"] else extra)]
    if diversity is not None and vector not in needed:
        needed.append(vector)
    rows = df.select([c for c in dict.fromkeys(needed) if c == id or c not in found.columns]).join(F.broadcast(found), id)  # the pool's rows
    if rules["modifiers"]:
        rows = scoring.modified(rows, "score", rules["modifiers"])
    if diversity is not None:
        rows = scoring.diverse(rows, k, diversity, vector=vector, id=id)
    else:
        order = [F.desc("score"), F.asc("rank")]
        rows = rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("rank").withColumnRenamed("place", "rank")
    more = [c for c in found.columns if c not in ("rank", id, "score")]
    return rows.select("rank", id, "score", *(["base_score"] if rules["modifiers"] else []), *more, *extra)


def pool(k: int, modifiers, diversity: float | None) -> int:
    """How many candidates a search goes on with: k, or more where their order may change."""
    rules = scoring.as_modifiers(modifiers)
    if not rules["modifiers"] and diversity is None:
        return k
    return max(rules["pool"], k) if rules["pool"] else max(4 * k, 20)


def dense(df: DataFrame, query, k: int, metric: str = "cosine", flt=None, predicate=None, modifiers=None, diversity: float | None = None, lists: InvertedLists | None = None, probes: int = 8, payload: PayloadIndex | None = None, id: str = "id", vector: str = "vector", columns: Sequence[str] | None = (), stats: dict | None = None) -> DataFrame:
    """By vector: score is the relevance of the distance. lists: search through them as plan() says; stats is filled."""
    n = pool(k, modifiers, diversity)
    how = plan(df, flt, lists, probes, payload)
    if stats is not None:
        stats |= how
    rows = allowed(df, predicate, id)
    if how["strategy"] == "candidates":
        rows = rows.join(payload.candidates(flt).withColumnRenamed("id", id), id, "left_semi")
    if how["strategy"] == "lists" and predicate is None:
        near = lists.search(query, n, how["probes"], flt)
    else:
        near = knn(rows, query, n, metric, id, vector, flt)
    found = near.withColumn("score", relevance(F.col("distance"), metric))
    return finish(df, found, k, modifiers, diversity, id, vector, columns)


def plan(df: DataFrame, flt, lists: InvertedLists | None, probes: int, payload: PayloadIndex | None) -> dict:
    """strategy (scan, candidates or lists), reason, selectivity and probes of a filtered search.

    Few matches, by the index's counts, are read by their ids. Lists are probed more widely the fewer rows match. Only
    without an index on the field are matches counted.
    """
    if flt is None:
        return {"strategy": "lists" if lists else "scan", "reason": "no filter", "selectivity": 1.0, "probes": probes if lists else 0}
    total = payload.manifest()["rows"] if payload else None
    hits = payload.most(flt) if payload else None
    if hits is None and lists:
        total, hits = df.count(), where(df, flt).count()
    if hits is None:
        return {"strategy": "scan", "reason": "no index and no lists", "selectivity": None, "probes": 0}
    share = hits / total if total else 0.0
    if hits <= EXACT_MATCHES or share <= EXACT_SHARE:
        by_ids = payload is not None and payload.candidates(flt) is not None
        return {"strategy": "candidates" if by_ids else "scan", "reason": "few rows match", "selectivity": share, "probes": 0}
    if not lists:
        return {"strategy": "scan", "reason": "no lists", "selectivity": share, "probes": 0}
    wide = probes if share >= WIDE_SHARE else min(len(lists.centres), int(-(-probes * WIDE_SHARE // share)))
    return {"strategy": "lists", "reason": "many rows match", "selectivity": share, "probes": wide}


def by_text(df: DataFrame, query, k: int, index: Postings | None = None, model: BM25 = BM25(), flt=None, predicate=None, modifiers=None, diversity: float | None = None, id: str = "id", text: str = "text", vector: str = "vector", columns: Sequence[str] | None = ()) -> DataFrame:
    """By BM25, or by weights of terms over an index of sparse vectors. Statistics cover all documents."""
    n = pool(k, modifiers, diversity)
    among = None if predicate is None else allowed(df.select(id), predicate, id)
    if index is not None:
        found = index.search(query, n, df, flt, among).withColumnRenamed("id", id)
    else:
        found = bm25_search(df, query, n, model, id, text, flt, among)
    return finish(df, found, k, modifiers, diversity, id, vector, columns)


def hybrid(df: DataFrame, k: int, modifiers=None, diversity: float | None = None, candidates: int | None = None, id: str = "id", vector: str = "vector", columns: Sequence[str] | None = (), **sides) -> DataFrame:
    """fusion.hybrid() with changed scores or a diverse choice; every fused candidate is in the pool."""
    rules = scoring.as_modifiers(modifiers)
    if diversity is not None and sides.get("vector_query") is None:
        raise ValueError("a diverse result needs a vector to search by")
    n = fusion.depth(k, candidates, rules["pool"] or 0)
    cut = not rules["modifiers"] and diversity is None
    found = fusion.hybrid(df, k, id=id, vector=vector, candidates=n, cut=cut, **sides)
    return finish(df, found, k, modifiers, diversity, id, vector, columns)


def as_hits(found: DataFrame):
    """Hits as a pandas DataFrame by rank; ranks of sides are integers that may be missing."""
    out = found.orderBy("rank").toPandas()  # k rows
    for c in ("vector_rank", "text_rank", "sparse_rank"):
        if c in out.columns:
            out[c] = out[c].astype("Int64")
    return out
