"""Nearest neighbours over a table of vectors: exact, batched, by range, by a stored row, and through inverted lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import METRICS, distance, literal, truncate
from marlstone.operators.filters import where

#: Rows of a list that one task writes.
LIST_ROWS = 1_000_000
#: Queries up to which a batch is sent to all tasks as one block, and the bytes that they take at most; more are taken
#: in blocks, each a scan. Queries of a block that a task multiplies with its rows in one step.
QUERY_BLOCK, QUERY_BYTES, STEP = 65_536, 64 << 20, 1024


def _scored(df: DataFrame, query, metric: str, vector: str, flt, dims: int | None) -> DataFrame:
    q, v = literal(query), F.col(vector)
    if dims:
        q, v = truncate(q, dims), truncate(v, dims)
    return where(df, flt).where(v.isNotNull()).withColumn("distance", distance(v, q, metric))


def knn(df: DataFrame, query, k: int, metric: str = "l2", id: str = "id", vector: str = "vector", flt=None, dims: int | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """rank, id, distance (and columns) of the k closest rows, ties by id; the filter applies before the distance.

    Wide columns are joined to the k rows at the end. dims: only the first dimensions count.
    """
    if k < 0:
        raise ValueError("k is at least 0")
    best = _scored(df, query, metric, vector, flt, dims).select(id, "distance").orderBy("distance", id).limit(k)
    # k rows, whatever the table
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("distance", id)))
    if columns:
        ranked = df.select(id, *columns).join(F.broadcast(ranked) if k <= 100_000 else ranked, id)
    return ranked.select("rank", id, "distance", *columns)


def among(df: DataFrame, ids, query, k: int, id: str = "id", **options) -> DataFrame:
    """knn() within a list of ids (a sequence or a DataFrame with that column); unknown and repeated ones don't count."""
    wanted = ids.select(id).distinct() if isinstance(ids, DataFrame) else df.sparkSession.createDataFrame([(int(x),) for x in set(ids)], f"{id} long")
    return knn(df.join(wanted, id, "left_semi"), query, k, id=id, **options)


def range_search(df: DataFrame, query, radius: float, most: int | None = None, metric: str = "l2", id: str = "id", vector: str = "vector", flt=None, dims: int | None = None) -> DataFrame:
    """id and distance of the rows within radius (squared for l2), closest first."""
    if radius != radius:
        raise ValueError("the radius is a number")
    near = _scored(df, query, metric, vector, flt, dims).select(id, "distance").where(F.col("distance") <= radius).orderBy("distance", id)
    return near if most is None else near.limit(most)


def knn_by_id(df: DataFrame, key, k: int, id: str = "id", vector: str = "vector", include_self: bool = False, **options) -> DataFrame | None:
    """The closest rows to a stored one, itself left out; None if it isn't stored."""
    row = df.where(F.col(id) == key).select(vector).first()
    if row is None or row[0] is None:
        return None
    others = df if include_self else df.where(F.col(id) != key)
    return knn(others, row[0], k, id=id, vector=vector, **options)


def knn_join(queries: DataFrame, df: DataFrame, k: int, metric: str = "l2", query_id: str = "query_id", query_vector: str = "vector", id: str = "id", vector: str = "vector", flt=None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, id, distance: the k closest rows of df for each query, as knn() would give them.

    The stated queries go to all tasks in blocks of `block`; a task multiplies them with its rows in one step, keeps
    the k closest per query, and only these are shuffled. Distances of the kept rows are taken anew in double
    precision, so rounding in the product decides nothing but a margin around the k-th place.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    rows = where(df, flt).where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    out = None
    for shared in query_blocks(queries, query_id, query_vector, block, metric == "cosine"):
        found = rows.mapInArrow(_closest(shared, k, metric), "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def query_blocks(queries: DataFrame, query_id: str, query_vector: str, block: int = QUERY_BLOCK, unit: bool = False) -> Iterator:
    """Broadcasts of (ids, vectors) of stated queries, of `block` queries and QUERY_BYTES at most (about, as they are
    dealt by a hash). For more queries than a few blocks deal the rows to lists: lists.search_all() shuffles both."""
    total, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size(query_vector)), F.lit(1))).first()
    blocks = max(1, -(-total // max(1, min(block, QUERY_BYTES // (8 * max(1, dim))))))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        got = part.select(F.col(query_id).cast("long"), F.col(query_vector).cast("array<double>")).toArrow()
        ids, lists = got.column(0).to_numpy(), got.column(1).combine_chunks()
        flat = lists.flatten().to_numpy() if len(ids) else np.zeros(0)
        q = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        yield queries.sparkSession.sparkContext.broadcast((ids, _unit(q) if unit else q))


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.where(n > 0, v / np.where(n > 0, n, 1), v).astype(np.float32).astype(np.float64)


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows."""
    d = ((q - v) ** 2).sum(1) if metric == "l2" else -(q * v).sum(1) if metric == "ip" else np.maximum(0, 1 - (q * v).sum(1))
    return np.where(np.isnan(d), np.inf, d)


def _closest(shared, k: int, metric: str):
    """The k closest rows of a task for each query, by blocks of rows and queries.

    Of the first block the k smallest rough distances of each query are picked out; after that only rows that come
    below the k-th so far (and a margin for rounding) are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, every = shared.value
        steps = [(qid[s : s + STEP], every[s : s + STEP], (every[s : s + STEP] ** 2).sum(1)) for s in range(0, len(qid), STEP)] if k else []
        best: list[np.ndarray] = [np.zeros(0, [("n", "i4"), ("id", "i8"), ("d", "f8"), ("r", "f8")]) for _ in steps]
        limits = [np.full(len(q), np.inf) for _, q, _ in steps]

        def cut(rows: np.ndarray, limit: np.ndarray) -> np.ndarray:
            rows = rows[np.lexsort((rows["id"], rows["d"], rows["n"]))]
            first = np.searchsorted(rows["n"], np.arange(len(limit) + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            rows = rows[np.arange(len(rows)) - np.repeat(first[:-1], np.diff(first)) < k]
            if len(full):
                worst = np.full(len(limit), -np.inf)
                np.maximum.at(worst, rows["n"], rows["r"])
                limit[full] = worst[full]
            return rows

        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                ids = part.column(0).to_numpy()
                v = part.column(1).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
                v = _unit(v) if metric == "cosine" else v
                for n, (_, q, square) in enumerate(steps):
                    with np.errstate(over="ignore", invalid="ignore"):
                        rough = -q @ v.T
                        if metric == "l2":
                            rough = 2 * rough + square[:, None] + (v**2).sum(1)[None]
                        edge, m = limits[n], k + 8
                        if m < len(ids) and np.isinf(edge).any():
                            edge = np.minimum(edge, np.partition(rough, m - 1, axis=1)[:, m - 1])
                        # rows that tie with the last one kept must stay in the race
                        near = rough <= (edge + 1e-9 * np.maximum(1, np.abs(edge)))[:, None]
                        near |= ~np.isfinite(rough)
                        a, b = np.nonzero(near)
                        if not len(a):
                            continue
                        rows = np.zeros(len(a), best[n].dtype)
                        rows["n"], rows["id"], rows["d"], rows["r"] = a, ids[b], _exact(q[a], v[b], metric), np.where(np.isfinite(rough[a, b]), rough[a, b], np.inf)
                    best[n] = cut(np.concatenate([best[n], rows]), limits[n])
        for (names, _, _), rows in zip(steps, best):
            yield pa.RecordBatch.from_arrays([pa.array(names[rows["n"]]), pa.array(rows["id"].copy()), pa.array(rows["d"].copy())], names=["query_id", "id", "distance"])

    return run


def padded(found: DataFrame, query_ids: Sequence[int], k: int, missing: int = 2**64 - 1) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint64) and distances as arrays of a row per query; places without a result hold `missing` and infinity."""
    ids, distances = np.full((len(query_ids), k), missing, np.uint64), np.full((len(query_ids), k), np.inf)
    place = {q: i for i, q in enumerate(query_ids)}
    for r in found.collect():  # k rows for each query
        ids[place[r["query_id"]], r["rank"] - 1], distances[place[r["query_id"]], r["rank"] - 1] = r["id"], r["distance"]
    return ids, distances


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id and the share of the exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


class InvertedLists:
    """Vectors dealt to the list of their nearest centre. A search reads the nearest lists only, and more while it has
    fewer than k matches; with all lists it is exact."""

    def __init__(self, df: DataFrame, centres: np.ndarray, metric: str, id: str, vector: str) -> None:
        self.df, self.centres, self.metric, self.id, self.vector = df, centres, metric, id, vector

    @classmethod
    def train(cls, df: DataFrame, lists: int, metric: str = "l2", id: str = "id", vector: str = "vector", sample: int = 100_000, rounds: int = 25, path: str | None = None) -> InvertedLists:
        """Centres by k-means on at most `sample` rows, chosen by a hash; every row is dealt. path: where the table is
        written, partitioned by list_id, so that a search reads its lists' files only."""
        from marlstone.operators.codecs import kmeans

        n = df.count()
        share = min(1.0, sample / max(1, n))
        some = df.where(F.pmod(F.xxhash64(id), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(vector).limit(sample).toArrow()
        x = np.array(some.column(0).to_pylist(), np.float32)
        centres = kmeans(_unit(x) if metric == "cosine" else x, lists, rounds)
        dealt = df.withColumn("list_id", cls._nearest(df, centres, metric, vector))
        if path:
            # a large list is written by several tasks
            salted = dealt.withColumn("__salt", F.pmod(F.xxhash64(id), F.lit(max(1, n // max(1, lists) // LIST_ROWS))))
            salted.repartition("list_id", "__salt").drop("__salt").write.partitionBy("list_id").mode("overwrite").parquet(path)
            dealt = df.sparkSession.read.parquet(path)
        return cls(dealt, centres, metric, id, vector)

    @staticmethod
    def _nearest(df: DataFrame, centres: np.ndarray, metric: str, vector: str):
        shared = df.sparkSession.sparkContext.broadcast(centres)

        @F.pandas_udf("int")
        def nearest(v):
            import pandas as pd

            x = np.stack(v.to_numpy()).astype(np.float64)
            return pd.Series(nearest_centre(_unit(x) if metric == "cosine" else x, shared.value))

        return nearest(F.col(vector).cast("array<float>"))

    def order(self, query) -> list[int]:
        q = np.array([query], np.float64)
        q = _unit(q) if self.metric == "cosine" else q
        return np.lexsort((np.arange(len(self.centres)), ((self.centres - q) ** 2).sum(1))).tolist()

    def search(self, query, k: int, probes: int = 8, flt=None) -> DataFrame:
        near = self.order(query)
        if probes >= len(near):
            return knn(self.df, query, k, self.metric, self.id, self.vector, flt)
        matches = where(self.df, flt).where(F.col(self.vector).isNotNull()).groupBy("list_id").agg(F.count("*").alias("n"))
        sizes = {r["list_id"]: r["n"] for r in matches.collect()}  # a row for each list
        held = np.cumsum([sizes.get(x, 0) for x in near])
        probes = min(len(near), max(probes, int(np.searchsorted(held, k)) + 1))
        return knn(self.df.where(F.col("list_id").isin(near[:probes])), query, k, self.metric, self.id, self.vector, flt)

    def list_of(self, key: int) -> int | None:
        row = self.df.where(F.col(self.id) == key).select("list_id").first()
        return None if row is None else row[0]

    def sizes(self) -> DataFrame:
        return self.df.groupBy("list_id").agg(F.count("*").alias("n"))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The index of the nearest centre of each row, the lower one of equally near ones."""
    out = []
    for i in range(0, len(x), 4096):
        p = x[i : i + 4096].astype(np.float64)
        out.append(((p**2).sum(1)[:, None] - 2 * p @ centres.T + (centres**2).sum(1)[None]).argmin(1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


#: Matches up to which, and shares of matches up to which, a filtered search is exact.
EXACT_MATCHES, EXACT_SHARE, WIDE_SHARE = 2000, 0.01, 0.20
