"""Facets, counts, best rows per group, and recommendations from examples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import normalize
from marlstone.operators.filters import kind_of, where
from marlstone.operators.knn import knn


@dataclass(frozen=True)
class FacetRequest:
    """limit 0: all values. bounds: counts of ranges instead of values. distinct: also how many different values."""

    name: str
    limit: int = 10
    bounds: tuple[float, ...] = ()
    distinct: bool = False

    def __post_init__(self) -> None:
        if not self.name or self.limit < 0 or any(not np.isfinite(b) for b in self.bounds) or any(a >= b for a, b in zip(self.bounds, self.bounds[1:])):
            raise ValueError("a facet needs a field, a limit of 0 or more, and finite bounds that rise")


def count_where(df: DataFrame, flt=None) -> int:
    return where(df, flt).count()


def counted_values(rows: DataFrame, name: str) -> DataFrame:
    """value, count of a field; a row counts once for each of its tags, and -0 is 0."""
    c = F.col(name)
    kind = kind_of(rows.schema[name].dataType)
    value = F.explode(F.array_distinct(c)) if kind == "tags" else F.when(c == 0, F.lit(0)).otherwise(c) if kind == "float" else c
    return rows.where(c.isNotNull()).select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))


def facet_values(df: DataFrame, request: FacetRequest, flt=None) -> DataFrame:
    """place, value, count of the most frequent values, ties by value. A row counts once for each of its tags."""
    counted = counted_values(where(df, flt), request.name)
    order = [F.desc("count"), F.asc("value")]
    best = counted.orderBy(*order).limit(request.limit) if request.limit else counted
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("place"), F.col("value").cast("string").alias("value"), "count")


def facet_summary(df: DataFrame, request: FacetRequest, flt=None) -> DataFrame:
    """total (rows with the field), missing, distinct, and other (counts of values beyond the limit).

    Values are counted once, and only the best ones are sorted: other is what all counts add up to, less theirs.
    """
    rows, c = where(df, flt), F.col(request.name)
    base = rows.agg(F.count(c).alias("total"), F.count(F.when(c.isNull(), 1)).alias("missing"))
    counted = counted_values(rows, request.name)
    every = counted.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("all"))
    best = counted.orderBy(F.desc("count"), F.asc("value")).limit(request.limit) if request.limit else counted
    best = best.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("best"))
    # one row each
    return base.crossJoin(every).crossJoin(best).select("total", "missing", "distinct", (F.col("all") - F.col("best")).alias("other"))


def facet_ranges(df: DataFrame, request: FacetRequest, flt=None) -> DataFrame:
    """bucket, low, high, count of each of the n + 1 ranges of n bounds; low belongs to a range, high does not."""
    if kind_of(df.schema[request.name].dataType) not in ("int", "float"):
        raise ValueError("ranges are of numbers")
    bounds = [float(b) for b in request.bounds]
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col(request.name) >= b))
    counted = where(df, flt).where(F.col(request.name).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("count"))
    edges = [None, *bounds, None]
    ranges = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(len(bounds) + 1)], "bucket int, low double, high double")
    return ranges.join(counted, "bucket", "left").select("bucket", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))


def facets(df: DataFrame, requests: Sequence[FacetRequest | str], flt=None, ids: Sequence[int] | None = None, id: str = "id") -> dict[str, dict]:
    """The facets of all rows, of those that a filter matches, or of some ids (each once; unknown ones don't count)."""
    requests = [FacetRequest(r) if isinstance(r, str) else r for r in requests]
    if len({r.name for r in requests}) < len(requests) or flt is not None and ids is not None:
        raise ValueError("a field is asked for once, and by a filter or by ids")
    rows = where(df, flt) if ids is None else df.join(df.sparkSession.createDataFrame([(int(x),) for x in set(ids)], f"{id} long"), id, "left_semi")
    out = {}
    for r in requests:
        if r.name not in df.columns:
            n = rows.count()
            out[r.name] = {"total": 0, "missing": n, "values": [], "other": 0, "buckets": [], "distinct": 0 if r.distinct else None}
            continue
        s = facet_summary(rows, r).first()
        values = [] if r.bounds else [(x["value"], x["count"]) for x in facet_values(rows, r).orderBy("place").collect()]
        buckets = [(x["low"], x["high"], x["count"]) for x in facet_ranges(rows, r).orderBy("bucket").collect()] if r.bounds else []
        out[r.name] = {"total": s["total"], "missing": s["missing"], "values": values, "other": 0 if r.bounds else s["other"], "buckets": buckets, "distinct": s["distinct"] if r.distinct else None}
    return out


def best_per_group(ranked: DataFrame, by: str, groups: int, per_group: int, id: str = "id") -> DataFrame:
    """group_rank, place, id of the `per_group` best rows of the first `groups` values in a full ranking (rank, id, by).

    Rows without a value are in no group. Each group's best are found first, so what is sorted further is small.
    """
    if kind_of(ranked.schema[by].dataType) not in ("keyword", "int", "bool"):
        raise ValueError("groups are by a keyword, an integer or a truth value")
    place = F.row_number().over(Window.partitionBy(by).orderBy("rank"))
    best = ranked.where(F.col(by).isNotNull()).withColumn("place", place).where(F.col("place") <= per_group)
    firsts = best.where("place = 1").select(by, F.col("rank").alias("first")).orderBy("first").limit(groups)
    firsts = firsts.withColumn("group_rank", F.row_number().over(Window.orderBy("first")))
    return best.join(firsts, by).select("group_rank", "place", by, id, "rank")


def search_groups(df: DataFrame, query, by: str, groups: int, per_group: int = 1, metric: str = "l2", id: str = "id", vector: str = "vector", flt=None) -> DataFrame:
    """best_per_group() of all rows by distance: group_rank, place, by, id, distance."""
    from marlstone.functions.vectors import distance, literal

    if kind_of(df.schema[by].dataType) not in ("keyword", "int", "bool"):
        raise ValueError("groups are by a keyword, an integer or a truth value")
    rows = where(df, flt).where(F.col(by).isNotNull() & F.col(vector).isNotNull()).select(id, by, distance(F.col(vector), literal(query), metric).alias("distance"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("distance", id))
    best = rows.withColumn("place", place).where(F.col("place") <= per_group)
    firsts = best.where("place = 1").select(by, F.struct("distance", id).alias("first")).orderBy("first").limit(groups)
    firsts = firsts.select(by, F.row_number().over(Window.orderBy("first")).alias("group_rank"))
    return best.join(firsts, by).select("group_rank", "place", by, id, "distance")


def recommend(df: DataFrame, positive: Sequence[int], negative: Sequence[int] = (), k: int = 10, metric: str = "cosine", id: str = "id", vector: str = "vector", flt=None) -> DataFrame:
    """The rows closest to 2 * mean(positive) - mean(negative), or to mean(positive); examples themselves are left out."""
    if not positive or set(positive) & set(negative):
        raise ValueError("a recommendation needs a positive example, and none that is negative too")
    wanted = [*set(positive), *set(negative)]
    v = normalize(F.col(vector)) if metric == "cosine" else F.col(vector)
    rows = {r[0]: r[1] for r in df.where(F.col(id).isin(wanted)).select(id, v).collect()}  # the examples
    if any(rows.get(x) is None for x in wanted):
        raise ValueError("an example is unknown or has no vector")
    mean = lambda ids: np.mean([np.asarray(rows[x], np.float64) for x in ids], axis=0)
    q = 2 * mean(set(positive)) - mean(set(negative)) if negative else mean(set(positive))
    top = float(np.finfo(np.float32).max)
    return knn(df.where(~F.col(id).isin(wanted)), np.clip(q, -top, top).astype(np.float32), k, metric, id, vector, flt)
