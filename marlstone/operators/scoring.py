"""Scores changed by metadata, diverse selections, and reranking by a function."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.dates import now_ms, to_ms
from marlstone.operators.filters import as_filter, kind_of, matches


def _number(fields: dict, name: str) -> Column | None:
    """A numeric or boolean field as a double; None for any other or none."""
    if name not in fields or kind_of(fields[name]) not in ("int", "float", "bool"):
        return None
    c = F.col(name)
    return (c.cast("int") if kind_of(fields[name]) == "bool" else c).cast("double")


@dataclass(frozen=True)
class RecencyDecay:
    """A factor that halves with each half_life that a date lies before origin; linear: it falls evenly to 0 over two."""

    name: str
    origin: float
    half_life: float
    shape: str = "exp"
    floor: float = 0.0
    missing: float = 1.0

    def __post_init__(self) -> None:
        if self.half_life <= 0 or not math.isfinite(self.half_life) or self.shape not in ("exp", "linear") or not 0 <= self.floor <= 1 or not 0 <= self.missing < math.inf:
            raise ValueError("a decay needs a half life above 0, a floor between 0 and 1 and a value of 0 or more for missing dates")

    def column(self, fields: dict) -> Column:
        v = _number(fields, self.name)
        if v is None:
            return F.lit(float(self.missing))
        age = F.greatest(F.lit(0.0), F.lit(float(self.origin)) - v)
        f = F.pow(F.lit(2.0), -age / self.half_life) if self.shape == "exp" else F.greatest(F.lit(0.0), 1 - age / (2 * self.half_life))
        return F.when(v.isNull(), float(self.missing)).otherwise(F.greatest(F.lit(float(self.floor)), f))


@dataclass(frozen=True)
class FieldMultiplier:
    name: str
    low: float = 0.0
    high: float = math.inf
    missing: float = 1.0

    def __post_init__(self) -> None:
        if not 0 <= self.low <= self.high or not 0 <= self.missing < math.inf:
            raise ValueError("a multiplier needs 0 <= low <= high and a value of 0 or more for missing fields")

    def column(self, fields: dict) -> Column:
        v = _number(fields, self.name)
        if v is None:
            return F.lit(float(self.missing))
        return F.when(v.isNull(), float(self.missing)).otherwise(F.least(F.greatest(v, F.lit(float(self.low))), F.lit(float(self.high))))


@dataclass(frozen=True)
class MatchBoost:
    flt: object
    bonus: float

    def __post_init__(self) -> None:
        if not math.isfinite(self.bonus):
            raise ValueError("a bonus is finite")

    def column(self, fields: dict) -> Column:
        return F.when(matches(self.flt, fields), float(self.bonus)).otherwise(0.0)


#: Milliseconds of the units in which half lives are given.
_UNITS = {"half_life": 1, "half_life_seconds": 1000, "half_life_minutes": 60_000, "half_life_hours": 3_600_000, "half_life_days": 86_400_000}


def _listed(x, single) -> list:
    return [] if x is None else [x] if isinstance(x, single) else list(x)


def _known(rule: dict, required: str, *others: str) -> dict:
    if required not in rule or set(rule) - {required, *others}:
        raise ValueError(f"a rule takes {required} and may take {', '.join(others)}; not {sorted(set(rule) - {required, *others})}")
    return rule


def _decay(rule: dict) -> RecencyDecay:
    units = [u for u in _UNITS if u in rule]
    if len(units) != 1:
        raise ValueError(f"a decay has one of {', '.join(_UNITS)}")
    _known(rule, "field", "origin", "shape", "missing", "floor", *_UNITS)
    shapes = {"exponential": "exp", "linear": "linear"}
    if rule.get("shape", "exponential") not in shapes:
        raise ValueError("a decay is exponential or linear")
    origin = to_ms(rule["origin"]) if "origin" in rule else now_ms()
    return RecencyDecay(rule["field"], float(origin), float(rule[units[0]]) * _UNITS[units[0]], shapes[rule.get("shape", "exponential")], float(rule.get("floor", 0.0)), float(rule.get("missing", 1.0)))


def _multiplier(rule: str | dict) -> FieldMultiplier:
    rule = _known({"field": rule} if isinstance(rule, str) else rule, "field", "missing", "min", "max")
    return FieldMultiplier(rule["field"], float(rule.get("min", 0.0)), float(rule.get("max", math.inf)), float(rule.get("missing", 1.0)))


def _boost(rule: dict | tuple) -> MatchBoost:
    when, bonus = (rule["when"], rule["bonus"]) if isinstance(rule, dict) else rule
    return MatchBoost(as_filter(when), float(bonus))


def as_modifiers(spec) -> dict:
    """modifiers (a list) and pool (or None), from a list of modifiers or from a dict of decay, multiply, boost and pool.

    A decay is {field, half_life (or _seconds, _minutes, _hours, _days), origin, shape, missing, floor}; a multiplier is
    a field's name or {field, missing, min, max}; a boost is {when, bonus} or a pair of a filter and a bonus. Each may be
    one rule or a list.
    """
    if spec is None:
        return {"modifiers": [], "pool": None}
    if not isinstance(spec, dict):
        if isinstance(spec, (str, bytes)) or not isinstance(spec, Sequence):
            raise TypeError("modifiers are a list or a dict of rules")
        return {"modifiers": list(spec), "pool": None}
    if set(spec) - {"decay", "multiply", "boost", "pool"}:
        raise ValueError(f"unknown rules {sorted(set(spec) - {'decay', 'multiply', 'boost', 'pool'})}")
    pair = isinstance(spec.get("boost"), tuple) and len(spec["boost"]) == 2 and isinstance(spec["boost"][1], (int, float))
    boosts = [spec["boost"]] if pair else _listed(spec.get("boost"), dict)
    rules = [*map(_decay, _listed(spec.get("decay"), dict)), *map(_multiplier, _listed(spec.get("multiply"), (str, dict))), *map(_boost, boosts)]
    pool = int(spec["pool"]) if "pool" in spec else None
    if pool is not None and pool < 0:
        raise ValueError("a pool has no fewer than 0 candidates")
    return {"modifiers": rules, "pool": pool}


def modified(df: DataFrame, score: str, modifiers: Sequence) -> DataFrame:
    """df with base_score, and score times all factors plus all bonuses."""
    fields = {f.name: f.dataType for f in df.schema if f.name != score and _filterable(f.dataType)}
    out = F.col("base_score")
    for m in modifiers:
        if not isinstance(m, MatchBoost):
            out = out * m.column(fields)
    for m in modifiers:
        if isinstance(m, MatchBoost):
            out = out + m.column(fields)
    return df.withColumn("base_score", F.col(score).cast("double")).withColumn(score, out)


def _filterable(kind: T.DataType) -> bool:
    try:
        kind_of(kind)
        return True
    except ValueError:
        return False


def rescored(candidates: DataFrame, score: str, modifiers: Sequence, k: int, pool: int | None = None, id: str = "id") -> DataFrame:
    """The k best of the `pool` best candidates (max(4k, 20) unless given) after modifiers; ties in the order before."""
    n = max(pool, k) if pool else max(4 * k, 20)
    best = candidates.orderBy(F.desc(score), id).limit(n).withColumn("inner", F.row_number().over(Window.orderBy(F.desc(score), id)))
    changed = modified(best, score, modifiers).orderBy(F.desc(score), "inner").limit(k)
    return changed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "inner"))).drop("inner")


def mmr(relevance: np.ndarray, vectors: list[np.ndarray | None], k: int, balance: float) -> list[int]:
    """Places of k rows in order of choice: balance * relevance / greatest - (1 - balance) * likeness to the chosen."""
    if not 0 <= balance <= 1:
        raise ValueError("the balance lies between 0 and 1")
    n = len(relevance)
    dim = next((len(v) for v in vectors if v is not None), 1)
    x = np.stack([np.zeros(dim) if v is None else np.asarray(v, np.float64) for v in vectors]) if n else np.zeros((0, dim))
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(length > 0, length, 1)
    has = np.array([v is not None for v in vectors], bool)
    top = max(relevance.max(initial=0), 1e-300)
    closest, left, out = np.full(n, -1.0), np.ones(n, bool), []
    while left.any() and len(out) < k:
        value = balance * relevance / top - (1 - balance) * (closest if out else np.zeros(n))
        at = int(np.where(left, value, -np.inf).argmax())
        out.append(at)
        left[at] = False
        closest = np.maximum(closest, np.where(has & has[at], x @ x[at], 0.0))
    return out


def diverse(candidates: DataFrame, k: int, balance: float, score: str = "score", vector: str = "vector", id: str = "id", by: str | None = None) -> DataFrame:
    """mmr() over candidates, for each value of `by` if given; candidates are a search's pool, so a group is small."""

    candidates = candidates.drop("rank")

    def choose(pdf):
        pdf = pdf.sort_values([score, id], ascending=[False, True], kind="stable").reset_index(drop=True)
        at = mmr(pdf[score].to_numpy(float), list(pdf[vector]), k, balance)
        out = pdf.iloc[at].copy()
        out["rank"] = np.arange(1, len(at) + 1, dtype=np.int32)
        return out

    schema = T.StructType([*candidates.schema.fields, T.StructField("rank", T.IntegerType())])
    if by:
        return candidates.groupBy(by).applyInPandas(choose, schema)
    return candidates.groupBy().applyInPandas(choose, schema)


def rerank(candidates: DataFrame, query: str, model: Callable | object, k: int, text: str = "text", score: str = "score", id: str = "id") -> list[dict]:
    """The k best candidates by a function of (query, texts), or an object with predict(pairs); equal ones keep their order."""
    rows = [r.asDict() for r in candidates.orderBy(F.desc(score), id).collect()]  # a search's pool
    texts = [r[text] or "" for r in rows]
    scores = [float(x) for x in (model.predict([(query, t) for t in texts]) if hasattr(model, "predict") else model(query, texts))]
    if len(scores) != len(rows) or not all(map(math.isfinite, scores)):
        raise ValueError("a reranker gives a finite score for each text")
    order = sorted(range(len(rows)), key=lambda i: -scores[i])[:k]
    return [rows[i] | {"rerank_score": scores[i]} for i in order]
