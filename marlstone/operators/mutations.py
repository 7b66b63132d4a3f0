"""Changes to a table of documents, as the table that results; and reading it page by page.

`_expires_at` (milliseconds) is when a row expires: it does from the next millisecond on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.dates import now_ms
from marlstone.operators.filters import compile_filter, kind_of, where

EXPIRES = "_expires_at"
RESERVED = ("_key", EXPIRES)


def page(df: DataFrame, limit: int, after: int | None = None, flt=None, id: str = "id") -> DataFrame:
    """The next `limit` rows by id behind `after`."""
    if limit < 1:
        raise ValueError("a page has a row at least")
    rows = where(df, flt)
    return (rows if after is None else rows.where(F.col(id) > after)).orderBy(id).limit(limit)


def scan(df: DataFrame, limit: int, after: int | None = None, flt=None, id: str = "id") -> tuple[list, int | None]:
    """The rows of a page and the id to go on behind, None if no row follows."""
    rows = page(df, limit + 1, after, flt, id).collect()
    return rows[:limit], rows[limit - 1][id] if len(rows) > limit else None


def documents(df: DataFrame, flt=None, id: str = "id") -> Iterator:
    """All rows by id, a partition at a time."""
    return where(df, flt).orderBy(id).toLocalIterator()


def alive(df: DataFrame, now: int | None = None) -> DataFrame:
    """The rows that haven't expired."""
    return df.where(F.col(EXPIRES).isNull() | (F.col(EXPIRES) >= (now_ms() if now is None else now))) if EXPIRES in df.columns else df


remove_expired = alive


def _ids(df: DataFrame, ids, id: str) -> DataFrame:
    return ids.select(id) if isinstance(ids, DataFrame) else df.sparkSession.createDataFrame([(int(x),) for x in set(ids)], f"{id} long")


def remove(df: DataFrame, ids, id: str = "id") -> DataFrame:
    """Without some ids; unknown and repeated ones don't matter."""
    return df.join(_ids(df, ids, id), id, "left_anti")


def remove_where(df: DataFrame, flt, strict: bool = True) -> DataFrame:
    from marlstone.operators.filters import as_filter

    return where(df, ~as_filter(flt), strict)


def upsert(df: DataFrame, new: DataFrame, id: str = "id", order: str | None = None) -> DataFrame:
    """Rows of new replace those with their id; of several, the one that is last by `order` stays. Columns may be added."""
    if order:
        last = F.row_number().over(Window.partitionBy(id).orderBy(F.desc(order)))
        new = new.withColumn("__n", last).where("__n = 1").drop("__n", order)
    elif new.groupBy(id).count().where("count > 1").limit(1).count():
        raise ValueError("an id comes twice; give the column that orders its rows")
    return df.join(new.select(id), id, "left_anti").unionByName(new, allowMissingColumns=True)


def update(df: DataFrame, new: DataFrame, id: str = "id") -> DataFrame | None:
    """As upsert(), if all ids of new are there; None if one isn't."""
    if not new.join(df.select(id), id, "left_anti").isEmpty():
        return None
    return upsert(df, new, id)


def add(df: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    """All rows of new, or an error if an id is null, twice there, or taken."""
    bad = new.where(F.col(id).isNull() | (F.col(id) < 0)).limit(1).count() or new.groupBy(id).count().where("count > 1").limit(1).count() or new.join(df.select(id), id, "left_semi").limit(1).count()
    if bad:
        raise ValueError("an id is missing, negative, given twice or taken")
    return df.unionByName(new, allowMissingColumns=True)


def _constant(field: T.StructField, value):
    if value is None:
        return F.lit(None).cast(field.dataType)
    kind = kind_of(field.dataType)
    fits = {"int": int, "float": (int, float), "bool": bool, "keyword": str, "tags": (list, tuple, set)}[kind]
    if not isinstance(value, fits) or isinstance(value, bool) != (kind == "bool") or kind == "float" and not abs(value) < float("inf"):
        raise ValueError(f"{field.name!r} is of type {kind}")
    if kind == "tags":
        return F.array(*(F.lit(t) for t in dict.fromkeys(value))).cast(field.dataType)
    return F.lit(value).cast(field.dataType)


def set_metadata_where(df: DataFrame, flt, changes: dict, strict: bool = True) -> DataFrame:
    """The given fields set where the filter holds before the change; None clears a field."""
    if any(k in RESERVED for k in changes):
        raise ValueError("a reserved field can't be set")
    hit = F.coalesce(compile_filter(flt, df.schema, strict), F.lit(False))
    known = {f.name: f for f in df.schema}
    if set(changes) - set(known):
        raise ValueError(f"unknown fields {sorted(set(changes) - set(known))}")
    return df.withColumns({k: F.when(hit, _constant(known[k], v)).otherwise(F.col(k)) for k, v in changes.items()})


def set_metadata(df: DataFrame, key: int, changes: dict, id: str = "id") -> DataFrame:
    from marlstone.operators.filters import Filter

    return set_metadata_where(df, Filter.eq(id, key), changes)


def fold(log: DataFrame, id: str = "id", lsn: str = "lsn", op: str = "op") -> DataFrame:
    """The rows that a log of changes leaves: the last change of each id, unless it removes it."""
    last = F.row_number().over(Window.partitionBy(id).orderBy(F.desc(lsn)))
    return log.withColumn("__n", last).where(f"__n = 1 and {op} <> 'remove'").drop("__n", lsn, op)
