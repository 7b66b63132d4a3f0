"""Filters on metadata: a small tree of conditions, compiled to a Column.

Conditions have two values: a row without the field matches no comparison, not even `ne`, and `~` turns the outcome of
the whole condition. Negations are therefore pushed to the leaves, where a negated one becomes `field is null or not
leaf`; so every leaf stays a form that Parquet readers can push down. Integers and floats are compared exactly, by
changing the constant and never casting the column.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.geo import geo_distance_m

#: The deepest nesting of a filter.
DEPTH = 256
LEAST, MOST = -(2**63), 2**63 - 1


def kind_of(kind: T.DataType) -> str:
    """int, float, bool, keyword or tags; ValueError for other column types."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.StringType):
        return "keyword"
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return "tags"
    raise ValueError(f"no filter applies to a column of type {kind.simpleString()}")


def _value(x):
    x = x.item() if hasattr(x, "item") else x
    if not isinstance(x, (bool, int, float, str)):
        raise TypeError(f"a filter can't compare with {type(x).__name__}")
    if isinstance(x, float) and math.isnan(x):
        raise ValueError("a filter can't compare with NaN")
    return x


@dataclass(frozen=True)
class Filter:
    op: str
    name: str = ""
    values: tuple = ()
    parts: tuple = field(default=())

    def __and__(self, other: Filter) -> Filter:
        return Filter.all_of([self, other])

    def __or__(self, other: Filter) -> Filter:
        return Filter.any_of([self, other])

    def __invert__(self) -> Filter:
        return Filter("not", parts=(self,))

    @property
    def depth(self) -> int:
        deepest, todo = 0, [(self, 1)]
        while todo:
            f, d = todo.pop()
            deepest = max(deepest, d)
            todo += [(p, d + 1) for p in f.parts]
        return deepest

    @staticmethod
    def all() -> Filter:
        return Filter("all")

    @staticmethod
    def all_of(parts: Sequence[Filter]) -> Filter:
        return Filter("and", parts=tuple(parts))

    @staticmethod
    def any_of(parts: Sequence[Filter]) -> Filter:
        return Filter("or", parts=tuple(parts))

    @staticmethod
    def eq(name, v) -> Filter:
        return Filter("eq", name, (_value(v),))

    @staticmethod
    def ne(name, v) -> Filter:
        return Filter("ne", name, (_value(v),))

    @staticmethod
    def lt(name, v) -> Filter:
        return Filter("lt", name, (_value(v),))

    @staticmethod
    def le(name, v) -> Filter:
        return Filter("le", name, (_value(v),))

    @staticmethod
    def gt(name, v) -> Filter:
        return Filter("gt", name, (_value(v),))

    @staticmethod
    def ge(name, v) -> Filter:
        return Filter("ge", name, (_value(v),))

    @staticmethod
    def between(name, low, high) -> Filter:
        return Filter("between", name, (_value(low), _value(high)))

    @staticmethod
    def in_(name, values: Iterable) -> Filter:
        return Filter("in", name, tuple(_value(v) for v in values))

    @staticmethod
    def has_tag(name, tag: str) -> Filter:
        return Filter("any_tag", name, (tag,))

    @staticmethod
    def has_any_tag(name, tags: Iterable[str]) -> Filter:
        return Filter("any_tag", name, tuple(tags))

    @staticmethod
    def has_all_tags(name, tags: Iterable[str]) -> Filter:
        return Filter("all_tags", name, tuple(tags))

    @staticmethod
    def exists(name) -> Filter:
        return Filter("exists", name)

    @staticmethod
    def missing(name) -> Filter:
        return ~Filter.exists(name)

    @staticmethod
    def geo_radius(lat, lon, at_lat: float, at_lon: float, metres: float) -> Filter:
        if not (math.isfinite(metres) and metres >= 0 and abs(at_lat) <= 90 and abs(at_lon) <= 180):
            raise ValueError("a geographic circle needs a place on Earth and a radius of at least 0")
        return Filter("geo_radius", values=(lat, lon, float(at_lat), float(at_lon), float(metres)))

    @staticmethod
    def geo_box(lat, lon, south: float, west: float, north: float, east: float) -> Filter:
        """west > east: the box crosses the antimeridian."""
        if not (-90 <= south <= north <= 90 and abs(west) <= 180 and abs(east) <= 180):
            raise ValueError("a geographic box needs south <= north and places on Earth")
        return Filter("geo_box", values=(lat, lon, float(south), float(west), float(north), float(east)))


def as_filter(x) -> Filter | None:
    """A Filter, or one from {field: value | [values] | {op: value}}; all conditions must hold."""
    if x is None or isinstance(x, Filter):
        return x
    names = {"eq": Filter.eq, "ne": Filter.ne, "lt": Filter.lt, "le": Filter.le, "gt": Filter.gt, "ge": Filter.ge, "lte": Filter.le, "gte": Filter.ge, "in": Filter.in_, "any": Filter.has_any_tag, "all": Filter.has_all_tags}
    parts = []
    for k, v in dict(x).items():
        if isinstance(v, dict):
            for op, arg in v.items():
                if op == "exists":
                    parts.append(Filter.exists(k) if arg else Filter.missing(k))
                elif op == "between":
                    parts.append(Filter.between(k, *arg))
                elif op in names:
                    parts.append(names[op](k, arg))
                else:
                    raise ValueError(f"unknown condition {op!r}")
        else:
            parts.append(Filter.in_(k, v) if isinstance(v, (list, tuple, set)) else Filter.eq(k, v))
    return Filter.all() if not parts else parts[0] if len(parts) == 1 else Filter.all_of(parts)


def _order(op: str, c: Column, v) -> Column:
    return {"eq": c == v, "ne": c != v, "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}[op]


def _number(op: str, c: Column, kind: str, v) -> Column | bool:
    """c op v, exactly; True stands for any value that is present."""
    if isinstance(v, bool) or isinstance(v, str):
        raise ValueError("a number is compared with numbers only")
    if kind == "int":
        if isinstance(v, float):
            if v.is_integer() and LEAST <= v <= MOST:
                v = int(v)
            elif math.isinf(v) or not LEAST <= v <= MOST:
                return op in (("lt", "le", "ne") if v > 0 else ("gt", "ge", "ne"))
            else:
                low = math.floor(v)
                return {"eq": False, "ne": True, "lt": c <= low, "le": c <= low, "gt": c > low, "ge": c > low}[op]
        if not LEAST <= v <= MOST:
            return op in (("lt", "le", "ne") if v > 0 else ("gt", "ge", "ne"))
        return _order(op, c, F.lit(v).cast("long"))
    if isinstance(v, int):
        try:
            near = float(v)
        except OverflowError:
            near = math.inf if v > 0 else -math.inf
        if not math.isinf(near) and int(near) == v:
            v = near
        else:
            low = near if not math.isinf(near) and int(near) < v else math.nextafter(near, -math.inf)
            high = math.nextafter(low, math.inf)
            return {"eq": False, "ne": True, "lt": c <= low, "le": c <= low, "gt": c >= high, "ge": c >= high}[op]
    return _order(op, c, F.lit(float(v)))


class Compiler:
    """strict: an unknown field is an error; else it is a field that no row has."""

    def __init__(self, fields: dict[str, T.DataType], strict: bool = True) -> None:
        self.fields, self.strict = fields, strict

    def kind(self, name: str) -> str | None:
        if name not in self.fields:
            if self.strict:
                raise ValueError(f"unknown field {name!r}")
            return None
        return kind_of(self.fields[name])

    def build(self, f: Filter) -> Column | bool:
        if f.depth > DEPTH:
            raise ValueError(f"a filter is nested at most {DEPTH} deep")
        return self._build(f, False)

    def _build(self, f: Filter, negated: bool) -> Column | bool:
        if f.op == "not":
            return self._build(f.parts[0], not negated)
        if f.op in ("and", "or"):
            both = (f.op == "and") != negated  # De Morgan
            parts = [self._build(p, negated) for p in f.parts]
            if (not both) in [p for p in parts if isinstance(p, bool)]:
                return not both
            rest = [p for p in parts if not isinstance(p, bool)]
            return reduce(lambda a, b: a & b if both else a | b, rest) if rest else both
        if f.op == "all":
            return not negated
        leaf, columns = self._leaf(f)
        if isinstance(leaf, bool):
            # True: wherever the fields are present
            if not leaf or not columns:
                return leaf != negated
            present = reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))
            return reduce(lambda a, b: a | b, (c.isNull() for c in columns)) if negated else present
        if not negated:
            return leaf
        return reduce(lambda a, b: a | b, [*(c.isNull() for c in columns), ~leaf])

    def _leaf(self, f: Filter) -> tuple[Column | bool, list[Column]]:
        if f.op in ("geo_radius", "geo_box"):
            kinds = [self.kind(n) for n in f.values[:2]]
            if None in kinds:
                return False, []
            if set(kinds) - {"int", "float"}:
                raise ValueError("places are numbers")
            lat, lon = (F.col(n).cast("double") for n in f.values[:2])
            on_earth = lat.between(-90, 90) & lon.between(-180, 180)
            if f.op == "geo_radius":
                return on_earth & (geo_distance_m(lat, lon, f.values[2], f.values[3]) <= f.values[4]), [F.col(n) for n in f.values[:2]]
            south, west, north, east = f.values[2:]
            across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
            return on_earth & (lat >= south) & (lat <= north) & across, [F.col(n) for n in f.values[:2]]
        kind = self.kind(f.name)
        if kind is None:
            return False, []
        c = F.col(f.name)
        if f.op == "exists":
            return True, [c]
        if f.op in ("any_tag", "all_tags"):
            if kind != "tags":
                raise ValueError(f"{f.name!r} holds no tags")
            if any(not isinstance(t, str) for t in f.values):
                raise TypeError("tags are texts")
            if not f.values:
                return f.op == "all_tags", [c]
            wanted = F.array(*(F.lit(t) for t in f.values))
            return (F.arrays_overlap(c, wanted) if f.op == "any_tag" else F.size(F.array_except(wanted, c)) == 0), [c]
        if kind == "tags":
            raise ValueError("tags are only asked for by the tag conditions")
        if f.op == "between":
            low, high = f.values
            if kind not in ("int", "float"):
                raise ValueError("only numbers lie between others")
            parts = [_number("ge", c, kind, low), _number("le", c, kind, high)]
            if low > high or False in [p for p in parts if isinstance(p, bool)]:
                return False, [c]
            rest = [p for p in parts if not isinstance(p, bool)]
            return (reduce(lambda a, b: a & b, rest) if rest else True), [c]
        if f.op == "in":
            return self._in(c, kind, f.values), [c]
        v = f.values[0]
        if kind in ("int", "float"):
            return _number(f.op, c, kind, v), [c]
        if f.op not in ("eq", "ne"):
            raise ValueError(f"{f.name!r} has no order")
        if isinstance(v, bool) != (kind == "bool") or isinstance(v, str) != (kind == "keyword"):
            raise ValueError(f"{f.name!r} is of type {kind}")
        return _order(f.op, c, F.lit(v)), [c]

    def _in(self, c: Column, kind: str, values: tuple) -> Column | bool:
        if kind == "bool":
            if any(not isinstance(v, bool) for v in values):
                raise ValueError("a truth value is compared with truth values only")
            return True if len(set(values)) == 2 else c == F.lit(values[0]) if values else False
        if kind == "keyword":
            if any(not isinstance(v, str) for v in values):
                raise ValueError("a text is compared with texts only")
            return c.isin(list(values)) if values else False
        exact = []
        for v in values:
            if isinstance(v, (bool, str)):
                raise ValueError("a number is compared with numbers only")
            if kind == "int":
                if float(v).is_integer() if isinstance(v, float) else True:
                    if LEAST <= v <= MOST:
                        exact.append(int(v))
            elif isinstance(v, float) or int(float(v)) == v:
                exact.append(float(v))
        return c.isin(exact) if exact else False


def compile_filter(f, fields: dict[str, T.DataType] | T.StructType, strict: bool = True) -> Column:
    """The Column of a filter (or a dict of conditions, or None) for a where clause."""
    if isinstance(fields, T.StructType):
        fields = {x.name: x.dataType for x in fields}
    f = as_filter(f)
    built = True if f is None else Compiler(fields, strict).build(f)
    return F.lit(built) if isinstance(built, bool) else built


def where(df, f, strict: bool = True):
    """The rows of df that a filter matches."""
    return df.where(compile_filter(f, df.schema, strict))


def matches(f, fields, strict: bool = False) -> Column:
    """A filter as a value of its own: false where a needed field is missing."""
    return F.coalesce(compile_filter(f, fields, strict), F.lit(False))
