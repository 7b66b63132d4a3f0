"""An index on metadata: for each value of a field the number of rows that hold it, and their ids.

Counts are a small table that facets and planners read instead of documents. Ids are dealt to folders by field and
value, so the candidates of a condition are read from the files of its values alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.aggregates import FacetRequest
from marlstone.operators.filters import Filter, as_filter, kind_of
from marlstone.sources.store import Folder

#: Kinds of fields that an index can be on.
KINDS = ("keyword", "bool", "tags")


class PayloadIndex(Folder):
    """path: a folder. It describes the rows that it was built from; build() again after they change."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32) -> None:
        super().__init__(spark, path, {"fields": {}, "rows": 0, "buckets": buckets, "name": None, "gone": []})

    def build(self, df: DataFrame, fields: Sequence[str], id: str = "id") -> PayloadIndex:
        kinds = {f: kind_of(df.schema[f].dataType) for f in fields}
        if set(kinds.values()) - set(KINDS):
            raise ValueError("an index is on a keyword, a truth value or tags")
        with self.writing():
            m = self.manifest()
            name = f"payload-{uuid.uuid4().hex}"
            # one scan: each row's fields with their values, as texts
            values = [F.struct(F.lit(f).alias("field"), (F.array_distinct(f) if k == "tags" else F.array(F.col(f).cast("string"))).alias("values"), F.col(f).isNotNull().alias("there")) for f, k in kinds.items()]
            each = df.select(F.col(id).alias("id"), F.explode(F.array(*values)).alias("x")).select("id", "x.*").where("there") if values else df.select(F.col(id).alias("id"), F.lit("").alias("field"), F.array(F.lit("")).alias("values")).limit(0)
            rows = each.select("id", "field", F.explode("values").alias("value")).where("value is not null")
            rows = rows.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(m["buckets"])).cast("int"))
            rows.repartition("field", "bucket").sortWithinPartitions("field", "bucket", "value", "id").write.partitionBy("field", "bucket").option("compression", "zstd").parquet(f"{self.path}/{name}/ids")
            found = each.groupBy("field").agg(F.count("*").alias("n")).select("field", F.lit(None).cast("string").alias("value"), "n")
            counts = rows.groupBy("field", "value").agg(F.count("*").alias("n"))
            counts.unionByName(found).sort("field", F.desc("n"), "value").write.option("compression", "zstd").parquet(f"{self.path}/{name}/counts")
            before, m["gone"] = m["gone"], [m["name"]] * (m["name"] is not None)
            m |= {"fields": kinds, "rows": df.count(), "name": name, "id": dict(df.dtypes)[id]}
            self.publish(m)
            self.delete(before)
        return self

    def fields(self) -> list[str]:
        return sorted(self.manifest()["fields"])

    def counts(self, field: str) -> DataFrame:
        """value (as a text), n of an indexed field; null for all rows that have the field."""
        m = self.manifest()
        if field not in m["fields"]:
            raise ValueError(f"{field!r} has no index")
        return self.spark.read.parquet(f"{self.path}/{m['name']}/counts").where(F.col("field") == field).select("value", "n")

    def _texts(self, m: dict, f: Filter) -> list[str] | None:
        """The values that a condition asks for, as texts; None if it isn't one on an indexed field."""
        kind = m["fields"].get(f.name)
        if kind == "tags":
            return sorted(set(f.values)) if f.op == "any_tag" else None
        if kind is None or f.op not in ("eq", "in"):
            return None
        fits = bool if kind == "bool" else str
        if any(not isinstance(v, fits) for v in f.values):
            raise ValueError(f"{f.name!r} is of type {kind}")
        return sorted({str(v).lower() if kind == "bool" else v for v in f.values})

    def _sum(self, m: dict, f: Filter) -> int | None:
        """Over the values of a condition, how many rows hold each; what they add up to."""
        texts = self._texts(m, f)
        if texts is None:
            return None
        return (self.counts(f.name).where(F.col("value").isin(texts)).agg(F.sum("n")).first()[0] or 0) if texts else 0

    def exact_count(self, flt) -> int | None:
        """How many rows match, from counts alone; None if they don't tell."""
        m, f = self.manifest(), as_filter(flt)
        if f is None or f.op == "all":
            return m["rows"]
        if f.op == "not":
            inner = self.exact_count(f.parts[0])
            return None if inner is None else m["rows"] - inner
        if f.op == "exists" and f.name in m["fields"]:
            return self.counts(f.name).where("value is null").agg(F.sum("n")).first()[0] or 0
        if m["fields"].get(f.name) == "tags" and len(set(f.values)) != 1:
            return 0 if f.op == "any_tag" and not f.values else None
        if f.op == "all_tags" and m["fields"].get(f.name) == "tags":
            return self._sum(m, Filter.has_any_tag(f.name, f.values))
        return self._sum(m, f)

    def most(self, flt) -> int | None:
        """A bound on how many rows match, from counts alone."""
        m, f = self.manifest(), as_filter(flt)
        exact = self.exact_count(f)
        if exact is not None:
            return exact
        parts = [self.most(p) for p in f.parts]
        if f.op == "and":
            return min((p for p in parts if p is not None), default=None)
        if f.op == "or":
            return None if None in parts else sum(parts)
        if f.op == "all_tags" and m["fields"].get(f.name) == "tags":
            return min(self._sum(m, Filter.has_tag(f.name, t)) for t in f.values)
        return self._sum(m, f)

    def candidates(self, flt) -> DataFrame | None:
        """id: the rows among which all matches are, by the index alone; None if it doesn't narrow them down.

        All of several conditions: the rows that the smallest one leaves, in the next larger one, and so on. One of
        several: their rows together, if the index knows all of them.
        """
        m, f = self.manifest(), as_filter(flt)
        if f is None:
            return None
        if f.op == "and":
            known = [(self.most(p), k, c) for k, p in enumerate(f.parts) if (c := self.candidates(p)) is not None]
            known.sort(key=lambda x: x[:2])
            return reduce(lambda a, b: a.join(b, "id", "left_semi"), [c for *_, c in known]) if known else None
        if f.op == "or":
            parts = [self.candidates(p) for p in f.parts]
            return None if None in parts or not parts else reduce(DataFrame.unionByName, parts).distinct()
        if f.op == "all_tags" and m["fields"].get(f.name) == "tags" and f.values:
            return self.candidates(Filter.all_of([Filter.has_tag(f.name, t) for t in sorted(set(f.values))]))
        texts = self._texts(m, f)
        if texts is None:
            return None
        rows = self.spark.read.schema(f"id {m['id']}, value string, field string, bucket int").parquet(f"{self.path}/{m['name']}/ids")
        buckets = [F.pmod(F.xxhash64(F.lit(t)), F.lit(m["buckets"])).cast("int") for t in texts]
        rows = rows.where((F.col("field") == f.name) & F.col("bucket").isin(buckets) & F.col("value").isin(texts)) if texts else rows.limit(0)
        return rows.select("id").distinct() if len(texts) > 1 else rows.select("id")

    def facet_values(self, request: FacetRequest) -> DataFrame:
        """As aggregates.facet_values() over all rows, from counts alone."""
        from pyspark.sql import Window

        order = [F.desc("n"), F.asc("value")]
        best = self.counts(request.name).where("value is not null").orderBy(*order)
        best = best.limit(request.limit) if request.limit else best
        return best.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "value", F.col("n").alias("count"))

    def facet_summary(self, request: FacetRequest) -> dict:
        """total, missing, distinct and other over all rows, from counts alone."""
        rows = self.counts(request.name)
        top = self.facet_values(FacetRequest(request.name, request.limit)).agg(F.sum("count")).first()[0] or 0
        every = rows.where("value is not null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        total = rows.where("value is null").agg(F.sum("n")).first()[0] or 0
        return {"total": total, "missing": self.manifest()["rows"] - total, "distinct": every[0], "other": every[1] - top}
