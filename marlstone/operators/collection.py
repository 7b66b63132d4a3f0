"""A collection of documents: vector, text, sparse vector and metadata under one id, in a store."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.dates import now_ms, to_ms
from marlstone.functions.text import id_of
from marlstone.operators import aggregates, fusion, mutations, scoring, search, sparse
from marlstone.operators.filters import Filter, as_filter, kind_of, where
from marlstone.operators.lists import ListIndex
from marlstone.operators.payload import PayloadIndex
from marlstone.operators.postings import Postings
from marlstone.sources.store import Store

#: Settings of the presets for create_vector_index(): lists of the index, lists that a search probes, and the codec.
PRESETS = {"balanced": {"lists": 256, "probes": 16, "codec": "sq8"}, "high_recall": {"lists": 256, "probes": 64, "codec": None}, "low_memory": {"lists": 256, "probes": 32, "codec": "pq"}}
#: The parts of a document. A metadata field with such a name is called metadata_<name> everywhere.
PARTS = ("id", "key", "expires_at", "vector", "text", "sparse", "indices", "values")


class KeyClash(ValueError):
    """Two keys, or a key and a number, with one id."""


class Collection:
    """fields: the metadata columns as a StructType; parts are the columns vector, text, indices and values.

    Documents are named by a number from 0 on, or by a text, whose id is the upper 63 bits of its 64-bit hash; ids order
    keys as their hashes do. A key that would take the id of another document is refused.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, fields: T.StructType | None = None, metric: str = "cosine", ttl_ms: int | None = None, model: sparse.BM25 = sparse.BM25()) -> None:
        self.spark, self.store, self.dim, self.metric, self.ttl_ms, self.model = spark, Store(spark, path), dim, metric, ttl_ms, model
        if {f.name for f in fields or ()} & set(mutations.RESERVED):
            raise ValueError("a metadata field has a reserved name")
        self.fields = T.StructType([T.StructField(f"metadata_{f.name}" if f.name in PARTS else f.name, f.dataType) for f in fields or ()])
        parts = [("id", T.LongType()), ("_key", T.StringType()), ("vector", T.ArrayType(T.FloatType())), ("text", T.StringType()), ("indices", T.ArrayType(T.LongType())), ("values", T.ArrayType(T.FloatType())), (mutations.EXPIRES, T.LongType())]
        self.schema = T.StructType([T.StructField(n, t) for n, t in parts] + list(self.fields))

    def table(self) -> DataFrame:
        """All rows, expired ones too."""
        found = self.store.load()
        return self.spark.createDataFrame([], self.schema) if found is None else found

    def rows(self, now: int | None = None) -> DataFrame:
        return mutations.alive(self.table(), now)

    def __len__(self) -> int:
        return self.table().count()

    def __contains__(self, key: int | str) -> bool:
        return not self.rows().where(F.col("id") == self._id(key)).isEmpty()

    @staticmethod
    def _id(key: int | str) -> int:
        if isinstance(key, str):
            return id_of(key) >> 1
        if isinstance(key, bool) or int(key) != key or not 0 <= key < 2**63:
            raise ValueError("a number that names a document is whole, from 0 on")
        return int(key)

    def _row(self, key: int | str, vector=None, text=None, sparse=None, expires_at=None, **metadata) -> dict:
        if set(metadata) - {f.name for f in self.fields}:
            raise ValueError(f"unknown fields {sorted(set(metadata) - {f.name for f in self.fields})}")
        if vector is not None and self.dim and len(vector) != self.dim:
            raise ValueError(f"a vector has {self.dim} dimensions")
        if vector is not None and not all(abs(float(x)) < float("inf") for x in vector):
            raise ValueError("a vector's numbers are finite")
        terms = sorted((int(t), float(w)) for t, w in (sparse or {}).items() if w)
        if any(not 0 <= t < 2**32 for t, _ in terms):
            raise ValueError("terms have 32 bits")
        if expires_at is None and self.ttl_ms:
            expires_at = now_ms() + self.ttl_ms
        tags = {k: list(dict.fromkeys(v)) if isinstance(v, (list, tuple, set)) else v for k, v in metadata.items()}
        return {"id": self._id(key), "_key": key if isinstance(key, str) else None, "vector": None if vector is None else [float(x) for x in vector], "text": text, "indices": [t for t, _ in terms] if sparse is not None else None, "values": [w for _, w in terms] if sparse is not None else None, mutations.EXPIRES: expires_at, **tags}

    def upsert(self, key: int | str, **parts) -> None:
        self.upsert_many([(key, parts)])

    def upsert_many(self, documents: Iterable[tuple[int | str, dict]]) -> None:
        """The last of several documents with one name counts; all are checked before any is written."""
        rows: dict[int, dict] = {}
        for r in (self._row(k, **p) for k, p in documents):
            if r["id"] in rows and rows[r["id"]]["_key"] != r["_key"]:
                raise KeyClash(f"{r['_key']!r} has the id of {rows[r['id']]['_key']!r}")
            rows[r["id"]] = r
        self.upsert_frame(self.spark.createDataFrame(list(rows.values()), self.schema))

    def upsert_frame(self, df: DataFrame) -> None:
        missing = [f for f in self.schema if f.name not in df.columns]
        rows = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(self.schema.names)
        self._agreed(rows)
        self.store.upsert(rows)

    def _agreed(self, rows: DataFrame) -> None:
        """KeyClash if an id is taken by a document of another key."""
        stored = self.table().select("id", F.col("_key").alias("__stored"))
        clash = rows.select("id", "_key").join(stored, "id").where(~F.col("_key").eqNullSafe(F.col("__stored"))).first()
        if clash is not None:
            raise KeyClash(f"{clash['_key']!r} has the id of {clash['__stored']!r}")

    def add(self, key: int | str, **parts) -> None:
        row = self.spark.createDataFrame([self._row(key, **parts)], self.schema)
        self._agreed(row)
        if not self.table().join(row.select("id"), "id", "left_semi").isEmpty():
            raise ValueError(f"{key!r} is taken")
        self.store.upsert(row)

    def update(self, key: int | str, **parts) -> bool:
        """Replaces a document that is there; False if it isn't."""
        row = self.spark.createDataFrame([self._row(key, **parts)], self.schema)
        if key not in self:
            return False
        self._agreed(row)
        self.store.upsert(row)
        return True

    def _removed(self, gone: DataFrame) -> int:
        n = gone.count()
        if n:
            self.store.remove(gone)
        return n

    def remove(self, *keys: int | str) -> int:
        return self._removed(self.table().where(F.col("id").isin([self._id(k) for k in keys])))

    def remove_where(self, flt) -> int:
        return self._removed(where(self.table(), flt))

    def remove_expired(self, now: int | None = None) -> int:
        return self._removed(self.table().where(F.col(mutations.EXPIRES) < (now_ms() if now is None else now)))

    def set_metadata_where(self, flt, changes: dict) -> int:
        """All rows that match get the change, expired ones too."""
        table = self.table()
        changed = mutations.set_metadata_where(where(table, flt), None, changes)
        n = changed.count()
        if n:
            self.store.upsert(changed)
        return n

    def set_metadata(self, key: int | str, changes: dict) -> bool:
        rows = self.table().where(F.col("id") == self._id(key))
        changed = mutations.set_metadata_where(rows, None, changes)
        if changed.isEmpty():
            return False
        self.store.upsert(changed)
        return True

    def get(self, key: int | str) -> dict | None:
        row = self.rows().where(F.col("id") == self._id(key)).first()
        return row and row.asDict()

    def get_vector(self, key: int | str) -> list[float] | None:
        """Read from the column of vectors alone."""
        row = self.rows().where(F.col("id") == self._id(key)).select("vector").first()
        return None if row is None else row[0]

    def get_metadata(self, key: int | str) -> dict | None:
        """The fields that the document has, read from their columns alone."""
        row = self.rows().where(F.col("id") == self._id(key)).select([f.name for f in self.fields]).first()
        return None if row is None else {k: v for k, v in row.asDict().items() if v is not None}

    def count_where(self, flt=None) -> int:
        """From the index's counts, where they tell and nothing has changed or can expire; else by a scan."""
        index = self._fresh("payload", PayloadIndex)
        if index is not None and not self._may_expire():
            n = index.exact_count(flt)
            if n is not None:
                return n
        return aggregates.count_where(self.rows(), flt)

    def facets(self, requests, flt=None, ids=None) -> dict:
        """From the index's counts for values of indexed fields over all documents; else by a scan."""
        requests = [aggregates.FacetRequest(r) if isinstance(r, str) else r for r in requests]
        index = self._fresh("payload", PayloadIndex) if flt is None and ids is None and not self._may_expire() else None
        known = index.fields() if index is not None else []
        out = {}
        for r in requests:
            if r.name in known and not r.bounds and len({x.name for x in requests}) == len(requests):
                s = index.facet_summary(r)
                values = [(x["value"], x["count"]) for x in index.facet_values(r).orderBy("place").collect()]
                out[r.name] = {"total": s["total"], "missing": s["missing"], "values": values, "other": s["other"], "buckets": [], "distinct": s["distinct"] if r.distinct else None}
        rest = [r for r in requests if r.name not in out]
        if rest:
            out |= aggregates.facets(self.rows(), rest, flt, ids)
        return {r.name: out[r.name] for r in requests}

    def scan(self, limit: int, after: int | None = None, flt=None):
        return mutations.scan(self.rows(), limit, after, flt)

    # indexes: folders beside the documents, which count while the collection is as it was when they were built

    def _fresh(self, kind: str, make, **options):
        m = self.store.manifest()
        return make(self.spark, f"{self.store.path}/index-{kind}", **options) if m.get("built", {}).get(kind) == m["lsn"] else None

    def _built(self, kind: str, **more) -> None:
        m = self.store.manifest()
        expiry = not self.table().where(F.col(mutations.EXPIRES).isNotNull()).isEmpty()
        self.store.set(built=m.get("built", {}) | {kind: m["lsn"]}, expiry=expiry, **more)

    def _may_expire(self) -> bool:
        """Whether a document had a time to expire when an index was built, or new ones get one."""
        return self.ttl_ms is not None or self.store.manifest().get("expiry", True)

    def create_payload_index(self, name: str) -> None:
        """Counts and ids of the values of a keyword, truth value or tags field; facets and counts read them."""
        if name not in self.fields.names or kind_of(self.fields[name].dataType) not in ("keyword", "bool", "tags"):
            raise ValueError("an index is on a keyword, a truth value or tags")
        self._index_payload(sorted({*self.payload_indexes(), name}))

    def _index_payload(self, names: list[str]) -> None:
        PayloadIndex(self.spark, f"{self.store.path}/index-payload").build(self.table(), names)
        self._built("payload", indexes=names)

    def payload_indexes(self) -> list[str]:
        return self.store.manifest()["indexes"]

    def create_text_index(self, buckets: int = 64) -> None:
        """Stored postings of the texts, which searches read instead of the texts."""
        index = Postings(self.spark, f"{self.store.path}/index-text", self.model, buckets)
        m = index.manifest()
        with index.writing():
            index.publish(m | {"segments": [], "gone": [x["name"] for x in m["segments"]]})
            index.upsert(self.table())
        self._built("text")

    def create_vector_index(self, preset: str = "balanced", lists: int | None = None) -> None:
        """Lists and codes by a preset; searches by vector alone read them."""
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset!r}")
        p = PRESETS[preset]
        ListIndex(self.spark, f"{self.store.path}/index-vector").build(self.table(), lists or p["lists"], self.metric, p["codec"])
        self._built("vector", preset=preset)

    def refresh(self) -> None:
        """Builds the indexes anew that there are and that changes have made stale."""
        m = self.store.manifest()
        stale = {k for k, lsn in m.get("built", {}).items() if lsn != m["lsn"]}
        if "payload" in stale:
            self._index_payload(m["indexes"])
        if "text" in stale:
            self.create_text_index()
        if "vector" in stale:
            self.create_vector_index(m.get("preset", "balanced"))

    def search(self, k: int = 10, vector=None, text: str | None = None, sparse: dict | None = None, flt=None, weights=None, method: str = "rrf", rrf_k: float = 60.0, candidates: int | None = None, modifiers=(), diversity: float | None = None, now: int | None = None) -> DataFrame:
        """rank, id, score, the sides' ranks and values, and the documents' metadata and text. Diversity needs vectors.

        modifiers: a list, or a dict as scoring.as_modifiers() takes. Documents that have expired are not found, but
        count in the statistics of texts until they are removed.
        """
        from marlstone.operators.sparse import sparse_postings

        if diversity is not None and vector is None:
            raise ValueError("a diverse result needs a vector to search by")
        now = now_ms() if now is None else now
        table = self.table()
        living = Filter.missing(mutations.EXPIRES) | Filter.ge(mutations.EXPIRES, now)
        asked = as_filter(flt)
        living = living if asked is None else living & asked
        posts = None if sparse is None else sparse_postings(table.where(F.col("indices").isNotNull()))
        rules = scoring.as_modifiers(modifiers)
        cut = not rules["modifiers"] and diversity is None
        depth = fusion.depth(k, candidates, rules["pool"] or 0)
        index = self._fresh("text", Postings, model=self.model) if text is not None else None
        found = fusion.hybrid(table, k, vector, text, sparse, posts=posts, metric=self.metric, flt=living, weights=weights, method=method, rrf_k=rrf_k, candidates=depth, model=self.model, cut=cut, index=index)
        found = table.drop("indices", "values").join(F.broadcast(found), "id")  # as many rows as the sides were cut at
        if rules["modifiers"]:
            found = scoring.modified(found, "score", rules["modifiers"])
        if diversity is not None:
            return scoring.diverse(found, k, diversity)
        found = found.orderBy(F.desc("score"), "id").limit(k)
        return found.drop("vector").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))

    def near(self, vector, k: int = 10, flt=None, probes: int | None = None, stats: dict | None = None) -> DataFrame:
        """rank, id, distance by vector alone, through the index of vectors if there is one that is up to date."""
        index = self._fresh("vector", ListIndex) if not self._may_expire() else None
        if index is not None:
            return index.search(vector, k, probes or PRESETS[self.store.manifest().get("preset", "balanced")]["probes"], flt=flt, stats=stats)
        payload = self._fresh("payload", PayloadIndex)
        found = search.dense(self.rows(), vector, k, self.metric, flt, payload=payload, stats=stats)
        return found.select("rank", "id", "distance")

    def search_groups(self, vector, by: str, groups: int, per_group: int = 1, flt=None) -> DataFrame:
        return aggregates.search_groups(self.rows(), vector, by, groups, per_group, self.metric, flt=flt)

    def recommend(self, positive, negative=(), k: int = 10, flt=None) -> DataFrame:
        return aggregates.recommend(self.rows(), [self._id(x) for x in positive], [self._id(x) for x in negative], k, self.metric, flt=flt)

    def checkpoint(self) -> None:
        self.store.checkpoint()

    def maintain(self, segments: int = 8) -> bool:
        """A checkpoint once the log has so many changes, and indexes that are stale built anew."""
        due = self.store.identify()["segments"] >= segments
        if due:
            self.checkpoint()
            self.refresh()
        return due

    def health(self) -> dict:
        """Live and stored rows, parts, and the change log; figures of a graph are None, as there is none."""
        t = self.table().agg(F.count("*").alias("stored"), F.count("vector").alias("vectors"), F.count("text").alias("texts"), F.count("indices").alias("sparse")).first().asDict()
        return t | {"live": self.rows().count(), "levels": None, "mean_degree": None} | self.store.identify()

    # tables in and out

    def export(self, flt=None, vectors: bool = True, text: bool = True, metadata: bool = True) -> DataFrame:
        """Live documents by id: id, key, expires_at, vector, sparse (indices and values), text, and the fields."""
        rows = where(self.rows(), flt)
        columns = [F.col("id"), F.col("_key").alias("key"), F.col(mutations.EXPIRES).alias("expires_at")]
        if vectors:
            columns += [F.col("vector"), F.when(F.col("indices").isNotNull(), F.struct("indices", "values")).alias("sparse")]
        columns += [F.col("text")] * text + [F.col(f.name) for f in self.fields] * metadata
        return rows.select(columns)

    def write_parquet(self, path: str, compression: str = "zstd", **options) -> None:
        """export() as Parquet, which upsert_parquet() reads."""
        self.export(**options).write.option("compression", compression).parquet(path)

    def import_frame(self, df: DataFrame, id_column: str | None = None, vector_column: str | None = None, text_column: str | None = None, sparse_column: str | None = None, metadata_columns: Sequence[str] | None = None, expires_column: str | None = None) -> None:
        """Upserts a table with the columns that export() gives, or others that are named.

        Names are those of the key column where there is one that holds any, else of id; a text names by its hash. All
        other columns are fields. A name that is missing is an error; a vector, text or field that is missing is none.
        """
        pick = lambda given, default: given or (default if default in df.columns else None)
        if id_column is None:
            keyed = "key" in df.columns and not df.where(F.col("key").isNotNull()).isEmpty()
            id_column = "key" if keyed and df.where(F.col("key").isNull()).isEmpty() else "id"
        if id_column not in df.columns:
            raise ValueError("there is no column that names the documents")
        if not df.where(F.col(id_column).isNull()).isEmpty():
            raise ValueError("a document has no name")
        vector_column, text_column, sparse_column, expires_column = pick(vector_column, "vector"), pick(text_column, "text"), pick(sparse_column, "sparse"), pick(expires_column, "expires_at")
        used = {id_column, "id", "key", vector_column, text_column, sparse_column, expires_column}
        names = [c for c in df.columns if c not in used] if metadata_columns is None else list(metadata_columns)
        called = {f"metadata_{c}" if c in PARTS else c: c for c in names}
        if set(called) - set(self.fields.names):
            raise ValueError(f"unknown fields {sorted(set(called) - set(self.fields.names))}")
        text_key = isinstance(df.schema[id_column].dataType, T.StringType)
        if text_key:
            from marlstone.functions.text import key_ids

            hashed = df.withColumn("id", F.shiftrightunsigned(key_ids(id_column), 1)).withColumn("_key", F.col(id_column))
        else:
            if not df.where(F.col(id_column) < 0).isEmpty():
                raise ValueError("a number that names a document is whole, from 0 on")
            stored = F.col("key") if "key" in df.columns else F.lit(None)
            hashed = df.withColumn("_key", stored.cast("string")).withColumn("id", F.col(id_column).cast("long"))
        out = {"id": F.col("id"), "_key": F.col("_key")}
        if vector_column:
            out["vector"] = F.col(vector_column).cast("array<float>")
            bad = F.col(vector_column).isNotNull() & ((F.size(vector_column) != (self.dim or F.size(vector_column))) | F.exists(F.col(vector_column).cast("array<float>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            if not hashed.where(bad).isEmpty():
                raise ValueError("a vector has another dimension, or numbers that are not finite")
        if text_column:
            out["text"] = F.col(text_column).cast("string")
        if sparse_column:
            out["indices"], out["values"] = F.col(f"{sparse_column}.indices").cast("array<bigint>"), F.col(f"{sparse_column}.values").cast("array<float>")
        default = F.lit(now_ms() + self.ttl_ms) if self.ttl_ms else F.lit(None)
        out[mutations.EXPIRES] = F.coalesce(F.col(expires_column), default).cast("long") if expires_column else default.cast("long")
        for name, column in called.items():
            c = F.col(column)
            out[name] = (F.array_distinct(c) if kind_of(self.fields[name].dataType) == "tags" else c).cast(self.fields[name].dataType)
        self.upsert_frame(hashed.select(*(c.alias(k) for k, c in out.items())))

    def upsert_parquet(self, path: str, **columns) -> None:
        self.import_frame(self.spark.read.parquet(path), **columns)

    def upsert_arrow(self, data, **columns) -> None:
        """A pyarrow Table; fixed-size and other lists alike are vectors."""
        self.import_frame(self.spark.createDataFrame(_plain(data)), **columns)

    def upsert_pandas(self, pdf, id_column: str | None = None, vector_column: str | None = None, text_column: str | None = None, sparse_column: str | None = None, metadata_columns: Sequence[str] | None = None, expires_column: str | None = None) -> None:
        """A pandas DataFrame, named by a column or its index. Missing values of any kind are none; dates become
        milliseconds; arrays, lists and sets of texts are tags."""
        names = pdf.index if id_column is None else pdf[id_column]
        used = {id_column, vector_column, text_column, sparse_column, expires_column}
        fields = [c for c in pdf.columns if c not in used] if metadata_columns is None else list(metadata_columns)
        rows = []
        for name, row in zip(names.tolist(), pdf.to_dict("records")):
            parts = {f"metadata_{c}" if c in PARTS else str(c): v for c in fields if (v := _clean(row[c])) is not None}
            given = {"vector": vector_column, "text": text_column, "sparse": sparse_column, "expires_at": expires_column}
            parts |= {k: v for k, c in given.items() if c is not None and (v := row[c] if k in ("vector", "sparse") else _clean(row[c])) is not None}
            rows.append((name if isinstance(name, str) else int(name), parts))
        self.upsert_many(rows)

    def to_arrow(self, **options):
        """export() as a pyarrow Table, for collections that fit into the driver."""
        return self.export(**options).toArrow()

    def to_pandas(self, **options):
        """export() as a pandas DataFrame by id, for collections that fit into the driver; times of expiry are integers
        that may be missing."""
        out = self.export(**options).orderBy("id").toPandas()
        out["expires_at"] = out["expires_at"].astype("Int64")
        return out

    def describe(self) -> str:
        return json.dumps({"dim": self.dim, "metric": self.metric, "fields": {f.name: f.dataType.simpleString() for f in self.fields}})


def _plain(data):
    """A pyarrow Table whose fixed-size lists are lists."""
    import pyarrow as pa

    data = pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data
    for k, f in enumerate(data.schema):
        if pa.types.is_fixed_size_list(f.type):
            data = data.set_column(k, f.name, data.column(k).cast(pa.list_(f.type.value_type)))
        elif pa.types.is_unsigned_integer(f.type):
            data = data.set_column(k, f.name, data.column(k).cast(pa.int64()))
    return data


def _clean(value):
    """A value of a pandas row as a plain one; None where it is missing."""
    import datetime as dt

    import numpy as np
    import pandas as pd

    if isinstance(value, (list, tuple, set, np.ndarray)):
        return [str(x) for x in (value.tolist() if isinstance(value, np.ndarray) else value)]
    if value is None or pd.isna(value):
        return None
    if isinstance(value, (dt.date, np.datetime64, pd.Timestamp)):
        return to_ms(value)
    return value.item() if isinstance(value, np.generic) else value
