"""Vector files, foreign index files, and text exports."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that a reader hands on at once.
PART = 8 << 20


class FormatError(RuntimeError):
    """A file that is damaged or of another kind."""


def _files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from parse(data.as_buffer())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _vectors(ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, PART // max(1, rows.shape[1] * 4))
    for i in range(0, len(rows), step):
        part = np.ascontiguousarray(rows[i : i + step])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + step]), lists], names=["id", "vector"])


def read_fbin(spark: SparkSession, path: str) -> DataFrame:
    """id (the place in its file), vector: files of a count, a dimension (both 32 bits) and rows of floats, little-endian."""

    def parse(data) -> Iterator[pa.RecordBatch]:
        if len(data) < 8:
            raise FormatError("a vector file is shorter than its header")
        n, dim = struct.unpack("<II", data[:8].to_pybytes())
        if dim < 1 or len(data) != 8 + 4 * n * dim:
            raise FormatError("a vector file has another size than its header says")
        yield from _vectors(np.arange(n), np.frombuffer(data, "<f4", offset=8).reshape(n, dim))

    return _files(spark, path, parse, "id long, vector array<float>")


def read_vecs(spark: SparkSession, path: str, integers: bool = False) -> DataFrame:
    """id, vector: files whose rows begin with their dimension; integers: of 32-bit integers, not floats."""

    def parse(data) -> Iterator[pa.RecordBatch]:
        whole = np.frombuffer(data, "<i4")
        dim = int(whole[0]) if len(whole) else 1
        if dim < 1 or len(whole) % (dim + 1) or (whole.reshape(-1, dim + 1)[:, 0] != dim).any():
            raise FormatError("rows of a vector file differ in their dimension")
        rows = whole.reshape(-1, dim + 1)[:, 1:]
        rows = rows.astype(np.float32) if integers else np.ascontiguousarray(rows).view("<f4")
        yield from _vectors(np.arange(len(rows)), rows)

    return _files(spark, path, parse, "id long, vector array<float>")


def fbin_bytes(rows: np.ndarray) -> bytes:
    rows = np.asarray(rows, "<f4")
    return struct.pack("<II", *rows.shape) + rows.tobytes()


#: The fixed header of an hnswlib index file: eleven fields, little-endian, as its public source writes them.
_HEADER = "<QQQQQQiIQQQdQ"
#: The bit of an element's third byte that marks it as deleted.
_DELETED = 0x01


def read_hnswlib(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """id, vector of the elements of hnswlib index files that aren't marked as deleted."""

    def parse(data) -> Iterator[pa.RecordBatch]:
        head = struct.calcsize(_HEADER)
        if len(data) < head:
            raise FormatError("an index file is shorter than its header")
        _, most, count, size, label_at, data_at, *_ = struct.unpack(_HEADER, data[:head].to_pybytes())
        if count > most or size < dim * 4 + 8 or len(data) < head + count * size or data_at + 4 * dim > label_at or label_at + 8 > size:
            raise FormatError("an index file is damaged, or of another dimension")
        rows = np.frombuffer(data, np.uint8, count * size, head).reshape(count, size)
        live = rows[rows[:, 2] & _DELETED == 0]
        vectors = np.ascontiguousarray(live[:, data_at : data_at + 4 * dim]).view("<f4")
        yield from _vectors(np.ascontiguousarray(live[:, label_at : label_at + 8]).view("<i8").ravel(), vectors)

    return _files(spark, path, parse, "id long, vector array<float>")


def from_faiss(spark: SparkSession, index) -> DataFrame:
    """id, vector of a FAISS index object with reconstruct_n(); ids from its map, if it has one."""
    n = int(index.ntotal)
    inner = getattr(index, "index", index)
    ids = np.arange(n) if not hasattr(index, "id_map") else np.array([index.id_map.at(i) for i in range(n)])
    rows = np.asarray(inner.reconstruct_n(0, n), np.float32)
    return spark.createDataFrame(pa.Table.from_batches(list(_vectors(ids.astype(np.int64), rows))))


def from_pages(spark: SparkSession, fetch, schema, size: int = 10_000) -> DataFrame:
    """Rows of a paged source, as Chroma's get(): fetch(offset, size) gives a list of tuples, an empty one at the end."""
    parts, at = [], 0
    while rows := fetch(at, size):
        parts.append(spark.createDataFrame(rows, schema))
        at += len(rows)
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def from_chroma(spark: SparkSession, collection, size: int = 1000, path: str | None = None) -> tuple[DataFrame, str]:
    """key, vector, text and metadata (a map of texts) of a Chroma collection, and its metric.

    Pages go to Parquet one by one (path, or a new shared folder), so the driver holds one at a time.
    """
    import uuid

    from marlstone.sources.store import shared_folder

    if size < 1:
        raise ValueError("a page has a row at least")
    metric = (getattr(collection, "metadata", None) or {}).get("hnsw:space", "l2")
    if metric not in ("l2", "ip", "cosine"):
        raise ValueError(f"unknown space {metric!r}")
    path, at = path or f"{shared_folder(spark)}/chroma-{uuid.uuid4().hex}", 0
    schema = "key string, vector array<float>, text string, metadata map<string,string>"
    while ids := list((page := collection.get(include=["embeddings", "documents", "metadatas"], limit=size, offset=at)).get("ids") or []):
        vectors = page.get("embeddings")
        if vectors is None or len(vectors) != len(ids):
            raise ValueError("the collection gives no embeddings")
        texts, fields = page.get("documents") or [None] * len(ids), page.get("metadatas") or [None] * len(ids)
        rows = [(str(i), [float(x) for x in v], t, {k: str(x) for k, x in (m or {}).items()}) for i, v, t, m in zip(ids, vectors, texts, fields)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        at += len(ids)
    if not at:
        raise ValueError("the collection is empty")
    return spark.read.schema(schema).parquet(path), metric


def write_fbin(df: DataFrame, path: str, id: str = "id", vector: str = "vector") -> int:
    """One vector file of all rows by id; the number of rows. Rows pass through the driver a partition at a time."""
    rows = df.where(F.col(vector).isNotNull()).select(id, F.col(vector).cast("array<float>").alias("v"))
    n, least, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if n and (least != most or least < 1) or n >= 2**32:
        raise FormatError("vectors of a file have one dimension, and fewer than 2^32 rows")
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(struct.pack("<II", n, most or 0)))
    held: list[bytes] = []
    for r in rows.orderBy(id).toLocalIterator():
        held.append(np.asarray(r["v"], "<f4").tobytes())
        if len(held) * 4 * most >= PART:
            out.write(bytearray(b"".join(held)))
            held = []
    out.write(bytearray(b"".join(held)))
    out.close()
    return n


def _text(value, kind: T.DataType) -> str:
    """A value as JSON: floats with 9 digits and doubles with 17, which read back as they are."""
    if value is None:
        return "null"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return ("%.9g" if isinstance(kind, T.FloatType) else "%.17g") % value
    if isinstance(kind, T.ArrayType):
        return "[" + ",".join(_text(x, kind.elementType) for x in value) + "]"
    if isinstance(kind, T.StructType):
        return "{" + ",".join(f"{json.dumps(f.name)}:{_text(value[f.name], f.dataType)}" for f in kind) + "}"
    return json.dumps(value, ensure_ascii=False, default=str)


#: The columns of a document that aren't metadata, in the order of an export.
PARTS = ("id", "key", "expires_at", "vector", "sparse", "text")


def _ordered(df: DataFrame, vectors: bool, limit: int) -> tuple[DataFrame, list[str], list[str]]:
    parts = [c for c in PARTS if c in df.columns and (vectors or c not in ("vector", "sparse"))]
    fields = sorted(c for c in df.columns if c not in PARTS)
    rows = df.select(*parts, *fields).orderBy("id")
    return (rows.limit(limit) if limit else rows), parts, fields


def export_json(df: DataFrame, path: str, vectors: bool = True, limit: int = 0) -> None:
    """A line of JSON per row, by id: the parts of a document, and an object of the fields that it has. limit 0: all rows."""
    rows, parts, fields = _ordered(df, vectors, limit)
    kinds = {f.name: f.dataType for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                own = ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_text(r[k], kinds[k])}" for k in fields if r[k] is not None)
                lines.append("{" + ",".join([*(f'"{k}":{_text(r[k], kinds[k])}' for k in parts), f'"metadata":{{{own}}}']) + "}")
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    rows.mapInArrow(run, "value string").write.mode("errorifexists").text(path)


def export_csv(df: DataFrame, path: str, vectors: bool = True, limit: int = 0) -> None:
    """CSV (RFC 4180) with a header, by id: the parts of a document, then the fields by name; arrays and structs are
    JSON, and what is missing is empty. limit 0: all rows."""
    rows, parts, fields = _ordered(df, vectors, limit)
    kinds, names = {f.name: f.dataType for f in rows.schema}, [*parts, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [[None if x is None else x if isinstance(kinds[k], T.StringType) else _text(x, kinds[k]) for x in batch.column(k).to_pylist()] for k in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names=names)

    cells = rows.mapInArrow(run, T.StructType([T.StructField(k, T.StringType()) for k in names]))
    cells.write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
