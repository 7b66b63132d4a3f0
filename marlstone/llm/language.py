"""Language identification: TF-IDF vectors of hashed byte n-grams against several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import ALNUM, steps, text_buffers

#: Dimensions that n-grams of 1 to 3 bytes are hashed into.
DIMENSIONS = 1 << 12
#: Most documents of a language that its centroids are fitted on; centroids of a language.
SAMPLE, CENTROIDS = 400, 4
#: Most languages of a model: its centroids, 16 kB each, are sent to all tasks.
LANGUAGES = 2000
#: A text is rejected below this share of the least similarity that a centroid has to its own sample.
MARGIN = 0.8

_fold = ALNUM.copy()
_fold[48:58] = 0
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row per document: how often each hashed n-gram occurs in its letters, with runs of anything else as one space."""
    low = _fold[buf]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    edges = offs[:-1][offs[:-1] < len(buf)]
    keep[edges] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offs]
    b = low[keep].astype(np.uint64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    total = np.zeros((len(offs) - 1) * DIMENSIONS, np.int64)
    for n in (1, 2, 3):
        if len(b) < n:
            break
        gram = np.full(len(b) - n + 1, n, np.uint64)
        for k in range(n):
            gram = gram << np.uint64(8) | b[k : len(b) - n + 1 + k]
        inside = doc[: len(gram)] == doc[n - 1 :]
        dim = (gram * _MULTIPLY >> np.uint64(52)).astype(np.int64)
        total += np.bincount((doc[: len(gram)] * DIMENSIONS + dim)[inside], minlength=len(total))
    return total.reshape(-1, DIMENSIONS)


def vectors(buf: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts(buf, offs)) * idf).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def centroids(v: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with deterministic farthest-first seeds: unit centroids, and for each the least similarity of its own rows."""
    c = v[:1]
    while len(c) < min(k, len(v)):
        c = np.concatenate([c, v[[int(np.argmin((v @ c.T).max(1)))]]])
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        sums = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = v @ c.T
    own = near.argmax(1)
    return c, np.array([near[own == j, j].min() if (own == j).any() else 0.0 for j in range(len(c))])


@dataclass
class Languages:
    names: list[str]
    idf: np.ndarray
    centres: np.ndarray
    language: np.ndarray
    least: np.ndarray

    def predict(self, v: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        near = v @ self.centres.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(v)), best].astype(float), 0, 1)
        return [self.names[x] for x in self.language[best]], score, score < MARGIN * self.least[best]


def _mapped(docs: DataFrame, text: str, schema: T.StructType, keep: list[str], make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(text))
            for i, j in steps(offs, rows=128):
                new = make(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in keep] + new, names=schema.names)

    return docs.mapInArrow(run, schema)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each dimension occurs, and the number of documents; a row per task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for i, j in steps(offs, rows=128):
                df += (counts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) > 0).sum(0)
            n += len(offs) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMENSIONS), -1)), pa.array(np.append(df, n))], names=["dim", "n"])

    rows = docs.select(F.col(text)).mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out = {r["dim"]: r["n"] for r in rows}
    return np.array([out.get(k, 0) for k in range(DIMENSIONS)], float), out.get(-1, 0)


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, per: int = CENTROIDS) -> Languages | None:
    """A model from documents with a language; None if there are none. More than LANGUAGES languages raise.

    Document frequencies cover all of them; centroids are fitted on about `sample` of each language, chosen by a hash
    (and never on more than twice as many of one language; equal texts of a language count once, so repeated rows and
    ties in the hash change nothing), in a task for each language. Null texts and texts without letters aren't fitted
    on; very long texts count whole; other columns aren't read.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    df, n = document_frequencies(known, "text")
    idf = np.log((1 + n) / (1 + df)) + 0.1
    cut = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1 << 30, int((sample << 30) / v) + 1))) for k, v in sizes.items()))
    some = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < cut).select("text", "lang").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    some = some.withColumn("place", place).where(F.col("place") <= 2 * sample).select("text", "lang")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("v", T.BinaryType())])
    as_rows = lambda buf, offs: [pa.array([x.tobytes() for x in vectors(buf, offs, idf)], pa.binary())]

    def cluster(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(sorted(group["v"].to_pylist())), np.float32).reshape(-1, DIMENSIONS)
        rows = rows[rows.any(1)]
        c, least = centroids(rows, per) if len(rows) else (rows, np.zeros(0))
        return pa.table([pa.array([group["lang"][0].as_py()] * len(c), pa.string()), pa.array([x.astype(np.float32).tobytes() for x in c], pa.binary()), pa.array(least.astype(float))], names=["lang", "centre", "least"])

    got = _mapped(some, "text", schema, ["lang"], as_rows).groupBy("lang").applyInArrow(cluster, "lang string, centre binary, least double").orderBy("lang", "centre").collect()
    names = sorted({r["lang"] for r in got})
    if not names:
        return None
    centres = np.frombuffer(b"".join(bytes(r["centre"]) for r in got), np.float32).reshape(-1, DIMENSIONS)
    return Languages(names, idf, centres, np.array([names.index(r["lang"]) for r in got]), np.array([r["least"] for r in got]))


def identify(docs: DataFrame, model: Languages | None, text: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language; `und` if the text is null or has no letter), score (cosine to the
    nearest centroid, 0 for `und`) and rejected (too far from that centroid). Only the text is looked at.

    A text of letters with nothing learned is `und` too. A very long text is looked at whole; equal texts and repeated
    rows get equal answers, and of equally near centroids the first (by language) wins. An empty table gives no rows.
    Columns with the new names are replaced.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    docs = docs.drop(*(f.name for f in new))
    keep = docs.columns
    schema = T.StructType(docs.schema.fields + new)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(buf: np.ndarray, offs: np.ndarray) -> list:
        model, n = shared.value, len(offs) - 1
        if model is None:
            return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))]
        names, score, rejected = model.predict(vectors(buf, offs, model.idf))
        return [pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]

    spoken = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)) & (F.col("lang_pred") != "und")
    out = _mapped(docs, text, schema, keep, make)
    return out.select(*keep, F.when(spoken, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(spoken, F.col("score")).otherwise(0.0).alias("score"), (F.col("rejected") | ~spoken).alias("rejected"))


def fold(id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(folds))
