"""Compressed vectors: scalar, binary, product, half-precision and rotated sign codes, and the k-means they train with."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import distance, literal


def kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 17) -> np.ndarray:
    """Centres of at most k clusters: k-means++ seeds, then Lloyd's rounds; an empty cluster takes the farthest row."""
    from marlstone.operators.knn import nearest_centre

    x = np.asarray(x, np.float64)
    rng, k = np.random.default_rng(seed), min(k, len(x))
    if not k:
        return np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
    centres = [x[int(rng.integers(len(x)))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = near.sum()
        at = int(np.searchsorted(np.cumsum(near), rng.random() * total)) if total > 0 else len(centres)
        centres.append(x[min(at, len(x) - 1)])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c, own = np.array(centres), None
    for _ in range(rounds):
        new = nearest_centre(x, c)
        if own is not None and (new == own).all():
            break
        own = new
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], c)
        for j in np.flatnonzero(size == 0):
            c[j] = x[int(((x - c[own]) ** 2).sum(1).argmax())]
    return c


@dataclass
class Scalar8:
    """A byte per dimension between the least and the greatest value seen."""

    low: np.ndarray
    step: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray) -> Scalar8:
        low = x.min(0).astype(np.float64)
        return cls(low, (x.max(0).astype(np.float64) - low) / 255)

    def encode(self, x: np.ndarray) -> np.ndarray:
        step = np.where(self.step > 0, self.step, 1)
        return np.clip(np.floor((x - self.low) / step + 0.5), 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes * self.step


@dataclass
class Binary:
    """A bit per dimension: above the mean or not; it decodes to the mean plus or minus the mean deviation."""

    mean: np.ndarray
    spread: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray) -> Binary:
        mean = x.mean(0, dtype=np.float64)
        return cls(mean, np.abs(x - mean).mean(0))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x > self.mean, axis=1, bitorder="little")

    def decode(self, codes: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(codes, axis=1, bitorder="little")[:, : len(self.mean)]
        return self.mean + np.where(bits == 1, self.spread, -self.spread)


@dataclass
class Product:
    """A byte per part of the dimensions: the nearest of at most 256 centres of that part."""

    bounds: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def train(cls, x: np.ndarray, parts: int = 0, rounds: int = 25) -> Product:
        dim = x.shape[1]
        parts = parts or max(1, dim // 8)
        if not 1 <= parts <= dim:
            raise ValueError("a part has at least one dimension")
        # the first parts take what is left over
        bounds = np.concatenate([[0], np.cumsum([dim // parts + (p < dim % parts) for p in range(parts)])])
        return cls(bounds, [kmeans(x[:, a:b], 256, rounds, 1000 + p) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))])

    def encode(self, x: np.ndarray) -> np.ndarray:
        from marlstone.operators.knn import nearest_centre

        return np.stack([nearest_centre(x[:, a:b], c) for a, b, c in zip(self.bounds[:-1], self.bounds[1:], self.books)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, p]] for p, c in enumerate(self.books)], 1)


@dataclass
class Half:
    """16-bit floats, IEEE or with the exponent of a 32-bit float; rounded to even."""

    brain: bool = False

    @classmethod
    def train(cls, x: np.ndarray, brain: bool = False) -> Half:
        return cls(brain)

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float32)
        if not self.brain:
            if np.abs(x).max(initial=0) > 65504:
                raise ValueError("a value is too large for 16 bits")
            return x.astype(np.float16).view(np.uint8)
        bits = np.ascontiguousarray(x).view(np.uint32)
        return ((bits + (np.uint32(0x7FFF) + (bits >> np.uint32(16) & np.uint32(1)))) >> np.uint32(16)).astype(np.uint16).view(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        codes = np.ascontiguousarray(codes)
        if not self.brain:
            return codes.view(np.float16).astype(np.float32)
        return (codes.view(np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


@dataclass
class RotatedSigns:
    """The signs of a centred, randomly rotated vector, with its length and how well the signs match its direction."""

    centre: np.ndarray
    signs: np.ndarray = field(repr=False)

    @classmethod
    def train(cls, x: np.ndarray, seed: int = 99) -> RotatedSigns:
        size = 1 << max(0, x.shape[1] - 1).bit_length()
        return cls(x.mean(0, dtype=np.float64), np.random.default_rng(seed).choice([-1.0, 1.0], (3, size)))

    def rotate(self, x: np.ndarray) -> np.ndarray:
        size = self.signs.shape[1]
        y = np.zeros((len(x), size))
        y[:, : x.shape[1]] = x
        for s in self.signs:
            y = y * s
            width = 1
            while width < size:  # Walsh-Hadamard
                y = y.reshape(len(x), -1, 2, width)
                y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), size)
                width *= 2
            y = y / np.sqrt(size)
        return y

    def unrotate(self, y: np.ndarray) -> np.ndarray:
        size = self.signs.shape[1]
        for s in self.signs[::-1]:
            width = 1
            while width < size:
                y = y.reshape(len(y), -1, 2, width)
                y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(y), size)
                width *= 2
            y = y / np.sqrt(size) * s
        return y

    def encode(self, x: np.ndarray) -> np.ndarray:
        y = self.rotate(x - self.centre)
        length = np.sqrt((y**2).sum(1))
        match = np.abs(y).sum(1) / np.where(length > 0, length, 1) / np.sqrt(y.shape[1])
        return np.concatenate([np.packbits(y > 0, axis=1, bitorder="little"), np.stack([length, match], 1).astype(np.float32).view(np.uint8)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        size = self.signs.shape[1]
        bits = np.unpackbits(codes[:, :-8], axis=1, bitorder="little")[:, :size]
        length, match = np.ascontiguousarray(codes[:, -8:]).view(np.float32).T.astype(np.float64)
        unit = np.where(bits == 1, 1.0, -1.0) / np.sqrt(size)
        return self.unrotate(unit * (length / np.maximum(match, 1e-6))[:, None])[:, : len(self.centre)] + self.centre


CODECS = {"sq8": Scalar8, "binary": Binary, "pq": Product, "f16": Half, "bf16": Half, "rabitq": RotatedSigns}


def train(df: DataFrame, codec: str, vector: str = "vector", id: str = "id", sample: int = 100_000):
    """A codec fitted on at most `sample` vectors, chosen by a hash. The scalar one takes its bounds from all rows, the binary one its means."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    if codec == "sq8":
        rows = scalar_bounds(df, vector).orderBy("dim").collect()  # a row per dimension
        return Scalar8(np.array([r["low"] for r in rows]), np.array([r["step"] for r in rows]))
    if codec == "binary":
        rows = binary_means(df, vector).orderBy("dim").collect()
        return Binary(np.array([r["mean"] for r in rows], np.float64), np.array([r["spread"] for r in rows], np.float64))
    got = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id)).select(vector).limit(sample).toArrow()
    x = np.array(got.column(0).to_pylist(), np.float32)
    return CODECS[codec].train(x, True) if codec == "bf16" else CODECS[codec].train(x)


def scalar_bounds(df: DataFrame, vector: str = "vector") -> DataFrame:
    """dim, low, step of the scalar codec, over all rows."""
    each = df.select(F.posexplode(vector).alias("dim", "x"))
    low, high = F.min("x").cast("double"), F.max("x").cast("double")
    return each.groupBy("dim").agg(low.alias("low"), ((high - low) / 255).alias("step"))


def binary_means(df: DataFrame, vector: str = "vector") -> DataFrame:
    """dim, mean, spread of the binary codec, over all rows."""
    each = df.select(F.posexplode(F.col(vector).cast("array<float>")).alias("dim", "x")).select("dim", F.col("x").cast("double"))
    means = each.groupBy("dim").agg(F.avg("x").alias("mean"))
    return each.join(F.broadcast(means), "dim").groupBy("dim", "mean").agg(F.avg(F.abs(F.col("x") - F.col("mean"))).alias("spread"))


def encode(df: DataFrame, model, vector: str = "vector", code: str = "code") -> DataFrame:
    """df with a binary column of codes."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("binary")
    def codes(v):
        import pandas as pd

        return pd.Series([r.tobytes() for r in shared.value.encode(np.stack(v.to_numpy()).astype(np.float32))])

    return df.withColumn(code, codes(F.col(vector).cast("array<float>")))


def decode(df: DataFrame, model, code: str = "code", vector: str = "decoded") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<float>")
    def vectors(c):
        import pandas as pd

        return pd.Series(list(shared.value.decode(np.stack([np.frombuffer(x, np.uint8) for x in c])).astype(np.float32)))

    return df.withColumn(vector, vectors(code))


def measured(model, codes: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Distances of a query to coded vectors, from the codes as far as the codec allows.

    Scalar codes are measured as they are: a squared distance from the query moved into their steps, a dot product with
    whole numbers from -63 to 63 as weights. Product codes add up a table of a part's distances for each of its
    centres. Others, and all under cosine, are decoded.
    """
    q = np.asarray(query, np.float64)
    if metric != "cosine" and isinstance(model, Scalar8):
        if metric == "l2":
            return (((q - model.low) - codes * model.step) ** 2).sum(1)
        scaled = q * model.step
        unit = np.abs(scaled).max(initial=0) / 63
        weights = np.rint(scaled / unit).astype(np.int32) if unit else np.zeros(len(q), np.int32)
        return -(q @ model.low + unit * (codes.astype(np.int32) @ weights))
    if metric != "cosine" and isinstance(model, Product):
        out = np.zeros(len(codes))
        for p, (a, b, c) in enumerate(zip(model.bounds[:-1], model.bounds[1:], model.books)):
            table = ((c - q[a:b]) ** 2).sum(1) if metric == "l2" else -(c @ q[a:b])
            out += table[codes[:, p]]
        return out
    v = np.asarray(model.decode(codes), np.float64)
    if metric == "l2":
        return ((v - q) ** 2).sum(1)
    if metric == "ip":
        return -(v @ q)
    length = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
    return np.maximum(0, 1 - v @ q / np.where(length > 0, length, np.inf))


def coded_best(df: DataFrame, model, query, k: int, metric: str = "l2", id: str = "id", code: str = "code") -> DataFrame:
    """id, d: the k rows that are closest by their codes alone; each task hands on k of its own."""
    q = np.array([float(x) for x in query])
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            codes = batch.column(code)
            if not batch.num_rows:
                continue
            width = len(codes[0].as_py())
            raw = np.frombuffer(codes.buffers()[2], np.uint8, width * batch.num_rows, np.frombuffer(codes.buffers()[1], np.int32)[codes.offset]).reshape(-1, width)
            part = pa.table([batch.column(id), pa.array(measured(shared.value, raw, q, metric))], names=["id", "d"])
            held = part if held is None else pa.concat_tables([held, part])
            held = held.take(pa.compute.select_k_unstable(held, k, [("d", "ascending"), ("id", "ascending")])) if held.num_rows > k else held
        if held is not None:
            yield from held.combine_chunks().to_batches()

    found = df.where(F.col(code).isNotNull()).select(id, code).mapInArrow(run, f"id {kind}, d double")
    return found.orderBy("d", "id").limit(k).withColumnRenamed("id", id)


def coded_knn(df: DataFrame, model, query, k: int, metric: str = "l2", factor: int = 4, id: str = "id", vector: str = "vector", code: str = "code") -> DataFrame:
    """The k closest rows in two stages: k * factor by their codes alone, then by their whole vectors."""
    few = coded_best(df, model, query, k * factor, metric, id, code).select(id)
    exact = df.join(F.broadcast(few), id, "left_semi").withColumn("distance", distance(F.col(vector), literal(query), metric))
    best = exact.select(id, "distance").orderBy("distance", id).limit(k)
    return best.select(F.row_number().over(Window.orderBy("distance", id)).alias("rank"), id, "distance")


def coded_join(queries: DataFrame, df: DataFrame, model, k: int, metric: str = "l2", factor: int = 4, query_id: str = "query_id", id: str = "id", vector: str = "vector", code: str = "code") -> DataFrame:
    """query_id, rank, id, distance: coded_knn() for a table of queries, which go to all tasks in blocks.

    A task hands on k * factor rows per query by their codes; those that are best of all meet their vectors.
    """
    from marlstone.operators.knn import query_blocks

    kind = dict(df.dtypes)[id]
    rows = df.where(F.col(code).isNotNull()).select(F.col(id).alias("id"), F.col(code).alias("code"))
    rough = None
    for shared in query_blocks(queries, query_id, vector):
        found = rows.mapInArrow(_rough(shared, df.sparkSession.sparkContext.broadcast(model), k * factor, metric), f"query_id long, id {kind}, d double")
        rough = found if rough is None else rough.unionByName(found)
    near = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    few = rough.withColumn("place", near).where(F.col("place") <= k * factor).select("query_id", "id")
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("__q"))
    exact = few.join(df.select(F.col(id).alias("id"), F.col(vector).alias("__v")), "id").join(asked, "query_id")
    exact = exact.select("query_id", "id", distance(F.col("__v"), F.col("__q"), metric).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _rough(shared, model, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(qid)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            codes = np.stack([np.frombuffer(x, np.uint8) for x in batch.column("code").to_pylist()])
            for j, one in enumerate(q):
                i, d = np.concatenate([best[j][0], ids]), np.concatenate([best[j][1], measured(model.value, codes, one, metric)])
                at = np.lexsort((i, d))[:k]
                best[j] = (i[at], d[at])
        for j, (i, d) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), qid[j])), pa.array(i), pa.array(d)], names=["query_id", "id", "d"])

    return run


def to_arrays(model) -> dict[str, np.ndarray]:
    """A codec as named arrays, which from_arrays() makes it of again."""
    out = {}
    for name, value in vars(model).items():
        if isinstance(value, list):
            out |= {f"{name}.{k}": x for k, x in enumerate(value)}
        else:
            out[name] = np.asarray(value)
    return out


def from_arrays(codec: str, arrays: dict[str, np.ndarray]):
    if not arrays:
        return None
    plain = {k: v if v.ndim else v.item() for k, v in arrays.items() if "." not in k}
    lists: dict[str, list] = {}
    for k in sorted((k for k in arrays if "." in k), key=lambda k: int(k.split(".")[1])):
        lists.setdefault(k.split(".")[0], []).append(arrays[k])
    return CODECS[codec](**plain, **lists)


#: Rows from which a codec can be trained.
TRAIN_AFTER = 1000


def encoded(df: DataFrame, codec: str, vector: str = "vector", id: str = "id", train_after: int = TRAIN_AFTER, codes_only: bool = False, sample: int = 100_000) -> tuple[DataFrame, object]:
    """df with codes, and the codec; without codes (and None) while it has fewer than train_after rows.

    Codecs without parameters need no rows. codes_only: the vectors go, so that this training is final.
    """
    if codec not in ("f16", "bf16") and df.where(F.col(vector).isNotNull()).limit(train_after).count() < train_after:
        return df.withColumn("code", F.lit(None).cast("binary")), None
    model = train(df, codec, vector, id, sample)
    out = encode(df, model, vector)
    return (out.drop(vector) if codes_only else out), model


def error(df: DataFrame, model, vector: str = "vector") -> DataFrame:
    """The mean squared error per dimension of decoded vectors."""
    back = decode(encode(df.select(vector), model, vector), model)
    return back.select(F.avg(distance(F.col(vector), F.col("decoded"), "l2") / F.size(vector)).alias("mean_squared_error"))
