"""Shared pieces of the text operators: Arrow text buffers, vectorised words and hashes, tables in the shared folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles, besides a single longer document.
STEP_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def _word_table(separators: bytes) -> np.ndarray:
    """For each byte its lower-case form, or 0 for a separator."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words are runs of 0-9, a-z (after lower-casing A-Z) and bytes from 0x80 on.
ALNUM = _word_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Words are runs of anything but white space.
BLANK = _word_table(bytes([0x20, *range(0x09, 0x0E)]))


class Powers:
    """Powers of BASE modulo 2^64, as many as have been asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            k = len(self.values)
            self.values = np.concatenate([self.values, self.values * np.uint64(pow(self.base, k, 2**64))])
        return self.values[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[begin:end] for each pair, which doesn't depend on the place."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * UP.upto(len(values)), out=sums[1:])
    return mix((sums[end] - sums[begin]) * DOWN.upto(len(values) + 1)[begin] + (end - begin).astype(np.uint64))


def chained(values: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of size values from begin on, each mixed into the ones before it; equal runs of values have equal hashes."""
    h = mix(size.astype(np.uint64) + np.uint64(seed))
    least = int(size.min(initial=1 << 62)) if len(size) else 0
    for k in range(int(size.max(initial=0))):
        if k < least:
            h = mix(h * np.uint64(BASE) + values[begin + k])
        else:
            live = np.flatnonzero(size > k)
            h[live] = mix(h[live] * np.uint64(BASE) + values[begin[live] + k])
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len + 1 offsets; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, most: int = STEP_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most so many bytes and rows, or of one longer document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, min(int(np.searchsorted(offs, offs[i] + most, "right")) - 1, i + rows))
        yield i, min(j, n)
        i = j


#: Bytes of a word that its key holds as they are; longer words are known by a digest.
PLAIN = 15
_HEAD = np.array([0, *(((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 9))], np.uint64)


class Words:
    """The words of documents: places in buf, keys, hashes, and for each document the range of its words.

    The key of a word is 128 bits (head, tail): its bytes and its length, so that words of up to PLAIN bytes are equal
    when their keys are, or 120 bits of BLAKE2b of a longer one. hash and hash2 are 64 bits of the key each.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray = ALNUM) -> None:
        low = table[buf]
        inside = low != 0
        first, last = inside.copy(), inside.copy()
        if len(buf):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = offs[(offs > 0) & (offs < len(buf))]
            first[edges] = inside[edges]
            last[edges - 1] = inside[edges - 1]
        self.low, self.begin, self.end = low, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.begin, offs)
        self.head, self.tail = self._keys()
        self.hash = mix(mix(self.head) + self.tail * np.uint64(BASE))
        self._hash2: np.ndarray | None = None

    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([self.low, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        size = self.end - self.begin
        head = eight[self.begin].astype(np.uint64) & _HEAD[np.minimum(size, 8)]
        tail = eight[np.minimum(self.begin + 8, len(self.low))].astype(np.uint64) & _HEAD[np.clip(size - 8, 0, 7)]
        tail |= np.minimum(size, 255).astype(np.uint64)
        for k in np.flatnonzero(size > PLAIN).tolist():
            d = hashlib.blake2b(self.low[self.begin[k] : self.end[k]], digest_size=16).digest()
            head[k], tail[k] = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big") | 0xFF
        return head, tail

    @property
    def hash2(self) -> np.ndarray:
        if self._hash2 is None:
            self._hash2 = mix(mix(self.tail ^ np.uint64(0x5851F42D4C957F2D)) + self.head * np.uint64(0xD1342543DE82EF95))
        return self._hash2

    def __len__(self) -> int:
        return len(self.begin)

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word(self, i: int) -> bytes:
        return self.low[self.begin[i] : self.end[i]].tobytes()

    def places(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each window of n words inside one document; short: also one window of all words of a shorter document."""
        d = self.document()
        at = np.flatnonzero(d[: len(d) - n + 1] == d[n - 1 :]) if len(d) >= n else np.zeros(0, np.int64)
        size = np.full(len(at), n, np.int64)
        if short:
            few = np.diff(self.bounds)
            few = np.flatnonzero((few > 0) & (few < n))
            at, size = np.concatenate([at, self.bounds[few]]), np.concatenate([size, np.diff(self.bounds)[few]])
            order = np.argsort(at, kind="stable")
            at, size = at[order], size[order]
        return at, size

    def windows(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window, as in places()."""
        at, size = self.places(n, short)
        return at, chained(self.hash, at, size)


def same_words(a: Words, at: np.ndarray, b: Words, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size words of a from at on are those of b from to on, by their keys."""
    same = np.ones(len(at), bool)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(same & (size > k))
        i, j = at[live] + k, to[live] + k
        same[live] = (a.head[i] == b.head[j]) & (a.tail[i] == b.tail[j])
    return same


def distinct(h: np.ndarray, same) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different item, in the order of their hashes h, and the number of each item's own.

    same(i, j) tells which items i are items j. Items of one hash that differ are told apart by it.
    """
    _, at, of = np.unique(h, return_index=True, return_inverse=True)
    wrong = np.flatnonzero(~same(np.arange(len(h)), at[of]))
    while len(wrong):
        here, first, own = np.unique(h[wrong], return_index=True, return_inverse=True)
        new = wrong[first]
        of[wrong] = len(at) + own
        at = np.concatenate([at, new])
        wrong = wrong[~same(wrong, at[of[wrong]])]
    return at, of


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that all executors share and read again: cuts the lineage, and survives lost executors.

    The folder is spark.checkpoint.dir; without one, as in local tests, a folder below the warehouse.
    """
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return f"{root.rstrip('/')}/marlstone"


def settle(df: DataFrame) -> DataFrame:
    """df by checkpoint(): computed once, kept in the shared folder, removed when no longer referred to."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(f"{shared(df.sparkSession)}/checkpoints")
    return df.checkpoint()


#: Edges from which the least neighbours are settled: below, no hub has rows enough to be worth the further jobs.
SETTLED = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b): root is the smallest node of its component.

    Alternates the large-star and small-star steps, whose rows never exceed twice the edges, until nothing changes. The
    least neighbours of many edges are settled before rows meet them, so that adaptive execution splits a hub's rows.
    Null ends are left out. No edges: no rows.
    """
    from pyspark.sql import functions as F

    e = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct())
    hold = settle if e.count() >= SETTLED else lambda df: df
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = hold(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = hold(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = hold(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("u") == F.col("v"), F.col("u")).otherwise(F.col("v")).alias("x"), "m", "u")
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = settle(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
