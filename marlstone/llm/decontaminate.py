"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import Words, chained, steps, table, text_buffers

#: Words of a window.
WINDOW = 10
#: Most bytes of benchmark text behind a broadcast, whose arrays take about five times as much; a larger benchmark's
#: windows are joined with those of the documents that pass a bit table.
BLOCK_BYTES = 16 << 20
#: Bits of that table (a power of 2), and slices in which it is put together.
FILTER_BITS, SLICES = 1 << 27, 64

SPAN = T.StructType([T.StructField("begin", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])


def _table(hashes: np.ndarray, bits: int = 1 << 20) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[hashes >> np.uint64(65 - bits.bit_length())] = True
    return out


class Benchmark:
    """The different windows of some items: sorted hashes, the words to verify a hit with, and the items of each.

    Arrays only: for each word of the items its place among the different words, for each different window its hash,
    first word and size.
    """

    def __init__(self, items: list[tuple[str | None, str]], n: int) -> None:
        texts = [t.encode() for _, t in items]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        words = Words(np.frombuffer(b"".join(texts), np.uint8), offs)
        names = sorted({i for i, _ in items if i is not None})
        place = {i: k for k, i in enumerate(names)}
        self.names = names
        at, size = words.places(n, short=True)
        h = chained(words.hash, at, size)
        item = np.array([place.get(i, -1) for i, _ in items], np.int32)[words.document()[at]] if len(at) else np.zeros(0, np.int32)
        order = np.lexsort((words.tail, words.head))
        new = np.ones(len(order), bool)
        new[1:] = (words.head[order[1:]] != words.head[order[:-1]]) | (words.tail[order[1:]] != words.tail[order[:-1]])
        self.head, self.tail = words.head[order[new]], words.tail[order[new]]
        self.words = np.empty(len(order), np.int32)
        self.words[order] = np.cumsum(new) - 1
        # windows of one hash are in the order of their words, so equal ones are neighbours
        columns = [np.where(size > k, self.words[np.minimum(at + k, max(0, len(self.words) - 1))], -1) for k in range(int(size.max(initial=0)))]
        order = np.lexsort((item, *columns[::-1], h)) if len(at) else np.zeros(0, np.int64)
        differ = np.zeros(max(0, len(order) - 1), bool)
        for x in (h, *columns):
            differ |= x[order[1:]] != x[order[:-1]]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), differ]))
        again = np.concatenate([np.zeros(min(1, len(order)), bool), ~differ & (item[order[1:]] == item[order[:-1]])])
        listed = ~again & (item[order] >= 0)
        self.items, self.begin = item[order][listed], np.append(0, np.cumsum(listed))[np.append(first, len(order))].astype(np.int32)
        self.hashes, self.start, self.size = h[order[first]], at[order[first]].astype(np.int32), np.minimum(size[order[first]], n).astype(np.int16)
        self.lengths = np.unique(self.size).tolist()
        self.bits = _table(self.hashes)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, word behind the last, and number of the window, of each occurrence of a window."""
        found = [np.zeros((3, 0), np.int64)]
        for size in self.lengths:
            at, h = words.windows(size)
            some = np.flatnonzero(self.bits[h >> np.uint64(44)])
            left, right = np.searchsorted(self.hashes, h[some], "left"), np.searchsorted(self.hashes, h[some], "right")
            many = right - left
            at = np.repeat(at[some], many)
            window = np.repeat(left, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            good = self.size[window] == size
            at, window = at[good], window[good]
            for k in range(size):  # word by word
                w = self.words[self.start[window] + k]
                good = (words.head[at + k] == self.head[w]) & (words.tail[at + k] == self.tail[w])
                at, window = at[good], window[good]
            found.append(np.stack([at, at + size, window]))
        at, end, window = np.concatenate(found, 1)
        order = np.argsort(at, kind="stable")
        return at[order], end[order], window[order]

    def named(self, windows: np.ndarray) -> list[str]:
        """The items of some windows, sorted."""
        return sorted({self.names[i] for w in np.unique(windows).tolist() for i in self.items[self.begin[w] : self.begin[w + 1]].tolist()})


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for b, e in spans:
        out.append(text[last:b])
        last = e
    return b"".join([*out, text[last:]])


NEW = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(SPAN)), T.StructField("hit_bytes", T.ArrayType(SPAN)), T.StructField("hit_items", T.ArrayType(T.StringType()))]
NAMES = [f.name for f in NEW]


def _told(docs: DataFrame, text: str, drop: tuple[str, ...], of) -> DataFrame:
    """docs, but for drop, with the columns n_words, hit_words, hit_bytes and hit_items.

    of(batch) makes a function of the Words of some of its documents (i to j) that gives for each document with hits
    its spans, in words of the step, and its items.
    """
    schema = T.StructType([f for f in docs.schema.fields if f.name not in (*NAMES, *drop)] + NEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            buf, offs = text_buffers(batch.column(text))
            rows: list[list] = [[], [], [], []]
            look = of(batch)
            for i, j in steps(offs):
                words = Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                hits = look(words, i, j)
                counts = np.diff(words.bounds).tolist()
                for d in range(j - i):
                    first, base = int(words.bounds[d]), int(offs[i + d] - offs[i])
                    spans, items = hits.get(d, ((), ()))
                    spans = _merged(spans)
                    rows[0].append(counts[d])
                    rows[1].append([{"begin": b - first, "end": e - first} for b, e in spans])
                    rows[2].append([{"begin": int(words.begin[b]) - base, "end": int(words.end[e - 1]) - base} for b, e in spans])
                    rows[3].append(list(items))
            columns = [batch.column(k) for k in batch.schema.names if k not in (*NAMES, *drop)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(rows, NEW)], names=schema.names)

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, block, text: str) -> DataFrame:
    """docs with what the windows of a broadcast Benchmark hit."""

    def of(batch: pa.RecordBatch):
        bench = block.value

        def look(words: Words, i: int, j: int) -> dict:
            begin, end, window = bench.hits(words)
            doc = np.searchsorted(words.bounds, begin, "right") - 1
            edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
            return {int(doc[a]): (list(zip(begin[a:b].tolist(), end[a:b].tolist())), bench.named(window[a:b])) for a, b in zip(edges[:-1], edges[1:])}

        return look

    return _told(docs, text, (), of)


def _windows(rows: DataFrame, n: int, short: bool, sizes, bits) -> DataFrame:
    """name, at, size, hash and window (its words with a space between) of the windows of rows (name, body).

    sizes: the sizes that count, else n; bits: a broadcast table that the hash must be in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else np.unpackbits(np.frombuffer(b"".join(bits.value), np.uint8), bitorder="little")
        for batch in batches:
            buf, offs = text_buffers(batch.column("body"))
            for i, j in steps(offs):
                words = Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                doc = words.document()
                for m in sizes or (n,):
                    at, size = words.places(m, short)
                    h = chained(words.hash, at, size)
                    if held is not None:
                        some = np.flatnonzero(held[h >> np.uint64(65 - len(held).bit_length())])
                        at, size, h = at[some], size[some], h[some]
                    for k in range(0, len(at), 20_000):
                        a, s = at[k : k + 20_000], size[k : k + 20_000]
                        d = doc[a]
                        body = [b" ".join(words.word(x + y) for y in range(z)) for x, z in zip(a.tolist(), s.tolist())]
                        yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(d + i)), pa.array((a - words.bounds[d]).astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(h[k : k + 20_000].view(np.int64)), pa.array(body, pa.binary())], names=["name", "at", "size", "hash", "window"])

    return rows.mapInArrow(run, f"name {dict(rows.dtypes)['name']}, at int, size int, hash long, window binary")


def _filter(windows: DataFrame, bits: int) -> list[bytes]:
    """A table of bits, set where a hash has been seen, in slices that the tasks' own tables are joined to."""
    most = bits // SLICES // 8

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(65 - bits.bit_length())] = True
        for k, part in enumerate(seen.reshape(SLICES, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in parts:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = held.get(k, 0) | np.frombuffer(b, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slice", "bits"])

    schema = "slice long, bits binary"
    parts = windows.select("hash").mapInArrow(own, schema).repartition(SLICES, "slice").mapInArrow(joined, schema)
    found = {r["slice"]: bytes(r["bits"]) for r in parts.collect()}  # bits / 8 bytes in all
    return [found.get(k, bytes(most)) for k in range(SLICES)]


def joined(docs: DataFrame, items: DataFrame, text: str, n: int, bits: int = FILTER_BITS) -> DataFrame:
    """What scan() gives, for a benchmark of any size (rows item, body).

    Documents are numbered in a table; those of their windows that a bit table lets pass meet the benchmark's by the
    words themselves. A window of many items is one row with a list, and a window of many documents is split by
    adaptive execution, as both sides of the join are tables.
    """
    spark = docs.sparkSession
    windows = table(_windows(items.withColumnRenamed("item", "name"), n, True, None, None).select("name", "size", "hash", "window").distinct(), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # n at most
    bench = table(windows.groupBy("window").agg(F.collect_set("name").alias("items")), "benchmark")
    table_ = spark.sparkContext.broadcast(_filter(windows, bits))
    safe = [f"c{k}" for k in range(len(docs.columns))]
    numbered = table(docs.toDF(*safe).withColumn("row", F.monotonically_increasing_id()), "numbered")
    body = safe[docs.columns.index(text)]
    rows = numbered.select(F.col("row").alias("name"), F.col(body).cast("string").alias("body"))
    asked = _windows(rows, n, False, sizes, table_).select(F.col("name").alias("row"), "at", "size", "window")
    hits = asked.join(bench, "window").groupBy("row").agg(F.collect_list(F.struct("at", "size")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
    found = numbered.join(hits, "row", "left").drop("row")

    def of(batch: pa.RecordBatch):
        spans, names = batch.column("spans"), batch.column("found")

        def look(words: Words, i: int, j: int) -> dict:
            some = [d for d in range(i, j) if spans[d].is_valid]
            return {d - i: ([(x["at"] + int(words.bounds[d - i]), x["at"] + x["size"] + int(words.bounds[d - i])) for x in spans[d].as_py()], names[d].as_py()) for d in some}

        return look

    kept = [c for c in docs.columns if c not in NAMES]
    out = _told(found, body, ("spans", "found", *(x for x, c in zip(safe, docs.columns) if c in NAMES)), of)
    return out.toDF(*kept, *NAMES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words; hit_words and hit_bytes (merged spans inside any occurrence of a benchmark window, as word
    and UTF-8 byte places); hit_items (sorted strings of the items that have occurring windows).

    Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A window is n consecutive words of an
    item; an item with fewer words, but not none, is one window. Null and empty texts have no words; a very long text
    is scanned as one; repeated documents get equal rows, one each; null items hit words but are not listed; repeated
    items count once; an empty table gives no rows; an empty benchmark hits nothing. Each window found by its hash is
    verified word by word. Up to block_bytes of benchmark text are broadcast; a larger benchmark is joined. Both give
    the same. Columns of docs with the names of the new ones are replaced.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("body")).where("body is not null")
    size = items.agg(F.sum(F.octet_length("body") + 40)).first()[0] or 0
    if size > block_bytes:
        return joined(docs, items, text, n)
    rows = [(r["item"], r["body"]) for r in items.collect()]  # block_bytes at most
    return scan(docs, docs.sparkSession.sparkContext.broadcast(Benchmark(rows, n)), text)


def _n_hit(spans: str = "hit_words"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["begin"]))


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """What decontaminate() found, a short row per document."""
    return found.select(
        F.col(id), "n_words", _n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (_n_hit() > 0).alias("contaminated"),
    )


def without_documents(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a hit, in their own columns."""
    return found.where(F.size("hit_words") == 0).drop("n_words", "hit_words", "hit_bytes", "hit_items")


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """All documents in their own columns, hit spans cut out of the texts."""

    @F.pandas_udf("string")
    def cut(body, spans):
        import pandas as pd

        return pd.Series([b if b is None or not len(s) else _cut(b.encode(), [(x["begin"], x["end"]) for x in s]).decode() for b, s in zip(body, spans)])

    return found.withColumn(text, F.when(F.size("hit_bytes") == 0, F.col(text)).otherwise(cut(text, "hit_bytes"))).drop("n_words", "hit_words", "hit_bytes", "hit_items")
