"""Repeated substrings: suffix order and longest previous factors over the places where a long string may stand twice.

A string of LENGTH bytes that stands twice is the same window in both places, and so has the same anchor: the least hash
among its GRAM-byte grams. Neighbouring windows with one anchor are a stretch. Only anchors travel at first: those that
stand once are done with. Stretches that share an anchor then meet by a digest of their bytes; a stretch that stands
twice is repeated in all its windows, and one of each different stretch of an anchor goes on. Their bytes are put in
suffix order, and the previous and next smaller positions in that order give each suffix its longest previous factor,
as far as LENGTH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import BYTE_VALUES, DOWN, UP, mix, settle, steps, table, text_buffers

#: Bytes of a string that counts, and of the grams that anchors are chosen among.
LENGTH, GRAM = 200, 50
#: Different stretches of one anchor beyond which they meet by digests instead, spread over all tasks: in pieces of so
#: many windows first, and window by window only where pieces agree in what their windows share but differ elsewhere.
CROWD, PIECE = 4_000, 10
#: Bytes of stretches that are put in suffix order at once, besides a single anchor's.
SORT_BYTES = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)


def digests(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each piece of buf, as two columns."""
    data = memoryview(np.ascontiguousarray(buf))
    each = b"".join([hashlib.blake2b(data[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), end.tolist())])
    return np.frombuffer(each, np.int64).reshape(-1, 2)


def _rolling(buf: np.ndarray, n: int) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf] * UP.upto(len(buf)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * DOWN.upto(len(buf) + 1)[: len(buf) - n + 1])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def stretches(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows, anchor hash and place of the anchor of each stretch."""
    out: list[tuple[np.ndarray, ...]] = []
    for i, j in steps(offs):
        if j == i + 1 and offs[j] - offs[i] > 1 << 20:  # a long text in pieces that overlap by a window
            pieces = [(s, min(int(offs[j]), s + (1 << 20) + length - 1)) for s in range(int(offs[i]), int(offs[j]), 1 << 20)]
        else:
            pieces = [(int(offs[i]), int(offs[j]))]
        for b, e in pieces:
            if e - b < length:
                continue
            part, own = buf[b:e], np.clip(offs[i : j + 1] - b, 0, e - b)
            h = _rolling(part, gram)
            least = _sliding_least(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), length - gram + 1)
            doc = np.repeat(np.arange(i, j), np.diff(own))
            first = np.flatnonzero(doc[: len(part) - length + 1] == doc[length - 1 :])
            if not len(first):
                continue
            anchor = (least[first] & _PLACE).astype(np.int64)
            new = np.ones(len(first), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
            run = np.flatnonzero(new)
            begin, n = first[run], np.diff(np.append(run, len(first)))
            out.append((doc[begin], begin + b - offs[doc[begin]], n, h[anchor[run]].view(np.int64), anchor[run] - begin))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, size: how many stretches of some documents have each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column("text"))
            for i, j in steps(offs, 4 << 20):
                found, size = np.unique(stretches(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(size)], names=["anchor", "size"])

    return docs.select("text").mapInArrow(run, "anchor long, size long")


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """id, key, anchor, own1, own2, begins, n, place (of the anchor): a row per document and different stretch, with all places where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column("text"))
            for i, j in steps(offs, 4 << 20):
                part, own = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                doc, begin, n, anchor, place = stretches(part, own, length, gram)
                at = own[doc] + begin
                one, two = digests(part, at, at + n - 1 + length).T
                order = np.lexsort((begin, two, one, anchor, doc))
                doc, begin, n, anchor, one, two, place = (x[order] for x in (doc, begin, n, anchor, one, two, place))
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                first = np.flatnonzero(new)
                rows = pa.array(doc[first] + i)
                begins = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(begin.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("key").take(rows), pa.array(anchor[first]), pa.array(one[first]), pa.array(two[first]), begins, pa.array(n[first].astype(np.int32)), pa.array(place[first].astype(np.int32))], names=["id", "key", "anchor", "own1", "own2", "begins", "n", "place"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, key long, anchor long, own1 long, own2 long, begins array<int>, n int, place int")


class Suffixes:
    """Ranks of the strings of 1, 2, 4, ... bytes at each place of data, which compare any two suffixes in a few steps."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.length, self.levels = length, []
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        rank, have = np.zeros(0), 1
        while have <= length:
            if have <= 8:  # so many bytes as one number
                rank = np.ndarray((len(data),), f">u{have}", padded, strides=(1,)).astype(f"u{have}")
            else:
                half = have // 2
                pair = rank.astype(np.uint64) << np.uint64(32)
                pair[:-half] |= rank[half:] + np.uint64(1)
                rank = pair
            if have >= 8:
                rank = np.unique(rank, return_inverse=True)[1].astype(np.uint32)
            self.levels.append((have, rank))
            have *= 2

    def order(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts in suffix order as far as length bytes, equal ones by position, and their ranks."""
        have, rank = self.levels[-1]
        key = rank[starts].astype(np.uint64) << np.uint64(32) | rank[starts + self.length - have]
        own = np.unique(key, return_inverse=True)[1]
        return np.argsort(own, kind="stable"), own

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at i and j have in common, as far as length."""
        out = np.zeros(len(i), np.int64)
        last = len(self.levels[0][1]) - 1
        for size, rank in reversed(self.levels):
            a, b = np.minimum(i + out, last), np.minimum(j + out, last)
            out += np.where((out + size <= self.length) & (rank[a] == rank[b]), size, 0)
        return out


def smaller(x: np.ndarray) -> np.ndarray:
    """For each place of x the nearest one before it that holds less, or -1; pointers are followed, all at once."""
    p = np.arange(len(x)) - 1
    live = np.arange(len(x))
    while len(live):
        live = live[p[live] >= 0]
        live = live[x[p[live]] > x[live]]
        p[live] = p[p[live]]
    return p


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor of each suffix at starts (increasing), as far as length bytes, and whether a later
    one matches it so far.

    The longest match that starts earlier is with the previous or the next smaller position in suffix order. A suffix
    whose right neighbour in that order agrees on all length bytes has a later match.
    """
    n = len(starts)
    suffixes = Suffixes(data, length)
    order, rank = suffixes.order(starts)
    before = smaller(order)
    after = n - 1 - smaller(order[::-1])[::-1]
    factor = np.zeros(n, np.int64)
    for found, near in ((before >= 0, before), (after < n, after)):
        at = np.flatnonzero(found)
        factor[at] = np.maximum(factor[at], suffixes.common(starts[order[at]], starts[order[near[at]]]))
    longest, later = np.empty(n, np.int64), np.zeros(n, bool)
    longest[order] = factor
    same = rank[order[1:]] == rank[order[:-1]]
    later[order[:-1][same]] = True
    return longest, later


def _runs(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of set flags inside one row."""
    at = np.flatnonzero(flags)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def matched(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """id, key, begin, n of the repeated windows among different stretches (anchor, id, key, begin, copies, bytes), sorted by anchor and position."""
    kind = dict(rows.dtypes)["id"]

    def find(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        data, offs = text_buffers(t.column("bytes"))
        n = np.diff(offs) - length + 1
        row = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        factor, later = previous_factors(data, offs[row] + inside, length)
        earlier = factor >= length
        # Without keep_first, all windows of a stretch of several copies are known to be repeated.
        flags = earlier if keep_first else (earlier | later) & (t.column("copies").to_numpy() == 1)[row]
        at, size = _runs(flags, row)
        own = pa.array(row[at])
        return pa.RecordBatch.from_arrays([t.column("id").take(own), t.column("key").take(own), pa.array((t.column("begin").to_numpy()[row[at]] + inside[at]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["id", "key", "begin", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for whole in batches:
            anchors = whole.column("anchor").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(anchors) else np.zeros(0, np.int64)
            offs = text_buffers(whole.column("bytes"))[1]
            b = 0
            while b < len(anchors):
                # cut in front of an anchor once enough is held
                ahead = edges[(edges > b) & (offs[edges] - offs[b] >= SORT_BYTES)]
                e = int(ahead[0]) if len(ahead) else len(anchors)
                if held and size >= SORT_BYTES and anchors[b] != last:
                    yield find(held)
                    held, size = [], 0
                elif held and size >= SORT_BYTES:  # the rest of the anchor that is held
                    e = int(edges[edges > b][0]) if (edges > b).any() else len(anchors)
                held.append(whole.slice(b, e - b))
                size += int(offs[e] - offs[b])
                last = anchors[e - 1]
                b = e
        if held:
            yield find(held)

    return rows.mapInArrow(run, f"id {kind}, key long, begin int, n int")


def _extracted(found: DataFrame, length: int) -> DataFrame:
    """The marked stretches of documents, with their bytes."""
    schema = f"id {dict(found.dtypes)['id']}, key long, begin int, n int, anchor long, copies long, place int, crowded boolean, bytes binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column("text"))
            marks = batch.column("marks")
            bounds = np.asarray(marks.offsets)
            inner = (marks if marks.offset == 0 and not marks.null_count else pa.concat_arrays([marks])).values.flatten()
            begin, n = (x.to_numpy() for x in inner[:2])
            for s in range(0, len(bounds) - 1, 256):
                e = min(s + 256, len(bounds) - 1)
                part = slice(int(bounds[s]), int(bounds[e]))
                doc = np.repeat(np.arange(s, e), np.diff(bounds[s : e + 1]))
                at = offs[doc] + begin[part]
                data = [buf[x : x + y].tobytes() for x, y in zip(at.tolist(), (n[part] + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), batch.column("key").take(pa.array(doc)), *(x[part.start : part.stop] for x in inner), pa.array(data, pa.binary())], names=names)

    return found.mapInArrow(run, schema)


def _pieces(rows: DataFrame, length: int) -> DataFrame:
    """Stretches in pieces of at most PIECE windows, with digests of what all windows of a piece share wherever it is cut
    off (core), and of the piece (own). stretch: where the stretch begins.

    Pieces are numbered from the anchor, so windows that are equal lie in pieces of one number.
    """
    schema = f"id {dict(rows.dtypes)['id']}, key long, stretch int, begin int, n int, copies long, core1 long, core2 long, own1 long, own2 long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(s, 2000) for s in range(0, whole.num_rows, 2000)):
                buf, offs = text_buffers(batch.column("bytes"))
                begin, n, copies, place = (batch.column(c).to_numpy().astype(np.int64) for c in ("begin", "n", "copies", "place"))
                # windows by how far they begin in front of the anchor: from low to high
                high, low = place, place - n + 1
                many = high // PIECE - low // PIECE + 1
                row = np.repeat(np.arange(len(n)), many)
                piece = (low // PIECE)[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                here = offs[row] + high[row]
                top, bottom = np.minimum(high[row], piece * PIECE + PIECE - 1), np.maximum(low[row], piece * PIECE)
                core = digests(buf, here - piece * PIECE, here - piece * PIECE + length - PIECE + 1)
                own = digests(buf, here - top, here - bottom + length)
                numbers = [begin[row].astype(np.int32), (begin[row] + high[row] - top).astype(np.int32), (top - bottom + 1).astype(np.int32), copies[row], *core.T, *own.T]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("key").take(pa.array(row)), *(pa.array(np.ascontiguousarray(x)) for x in numbers)], names=names)

    return rows.select("id", "key", "begin", "n", "copies", "place", "bytes").mapInArrow(run, schema)


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """The digest of each window of the pieces (first: their first window in bytes, begin: in the text)."""
    schema = f"id {dict(rows.dtypes)['id']}, key long, begin int, copies long, own1 long, own2 long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(s, 2000) for s in range(0, whole.num_rows, 2000)):
                buf, offs = text_buffers(batch.column("bytes"))
                first, begin, n, copies = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "begin", "n", "copies"))
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = (offs[:-1] + first)[row] + step
                own = digests(buf, at, at + length)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("key").take(pa.array(row)), pa.array((begin[row] + step).astype(np.int32)), pa.array(copies[row]), *(pa.array(np.ascontiguousarray(x)) for x in own.T)], names=names)

    return rows.mapInArrow(run, schema)


def _alike(rows: DataFrame, group: list[str], own: list[str], order, name: str) -> DataFrame:
    """rows (with copies) with the copies of all that are alike (own) in a group, the first of them, and how many
    different ones the group has. Rows that are alone are left out.

    What meets the rows is written as tables, so that adaptive execution splits the joins where one group is hot.
    """
    alike = table(rows.groupBy(*group, *own).agg(F.sum("copies").alias("all"), F.min(order).alias("first")), f"{name}_different")
    sizes = table(alike.groupBy(*group).agg(F.count("*").alias("different")), f"{name}_groups")
    alike = table(alike.join(sizes, group).where("all > 1 or different > 1"), f"{name}_alike")
    return rows.drop("copies").join(alike, [*group, *own]).withColumnRenamed("all", "copies")


def _crowded(stretches_: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """id, key, begin, n: what is repeated among stretches of crowded anchors."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "begin")
    pieces = table(_pieces(stretches_, length), "pieces")
    rows = _alike(pieces, ["core1", "core2"], ["own1", "own2"], place, "pieces")
    first = F.col("first") == place
    sure = rows.where(~first if keep_first else F.col("copies") > 1).select("id", "key", "begin", "n")
    differ = rows.where(first & (F.col("different") > 1)).select("id", "key", "stretch", "begin", "n", "copies", (F.col("begin") - F.col("stretch")).alias("first"))
    own = stretches_.select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("begin").alias("s"), "bytes")
    differ = differ.join(own, (F.col("key") == F.col("k")) & (F.col("stretch") == F.col("s")) & F.col("id").eqNullSafe(F.col("i")))
    each = table(_windows(differ.select("id", "key", "begin", "n", "copies", "first", "bytes"), length), "windows")
    twice = table(each.groupBy("own1", "own2").agg(F.count("*").alias("rows"), F.min(place).alias("first")).where("rows > 1"), "repeated")
    again = each.join(twice, ["own1", "own2"]).where(~first if keep_first else F.col("copies") == 1)
    return sure.unionByName(again.select("id", "key", "begin", F.lit(1).cast("int").alias("n")))


def _joined(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    marks = marks.withColumnsRenamed({"id": "mark_id", "key": "mark_key"})
    return docs.join(marks, (docs["key"] == marks["mark_key"]) & docs["id"].eqNullSafe(marks["mark_id"]), how).drop("mark_id", "mark_key")


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, crowd: int = CROWD, kept: bool = False) -> DataFrame:
    """A row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans, and the kept bytes if asked for.

    Removed is each byte that a string of `length` bytes covers which also starts elsewhere, in the same document or
    another; with keep_first only where such a string starts earlier (by id, null last, then a hash of the text, then
    place). Strings are judged on the whole UTF-8 input and never span documents. Null texts are empty; shorter texts
    keep everything; very long texts are cut into overlapping pieces, so nothing is missed; repeated rows are copies of
    each other (with keep_first they are judged as one); an empty table gives no rows; other columns aren't read.
    Nothing is removed on the word of a plain hash: bytes are compared, in suffix order, or 128-bit BLAKE2b digests of
    whole stretches and, where more than `crowd` different stretches share an anchor, of pieces and windows.
    """
    docs = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    long = docs.where(F.octet_length("text") >= length)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", F.col("begins")[0].alias("begin"))
    flagged = settle(anchors(long, length, gram).groupBy("anchor").agg(F.sum("size").alias("size")).where("size > 1").select("anchor"))
    # a table, so that adaptive execution splits the join at a hot anchor
    met = table(anchored(long, length, gram).join(flagged, "anchor"), "met")
    shared = table(met.groupBy("id", "key", "anchor", "own1", "own2", "begins", "n", "place").agg((F.count("*") * F.size("begins")).alias("copies")), "stretches")
    rows = _alike(shared, ["anchor"], ["own1", "own2"], order, "stretches")
    # All copies of a stretch are repeated (but the first); one of each different stretch is compared with the others.
    first = F.col("first") == order
    rest = F.slice("begins", F.lit(2), F.greatest(F.lit(0), F.size("begins") - 1))
    sure = F.when(first, rest).otherwise(F.col("begins")) if keep_first else F.when(F.col("copies") > 1, F.col("begins")).otherwise(F.array().cast("array<int>"))
    mark = F.when(first & (F.col("different") > 1), F.struct(F.col("begins")[0].alias("begin"), "n", "anchor", "copies", "place", (F.col("different") > crowd).alias("crowded")))
    told = rows.select("id", "key", sure.alias("sure"), "n", mark.alias("mark"))
    own = lambda c, x: F.filter(F.collect_list(F.when(c, x)), lambda y: y.isNotNull())
    window = F.struct("begin", "n")
    placed = F.struct("sure", "n")
    marks = settle(
        told.groupBy("id", "key").agg(own(F.size("sure") > 0, placed).alias("sure"), own(F.col("mark").isNotNull(), F.col("mark")).alias("marks"))
    )
    sure = F.flatten(F.transform("sure", lambda x: F.transform(x["sure"], lambda y: F.struct(y.alias("begin"), x["n"].alias("n")))))

    found = _joined(docs, marks.where(F.size("marks") > 0).select("id", "key", "marks"), "inner")
    extracts = table(_extracted(found, length), "extracts")
    few, many = extracts.where("not crowded"), extracts.where("crowded")
    sorted_ = few.repartition("anchor").sortWithinPartitions("anchor", F.col("id").asc_nulls_last(), "key", "begin")
    windows = matched(sorted_.select("anchor", "id", "key", "begin", "copies", "bytes"), length, keep_first)
    if not many.isEmpty():
        windows = windows.unionByName(_crowded(many, length, keep_first))
    later = windows.groupBy("id", "key").agg(F.collect_list(window).alias("later"))
    both = later.unionByName(marks.where(F.size("sure") > 0).select("id", "key", sure.alias("later"))).groupBy("id", "key").agg(F.flatten(F.collect_list("later")).alias("windows"))
    return _removed(_joined(docs, both, "left").select("id", "text", "windows"), length, kept).withColumnRenamed("id", id)


def _removed(docs: DataFrame, length: int, kept: bool) -> DataFrame:
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * kept
        for batch in batches:
            buf, offs = text_buffers(batch.column("text"))
            out: list[list] = [[], [], [], [], []]
            lists = batch.column("windows")
            for d in range(batch.num_rows):
                data = buf[offs[d] : offs[d + 1]]
                spans, removed, rest = [], 0, data
                if lists[d].is_valid and len(lists[d].values):
                    begin, n = (x.to_numpy() for x in lists[d].values.flatten())
                    edge = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + n + length - 1, minlength=len(data) + 1)
                    inside = np.cumsum(edge)[:-1] > 0
                    rest, removed = data[~inside], int(inside.sum())
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                    spans = turn.reshape(-1, 2).tolist()
                body = rest.tobytes()
                for column, x in zip(out, (removed, len(spans), hashlib.sha256(body).hexdigest(), [{"begin": b, "end": e} for b, e in spans], body if kept else None)):
                    column.append(x)
            columns = [batch.column("id"), pa.array(np.diff(offs)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(out[4], pa.binary())] if kept else []), names=names)

    more = ", kept binary" if kept else ""
    return docs.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>{more}")
