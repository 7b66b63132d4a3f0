"""n-gram Jaccard join: candidates by MinHash bands, Bayesian pruning on MinHash bits, exact verification of the rest.

Documents with the same set of word shingles are one class and move as one row. Classes that share a band of MinHash
values are candidates. Their one-bit MinHash values are compared 32 at a time, and a pair is dropped once the posterior
probability that its similarity reaches the threshold is below a tolerance. Pairs that are left join classes to
clusters; in a cluster every pair that isn't dropped in the same way is verified on the whole sets. Large buckets are
linked through leaders and large clusters are verified by pairs of blocks, so no list of all pairs of a group is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Words, chained, components, distinct, mix, same_words, steps, table, text_buffers

#: Words of a shingle and the least Jaccard similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: Bands of so many MinHash values: a pair at the threshold shares none with a chance of 5e-6.
BANDS, ROWS = 40, 6
#: A pair is dropped when its posterior chance of reaching the threshold is below this.
TOLERANCE = 1e-6
#: Classes of a bucket whose pairs are looked at one by one; classes, and their shingles, of a block of a large cluster.
BUCKET, BLOCK, BLOCK_SHINGLES = 64, 1024, 400_000
#: Similarities (estimated) from which a class of a large bucket goes with a leader, and without which it is one.
NEAR, LEAD = 0.3, 0.6
#: Leaders of a bucket in one round; classes that resemble none of so many get leaders of their own in the next round.
LEADERS = 4096
#: Classes (estimated by one in SHARE) of a bucket beyond which it is dealt to parts of about so many, at most MOST_HOT
#: buckets; parts have leaders of their own, which are closer to their classes, and meet by these in the next round.
HOT, SHARE, MOST_HOT, PART_LEAD = 200_000, 64, 10_000, 0.8

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_C = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BITS = 128


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, bits: int = BITS) -> np.ndarray:
    """For n bits compared, the fewest that must agree for a pair to stay.

    One-bit values of sets of similarity J agree with probability (1 + J) / 2; the prior of J is uniform on [0, 1].
    """
    j = (np.arange(4000) + 0.5) / 4000
    p = (1 + j) / 2
    out = np.zeros(bits + 1, np.int64)
    for n in range(1, bits + 1):
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log(1 - p)
            like = np.exp(logs - logs.max())
            if like[j >= threshold].sum() >= tolerance * like.sum():
                out[n] = m
                break
    return out


_STEPS = (32, 64, 96, 128)
_LEAST = dict(zip(_STEPS, least_matches()[list(_STEPS)].tolist()))
_HALF = np.uint64(0xFFFFFFFF)


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches (rows of two 64-bit words) are left after comparing 32, 64, 96 and 128 bits."""
    left = np.arange(len(a))
    agree = np.zeros(len(a), np.int64)
    for k, n in enumerate(_STEPS):
        differ = (a[left, k // 2] ^ b[left, k // 2]) >> np.uint64(32 * (k % 2)) & _HALF
        agree[left] += 32 - np.bitwise_count(differ).astype(np.int64)
        left = left[agree[left] >= _LEAST[n]]
    return left


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity of each sketch of a to each of b, by the share of equal bits."""
    differ = sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.int64) for k in (0, 1))
    return 1 - 2 * differ / BITS


def sketches(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (int64) and one-bit sketches (two uint64) of the sets that begin at starts in h; no set is empty."""
    x = (mix(h) >> np.uint64(32)).astype(np.uint32)
    mins = np.stack([np.minimum.reduceat(x * a + b, starts) for a, b in zip(_A, _B)], 1)
    rows = mins.reshape(len(starts), BANDS, ROWS).astype(np.uint64)
    bands = mix((rows * _C).sum(2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bit = mins[:, :BITS] * np.uint32(0x9E3779B1) >> np.uint32(31)
    return bands.view(np.int64), np.packbits(bit.astype(np.uint8), axis=1).view(np.uint64)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes (128 bits) of the different shingles of each document, in their order, and the bounds of the documents.

    A document of fewer words than a shingle, but not none, is one shingle.
    """
    at, size = words.places(n, short=True)
    doc = words.document()[at]
    one, two = chained(words.hash, at, size), chained(words.hash2, at, size, 1)
    order = np.lexsort((two, one, doc))
    doc, one, two = doc[order], one[order], two[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one[new], two[new], np.searchsorted(doc[new], np.arange(len(words.bounds)))


def signatures(docs: DataFrame, id: str, text: str, n: int) -> DataFrame:
    """id, text, key (a digest of the set; null without words), k64 (its first 8 bytes), n, bands and sketch, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for i, j in steps(offs):
                one, two, bounds = shingle_sets(Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), n)
                both = np.stack([one, two], 1)
                size = np.diff(bounds)
                keys = [hashlib.blake2b(both[b:e].tobytes(), digest_size=16).digest() if e > b else None for b, e in zip(bounds[:-1], bounds[1:])]
                bands, sketch = sketches(one, bounds[:-1][size > 0]) if len(one) else (np.zeros((0, BANDS), np.int64), np.zeros((0, 2), np.uint64))
                place = iter(range(len(bands)))
                rows = [None if k is None else next(place) for k in keys]
                columns = [
                    batch.column(0).slice(i, j - i),
                    batch.column(1).slice(i, j - i),
                    pa.array(keys, pa.binary()),
                    pa.array([None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()),
                    pa.array(size.astype(np.int32)),
                    pa.array([None if r is None else bands[r].tobytes() for r in rows], pa.binary()),
                    pa.array([None if r is None else sketch[r].tobytes() for r in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "key", "k64", "n", "bands", "sketch"])

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, text string, key binary, k64 long, n int, bands binary, sketch binary")


def _words(column: pa.Array) -> np.ndarray:
    """Binary values of 16 bytes as rows of two uint64."""
    buf, _ = text_buffers(column)
    return np.frombuffer(buf.tobytes(), np.uint64).reshape(-1, 2)


def banded(classes: DataFrame) -> DataFrame:
    """A row for each class and band: band, k64, s0, s1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            buf, _ = text_buffers(batch.column("bands"))
            sketch = np.repeat(_words(batch.column("sketch")), BANDS, 0).view(np.int64)
            k64 = np.repeat(batch.column("k64").to_numpy(), BANDS)
            bands = np.frombuffer(buf.tobytes(), np.int64)
            for i in range(0, n * BANDS, 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(bands[part]), pa.array(k64[part]), pa.array(sketch[part, 0]), pa.array(sketch[part, 1])], names=["band", "k64", "s0", "s1"])

    return classes.select("k64", "bands", "sketch").mapInArrow(run, "band long, k64 long, s0 long, s1 long")


class Leaders:
    """The leaders of one large bucket: a class is tied to each leader that it may resemble, or becomes one.

    Two classes of similarity 0.8 are at most 0.2 apart; one lies within 0.4 of a leader, so the other lies within
    0.6 of it, and both are tied to it. Once there are LEADERS leaders, classes that resemble none are left for the
    next round, besides the ties that they have: of two such classes both are left.
    Ties that join nothing new are left out: there are fewer of them than classes and leaders.

    In a part of a bucket leaders are at most 0.2 from their classes, so leaders of like classes in two parts are at
    most 0.6 apart, and are tied where all leaders meet.
    """

    def __init__(self, part: bool = False) -> None:
        self.part, self.lead = part, PART_LEAD if part else LEAD
        self.group: list[int] = []
        self.keys, self.rows = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)

    def root(self, x: int) -> int:
        while self.group[x] != x:
            x = self.group[x]
        return x

    def add(self, keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of keys that are tied, and places of those that are left."""
        none = np.zeros((0, 2), np.int64)
        for i in range(0, len(keys), 1024):
            k, r = keys[i : i + 1024], rows[i : i + 1024]
            near = estimated(r, self.rows)
            while len(k):
                alone = np.flatnonzero(near.max(1, initial=-1) < self.lead)
                if not len(alone) or len(self.keys) >= LEADERS:
                    break
                self.keys, self.rows = np.append(self.keys, k[alone[0]]), np.concatenate([self.rows, r[alone[:1]]])
                near = np.concatenate([near, estimated(r, r[alone[:1]])], 1)
            self.group += range(len(self.group), len(self.keys))
            a, b = np.nonzero(near >= NEAR)
            first = b[np.searchsorted(a, a)]
            yield np.stack([k[a[b == first]], self.keys[b[b == first]]], 1), i + np.flatnonzero(near.max(1, initial=-1) < self.lead)
            for x, y in np.unique(np.stack([first, b], 1), axis=0).tolist():
                x, y = self.root(x), self.root(y)
                if x != y:
                    self.group[max(x, y)] = min(x, y)
                    yield self.keys[[[x, y]]], none[:, 0]


def leaders_of(buckets: int, m: int, which: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of m places of each bucket the first place that the bucket's pairs (i, j) connect it with."""
    tied = np.zeros((buckets, m, m), bool)
    tied[:, np.arange(m), np.arange(m)] = True
    tied[which, i, j] = tied[which, j, i] = True
    lead = np.tile(np.arange(m), (buckets, 1))
    while True:
        new = np.where(tied, lead[:, None, :], m).min(2)
        if (new == lead).all():
            return lead
        lead = new


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of k64, which connect what likely pairs connect: each class of a small bucket is tied to the first
    one that its likely pairs lead to, each class of a large bucket to leaders. Rounds go on until no class is left."""
    some = banded(classes.where(F.pmod("k64", F.lit(SHARE)) == 0)).groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") * SHARE > HOT)
    hot = table(some.orderBy(F.desc("n")).limit(MOST_HOT).select("band", F.ceil(F.col("n") * SHARE / HOT).alias("parts")), "hot")
    bands = banded(classes).join(F.broadcast(hot), "band", "left")  # MOST_HOT rows at most
    bands = bands.withColumn("part", F.pmod(F.xxhash64("k64"), F.col("parts"))).drop("parts")
    out = None
    while True:
        found = table(_round(bands), "candidates")
        ties = found.where("not left").select("a", "b")
        out = ties if out is None else out.unionByName(ties)
        rest = found.where("left")
        if rest.isEmpty():
            return out.distinct()
        bands = rest.select(F.col("a").alias("band"), F.col("b").alias("k64"), "s0", "s1", F.lit(None).cast("long").alias("part"))


def _round(bands: DataFrame) -> DataFrame:
    """Ties (a, b), and rows (band, k64, s0, s1) that are left, as rows a, b, s0, s1, left. part: of a bucket, or null."""
    names = ["a", "b", "s0", "s1", "left"]

    def emit(pairs: np.ndarray) -> pa.RecordBatch:
        a, b = pairs.min(1), pairs.max(1)
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, pa.array(np.zeros(len(pairs), bool))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tri = {2: np.triu_indices(2, 1)}
        hot: tuple[int, int, Leaders] | None = None  # bucket, band and leaders
        out: list[np.ndarray] = []
        left: list[pa.RecordBatch] = []

        def leave(band: int, key: np.ndarray, row: np.ndarray) -> None:
            if len(key):
                s = np.ascontiguousarray(row).view(np.int64)
                left.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(key), band)), pa.array(key), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), pa.array(np.ones(len(key), bool))], names=names))

        def led(leaders: Leaders, band: int, key: np.ndarray, row: np.ndarray) -> None:
            for ties, rest in leaders.add(key, row):
                out.append(ties)
                leave(band, key[rest], row[rest])

        def over(leaders: Leaders, band: int) -> None:
            if leaders.part:
                leave(band, leaders.keys, leaders.rows)

        def closed(bucket: np.ndarray, band: np.ndarray, key: np.ndarray, row: np.ndarray, part: np.ndarray) -> None:
            """The pairs of whole buckets."""
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(bucket)))
            large = part[start] | (size > BUCKET)
            for s, m in zip(start[large], size[large]):
                leaders = Leaders(bool(part[s]))
                led(leaders, int(band[s]), key[s : s + m], row[s : s + m])
                over(leaders, int(band[s]))
            start, size = start[~large], size[~large]
            for m in np.unique(size[size > 1]).tolist():
                at = start[size == m]
                i, j = tri.setdefault(m, np.triu_indices(m, 1))
                for k in range(0, len(at), max(1, 200_000 // len(i))):
                    some = at[k : k + max(1, 200_000 // len(i)), None]
                    a, b = (some + i).ravel(), (some + j).ravel()
                    found = likely(row[a], row[b])
                    lead = leaders_of(len(some), m, found // len(i), i[found % len(i)], j[found % len(i)])
                    which, place = np.nonzero(lead != np.arange(m))
                    out.append(np.stack([key[some[which, 0] + place], key[some[which, 0] + lead[which, place]]], 1))

        def told() -> Iterator[pa.RecordBatch]:
            if out:
                yield emit(np.concatenate(out))
            yield from left
            out.clear()
            left.clear()

        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, bool)]
        for batch in batches:
            bucket, band, key, *s = (batch.column(c).to_numpy() for c in ("bucket", "band", "k64", "s0", "s1"))
            rows = [bucket, band, key, np.stack(s, 1).view(np.uint64), batch.column("split").to_numpy(zero_copy_only=False)]
            if hot:
                n = int(np.searchsorted(bucket != hot[0], True)) if len(bucket) else 0
                led(hot[2], hot[1], key[:n], rows[3][:n])
                rows = [x[n:] for x in rows]
                if len(rows[0]):
                    over(hot[2], hot[1])
                    hot = None
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
            bucket = rows[0]
            last = int(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[-1]) if len(bucket) else 0
            closed(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
            if len(held[0]) > BUCKET:
                hot = (int(held[0][0]), int(held[1][0]), Leaders(bool(held[4][0])))
                led(hot[2], hot[1], held[2], held[3])
                held = [x[:0] for x in held]
            yield from told()
        closed(*held)
        if hot:
            over(hot[2], hot[1])
        yield from told()

    bucket = F.when(F.col("part").isNull(), F.col("band")).otherwise(F.xxhash64("band", "part"))
    rows = bands.select(bucket.alias("bucket"), "band", "k64", "s0", "s1", F.col("part").isNotNull().alias("split"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "k64").mapInArrow(run, "a long, b long, s0 long, s1 long, left boolean")


def numbered(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text as numbers, the same one for the same words, and the bounds of the texts."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(texts), np.uint8), offs)
    at, size = words.places(n, short=True)
    many, of = distinct(chained(words.hash, at, size), lambda i, j: (size[i] == size[j]) & same_words(words, at[i], words, at[j], np.minimum(size[i], size[j])))
    key = np.unique(words.document()[at] * max(1, len(many)) + of)
    doc, ids = key // max(1, len(many)), key % max(1, len(many))
    return ids, np.searchsorted(doc, np.arange(len(texts) + 1))


def verify(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links within runs of members (root, i, j, block, key, copies, sketch, text): key, other, links, docs.

    A row with other null adds links and linked documents to key; one with other set is an edge of a spanning forest
    of the run's links. Members of block i are compared with those of block j, or with each other if i = j.
    """

    def compare(rows: dict[str, list]) -> Iterator[tuple]:
        first: dict[bytes, int] = {}
        for p, k in enumerate(rows["key"]):
            first.setdefault(k, p)
        keep = list(first.values())
        key, copies, block = ([rows[c][p] for p in keep] for c in ("key", "copies", "block"))
        i, j = rows["i"][0], rows["j"][0]
        left = [p for p, b in enumerate(block) if b == i]
        right = left if i == j else [p for p, b in enumerate(block) if b == j]
        if not left or not right or len(keep) < 2:
            return
        ids, bounds = numbered([(rows["text"][p] or "").encode() for p in keep], n)
        size = np.diff(bounds)
        sketch = np.stack([np.frombuffer(rows["sketch"][p], np.uint64) for p in keep])
        of = lambda p: ids[bounds[p] : bounds[p + 1]]
        mark = np.zeros(int(ids.max()) + 1, bool)
        weight = np.array(copies)
        links, docs = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)
        parent = list(range(len(keep)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        others = np.array(right)
        for p in left:
            some = others[others > p] if i == j else others
            some = some[(np.minimum(size[some], size[p]) >= threshold * np.maximum(size[some], size[p]) - 1e-9)]
            some = some[likely(np.repeat(sketch[[p]], len(some), 0), sketch[some])]
            if not len(some):
                continue
            mark[of(p)] = True
            each = np.concatenate([of(q) for q in some])
            common = np.add.reduceat(mark[each].astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
            mark[of(p)] = False
            linked = some[common >= threshold * (size[some] + size[p] - common) - 1e-9]
            links[p] += len(linked)
            docs[p] += weight[linked].sum()
            links[linked] += 1
            docs[linked] += weight[p]
            for q in linked.tolist():
                a, b = root(p), root(q)
                if a != b:
                    parent[a] = b
                    yield key[p], key[q], 0, 0
        for p in np.flatnonzero(links).tolist():
            yield key[p], None, int(links[p]), int(docs[p])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        at, out = None, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["key", "other", "links", "docs"])

        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                part = whole.slice(s, 256).to_pydict()
                runs = list(zip(part["root"], part["i"], part["j"]))
                b = 0
                while b < len(runs):
                    e = b
                    while e < len(runs) and runs[e] == runs[b]:
                        e += 1
                    if runs[b] != at:
                        if held:
                            out += compare(held)
                        held, at = {k: [] for k in part}, runs[b]
                    for k, v in part.items():
                        held[k] += v[b:e]
                    b = e
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
        if held:
            out += compare(held)
        yield batch(out)

    return members.mapInArrow(run, "key binary, other binary, links long, docs long")


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, unique: bool = False) -> DataFrame:
    """A row per document: id, class_id, n_copies, n_links, n_linked_docs, group_id, kept.

    Documents with equal sets of shingles are a class; class_id is its smallest id (null last) and n_copies its
    documents. n_links counts the other classes with a Jaccard similarity of at least threshold, n_linked_docs the
    documents in them. group_id is the smallest id of all documents that links and classes connect, and kept is true
    for one document of each group. Words are runs of [0-9a-z] (after lower-casing A-Z) and non-ASCII characters;
    a document of fewer words than a shingle, but not none, is one shingle; one without words (null or empty too) is
    a class of its own. Very long texts count whole. Repeated rows are copies, and rows that share an id, or have none,
    are judged on their own. An empty table gives no rows; other columns aren't read. unique: ids differ and docs is a
    table, so texts that are needed again are read there, and no copy of them is kept meanwhile.

    Sets are equal when the BLAKE2b digests of their shingles' 128-bit hashes are. Links are verified by the words of
    the shingles (a word of more than 15 bytes by 120 bits of BLAKE2b). Candidate search is probabilistic: a pair at the
    threshold shares no band with a chance of about 6e-6, one at 0.9 with less than 1e-12; in buckets of more than
    BUCKET classes similarities to leaders are estimates, whose recall the tests measure.
    """
    signed = signatures(docs, id, text, shingle).withColumn("row", F.monotonically_increasing_id())
    each = table(signed.drop("text") if unique else signed, "signatures")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = table(each.where("key is not null").groupBy("key").agg(F.min(order).alias("rep"), F.count("*").alias("copies"), F.first("k64").alias("k64"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    clusters = components(candidates(classes))
    member = classes.drop("bands").join(clusters, F.col("k64") == F.col("node"))
    member = table(member.select("root", "key", "copies", "sketch", "n", F.col("rep.id" if unique else "rep.row").alias("place")), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = table(member.groupBy("root").agg(blocks.alias("blocks")), "clusters")
    placed = member.join(sized, "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(id).alias("place"), F.col(text).cast("string").alias("text")) if unique else each.select(F.col("row").alias("place"), "text")
    found = placed.drop("n").join(texts, "place")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = found.select("root", "block", "key", "copies", "sketch", "text", other.alias("o")).select("root", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "key", "copies", "sketch", "text")
    runs = spread.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = table(verify(runs, shingle, threshold), "links")
    groups = components(links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    reps = classes.select("key", "rep", "copies")
    rooted = reps.join(groups, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    first = rooted.groupBy("root").agg(F.min("rep").alias("first"))
    totals = links.where("other is null").groupBy("key").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("n_docs"))
    told = rooted.join(first, "root").join(totals, "key", "left").select("key", "rep", "copies", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    with_words = each.where("key is not null").select("id", "row", "key").join(told, "key")
    out = with_words.select(F.col("id").alias(id), F.col("rep.id").alias("class_id"), F.col("copies").alias("n_copies"), "n_links", F.col("n_docs").alias("n_linked_docs"), F.col("first.id").alias("group_id"), (F.col("row") == F.col("first.row")).alias("kept"))
    none = each.where("key is null").select(F.col("id").alias(id), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_linked_docs"), F.col("id").alias("group_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)
