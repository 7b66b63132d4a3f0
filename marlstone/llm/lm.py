"""A word trigram model in Elias-Fano tries, counted over the whole corpus, and scores of texts under it.

The model is dealt to shards and nothing of it is broadcast. Texts are gathered in blocks; a block asks with its distinct
words, pairs and triples, and says what training adds to their counts. Words come first: shards of words count them and
number those of the model, the frequent ones low. Pairs and triples then travel as numbers, sorted, a few bytes each. A
shard of pairs sums them, makes its trie (first words, their successors, the successors of pairs) and answers.
"""

from __future__ import annotations

import gc
import math
import mmap
import os
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import BLANK, Words, distinct, mix, steps, table, text_buffers

#: An n-gram that stands so often in training is in the model, at every size of the corpus.
LEAST = 2
#: Taken from each count of an n-gram and given to what its context hasn't been seen with.
DISCOUNT = 0.75
#: The hash of the token behind the last word of a text; its key is that of no word.
END = np.uint64(0x5EED0FE2D0F7E875)
#: Bytes of text in a block, and of all texts for each shard of pairs and for each shard of words.
BLOCK_BYTES, SHARD_BYTES, WORD_BYTES = 8 << 20, 6 << 20, 32 << 20
#: Steps of log10 between the 8-bit codes of chances, the same in all shards; the last code stands for none.
STEP, NONE = 0.0375, 255

_BYTES, _ALL = np.uint64(0x0101010101010101), np.uint64(2**64 - 1)
#: Where the k-th one of a byte is.
_PLACE = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    """Increasing integers: low bits in a packed array, high bits in unary, and how many ones stand before each word of
    them, a byte for every two. All three arrays may lie in mapped memory."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, int(math.floor(math.log2(top / n)))) if n else 0
        values = values.astype(np.uint64)
        bits = np.zeros(-(-(n + (top >> low_bits) + 2) // 64) * 64, np.uint8)
        bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
        part = values & np.uint64((1 << low_bits) - 1)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(low, word, part << shift)
        over = (shift + np.uint64(low_bits)) > 64
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        return cls(n, low_bits, low, high, np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.uint32)).astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        more = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift | more) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, i: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Where the i-th one (or zero, with all bits to flip) of the high bits is; before: how many stand in front of each word."""
        word = np.searchsorted(before, i, "right") - 1
        rest = (i - before[word]).astype(np.uint64)
        x = self.high[word] ^ flip
        # the ones of each byte, and then those up to it, side by side in one number
        s = x - (x >> np.uint64(1) & _BYTES * np.uint64(0x55))
        s = (s & _BYTES * np.uint64(0x33)) + (s >> np.uint64(2) & _BYTES * np.uint64(0x33))
        s = (s + (s >> np.uint64(4)) & _BYTES * np.uint64(0x0F)) * _BYTES
        full = np.bitwise_count((rest * _BYTES | _BYTES * np.uint64(0x80)) - s & _BYTES * np.uint64(0x80)).astype(np.uint64)
        shift = full << np.uint64(3)
        rest -= s << np.uint64(8) >> shift & np.uint64(0xFF)
        return word * 64 + shift.astype(np.int64) + _PLACE[x >> shift & np.uint64(0xFF), rest]

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, self.ones, np.uint64(0)) - i) << self.low_bits | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the place of the first value that is at least x, or n."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        h = np.minimum(x >> self.low_bits, len(self.high) * 64 - self.n - 1)
        low = x & ((1 << self.low_bits) - 1)
        start = lambda k: np.where(k > 0, self._select(np.maximum(k - 1, 0), zeros, _ALL) - np.maximum(k - 1, 0), 0)
        begin, end = start(h), np.minimum(self._select(h, zeros, _ALL) - h, self.n)
        live = np.flatnonzero(begin < end)
        while len(live):
            mid = (begin[live] + end[live]) >> 1
            less = self._low(mid) < low[live]
            begin[live] = np.where(less, mid + 1, begin[live])
            end[live] = np.where(less, end[live], mid)
            live = live[begin[live] < end[live]]
        return begin


class Level:
    """The successors of each context, as ids that grow inside a context; a base per context makes them one sequence."""

    def __init__(self, pointers: EliasFano, ids: EliasFano) -> None:
        self.pointers, self.ids = pointers, ids

    @classmethod
    def encode(cls, context: np.ndarray, word: np.ndarray, contexts: int) -> Level:
        """Entries sorted by context and word."""
        pointers = np.searchsorted(context, np.arange(contexts + 1))
        last = np.flatnonzero(np.append(context[1:] != context[:-1], True)) if len(context) else np.zeros(0, np.int64)
        base = np.zeros(contexts + 1, np.int64)
        base[context[last] + 1] = word[last] + 1
        return cls(EliasFano.encode(pointers), EliasFano.encode(word + np.cumsum(base)[context]))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The entry of word among the successors of context, or -1. Runs of one context are looked up once."""
        turn = np.flatnonzero(np.diff(context, prepend=-1))
        times = np.diff(np.append(turn, len(context)))
        begin, end = self.pointers.access(context[turn]), self.pointers.access(context[turn] + 1)
        base = np.zeros(len(turn), np.int64)
        later = np.flatnonzero((begin < end) & (begin > 0))
        base[later] = self.ids.access(begin[later] - 1) + 1
        some = np.flatnonzero(np.repeat(begin < end, times))
        x = np.repeat(base, times)[some] + word[some]
        at = self.ids.successor(x)
        hit = at < np.repeat(end, times)[some]
        hit[hit] = self.ids.access(at[hit]) == x[hit]
        out = np.full(len(context), -1, np.int64)
        out[some[hit]] = at[hit]
        return out


def mapped(*parts: EliasFano | np.ndarray) -> list:
    """The parts with their arrays moved to one anonymous memory map, which no file stands behind."""
    arrays = [x for p in parts for x in ((p.low, p.high, p.ones) if isinstance(p, EliasFano) else (p,))]
    whole = mmap.mmap(-1, max(1, sum(-(-x.nbytes // 8) * 8 for x in arrays)))
    at, moved = 0, []
    for x in arrays:
        view = np.frombuffer(whole, x.dtype, len(x), at)
        view[:] = x
        moved.append(view)
        at += -(-x.nbytes // 8) * 8
    each = iter(moved)
    return [EliasFano(p.n, p.low_bits, next(each), next(each), next(each)) if isinstance(p, EliasFano) else next(each) for p in parts]


def packed(*arrays) -> bytes:
    raw = pickle.dumps(arrays, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(body: bytes) -> tuple:
    return pickle.loads(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True))


def planes(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on by their bytes, the lowest of all first, which packs better."""
    n = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)


def numbers(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, : len(x)] = x.T
    return out.view("<i8").ravel().astype(np.int64)


def code(chance: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log10(chance) / -STEP), 0, NONE - 1).astype(np.uint8)


def chance(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == NONE, 0.0, 10 ** (codes * -STEP))


def parts(shard: np.ndarray) -> list[tuple[int, slice]]:
    """Each number of an increasing array and where it stands."""
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(1, np.int64)
    return [(int(shard[b]), slice(int(b), int(e))) for b, e in zip(edges[:-1], edges[1:])]


def paired(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different pair, in their order, and the number of each pair's own."""
    if not len(a) or max(int(a.max()), int(b.max())) < 1 << 31:
        return np.unique(a << 31 | b, return_index=True, return_inverse=True)[1:]
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


class Vocabulary:
    """The words of a shard of words, from the requests (words by their keys, counts) of all blocks.

    Words that stand LEAST times are numbered from 0 on, the most frequent first, and their numbers leave room for those
    of the other shards; a number is so large only as there are words in the model.
    """

    def __init__(self, requests: list[tuple], group: int, groups: int) -> None:
        keys = [x.T.copy().view(">u8").astype(np.uint64) for x, _ in requests]
        every = np.concatenate([np.zeros((0, 2), np.uint64), *keys])
        order = np.lexsort((every[:, 1], every[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (every[order[1:]] != every[order[:-1]]).any(1)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        size = int(new.sum())
        #: The words of each request, by their places here.
        self.asked = np.split(of, np.cumsum([len(k) for k in keys])[:-1]) if keys else []
        self.count = np.bincount(of, np.concatenate([np.zeros(0), *(n for _, n in requests)]), size).astype(np.int64)
        self.by_count = np.argsort(-self.count, kind="stable")[: int((self.count >= LEAST).sum())]
        self.id = np.full(size, -1, np.int64)
        self.id[self.by_count] = np.arange(len(self.by_count)) * groups + group


class Shard:
    """The trie of the pairs of a shard: first words, their successors, and the successors of each pair.

    Made of pairs and triples by the numbers of their words, which may repeat; context: the row of a triple's pair.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray, n: np.ndarray, context: np.ndarray, w: np.ndarray, n3: np.ndarray) -> None:
        at, of = paired(u, v)
        total = np.bincount(of, n, len(at)).astype(np.int64)
        kept = total >= LEAST
        entry = np.where(kept, np.cumsum(kept) - 1, -1)[of[context]]
        at, count = at[kept], total[kept]
        some = np.flatnonzero(entry >= 0)
        entry, w, n3 = entry[some], w[some], n3[some]
        at3, of = paired(entry, w)
        total = np.bincount(of, n3, len(at3)).astype(np.int64)
        kept = total >= LEAST
        entry, w, total = entry[at3][kept], w[at3][kept], total[kept]
        firsts, first = np.unique(u[at], return_inverse=True)
        seen = (total - DISCOUNT) / count[entry]
        left = np.maximum(1 - np.bincount(entry, seen, len(count)), 1e-9)
        two, three = Level.encode(first, v[at], len(firsts)), Level.encode(entry, w, len(count))
        self.firsts, p2, i2, p3, i3, self.count, self.left, self.seen = mapped(EliasFano.encode(firsts), two.pointers, two.ids, three.pointers, three.ids, count, code(left), code(seen))
        self.two, self.three = Level(p2, i2), Level(p3, i3)
        #: For each first word its number, and how often and with how many different words it begins a pair.
        self.sums = firsts, np.bincount(first, count, len(firsts)).astype(np.int64), np.bincount(first, minlength=len(firsts))

    def ask(self, u: np.ndarray, v: np.ndarray, successors: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The count of each pair, or 0; what it leaves to shorter contexts; and the chance of each of its successors."""
        count, left, seen = np.zeros(len(u), np.int64), np.full(len(u), NONE, np.uint8), np.full(len(w), NONE, np.uint8)
        if not len(self.count):
            return count, left, seen
        first = np.minimum(self.firsts.successor(u), self.firsts.n - 1)
        some = np.flatnonzero(self.firsts.access(first) == u)
        pair = np.full(len(u), -1, np.int64)
        pair[some] = self.two.find(first[some], v[some])
        hit = pair >= 0
        count[hit], left[hit] = self.count[pair[hit]], self.left[pair[hit]]
        context = np.repeat(pair, successors)
        some = np.flatnonzero(context >= 0)
        at = self.three.find(context[some], w[some])
        seen[some[at >= 0]] = self.seen[at[at >= 0]]
        return count, left, seen


class Grams:
    """The distinct pairs and triples of a block's tokens whose words are in the model, and for each token those that it
    ends, or -1. Both are in the order of their shard and their words' numbers.

    A triple is in the shard of its first pair, so a context and its successors meet.
    """

    def __init__(self, word: np.ndarray, bounds: np.ndarray, ids: np.ndarray, shards: int) -> None:
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        known = int((ids < 0).sum())
        self.id, own, n = ids[order], place[word], max(1, len(ids))
        inside = own >= known
        inside[1:] &= inside[:-1]
        inside[bounds[:-1]] = False
        self.pair, self.triple = np.full(len(word), -1, np.int64), np.full(len(word), -1, np.int64)
        at = np.flatnonzero(inside)
        key, pair = np.unique(own[at - 1] * n + own[at], return_inverse=True)
        first, second = key // n, key % n
        shard = mix(mix(self.id[first].astype(np.uint64)) + self.id[second].astype(np.uint64)) % np.uint64(shards)
        shard = shard.astype(np.uint16 if shards < 1 << 16 else np.int64)  # sorted by radix while they are few
        order = np.argsort(shard, kind="stable")
        self.first, self.second, self.shard = self.id[first[order]], self.id[second[order]], shard[order].astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair[at] = place[pair]
        at = at[inside[at - 1]]
        key, triple = np.unique(self.pair[at - 1] * n + own[at], return_inverse=True)
        self.context, self.third = key // n, self.id[key % n]
        self.triple[at] = triple

    def requests(self, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Shard and contents of a block's requests. train: whether a token counts, and not only asks."""
        counts = [np.bincount(k[train & (k >= 0)], minlength=n) for k, n in ((self.pair, len(self.first)), (self.triple, len(self.context)))]
        successors = np.bincount(self.context, minlength=len(self.first))
        ends = np.append(0, np.cumsum(successors))
        for s, p in parts(self.shard):
            t = slice(ends[p.start], ends[p.stop])
            yield s, packed(planes(np.diff(self.first[p], prepend=0)), planes(self.second[p]), planes(counts[0][p]), planes(successors[p]), planes(self.third[t]), planes(counts[1][t]))


#: Kinds of rows on their way: requests about words, blocks, and answers about words, pairs, and what words leave.
WORDS, TEXTS, PAIRS, SUMS, WORD_ANSWERS, PAIR_ANSWERS, LEFT = range(7)
ROWS = "to long, kind int, part int, block long, body binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=NAMES)


def _of(got: pa.Table, kind: int) -> list[dict]:
    """The rows of a kind, in the order of their parts and blocks."""
    rows = got.filter(pc.equal(got["kind"], kind)).select(["part", "block", "body"]).to_pylist()
    return sorted(rows, key=lambda x: (x["part"], x["block"]))


def _block(held: list[tuple[pa.RecordBatch, Words, np.ndarray]], groups: int) -> list[tuple]:
    """The rows of a block: its documents with their tokens, and the requests about its words."""
    head, tail, h, sizes = [], [], [], []
    for _, w, _ in held:
        n = len(w.bounds) - 1
        at = np.arange(len(w)) + w.document()
        for out, x, end in ((head, w.head, 0), (tail, w.tail, 0), (h, w.hash, END)):
            line = np.full(len(w) + n, end, np.uint64)
            line[at] = x
            out.append(line)
        sizes.append(np.diff(w.bounds) + 1)
    head, tail, h, sizes = (np.concatenate(x) for x in (head, tail, h, sizes))
    train = np.concatenate([t for _, _, t in held])
    first, word = distinct(h, lambda i, j: (head[i] == head[j]) & (tail[i] == tail[j]))
    head, tail = head[first], tail[first]
    # shards of words are ranges of hashes
    group = ((h[first] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((tail, head, group))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    word, head, tail, group = place[word], head[order], tail[order], group[order]
    every = np.bincount(word, minlength=len(order))
    mine = np.bincount(word[np.repeat(train, sizes)], minlength=len(order))
    rank = np.empty(len(order), np.int64)
    rank[np.argsort(-every, kind="stable")] = np.arange(len(order))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0][0].schema) as out:
        for x, _, _ in held:
            out.write_batch(x)
    name = int.from_bytes(os.urandom(8), "little") >> 1
    rows = [(name, TEXTS, 0, name, packed(sink.getvalue().to_pybytes(), sizes.astype(np.int32), train, planes(rank[word]), planes(every)))]
    keys = np.stack([head, tail], 1).astype(">u8").view(np.uint8).reshape(-1, 16)
    return rows + [(g, WORDS, g, name, packed(np.ascontiguousarray(keys[s].T), mine[s].astype(np.int32))) for g, s in parts(group)]


def _opened(body: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The documents of a block, the bounds of their tokens, whether each is of training, and the word of each token."""
    docs, sizes, train, rank, every = unpacked(body)
    order = np.argsort(-numbers(every), kind="stable")
    return pa.ipc.open_stream(docs).read_all(), np.append(0, np.cumsum(sizes, dtype=np.int64)), train, order[numbers(rank)]


def _freed(df: DataFrame) -> None:
    """Shuffle files go when Spark sees that nothing refers to them any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def corpus_scores(docs: DataFrame, train: str, text: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, word_bytes: int = WORD_BYTES) -> DataFrame:
    """docs, but for text, with n_tokens, n_known (tokens seen in training), train_tokens, base_score and score, under the
    model of the rows whose column train is true.

    base_score adds up log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; score is the log10 chance of the text under
    the trigram model: seen n-grams by discounted counts, the rest of a context's chance by the next shorter context,
    down to the base. Every word, and every pair and triple that stands LEAST times in training, is in the model, at every
    size. Chances of triples, and what contexts leave, are in 8 bits. A null or empty text is its end alone; a very long
    one is in one block; repeated rows are scored, and counted, one by one; ties don't arise; an empty table gives no
    rows; columns with the new names are replaced. Words of up to 15 bytes are told apart by their bytes, longer ones by
    120 bits of BLAKE2b.

    Shards and blocks grow in number with the texts, not in size, but for a pair's successors, which meet in one shard.
    Each block asks each shard at most once; on corpora of many terabytes take block_bytes and shard_bytes larger, in
    step with the root of the corpus, so that a request still holds many n-grams.
    """
    new = ["n_tokens", "n_known", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (text, train, "train_tokens", *new)]
    safe = [f"c{k}" for k in range(len(keep))]
    slim = docs.select(*(F.col(c).alias(s) for c, s in zip(keep, safe)), F.col(text).cast("string").alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, groups = max(1, math.ceil(total / shard_bytes)), max(1, math.ceil(total / word_bytes))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            buf, offs = text_buffers(batch.column("text"))
            flags = batch.column("train").to_numpy(zero_copy_only=False)
            rest = batch.select(safe) if safe else batch.select(["train"])
            for i, j in steps(offs):
                held.append((rest.slice(i, j - i), Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], BLANK), flags[i:j]))
                size += int(offs[j] - offs[i])
                if size >= block_bytes:
                    yield from _rows(_block(held, groups)).to_batches(max_chunksize=16)
                    held, size = [], 0
        if held:
            yield from _rows(_block(held, groups)).to_batches(max_chunksize=16)

    def words(got: pa.Table) -> pa.Table:
        asked = _of(got, WORDS)
        group = asked[0]["part"]
        v = Vocabulary([unpacked(x["body"]) for x in asked], group, groups)
        out = _rows([(x["block"], WORD_ANSWERS, group, x["block"], packed(planes(v.count[at]), planes(v.id[at] + 1))) for x, at in zip(asked, v.asked)])
        one = np.concatenate([[1], np.zeros(len(asked) - 1, np.int64)])
        return out.append_column("tokens", pa.array(one * v.count.sum())).append_column("words", pa.array(one * (v.count > 0).sum()))

    def told(answers: list[tuple], k: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(numbers(a[k]) for a in answers)])

    def ask(got: pa.Table) -> pa.Table:
        (body,) = (x["body"] for x in _of(got, TEXTS))
        _, bounds, mine, word = _opened(body)
        ids = told([unpacked(x["body"]) for x in _of(got, WORD_ANSWERS)], 1) - 1
        block = got["block"][0].as_py()
        return _rows([(s, PAIRS, s, block, x) for s, x in Grams(word, bounds, ids, shards).requests(np.repeat(mine, np.diff(bounds)))])

    def pairs(got: pa.Table) -> pa.Table:
        asked = _of(got, PAIRS)
        asks = []
        for x in asked:
            u, *rest = map(numbers, unpacked(x["body"]))
            asks.append((np.cumsum(u), *rest))
        u, v, n, successors, w, n3 = (np.concatenate(x) for x in zip(*asks))
        shard = Shard(u, v, n, np.repeat(np.arange(len(u)), successors), w, n3)
        del u, v, n, successors, w, n3
        rows = []
        for x, a in zip(asked, asks):
            count, left, seen = shard.ask(a[0], a[1], a[3], a[4])
            rows.append((x["block"], PAIR_ANSWERS, x["part"], x["block"], packed(planes(count), left, seen)))
        first, total, number = shard.sums
        group = first % groups
        order = np.argsort(group, kind="stable")
        for g, s in parts(group[order]):
            at = order[s]
            rows.append((g, SUMS, g, asked[0]["part"], packed(planes(np.diff(first[at] // groups, prepend=0)), planes(total[at]), planes(number[at]))))
        return _rows(rows)

    def leave(got: pa.Table) -> pa.Table:
        asked = _of(got, WORDS)
        if not asked:
            return _rows([])
        group = asked[0]["part"]
        v = Vocabulary([unpacked(x["body"]) for x in asked], group, groups)
        total, number = np.zeros(len(v.id), np.int64), np.zeros(len(v.id), np.int64)
        for x in _of(got, SUMS):
            place, t, n = map(numbers, unpacked(x["body"]))
            at = v.by_count[np.cumsum(place)]
            total[at] += t
            number[at] += n
        left = code(np.maximum(1 - (total - DISCOUNT * number) / np.maximum(1, v.count), 1e-9))
        return _rows([(x["block"], LEFT, group, x["block"], packed(left[at])) for x, at in zip(asked, v.asked)])

    first = table(slim.mapInArrow(blocks, ROWS), "blocks")
    texts, requests = first.where(F.col("kind") == TEXTS), first.where(F.col("kind") == WORDS)
    vocabulary = table(requests.groupBy("to").applyInArrow(words, f"{ROWS}, tokens long, words long"), "words")
    seen, different = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    _freed(docs)
    known = vocabulary.select(NAMES)
    answers = table(texts.unionByName(known).groupBy("to").applyInArrow(ask, ROWS).groupBy("to").applyInArrow(pairs, ROWS), "pairs")
    _freed(docs)
    left = table(requests.unionByName(answers.where(F.col("kind") == SUMS)).groupBy("to").applyInArrow(leave, ROWS), "left")
    _freed(docs)
    scale = seen + 0.1 * (different + 1)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in slim.dtypes[: len(safe)]), "n_tokens long, n_known long, base_score double, score double"])

    def finish(got: pa.Table) -> pa.Table:
        (body,) = (x["body"] for x in _of(got, TEXTS))
        rows, bounds, _, word = _opened(body)
        answered = [unpacked(x["body"]) for x in _of(got, WORD_ANSWERS)]
        count, ids = told(answered, 0), told(answered, 1) - 1
        left2 = chance(np.concatenate([np.zeros(0, np.uint8), *(unpacked(x["body"])[0] for x in _of(got, LEFT))]))
        g = Grams(word, bounds, ids, shards)
        answered = [unpacked(x["body"]) for x in _of(got, PAIR_ANSWERS)]
        count2 = told(answered, 0)
        left3, seen3 = (chance(np.concatenate([np.zeros(0, np.uint8), *(a[k] for a in answered)])) for k in (1, 2))
        p1 = ((count + 0.1) / scale)[word]
        p = p1.copy()
        begins = np.ones(len(word), bool)
        begins[bounds[:-1]] = False
        at = np.flatnonzero(begins)
        p[at] *= left2[word[at - 1]]
        at = np.flatnonzero(g.pair >= 0)
        n = count2[g.pair[at]]
        p[at] += np.where(n > 0, (n - DISCOUNT) / np.maximum(1, count[word[at - 1]]), 0)
        # behind a pair of the model, whatever follows
        behind = np.flatnonzero(begins[1:] & (g.pair[:-1] >= 0)) + 1
        context = g.pair[behind - 1]
        p[behind] *= np.where(count2[context] > 0, left3[context], 1)
        at = np.flatnonzero(g.triple >= 0)
        p[at] += seen3[g.triple[at]]
        sums = [np.add.reduceat(x, bounds[:-1]) for x in ((count > 0).astype(np.int64)[word], np.log10(p1), np.log10(p))]
        return pa.table([*(rows[c] for c in safe), pa.array(np.diff(bounds)), *map(pa.array, sums)], names=[*safe, *new])

    rows = texts.unionByName(known).unionByName(answers.where(F.col("kind") == PAIR_ANSWERS)).unionByName(left)
    return rows.groupBy("to").applyInArrow(finish, schema).toDF(*keep, *new).withColumn("train_tokens", F.lit(seen).cast("long"))
