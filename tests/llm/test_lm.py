import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from helpers import BLANK, ODD, TRANSLATE, empty, odd, thue_morse
from marlstone.llm import lm as m
from marlstone.llm.queries import op10_language_model


def tokens(text):
    return [*BLANK.findall((text or "").translate(TRANSLATE)), None]


class Plain:
    """The same model by dictionaries, unquantised."""

    def __init__(self, texts, share):
        ws = [tokens(t) for t in texts]
        self.c1, c2, c3 = Counter(), Counter(), Counter()
        for w in ws:
            self.c1.update(w)
            c2.update(zip(w, w[1:]))
            c3.update(zip(w, w[1:], w[2:]))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.least = max(2, math.ceil(share * self.n))
        self.c2, self.c3 = ({k: n for k, n in c.items() if n >= self.least} for c in (c2, c3))
        self.left2, self.left3 = Counter(), Counter()
        for (a, b), n in self.c2.items():
            self.left2[a] += (n - m.DISCOUNT) / self.c1[a]
        for (a, b, c), n in self.c3.items():
            self.left3[a, b] += (n - m.DISCOUNT) / self.c2[a, b]

    def p(self, *w):
        if len(w) == 1:
            return (self.c1[w[0]] + 0.1) / (self.n + 0.1 * (self.v + 1))
        if len(w) == 2:
            if self.c1[w[0]] < self.least:
                return self.p(w[1])
            return ((self.c2[w] - m.DISCOUNT) / self.c1[w[0]] if w in self.c2 else 0) + (1 - self.left2[w[0]]) * self.p(w[1])
        if w[:2] not in self.c2:
            return self.p(*w[1:])
        return ((self.c3[w] - m.DISCOUNT) / self.c2[w[:2]] if w in self.c3 else 0) + (1 - self.left3[w[:2]]) * self.p(*w[1:])

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(*w[max(0, k - 2) : k + 1])) for k in range(len(w)))


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    plain = Plain([t for i, t in docs.items() if i not in held], 0)
    got = op10_language_model(spark, SMALL).collect()
    assert len(got) == len(docs)
    gain = 0
    for r in got:
        w = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(w), sum(plain.c1[x] > 0 for x in w), plain.n)
        assert r.base_score == pytest.approx(sum(math.log10(plain.p(x)) for x in w))
        assert abs(r.score - plain.score(docs[r.doc_id])) < 0.03 * len(w)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0  # the model is better than its base on what it hasn't seen


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 10**9), (50, 60), (2000, 10**7), (2000, 500), (300, 2**40)):
        values = np.sort(rng.integers(0, top, n))
        ef = m.EliasFano.encode(values)
        assert (ef.access(np.arange(n)) == values).all()
        x = np.concatenate([values, rng.integers(0, top + 5, 500)])
        assert (ef.successor(x) == np.searchsorted(values, x)).all()
    assert m.EliasFano.encode(np.zeros(0, np.int64)).successor(np.array([3])).tolist() == [0]


def test_levels_find_what_they_hold():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 300 * 300, 5000))
    context, word = pairs // 300, pairs % 300
    level = m.Level.encode(context, word, 300)
    ask = rng.integers(0, 300 * 300, 20_000)
    place = {p: k for k, p in enumerate(pairs.tolist())}
    assert level.find(ask // 300, ask % 300).tolist() == [place.get(x, -1) for x in ask.tolist()]


def test_a_shard_against_dictionaries():
    """Pairs and triples that repeat over requests; the chances of all words after a pair add up to 1."""
    rng = np.random.default_rng(6)
    for top in (40, 1 << 40):  # small numbers, and larger ones than fit side by side
        ids = np.unique(rng.integers(0, top, 40))
        u, v = ids[rng.integers(0, len(ids), 3000)], ids[rng.integers(0, 6, 3000)]
        n = rng.integers(0, 2, 3000) * 60
        context = rng.integers(0, 3000, 6000)
        w, n3 = ids[rng.integers(0, 6, 6000)], rng.integers(0, 2, 6000)
        c2, c3 = Counter(), Counter()
        for a, b, c in zip(u.tolist(), v.tolist(), n.tolist()):
            c2[a, b] += c
        for k, x, c in zip(context.tolist(), w.tolist(), n3.tolist()):
            c3[u[k], v[k], x] += c
        shard = m.Shard(u, v, n, context, w, n3)
        kept2 = {k: c for k, c in c2.items() if c >= m.LEAST}
        asked = sorted({*c2, (ids[0], top + 5), (top + 5, ids[0])})
        x = [(k, int(y)) for k in asked for y in ids[:6]]
        count, left, seen = shard.ask(np.array([a for a, _ in asked]), np.array([b for _, b in asked]), np.full(len(asked), 6), np.array([y for _, y in x]))
        assert count.tolist() == [kept2.get(k, 0) for k in asked]
        for (k, y), s in zip(x, seen):
            c = c3[*k, y] if k in kept2 else 0
            assert (s == m.NONE) if c < m.LEAST else abs(math.log10((c - m.DISCOUNT) / c2[k]) + s * m.STEP) <= m.STEP / 2 + 1e-9
        first, total, number = shard.sums
        assert dict(zip(first.tolist(), zip(total.tolist(), number.tolist()))) == {a: (sum(c for k, c in kept2.items() if k[0] == a), sum(k[0] == a for k in kept2)) for a in {k[0] for k in kept2}}
        for k, l, s in zip(asked, left, seen.reshape(-1, 6)):
            if k in kept2:
                plain = sum((c3[*k, int(y)] - m.DISCOUNT) / c2[k] for y in ids[:6] if c3[*k, int(y)] >= m.LEAST)
                assert m.chance(np.array([l]))[0] == pytest.approx(max(1 - plain, 1e-9), rel=0.05)


def test_planes():
    for x in (np.array([0, 5, 255, 256, 1 << 40]), np.zeros(0, np.int64), np.zeros(3, np.int64)):
        assert m.numbers(m.planes(x)).tolist() == x.tolist()


def test_words_that_agree_in_a_polynomial_are_different(spark):
    one, other = thue_morse()
    docs = spark.createDataFrame([(1, one, True), (2, other, False)], "doc_id long, text string, seen boolean")
    got = {r.doc_id: (r.n_known, r.base_score) for r in m.corpus_scores(docs, "seen").collect()}
    scale = 2 + 0.1 * 3
    assert got[1] == (2, pytest.approx(2 * math.log10(1.1 / scale))) and got[2] == (1, pytest.approx(math.log10(0.1 / scale) + math.log10(1.1 / scale)))


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    held = [(pa.RecordBatch.from_pydict({"c0": [1]}), m.Words(*(lambda b: (np.frombuffer(b, np.uint8), np.array([0, len(b)])))(b"one two one three"), m.BLANK), np.array([True]))]
    held[0][1].hash[:] = 7
    rows = m._block(held, 1)
    _, bounds, _, word = m._opened(rows[0][4])
    assert bounds.tolist() == [0, 5] and len(set(word.tolist())) == 4 and word[0] == word[2]


@pytest.mark.parametrize("size", [m.SHARD_BYTES, 40_000])
def test_corpus_scores(spark, size):
    docs = odd(spark).withColumn("seen", F.expr("doc_id < 7"))
    plain = Plain([t for i, t in ODD if i is not None and i < 7], 0)
    got = m.corpus_scores(docs, "seen", block_bytes=size, shard_bytes=size, word_bytes=size).select("doc_id", "n_tokens", "n_known", "base_score", "score", "train_tokens").collect()
    expected = [(i, len(tokens(t)), sum(plain.c1[x] > 0 for x in tokens(t)), sum(math.log10(plain.p(x)) for x in tokens(t)), plain.score(t)) for i, t in ODD]
    key = lambda r: (str(r[0]), r[1], round(r[3], 3))
    for r, e in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert r[:3] == e[:3] and r[3] == pytest.approx(e[3]) and abs(r[4] - e[4]) < 0.02 * e[1] and r[5] == plain.n
    assert m.corpus_scores(empty(spark).withColumn("seen", F.lit(True)), "seen").count() == 0
    lone = m.corpus_scores(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, seen boolean"), "seen").first()
    assert (lone.n_tokens, lone.n_known, lone.train_tokens) == (3, 0, 0) and lone.score == pytest.approx(lone.base_score)


def test_what_stands_twice_counts_at_every_size(spark, tmp_path):
    """Beside 1.2 million tokens a passage that stands twice is still known (its share is less than 2e-6)."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    passage = " ".join(f"rare{k}" for k in range(30))
    filler = [(k, " ".join(f"w{(k * 7919 + j * j) % 3001}" for j in range(3000))) for k in range(500)]
    free = range(500, 600)
    twice = [i for i in free if not held(i)][:2] + [i for i in free if held(i)][:1]
    rows = filler + [(i, passage) for i in twice]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    plain = Plain([t for i, t in rows if not held(i)], 0)
    assert plain.c1["rare1"] == 2 < 2e-6 * plain.n
    got = op10_language_model(spark, path).where("doc_id >= 500").collect()
    assert len(got) == 3 and all(abs(r.score - plain.score(passage)) < 0.02 * r.n_tokens for r in got)
