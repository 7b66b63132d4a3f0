import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from helpers import ODD, empty, odd, prose, thue_morse
from marlstone.llm import substrings as m


def brute(docs, length, keep_first=False):
    data = [(i, (t or "").encode()) for i, t in docs]
    count, first = Counter(), {}
    for d in sorted(range(len(data)), key=lambda d: (data[d][0] is None, data[d][0] or 0)):
        b = data[d][1]
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] += 1
            first.setdefault(b[k : k + length], (d, k))
    out = []
    for d, (i, b) in enumerate(data):
        gone = bytearray(len(b))
        last = 0
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if count[w] > 1 and not (keep_first and first[w] == (d, k)):
                gone[max(k, last) : k + length] = b"\1" * (k + length - max(k, last))
                last = k + length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def passages():
    rng = random.Random(8)
    shared = [prose(300 + i, rng.randrange(10, 40)) for i in range(6)]
    docs = []
    for i in range(60):
        parts = [prose(400 + i, rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), prose(rng.randrange(10**6), rng.randrange(0, 9))]
        docs.append((i, " ".join(parts)))
    return docs + [(100, "ab" * 700), (101, "x" * 500), (102, "xab" * 100), (103, "ü" * 150), (104, "ü" * 99), (105, "a" * 199)]


@pytest.mark.parametrize("crowd", [m.CROWD, 1])
def test_odd_rows(spark, crowd):
    short = [(i, t) for i, t in ODD if t is None or len(t) < 10_000] + [(7, ODD[11][1][:30_000]), (8, ODD[11][1][:30_000] + " more")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in short], "doc_id long, text string, key string, begin int")
    assert rows(m.repeats(docs, crowd=crowd)) == brute(short, 200)


@pytest.mark.parametrize("crowd", [m.CROWD, 1])
def test_passages(spark, crowd):
    docs = passages()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(m.repeats(table, crowd=crowd)) == brute(docs, 200)
    assert rows(m.repeats(table, length=60, gram=20, crowd=crowd)) == brute(docs, 60)
    assert rows(m.repeats(table, crowd=crowd, keep_first=True)) == brute(docs, 200, True)


def test_long_texts_in_pieces(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range((1 << 20) + 5000))
    docs = [(1, text), (2, "zz" + text[(1 << 20) - 300 : (1 << 20) + 300] + "yy")]
    got = {r.doc_id: r for r in m.repeats(spark.createDataFrame(docs, "doc_id long, text string"), kept=True).collect()}
    assert got[1].n_removed == 600 and got[2].n_removed == 600 and bytes(got[2].kept) == b"zzyy"
    assert [(s.begin, s.end) for s in got[1].spans] == [((1 << 20) - 300, (1 << 20) + 300)]


def test_suffix_order_and_previous_factors():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    for length in (3, 4, 7, 8, 9, 16, 20, 25):
        starts = np.arange(len(data) - length + 1)
        texts = [data[s : s + length].tobytes() for s in starts]
        order, rank = m.Suffixes(data, length).order(starts)
        assert [texts[k] for k in order] == sorted(texts)
        factor, later = m.previous_factors(data, starts, length)
        common = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
        assert factor.tolist() == [max((common(t, x) for x in texts[:k]), default=0) for k, t in enumerate(texts)]
        assert later.tolist() == [t in texts[k + 1 :] for k, t in enumerate(texts)]


def test_previous_smaller():
    rng = np.random.default_rng(5)
    for x in (rng.permutation(300), np.arange(300), np.arange(300)[::-1]):
        assert m.smaller(x).tolist() == [max((j for j in range(k) if x[j] < x[k]), default=-1) for k in range(len(x))]


@pytest.mark.parametrize("crowd", [m.CROWD, 1])
def test_stretches_that_agree_in_a_polynomial_are_different(spark, crowd):
    """Alternating patterns, whose difference any hash by powers of an odd base modulo 2^64 misses."""
    docs = [(k, "shared head of both texts, " * 5 + w) for k, w in enumerate(thue_morse())]
    assert rows(m.repeats(spark.createDataFrame(docs, "doc_id long, text string"), crowd=crowd)) == brute(docs, 200)


def test_empty(spark):
    assert m.repeats(empty(spark)).count() == 0
    assert m.repeats(odd(spark).where("doc_id = 6")).count() == 3
