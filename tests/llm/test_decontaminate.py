import hashlib

import numpy as np

from helpers import ODD, empty, odd, prose, thue_morse, words
from marlstone.llm import decontaminate as m


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, prose(2, 25)), (1, prose(2, 25)), (12, "word"), (3, None), (4, ""), (None, prose(4, 12)), (2, "Nothing of this stands anywhere in the documents at all, twice"), (5, LONG_PART := " ".join(prose(1, 60_000).split()[41_000:41_030]))]


def test_odd_rows_against_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (m.BLOCK_BYTES, 200):  # broadcast, and joined
        found = m.decontaminate(odd(spark), items, block_bytes=size)
        got = m.digest(found).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(ODD, ITEMS)


def test_removal(spark):
    text = prose(5, 20) + " " + prose(6, 30) + " tail, kept"
    docs = spark.createDataFrame([(1, text, "a"), (2, "clean text", None), (3, None, "b")], "doc_id long, text string, lang string")
    found = m.decontaminate(docs, spark.createDataFrame([(9, prose(6, 30))], "item_id long, text string"))
    assert [r.doc_id for r in m.without_documents(found).orderBy("doc_id").collect()] == [2, 3]
    assert m.without_documents(found).columns == docs.columns
    left = {r.doc_id: r.text for r in m.without_spans(found).collect()}
    assert left[2] == "clean text" and left[3] is None
    assert left[1] == prose(5, 20) + " . tail, kept"


def test_empty(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert m.digest(m.decontaminate(empty(spark), items)).count() == 0
    assert {r.contaminated for r in m.digest(m.decontaminate(odd(spark), items)).collect()} == {False}


def test_the_set_takes_a_small_multiple_of_its_text():
    items = [(str(k), " ".join(f"w{(k * 7919 + j * j) % 300_007}" for j in range(1000))) for k in range(300)]
    size = sum(len(t) for _, t in items)
    assert m.Benchmark(items, 10).nbytes() < 6 * size


def test_long_words_that_agree_in_a_polynomial_differ():
    """Two words of 1,024 letters that any hash by powers of an odd base modulo 2^64 takes for one."""
    one, other = thue_morse()
    bench = m.Benchmark([("1", one)], 10)
    for text, n in ((one, 1), (other, 0)):
        buf = np.frombuffer(text.encode(), np.uint8)
        assert len(bench.hits(m.Words(buf, np.array([0, len(buf)])))[0]) == n


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(m, "chained", lambda h, at, size: size.astype(np.uint64))
    monkeypatch.setattr(m.Words, "windows", lambda self, n: (self.places(n)[0], np.full(len(self.places(n)[0]), n, np.uint64)))
    bench = m.Benchmark([("1", prose(3, 12)), ("2", prose(4, 12)), ("3", prose(3, 11))], 10)
    buf = np.frombuffer(prose(3, 40).encode(), np.uint8)
    begin, _, window = bench.hits(m.Words(buf, np.array([0, len(buf)])))
    assert begin.tolist() == list(range(len(words(prose(3, 12))) - 9)) and bench.named(window) == ["1", "3"]
