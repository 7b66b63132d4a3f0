import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from helpers import ODD, empty, odd
from marlstone.llm import language as m
from marlstone.llm.queries import op9_language


def test_held_out_accuracy(spark):
    path = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = op9_language(spark, path).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def grams(text):
    """How often each dimension's n-grams occur."""
    data = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").encode().lower())
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(data) - n + 1):
            out[(int.from_bytes(bytes([n]) + data[k : k + n].replace(b" ", b"\0"), "big") * 0x9E3779B97F4A7C15 % 2**64) >> 52] += 1
    return out


def test_query_against_brute_force(spark):
    """Vectors by dictionaries and k-means by plain loops, over a corpus that is its own sample."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    held = {r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    known = [(grams(r.text), r.text, r.lang) for r in docs if r.doc_id not in held and r.lang is not None and r.text is not None]
    df = Counter(k for g, _, _ in known for k in g)
    idf = [math.log((1 + len(known)) / (1 + df[k])) + 0.1 for k in range(m.DIMENSIONS)]

    def vector(g):
        v = np.zeros(m.DIMENSIONS)
        for k, n in g.items():
            v[k] = math.log1p(n) * idf[k]
        return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)

    model = []
    for lang in sorted({x for _, _, x in known}):
        texts = {t: g for g, t, x in known if x == lang}
        rows = sorted((vector(g) for g in texts.values() if g), key=lambda v: v.tobytes())
        centres = [rows[0]]
        while len(centres) < min(m.CENTROIDS, len(rows)):
            centres.append(min(rows, key=lambda v: max(float(v @ c) for c in centres)))
        for _ in range(15):
            own = [max(range(len(centres)), key=lambda j: float(v @ centres[j])) for v in rows]
            sums = [sum((v for v, o in zip(rows, own) if o == j), np.zeros(m.DIMENSIONS, np.float32)) if j in own else centres[j] for j in range(len(centres))]
            centres = [s / max(float(np.linalg.norm(s)), 1e-12) for s in sums]
        model += [(lang, c) for c in centres]
    got = op9_language(spark, SMALL).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in docs}
    for r in got:
        text = by_id[r.doc_id].text
        near = sorted(((float(vector(grams(text)) @ c), lang) for lang, c in model), reverse=True)
        letters = any(c.isalpha() for c in text or "")
        assert r.held_out == (r.doc_id in held) and r.score == pytest.approx(near[0][0] if letters else 0, abs=2e-3)
        assert r.lang_pred == (near[0][1] if letters else "und") or near[0][0] - near[1][0] < 2e-3


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(m, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        m.fit(spark.createDataFrame([(k, "abc", f"l{k}") for k in range(3)], "doc_id long, text string, lang string"))


def test_folds(spark):
    got = spark.range(50).select("id", m.fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_odd_rows(spark):
    known = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the one and the other of them", "en"), ("der die das und nicht ein", "de"), ("12 34", "en"), (None, "fr"), ("le la les", None)])], "doc_id long, text string, lang string")
    model = m.fit(known)
    got = m.identify(odd(spark, "lang"), model).collect()
    assert len(got) == len(ODD)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and r.lang_pred in ("und", "en", "de") and 0 <= r.score <= 1
        assert letters or (r.score == 0 and r.rejected)


def test_fitting_stands_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names of its own."""
    docs = odd(spark, "lang", "v", "place").withColumn("lang", F.when(F.length("text") > 1000, "long").when(F.col("doc_id") < 5, "few"))
    one, other = m.fit(docs.unionByName(docs)), m.fit(docs)
    assert one.names == ["few", "long"] and np.allclose(one.centres, other.centres, atol=0.05)
    got = m.identify(docs, one).collect()
    assert {r.lang_pred for r in got if r.text and len(r.text) > 1000} == {"long"}
    assert m.fit(docs.where("text is null or text = ''").withColumn("lang", F.lit("x"))) is None


def test_only_the_text_counts(spark):
    model = m.fit(spark.createDataFrame([(1, "aaa bbb", "x"), (2, "ccc ddd", "y")], "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(1, "ccc", "x"), (9, "ccc", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in m.identify(rows, model).collect()} == {"y"}


def test_nothing_learned(spark):
    assert m.fit(empty(spark)) is None
    assert {r.lang_pred for r in m.identify(odd(spark), None).collect()} == {"und"}
    assert m.identify(empty(spark), None).count() == 0


def test_a_repeated_row_leaves_the_other_languages_their_sample(spark):
    cut = int((5 << 30) / 3000) + 1
    hot = spark.range(100_000).where(F.pmod(F.xxhash64("id", F.lit("aaa bbb")), F.lit(1 << 30)) < cut).first().id  # a row that is in the sample
    rows = [(hot, "aaa bbb", "a")] * 3000 + [(k, f"zzz yyy {'xyz'[k % 3] * 3}", "z") for k in range(5)]
    model = m.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=5)
    assert set(model.names) == {"a", "z"}
