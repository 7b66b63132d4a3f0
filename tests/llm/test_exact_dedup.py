import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import ODD, empty, odd, prose
from marlstone.llm import exact_dedup as m


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_odd_rows_against_brute_force(spark):
    got = m.exact_dedup(odd(spark)).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(norm(t), []).append(i)
    expected = sorted(((i, hashlib.sha256(norm(t).encode()).hexdigest(), len(groups[norm(t)])) for i, t in ODD), key=str)
    assert sorted(((r.doc_id, r.text_sha256, r.group_size) for r in got), key=str) == expected
    assert sum(r.kept for r in got) == len(groups)  # one of each group, even of repeated rows and ids
    for r in got:
        ids = [i for i in groups[next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)] if i is not None]
        assert r.keep_id == (min(ids) if ids else None)


def cut(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", m.chunks(F.col("t")).alias("c")).collect()
    return [r.c for r in sorted(rows)]


def test_chunks_are_the_text(spark):
    texts = [norm(t) for _, t in ODD]
    for text, parts in zip(texts, cut(spark, texts)):
        assert "".join(parts).encode("latin-1") == text.encode() and all(0 < len(p) <= m.MOST for p in parts)


ALPHABETS = ["abcdefghijklmnopqrstuvwxyz ", "0123456789", "01", "ACGT", "0123456789abcdef", "".join(map(chr, range(0x4E00, 0x5E00))), "".join(map(chr, range(0xAC00, 0xB400))), "".join(map(chr, range(0x410, 0x450))), "".join(map(chr, range(33, 127)))]


@pytest.mark.parametrize("k", range(len(ALPHABETS)))
def test_an_insertion_changes_few_chunks_in_any_script(spark, k):
    rng = random.Random(k)
    text = "".join(rng.choice(ALPHABETS[k]) for _ in range(100_000))
    at = 30_000
    one, other = cut(spark, [text, text[:at] + ALPHABETS[k][0] * 3 + text[at:]])
    assert len(one) > 40 and len(set(other) - set(one)) <= 8


def test_chunks_that_share_an_identifier_are_told_apart(spark):
    rows = [(1, prose(1, 900)), (2, prose(2, 900)), (3, prose(2, 900)), (4, None), (5, prose(3, 5)), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in (lambda c: F.lit(b"7"), lambda c: F.unhex(F.lpad((F.length(c) % 3).cast("string"), 2, "0"))):
        assert not m.collisions(docs, "text", name).isEmpty()
        assert sorted((r.doc_id, r.keep_id, r.kept) for r in m.exact_dedup(docs, name=name).collect()) == [(1, 1, True), (2, 2, True), (3, 2, False), (4, 4, True), (5, 5, True), (6, 4, False)]
    assert m.collisions(docs, "text", m.identifier).isEmpty()


def test_empty(spark):
    assert m.exact_dedup(empty(spark)).count() == 0
