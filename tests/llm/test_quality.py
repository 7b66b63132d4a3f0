import math
from collections import Counter

import numpy as np
import pytest

from conftest import SMALL
from helpers import BLANK, ODD, TRANSLATE, empty, odd
from marlstone.llm import quality as m
from marlstone.llm.queries import op4_quality


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.where(rng.random((20_000, 4)) < accuracy, truth[:, None], ~truth[:, None]).astype(np.int8)
    votes[rng.random(votes.shape) < 0.3] = m.NONE
    patterns, counts = np.unique(m.pattern(votes), return_counts=True)
    model = m.expectation_maximisation(patterns, counts.astype(float), 4)
    good = model.posterior(m.pattern(votes)) > 0.5
    assert (good == truth).mean() > 0.93 and abs(model.share[1] - 0.7) < 0.05
    assert np.abs(np.array(list(model.accuracies().values())) - accuracy).max() < 0.06


def test_it_tells_junk_from_prose(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = m.classify(docs).join(labels, "doc_id").select("accepted", "quality").collect()
    good = [r.accepted for r in rows if r.quality]
    bad = [r.accepted for r in rows if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_odd_rows(spark):
    got = m.classify(odd(spark)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and 0 <= r.p_weak <= 1 and len(r.votes) == len(m.LABELLERS) for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add((r.votes, r.score))
    assert all(len(v) == 1 for v in by_text.values())  # equal texts are judged alike


def test_empty(spark):
    assert m.classify(empty(spark)).count() == 0


def plain_votes(text):
    """The ten labellers, a word and a byte at a time."""
    data = (text or "").encode()
    words = [x.encode() for x in BLANK.findall(text or "")]
    low = [x.translate(TRANSLATE) for x in BLANK.findall(text or "")]
    n, seen = max(1, len(words)), max(1, sum(map(len, words)))
    letter = lambda b: 65 <= b < 91 or 97 <= b < 123 or b >= 128
    symbol = lambda b: b in b"#$%&*+/<=>@[\\]^_`{|}~!"
    letters = sum(map(letter, data))
    symbols, capitals = sum(map(symbol, data)) / seen, sum(65 <= b < 91 for b in data) / max(1, letters)
    repeats = sum(a == b for a, b in zip(low, low[1:])) / n
    stops = sum(x[-1] in b".!?" for x in words) / n
    length, w = seen / n, len(words)
    pairs = len(set(zip(low, low[1:]))) / max(1, w - 1)
    marks = sum(not any(letter(b) or 48 <= b < 58 for b in x) for x in words) / n
    endings = sum(symbol(x[-1]) for x in words) / n
    say = lambda bad, good: 0 if bad else 1 if good else 2
    return (
        say(symbols > 0.06, symbols < 0.02), say(capitals > 0.4 and w > 5, capitals < 0.2), say(repeats > 0.12 and w > 5, repeats < 0.03),
        say(pairs < 0.4 and w > 20, pairs > 0.75 and w > 5), say(stops < 0.01 and w > 60 or stops > 0.6 and w > 10, 0.015 < stops < 0.4),
        say(length > 14 or length < 2.5, 3.5 < length < 10), say(w < 1, w >= 20), say(letters / seen < 0.6, letters / seen > 0.85),
        say(marks > 0.08 and w > 5, marks < 0.01), say(endings > 0.1 and w > 5, endings < 0.02),
    )


def plain_features(text):
    """Weights by dimension, of length 1."""
    kind = lambda b: ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b >= 128 else ord("0") if 48 <= b < 58 else b

    def hashed(shape):
        h = (sum(int(m.BYTE_VALUES[b]) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, b in enumerate(shape)) + len(shape)) % 2**64
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
        return h ^ (h >> 31)

    words = BLANK.findall(text or "")
    shapes = [[k for i, k in enumerate(x) if not i or x[i - 1] != k] for x in (list(map(kind, w.encode())) for w in words)]
    h = list(map(hashed, shapes))
    low = [w.translate(TRANSLATE) for w in words]
    found = Counter(x % m.DIMENSIONS for x in [*h, *((a * 31 + b) % 2**64 for a, b in zip(h, h[1:])), *(7 for a, b in zip(low, low[1:]) if a == b)])
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in found.values()))
    return {k: math.log1p(c) / norm for k, c in found.items()}


def test_query_against_brute_force(spark):
    """Votes, posteriors of expectation-maximisation over single documents, and a dense scorer."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    votes = {i: plain_votes(t) for i, t in docs.items()}
    v = np.array(list(votes.values()))
    good = np.where((v == 0).any(1), 0.05, 0.95)
    for _ in range(100):
        share, chance = [], np.ones((2, 10, 3))
        for c, weight in ((0, 1 - good), (1, good)):
            share.append((weight.sum() + 1) / (len(v) + 2))
            for k in range(10):
                given = [weight[v[:, k] == x].sum() + 0.1 for x in (0, 1)]
                chance[c, k, :2] = given / np.sum(given)
        like = np.array([[share[c] * np.prod([chance[c, k, x] for k, x in enumerate(row)]) for c in (0, 1)] for row in v])
        new = like[:, 1] / like.sum(1)
        done = np.abs(new - good).max() < 1e-6
        good = new
        if done:
            break
    x = np.zeros((len(docs), m.DIMENSIONS + 1))
    for row, t in zip(x, docs.values()):
        for k, weight in plain_features(t).items():
            row[k] = weight
        row[-1] = 1
    w, step = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(200):
        step = 0.9 * step - 4.0 * (x.T @ (1 / (1 + np.exp(-x @ w)) - good) / len(x) + 1e-5 * w)
        w = w + step
    score = dict(zip(docs, 1 / (1 + np.exp(-x @ w))))
    weak = dict(zip(docs, good))
    got = op4_quality(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.votes == "".join(map(str, votes[r.doc_id])) and r.p_weak == pytest.approx(weak[r.doc_id], abs=1e-4)
        assert r.score == pytest.approx(score[r.doc_id], abs=1e-3) and r.accepted == (r.score >= 0.5)


def test_the_sample_is_bounded_and_the_same_each_time(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    monkeypatch.setattr(m, "FEATURES", 2000)
    one, other = ({r.doc_id: r.score for r in m.classify(d, sample=50).collect()} for d in (docs, docs.repartition(7)))
    assert one == pytest.approx(other)
