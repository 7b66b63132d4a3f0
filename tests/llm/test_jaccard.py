import random
from collections import defaultdict

import numpy as np
import pytest

from helpers import ODD, empty, odd, prose, thue_morse, words
from marlstone.llm import jaccard as m


def brute(docs, n=5, threshold=0.8):
    """One row per document: id, class, copies, links, linked documents, group."""
    classes = defaultdict(list)
    for p, (i, t) in enumerate(docs):
        w = words(t)
        s = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])
        classes[s or ("none", p)].append(i)
    rank = lambda i: (i is None, i or 0)
    sets = list(classes)
    least = [min(classes[s], key=rank) for s in sets]
    links = defaultdict(list)
    for a in range(len(sets)):
        for b in range(a):
            if isinstance(sets[a], frozenset) and isinstance(sets[b], frozenset):
                common = len(sets[a] & sets[b])
                if common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                    links[a].append(b)
                    links[b].append(a)
    out = []
    for a, s in enumerate(sets):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        group = min((least[b] for b in seen), key=rank)
        out += [(i, least[a], len(classes[s]), len(links[a]), sum(len(classes[sets[b]]) for b in links[a]), group) for i in classes[s]]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.class_id, r.n_copies, r.n_links, r.n_linked_docs, r.group_id) for r in df.collect()), key=str)


def near(spark):
    rng = random.Random(4)
    docs = [(i, prose(100 + i, rng.randrange(1, 60))) for i in range(60)]
    for base in range(8):  # groups of near copies, one of them large
        w = prose(200 + base, 150).split()
        for _ in range(130 if base == 0 else 6):
            own = list(w)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
            docs.append((len(docs) + 1000, " ".join(own)))
    return docs + docs[:5]


def test_odd_rows(spark):
    assert rows(m.jaccard_join(odd(spark))) == brute(ODD)


@pytest.mark.parametrize("small", ["no", "blocks", "parts"])
def test_near_copies(spark, monkeypatch, small):
    if small != "no":  # every bucket is large and every cluster in blocks
        monkeypatch.setattr(m, "BLOCK", 16)
        monkeypatch.setattr(m, "BUCKET", 2)
    if small == "parts":  # hot buckets are dealt to several tasks
        monkeypatch.setattr(m, "HOT", 12)
        monkeypatch.setattr(m, "SHARE", 1)
    docs = near(spark)
    got = m.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(got) == brute(docs)
    assert got.where("kept").count() == got.select("group_id").distinct().count()


def test_pruning_follows_the_posterior():
    least = m.least_matches(0.8, 1e-6, 64)
    assert least[32] < 0.9 * 32 and (np.diff(least) >= 0).all()
    grid = (np.arange(4000) + 0.5) / 4000
    for n in (32, 64):
        for k, keep in ((least[n], True), (least[n] - 1, False)):
            like = ((1 + grid) / 2) ** k * ((1 - grid) / 2) ** (n - k)
            assert (like[grid >= 0.8].sum() / like.sum() >= 1e-6) == keep


def test_empty(spark):
    assert m.jaccard_join(empty(spark)).count() == 0


def test_components_go_on_until_nothing_changes(spark, monkeypatch):
    """A chain needs many rounds; with and without settled steps."""
    from marlstone.llm import common

    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(None, 1), (2, None), (40, 40)], "a long, b long")
    for settled in (0, 1000):
        monkeypatch.setattr(common, "SETTLED", settled)
        assert {tuple(r) for r in common.components(edges).collect()} == {(k, 0) for k in range(31)}


def test_words_that_agree_in_a_polynomial_are_different(spark):
    rest = " ".join(f"w{k}" for k in range(4))
    docs = [(k, f"{w} {rest}") for k, w in enumerate(thue_morse())]
    assert rows(m.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_shingles_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(m, "chained", lambda values, at, size, seed=0: values[at] % np.uint64(3))
    texts = [prose(k, 30) for k in (1, 2, 1)]
    ids, bounds = m.numbered([t.encode() for t in texts], 5)
    sets = [frozenset(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    plain = [{tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain] and sets[0] == sets[2]
    assert len(sets[0] & sets[1]) == len(plain[0] & plain[1])


def test_recall_with_more_unlike_classes_in_a_bucket_than_leaders(monkeypatch):
    """Pairs of similarity 0.82 or more in one bucket of 3,000 unlike classes, 64 leaders a round."""
    monkeypatch.setattr(m, "LEADERS", 64)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, (1500, 200), dtype=np.uint64)
    twin = base.copy()
    twin[:, :18] = rng.integers(0, 2**63, (1500, 18), dtype=np.uint64)  # 182 of 218 shingles are common
    sets = np.sort(np.concatenate([base, twin]), 1)
    sketch = m.sketches(sets.ravel(), np.arange(len(sets)) * 200)[1]
    keys, rounds = np.arange(len(sets)), 0
    tied: dict[int, int] = {}

    def root(x):
        while tied.get(x, x) != x:
            x = tied[x]
        return x

    some = rng.permutation(keys)
    while len(some):
        left, leaders, rounds = [], m.Leaders(), rounds + 1
        for pairs, rest in leaders.add(some, sketch[some]):
            for a, b in pairs.tolist():
                tied[root(a)] = root(b)
            left += some[rest].tolist()
        assert len(left) < len(some)
        some = np.array(left, np.int64)
    assert rounds > 10
    assert np.mean([root(k) == root(k + 1500) for k in range(1500)]) > 0.995
