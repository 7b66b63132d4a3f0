import itertools
import random
from collections import Counter, defaultdict

from helpers import BLANK, ODD, empty, odd
from marlstone.llm import packing as m


def padding(histogram, tops):
    return sum(n * (min(t for t in tops if t >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        histogram = {x: rng.randrange(1, 9) for x in rng.sample(range(1, 40), rng.randrange(1, 9))}
        k = rng.randrange(1, 5)
        tops = m.boundaries(histogram, k)
        best = min(padding(histogram, [*c, max(histogram)]) for r in range(k) for c in itertools.combinations(sorted(histogram)[:-1], r))
        assert padding(histogram, tops) == best and len(tops) <= k and tops[-1] == max(histogram)
    assert m.boundaries({}, 3) == []


def test_odd_rows(spark):
    got = m.pack(odd(spark), max_length=256, buckets=4, budget=1024, shard=20).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
        assert r.first_token == r.piece * 256 and 1 <= r.n_tokens <= r.bucket_length <= 256 and r.padding == r.bucket_length - r.n_tokens
    expected = Counter()
    for i, t in ODD:
        expected[i] += len(BLANK.findall(t or "")) + 1
    assert total == expected
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), rows in batches.items():
        most = max(1, 1024 // rows[0].bucket_length)
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) <= most
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(rows) == most  # only a bucket's last batch isn't full


def test_empty(spark):
    assert m.pack(empty(spark)).count() == 0
