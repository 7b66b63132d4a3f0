import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import vectors
from marlstone.operators import aggregates, codecs, fusion, knn, scoring, sparse
from marlstone.operators.filters import Filter

RNG = np.random.default_rng(5)
X = RNG.normal(size=(300, 8)).astype(np.float32)
X[7] = 0
X[11] = X[12]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(X)], "id long, vector array<float>, g int").cache()


def plain(q, metric, keep=lambda i: True):
    unit = lambda v: v / n if (n := np.linalg.norm(v.astype(float))) else v
    d = {"l2": lambda a, b: ((a.astype(float) - b) ** 2).sum(), "ip": lambda a, b: -(a.astype(float) * b).sum(), "cosine": lambda a, b: max(0, 1 - (unit(a) * unit(b)).sum())}[metric]
    return sorted((d(x, q), i) for i, x in enumerate(X) if keep(i))


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_exact(table, metric):
    for f, keep in ((None, lambda i: True), (Filter.eq("g", 1), lambda i: i % 3 == 1)):
        got = knn.knn(table, X[3], 7, metric, flt=f).orderBy("rank").collect()
        want = plain(X[3], metric, keep)[:7]
        assert [r.id for r in got] == [i for _, i in want] and np.allclose([r.distance for r in got], [d for d, _ in want], atol=1e-5)
    assert knn.knn(table, X[3], 0, metric).count() == 0 and knn.knn(table, X[3], 999, metric).count() == 300
    assert knn.knn(table, np.zeros(8), 1, "cosine").first().distance == 1


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_batch_equals_single(spark, table, metric):
    q = spark.createDataFrame([(i, X[i].tolist()) for i in (0, 7, 11, 12, 40)], "query_id long, vector array<float>")
    for block in (knn.QUERY_BLOCK, 2):
        got = {}
        for r in knn.knn_join(q, table, 5, metric, block=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id))
        for i, rows in got.items():
            assert sorted(rows) == [(r.rank, r.id) for r in knn.knn(table, X[i], 5, metric).orderBy("rank").collect()]


def test_padding_and_errors(spark, table):
    q = spark.createDataFrame([(0, X[0].tolist())], "query_id long, vector array<float>")
    ids, d = knn.padded(knn.knn_join(q, table, 150, flt=Filter.eq("g", 1)), [0], 150)
    assert (ids[0] == 2**64 - 1).sum() == 50 and np.isinf(d[0, -1])
    for bad in ([], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            knn.knn(table, bad, 3)
    with pytest.raises(ValueError):
        knn.range_search(table, X[0], float("nan"))
    with pytest.raises(ValueError):
        vectors.distance(F.col("a"), F.col("b"), "hamming")


def test_by_id_range_among(table):
    assert [r.id for r in knn.knn_by_id(table, 11, 2).orderBy("rank").collect()][0] == 12
    assert knn.knn_by_id(table, 9999, 2) is None
    want = [i for d, i in plain(X[0], "l2") if d <= 9]
    assert [r.id for r in knn.range_search(table, X[0], 9).collect()] == want
    assert knn.range_search(table, X[0], 9, 2).count() == min(2, len(want))
    assert sorted(r.id for r in knn.among(table, [1, 1, 5, -3], X[0], 9).collect()) == [1, 5]


def test_lists(table, tmp_path):
    lists = knn.InvertedLists.train(table, 12, path=str(tmp_path / "lists"))
    exact = [r.id for r in knn.knn(table, X[0], 10).orderBy("rank").collect()]
    assert [r.id for r in lists.search(X[0], 10, 12).orderBy("rank").collect()] == exact
    assert lists.search(X[0], 200, 1).count() == 200  # it reads on until there are enough
    found = [len({r.id for r in lists.search(X[0], 10, p).collect()} & set(exact)) for p in (1, 4, 12)]
    assert found == sorted(found) and lists.sizes().agg(F.sum("n")).first()[0] == 300
    assert lists.list_of(5) in range(12) and lists.list_of(-1) is None


@pytest.mark.parametrize(("name", "least"), [("sq8", 0.99), ("f16", 0.999), ("bf16", 0.99), ("pq", 0.9), ("rabitq", 0.7), ("binary", 0.5)])
def test_codecs(table, name, least):
    model = codecs.train(table, name)
    back = np.array([r.decoded for r in codecs.decode(codecs.encode(table, model), model).orderBy("id").collect()])
    kept = np.linalg.norm(X - back) ** 2 / np.linalg.norm(X - X.mean(0)) ** 2
    assert 1 - kept > least - 0.2
    exact = {m: [r.id for r in knn.knn(table, X[0], 5, m).orderBy("rank").collect()] for m in ("l2", "ip", "cosine")}
    for m in exact:  # as many candidates as rows
        assert [r.id for r in codecs.coded_knn(codecs.encode(table, model), model, X[0], 5, m, factor=60).orderBy("rank").collect()] == exact[m]
    codes = model.encode(X)
    for m in exact:
        v = np.asarray(model.decode(codes), float)
        want = {"l2": ((v - X[0]) ** 2).sum(1), "ip": -(v @ X[0]), "cosine": 1 - v @ X[0] / np.maximum(1e-12, np.linalg.norm(v, axis=1) * np.linalg.norm(X[0]))}[m]
        assert np.abs(codecs.measured(model, codes, X[0], m) - want).max() < 0.02 * np.abs(want).max()
    copied = codecs.from_arrays(name, codecs.to_arrays(model))
    assert (copied.encode(X) == codes).all()
    assert codecs.error(table, model).first()[0] >= 0


def test_binary_codes_take_the_means_of_all_rows(spark, table, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from marlstone.plans.queries import QUERIES, SQL

    model = codecs.train(table, "binary", sample=50)
    assert np.allclose(model.mean, X.mean(0, dtype=float), atol=1e-12) and np.allclose(model.spread, np.abs(X - model.mean).mean(0), atol=1e-12)
    empty = spark.createDataFrame([(0, [None, 1.0]), (1, [None, 3.0]), (2, None)], "id long, vector array<float>")
    assert codecs.train(empty, "binary").encode(np.array([[np.nan, 1], [np.nan, 3]], np.float32)).tolist() == [[0], [2]]
    n = 100_400  # more than a sample
    x = np.random.default_rng(6).normal(size=n * 64).astype(np.float32)
    rows = pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(np.arange(0, n * 64 + 1, 64, np.int32), pa.array(x)), "label": np.zeros(n, np.int32)})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    got = QUERIES["binary_codes"](spark, str(tmp_path)).toArrow().sort_by("id").column("total").to_pylist()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet')")
        assert got == [total for _, total in con.execute(f"{SQL['binary_codes']} ORDER BY id").fetchall()]


def test_codec_rules():
    with pytest.raises(ValueError):
        codecs.Half.train(X).encode(np.array([[1e6]]))
    assert codecs.Half(True).decode(codecs.Half(True).encode(np.array([[1.0, -2.5]], np.float32))).tolist() == [[1.0, -2.5]]
    r = codecs.RotatedSigns.train(X)
    assert np.allclose(r.unrotate(r.rotate(X)), X, atol=1e-4)
    assert len(codecs.kmeans(np.ones((3, 2)), 5)) == 3
    one = codecs.Product.train(X, 3)
    assert np.diff(one.bounds).tolist() == [3, 3, 2]


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(i, f"doc {i} {'rare' if i % 50 == 0 else 'common'}", i % 3) for i in range(300)] + [(300, "", 0), (301, None, 0)], "id long, text string, g int")
    got = sparse.bm25_search(docs, "rare", 10).collect()
    assert sorted(r.id for r in got) == [0, 50, 100, 150, 200, 250]
    assert sparse.bm25_search(docs, "rare rare", 1).first().score == pytest.approx(2 * got[0].score)
    assert {r.id % 3 for r in sparse.bm25_search(docs, "rare", 10, flt={"g": 1}).collect()} == {1}
    assert sparse.bm25_search(docs, "absent", 5).count() == 0
    with pytest.raises(ValueError):
        sparse.BM25(b=2)
    a = spark.createDataFrame([(1, 5, 0.9), (2, 6, 0.1)], "rank int, id long, similarity double")
    b = spark.createDataFrame([(1, 6, 3.0)], "rank int, id long, similarity double")
    assert {r.id: r.score for r in fusion.rrf([a, b]).collect()} == pytest.approx({5: 1 / 61, 6: 1 / 62 + 1 / 61})
    assert {r.id: r.score for r in fusion.weighted([a, b], [1, 0.5]).collect()} == pytest.approx({5: 1.0, 6: 0.5})
    assert {r.id: r.score for r in fusion.rrf([a, b], [0, 1]).collect()}[5] == 0
    with pytest.raises(ValueError):
        fusion.rrf([a], [-1])


def test_modifiers(spark):
    t = spark.createDataFrame([(1, 0.5, 1000, 2.0, True), (2, 0.5, 900, None, False), (3, 0.4, None, 9.0, None)], "id long, score double, at long, m double, b boolean")
    value = lambda m: {r.id: r.score for r in scoring.modified(t, "score", [m]).collect()}
    assert value(scoring.RecencyDecay("at", 1000, 100)) == pytest.approx({1: 0.5, 2: 0.25, 3: 0.4})
    assert value(scoring.RecencyDecay("at", 1000, 100, "linear", missing=0.5)) == pytest.approx({1: 0.5, 2: 0.25, 3: 0.2})
    assert value(scoring.FieldMultiplier("m", 1, 3, 0.5)) == pytest.approx({1: 1.0, 2: 0.25, 3: 1.2})
    assert value(scoring.MatchBoost(Filter.eq("b", True), 0.3)) == pytest.approx({1: 0.8, 2: 0.5, 3: 0.4})
    assert value(scoring.MatchBoost(Filter.eq("nope", 1), 0.3)) == pytest.approx({1: 0.5, 2: 0.5, 3: 0.4})
    assert [r.id for r in scoring.rescored(t, "score", [scoring.FieldMultiplier("m")], 2).orderBy("rank").collect()] == [3, 1]
    with pytest.raises(ValueError):
        scoring.RecencyDecay("at", 0, 0)


def test_mmr_spreads():
    x = np.repeat(np.eye(5), 6, 0) + RNG.normal(size=(30, 5)) * 0.005
    relevance = np.linspace(1, 0.9, 30)
    assert len({i // 6 for i in scoring.mmr(relevance, list(x), 6, 0.3)}) >= 3
    assert scoring.mmr(relevance, list(x), 4, 1.0) == [0, 1, 2, 3]
    assert scoring.mmr(relevance, [None] * 30, 3, 0.5) == [0, 1, 2]
    with pytest.raises(ValueError):
        scoring.mmr(relevance, list(x), 4, 1.5)


def test_rerank(spark):
    t = spark.createDataFrame([(i, "apple " + "z" * (i % 7), 1 - i / 100) for i in range(20)], "id long, text string, score double")
    got = scoring.rerank(t, "q", lambda q, ts: [len(x) for x in ts], 3)
    assert [r["id"] for r in got] == [6, 13, 5]
    for bad in (lambda q, ts: [1.0], lambda q, ts: [float("nan")] * len(ts)):
        with pytest.raises(ValueError):
            scoring.rerank(t, "q", bad, 3)


def test_facets(spark):
    rows = [(i, ["en", "en", "fr", "de"][i % 4] if i % 10 else None, float(i), ["a"] if i % 2 else ["a", "b", "a"]) for i in range(60)]
    t = spark.createDataFrame(rows, "id long, lang string, price double, tags array<string>")
    f = aggregates.facets(t, [aggregates.FacetRequest("lang", 1, distinct=True), aggregates.FacetRequest("price", bounds=(10, 50)), "tags", "nope"])
    assert f["lang"]["values"][0][0] == "en" and f["lang"]["missing"] == 6 and f["lang"]["distinct"] == 3
    assert f["lang"]["values"][0][1] + f["lang"]["other"] == 54
    assert [b[2] for b in f["price"]["buckets"]] == [10, 40, 10] and f["tags"]["values"] == [("a", 60), ("b", 30)]
    assert f["nope"]["missing"] == 60
    assert aggregates.facets(t, ["tags"], ids=[1, 1, 2, 999])["tags"]["values"] == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        aggregates.FacetRequest("price", bounds=(2, 1))


def test_groups_and_recommendations(table):
    got = aggregates.search_groups(table, X[0], "g", 2, 3).orderBy("group_rank", "place").collect()
    seen, want = [], {}
    for _, i in plain(X[0], "l2"):
        want.setdefault(i % 3, []).append(i)
        if i % 3 not in seen:
            seen.append(i % 3)
    assert [r.id for r in got] == [i for g in seen[:2] for i in want[g][:3]]
    ranked = knn.knn(table, X[0], 300, columns=["g"])
    assert [r.id for r in aggregates.best_per_group(ranked, "g", 2, 3).orderBy("group_rank", "place").collect()] == [r.id for r in got]
    unit = lambda v: v / np.linalg.norm(v)
    q = 2 * (unit(X[1]) + unit(X[2])) / 2 - unit(X[3])
    want = [i for _, i in plain(q, "cosine") if i not in (1, 2, 3)][:5]
    assert [r.id for r in aggregates.recommend(table, [1, 2], [3], 5).orderBy("rank").collect()] == want
    for p, n in (([], [1]), ([1], [1]), ([9999], [])):
        with pytest.raises(ValueError):
            aggregates.recommend(table, p, n)


def test_modifiers_by_rules(spark):
    got = scoring.as_modifiers({"decay": {"field": "at", "origin": "1970-01-02", "half_life_days": 2, "shape": "linear", "floor": 0.1}, "multiply": ["m", {"field": "n", "min": 1, "max": 3}], "boost": ({"b": True}, 0.5), "pool": 50})
    assert got["pool"] == 50
    assert got["modifiers"] == [scoring.RecencyDecay("at", 86_400_000.0, 172_800_000.0, "linear", 0.1), scoring.FieldMultiplier("m"), scoring.FieldMultiplier("n", 1.0, 3.0), scoring.MatchBoost(Filter.eq("b", True), 0.5)]
    assert scoring.as_modifiers(None) == {"modifiers": [], "pool": None}
    for bad in ({"nope": 1}, {"decay": {"field": "a"}}, {"decay": {"field": "a", "half_life": 1, "half_life_days": 1}}, {"decay": {"field": "a", "half_life": 1, "shape": "x"}}, {"multiply": {"min": 1}}, {"multiply": {"field": "a", "mean": 1}}):
        with pytest.raises(ValueError):
            scoring.as_modifiers(bad)
    with pytest.raises(TypeError):
        scoring.as_modifiers("decay")


def test_searches_with_options(table):
    from marlstone.operators import search

    rules = {"multiply": {"field": "g", "min": 0.0, "max": 2.0}, "pool": 300}
    got = search.dense(table, X[0], 5, "l2", modifiers=rules, columns=["g"]).orderBy("rank").collect()
    base = {i: 1 / (1 + d) for d, i in plain(X[0], "l2")}
    want = sorted(base, key=lambda i: -base[i] * (i % 3))[:5]
    assert [r.id for r in got] == want and all(r.score == pytest.approx(r.base_score * r.g) for r in got)
    odd = search.dense(table, X[0], 4, "l2", predicate=lambda ids: ids % 2 == 1).orderBy("rank").collect()
    assert [r.id for r in odd] == [i for _, i in plain(X[0], "l2") if i % 2][:4]
    assert {r.id for r in search.dense(table, X[0], 9, "l2", predicate=[1, 2, 999]).collect()} == {1, 2}
    assert search.dense(table, X[0], 4, "cosine", diversity=0.5).count() == 4
    texts = table.withColumn("text", F.concat(F.lit("word"), F.col("g").cast("string")))
    found = search.by_text(texts, "word1", 3, modifiers={"boost": {"when": {"g": 1}, "bonus": 2.0}}, predicate=lambda ids: ids > 10).orderBy("rank").collect()
    assert [r.id for r in found] == [13, 16, 19] and all(r.score == pytest.approx(r.base_score + 2) for r in found)
    both = search.hybrid(texts, 3, modifiers={"boost": ({"g": 2}, 9.0)}, vector_query=X[0], text_query="word1 word2", metric="l2").orderBy("rank").collect()
    assert all(r.id % 3 == 2 for r in both) and len(both) == 3
    hits = search.as_hits(search.hybrid(texts, 3, vector_query=X[0], text_query="word1", metric="l2"))
    assert list(hits["rank"]) == [1, 2, 3] and str(hits["text_rank"].dtype) == "Int64"
    with pytest.raises(ValueError):
        search.hybrid(texts, 3, text_query="word1", diversity=0.5)


def test_facet_summary_counts_what_lies_beyond(spark):
    t = spark.createDataFrame([(i, float(i % 7) if i % 7 else -0.0) for i in range(70)] + [(99, None)], "id long, x double")
    got = aggregates.facet_summary(t, aggregates.FacetRequest("x", 2)).first()
    assert (got.total, got.missing, got.distinct, got.other) == (70, 1, 7, 50)
    assert aggregates.facet_summary(t.limit(0), aggregates.FacetRequest("x")).first().asDict() == {"total": 0, "missing": 0, "distinct": 0, "other": 0}
