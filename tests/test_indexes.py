import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from marlstone.operators import codecs, knn, search, sparse
from marlstone.operators.aggregates import FacetRequest, facet_summary, facet_values
from marlstone.operators.filters import Filter, where
from marlstone.operators.lists import ListIndex, search_all
from marlstone.operators.payload import PayloadIndex
from marlstone.operators.postings import Postings
from marlstone.plans.queries import FACTORS, QUERIES, vecs
from marlstone.sources.store import LockedError, Store

RNG = np.random.default_rng(11)
CENTRES = RNG.normal(size=(10, 8)) * 3
X = (CENTRES[np.arange(600) % 10] + RNG.normal(size=(600, 8))).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, x.tolist(), i % 10, "abc"[i % 3] if i % 5 else None, [f"t{i % 4}", "all"] if i % 7 else None) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id long, vector array<float>, g int, kind string, tags array<string>").cache()


def words(i):
    return f"doc number{i % 40} {'rare' if i % 50 == 0 else 'common common'} t{i}"


def test_postings_are_what_a_scan_finds(spark, tmp_path):
    docs = spark.createDataFrame([(i, words(i), i % 3) for i in range(300)] + [(300, "", 0), (301, None, 0)], "id long, text string, g int")
    index = Postings(spark, str(tmp_path / "p"))
    assert index.upsert(docs) == 302
    for q in ("rare", "common rare number7", "absent", "rare rare t5"):
        want = [(r.rank, r.id, r.score) for r in sparse.bm25_search(docs, q, 10).orderBy("rank").collect()]
        assert [(r.rank, r.id, r.score) for r in index.search(q, 10).orderBy("rank").collect()] == want
    assert {r.id % 3 for r in index.search("rare", 10, docs, {"g": 1}).collect()} == {1}
    assert {r.id for r in index.search("common", 10, among=docs.where("id < 3").select("id")).collect()} == {1, 2}
    assert {r.term: r.df for r in index.document_frequency(["rare", "doc", "no"]).collect()} == {"rare": 6, "doc": 300}
    rare = index.postings(["rare"])
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,rare)]" in rare._jdf.queryExecution().toString()
    assert {f.split("bucket=")[1].split("/")[0] for f in rare.inputFiles()} == {str(zlib.crc32(b"rare") % 64)}


def test_postings_follow_changes(spark, tmp_path):
    state = {i: words(i) for i in range(60)}
    index = Postings(spark, str(tmp_path / "p"), buckets=4)
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    index.upsert(frame(state))
    new = {3: "rare thing", 70: "another rare", 4: ""}
    assert index.upsert(frame(new)) == 1
    state |= new
    assert index.remove([0, 5, 5, 999]) == 2
    for i in (0, 5):
        del state[i]
    assert not index.update(frame({999: "x"})) and index.update(frame({7: "rare seven"}))
    state[7] = "rare seven"
    with pytest.raises(ValueError):
        index.add(frame({7: "y"}))
    with pytest.raises(ValueError):
        index.upsert(frame({1: "a"}).unionByName(frame({1: "b"})))
    for step in range(2):
        want = [(r.id, r.score) for r in sparse.bm25_search(frame(state), "rare common", 20).orderBy("rank").collect()]
        assert [(r.id, r.score) for r in index.search("rare common", 20).orderBy("rank").collect()] == want
        assert {r.id for r in index.live().collect()} == set(state)
        assert (index.stats()["dead"] > 0) == (step == 0) and index.stats()["live"] == len(state)
        index.compact()


def test_an_index_with_more_dead_than_live_documents_is_compacted(spark, tmp_path, monkeypatch):
    from marlstone.operators import postings

    monkeypatch.setattr(postings, "DEAD", 5)
    index = Postings(spark, str(tmp_path / "p"), buckets=2)
    index.upsert(spark.createDataFrame([(i, "a b") for i in range(12)], "id long, text string"))
    assert index.remove(list(range(8))) == 8 and index.stats() == {"terms": 2, "postings": 8, "live": 4, "dead": 0, "segments": 1}


def test_sparse_vectors(spark, tmp_path):
    rows = [(i, [i % 5, 30], [1.0, 0.25 * i]) for i in range(20)] + [(20, None, None), (21, [4], [0.0])]
    index = Postings(spark, str(tmp_path / "s"), None)
    index.upsert(spark.createDataFrame(rows, "id long, indices array<long>, values array<double>"))
    want = sorted(((sum(w * {3: 2.0, 30: -1.0}.get(t, 0) for t, w in zip(*r[1:])), r[0]) for r in rows[:20] if r[1][0] == 3 or r[2][1]), key=lambda x: (-x[0], x[1]))
    got = [(r.score, r.id) for r in index.search({3: 2.0, 30: -1.0}, 25).orderBy("rank").collect()]
    assert got == want
    records = {r.id: (r.terms, r.weights) for r in index.records().collect()}
    assert records[7] == ([2, 30], [1.0, 1.75]) and records[20] == ([], []) and records[0][0] == [0]
    for bad in ([(1, [-1], [1.0])], [(1, [2**32], [1.0])], [(1, [1], [math.inf])]):
        with pytest.raises(ValueError):
            index.upsert(spark.createDataFrame(bad, "id long, indices array<long>, values array<double>"))


FILTERS = [
    Filter.eq("kind", "a"), ~Filter.eq("kind", "a"), Filter.in_("kind", ["a", "c", "zz"]), Filter.in_("kind", []), Filter.has_tag("tags", "t1"), Filter.exists("kind"), Filter.missing("tags"), Filter.all(),
    Filter.has_all_tags("tags", ["t1"]), Filter.has_any_tag("tags", ["t1", "t2"]), Filter.has_all_tags("tags", ["t1", "all"]), Filter.eq("kind", "a") & Filter.has_tag("tags", "t2"),
    Filter.eq("kind", "a") | Filter.has_tag("tags", "t2"), Filter.eq("kind", "a") & Filter.lt("g", 4), Filter.eq("kind", "a") | Filter.lt("g", 4),
]


def test_payload_index(spark, table, tmp_path):
    index = PayloadIndex(spark, str(tmp_path / "i")).build(table, ["kind", "tags"])
    assert index.fields() == ["kind", "tags"]
    for f in FILTERS:
        want = {r.id for r in where(table, f).collect()}
        exact, most, found = index.exact_count(f), index.most(f), index.candidates(f)
        assert exact in (None, len(want)) and (most is None or most >= len(want))
        if found is not None:
            got = [r.id for r in found.collect()]
            assert want <= set(got) and len(got) == len(set(got))
    assert [index.exact_count(f) for f in FILTERS[:9]].count(None) == 0
    assert index.candidates(FILTERS[11]).count() == where(table, FILTERS[11]).count() and index.candidates(FILTERS[14]) is None
    for name in ("kind", "tags"):
        assert index.facet_values(FacetRequest(name, 2)).collect() == facet_values(table, FacetRequest(name, 2)).collect()
        assert index.facet_summary(FacetRequest(name, 2)) == facet_summary(table, FacetRequest(name, 2)).first().asDict()
    with pytest.raises(ValueError):
        index.build(table, ["g"])
    stats = {}
    got = search.dense(table, X[0], 5, "l2", flt=Filter.eq("kind", "b"), payload=index, stats=stats)
    assert stats["strategy"] == "candidates" and stats["selectivity"] == pytest.approx(160 / 600)
    assert [r.id for r in got.orderBy("rank").collect()] == [r.id for r in knn.knn(table, X[0], 5, flt=Filter.eq("kind", "b")).orderBy("rank").collect()]


@pytest.mark.parametrize("codec", [None, "pq", "sq8"])
def test_list_index(spark, table, tmp_path, codec):
    index = ListIndex(spark, str(tmp_path / "l")).build(table, 10, codec=codec, replicas=2 if codec == "pq" else 1)
    exact = [r.id for r in knn.knn(table, X[3], 10).orderBy("rank").collect()]
    stats = {}
    assert [r.id for r in index.search(X[3], 10, 10, candidates=10_000, stats=stats).orderBy("rank").collect()] == exact and stats["strategy"] == "exact"
    near = [r.id for r in index.search(X[3], 10, 2, candidates=60, stats=stats).orderBy("rank").collect()]
    assert stats["strategy"] == "lists" and len(set(near)) == 10 and len(set(near) & set(exact)) >= 9
    few = index.search(X[3], 5, 1, flt=Filter.eq("g", 7), candidates=200, stats=stats)
    assert [r.id for r in few.orderBy("rank").collect()][0] == knn.knn(table, X[3], 1, flt=Filter.eq("g", 7)).first().id
    assert sum(index.sizes().values()) == 600 * (2 if codec == "pq" else 1) and index.list_of(5) in range(10) and index.list_of(-4) is None
    health = index.health(5)
    assert health["live"] == 600 and health["recall"] >= 0.9 and health["balance"] >= 1 and ("codec_error" in health) == (codec is not None)


def test_list_index_follows_changes(spark, table, tmp_path):
    index = ListIndex(spark, str(tmp_path / "l")).build(table, 6)
    moved = table.where("id in (5, 6)").withColumn("vector", F.transform("vector", lambda x: x * 0 + 50)).unionByName(table.where("id = 0").withColumn("id", F.lit(900).cast("long")))
    index.upsert(moved)
    assert index.remove(spark.createDataFrame([(1,), (777,)], "id long")) == 1
    now = table.where("id not in (1, 5, 6)").unionByName(moved)
    for step in (None, index.upkeep, index.rebuild):
        if step:
            step()
        assert {(r.id, tuple(r.vector)) for r in index.vectors().collect()} == {(r.id, tuple(r.vector)) for r in now.collect()}
        for q in (X[0], np.full(8, 50.0)):
            assert [r.id for r in index.search(q, 4, 6).orderBy("rank").collect()] == [r.id for r in knn.knn(now, q, 4).orderBy("rank").collect()]
        assert (index.health(2)["churn"] > 0) == (step is None)


def test_a_search_that_is_stopped_gives_the_best_so_far(spark, table, tmp_path):
    path = str(tmp_path / "l")
    ListIndex(spark, path).build(table, 8)
    index, told = ListIndex(spark, path), []  # opened again
    best, how = index.search_within(X[3], 5, progress=told.append)
    exact = [(r.id, r.distance) for r in knn.knn(table, X[3], 5).orderBy("rank").collect()]
    assert best == exact and how == {"probes": 8, "lists": 8, "stopped_early": False} and told == [0.5, 1.0]
    for stop in ({"seconds": 0}, {"cancel": lambda: True}):
        best, how = index.search_within(X[3], 5, wave=2, **stop)
        assert len(best) == 5 and best[0] == exact[0] and how["stopped_early"] and how["probes"] == 2


def test_sparse_dot(spark):
    t = spark.createDataFrame([({1: 2.0, 3: 0.5}, {3: 4.0, 9: 1.0}), ({1: 1.0}, {2: 1.0})], "a map<long,float>, b map<long,float>")
    assert [r[0] for r in t.select(sparse.sparse_dot(F.col("a"), F.col("b"))).collect()] == [2.0, 0.0]


def test_batches_through_lists(spark, table, tmp_path, monkeypatch):
    from marlstone.operators import lists

    monkeypatch.setattr(lists, "LIST_ROWS", 40)  # large lists in parts
    queries = table.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    for metric in ("l2", "cosine"):
        index = ListIndex(spark, str(tmp_path / metric)).build(table, 8, metric)
        exact = knn.knn_join(queries, table, 5, metric)
        rows = lambda df: sorted((r.query_id, r.rank, r.id, round(r.distance, 5) + 0.0) for r in df.collect())
        assert rows(search_all(index, queries, 5, 8)) == rows(exact)
        assert knn.recall(search_all(index, queries, 5, 3), exact).agg(F.avg("recall")).first()[0] >= 0.9


@pytest.mark.parametrize("name", ["lists_recall", *(f"codec_{k}" for k in FACTORS)])
def test_recall_over_all_stated_queries(spark, name):
    path = SMALL.replace("0.001", "0.01")
    found = QUERIES[name](spark, path)
    assert found.count() == vecs(spark, path).where("id % 20 = 0").count() and found.agg(F.avg("recall")).first()[0] >= 0.9


def test_a_codec_waits_for_enough_rows(table):
    coded, model = codecs.encoded(table, "pq")
    assert model is None and coded.where("code is not null").isEmpty()
    coded, model = codecs.encoded(table, "sq8", train_after=600, codes_only=True)
    assert model is not None and "vector" not in coded.columns
    assert codecs.encoded(table.limit(1), "f16")[1] is not None


def test_one_writer_and_checked_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"), keep=1)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    store.upsert(rows)
    with store.writing(), pytest.raises(LockedError):
        Store(spark, store.path).upsert(rows)
    store.upsert(rows, ("s", 4))
    assert store.upsert(rows, ("s", 4)) == store.upsert(rows, ("s", 3)) == store.manifest()["lsn"] == 2  # batches that run again
    before = store.load()
    store.checkpoint()
    assert before.count() == 2  # a reader that began before the checkpoint
    store.checkpoint()
    part = store.manifest()["snapshots"][0]["name"]
    store.verify()
    spark.createDataFrame([(1, "a"), (2, "x")], "id long, t string").write.mode("overwrite").parquet(f"{store.path}/{part}")
    with pytest.raises(RuntimeError, match="other values"):
        store.verify()
