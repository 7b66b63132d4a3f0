import re
from collections import Counter

import corpus_pipeline as p
from conftest import SMALL
from helpers import BLANK, empty, odd, prose
from test_decontaminate import brute as contaminated
from test_jaccard import brute as linked


def test_run_against_brute_force(spark):
    """Every stage but the classifier is replayed in plain Python; the classifier's own stage gives its input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = [(r.doc_id, r.text) for r in p.quality(spark, docs, SMALL).collect()]
    assert 0.7 * docs.count() < len(good) < docs.count()
    first = {}
    for i, t in sorted(good):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
    good = [(i, t) for i, t in good if i in set(first.values())]
    keep = {r[0] for r in linked(good) if r[0] == r[5]}
    good = [(i, t) for i, t in good if i in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r[0] for r in contaminated(good, items) if not r[5]}
    expected = {i: len(BLANK.findall(t)) + 1 for i, t in good if i in clean}
    total = Counter()
    for r in p.run(spark, SMALL).collect():
        total[r.doc_id] += r.n_tokens
    assert total == expected


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 4 <= len(p.STAGES) <= 5
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema == docs.schema


def test_stages_stand_odd_rows(spark):
    docs = odd(spark, "lang", "source", "place")
    docs = p.table(docs.unionByName(docs.limit(0)), "odd")
    for name, stage in p.STAGES[:-1]:
        out = p.table(stage(spark, docs, SMALL), "odd")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    assert p.exact(spark, docs, SMALL).where("doc_id = 6").count() == 2  # repeated rows with one id, and another text with that id
    assert p.packing(spark, docs, SMALL).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_rows_keep_their_numbers_when_splits_change(spark):
    """Between the judge's scan and the join the cluster has other cores, as if executors had come or gone."""
    path = p.table(spark.range(3000).selectExpr("id as doc_id", "concat('text ', id % 1000) as text").repartition(3), "moving")

    def judge(rows):
        found = p.table(p.exact_dedup(rows, id="place"), "verdict")
        spark.conf.set("spark.sql.files.minPartitionNum", 37)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        return found

    try:
        assert sorted(r.text for r in p._kept(path, "moving", judge).collect()) == sorted(f"text {k}" for k in range(1000))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stages_stand_empty_tables(spark):
    for _, stage in p.STAGES:
        assert stage(spark, p.table(empty(spark), "none"), SMALL).count() == 0


def test_rows_that_share_an_id_are_judged_alone(spark):
    rows = [(1, prose(1, 30)), (1, prose(2, 30)), (2, prose(1, 30)), (None, prose(2, 30)), (None, prose(3, 30))]
    docs = p.table(spark.createDataFrame(rows, "doc_id long, text string"), "shared")
    for stage in (p.exact, p.near):
        assert sorted(((r.doc_id, r.text) for r in stage(spark, docs, SMALL).collect()), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)
