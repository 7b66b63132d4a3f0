import datetime as dt
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.__main__ import main
from marlstone.functions import dates, text
from marlstone.operators import mutations
from marlstone.operators.collection import Collection
from marlstone.operators.filters import Filter
from marlstone.operators.labels import BFIndex, Index
from marlstone.sources import files
from marlstone.sources.store import Store
from marlstone.streaming import streams

ROOT = Path(__file__).resolve().parent.parent


def test_text(spark):
    rows = ["Running SHOES", "École de Paris", "don’t stop", "", None, "a'b 12"]
    t = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in t.select(text.tokenize(F.col("t"))).collect()] == [["running", "shoes"], ["École", "de", "paris"], ["don’t", "stop"], [], [], ["a", "b", "12"]]
    assert text.unicode_tokens("École de Paris don’t ☃ 12x") == ["école", "de", "paris", "don't", "12x"]
    words = {"running": "run", "shoes": "shoe", "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "hopping": "hop", "hoping": "hope", "happily": "happili", "rational": "ration", "conditional": "condit", "generously": "generous", "skies": "sky", "national": "nation", "knightly": "knight", "consigned": "consign", "cry": "cri", "by": "by", "say": "say"}
    assert {w: text.stem(w) for w in words} == words
    got = spark.createDataFrame([("the running dogs and cats",)], "t string").select(text.analyze(F.col("t"), stop_words=True, stemming=True)).first()[0]
    assert got == ["run", "dog", "cat"] and len(text.STOP_WORDS) > 150
    for options in ({}, {"unicode": True}, {"stop_words": True, "stemming": True}, {"unicode": True, "stemming": True}):
        assert [text.analyzed(r, **options) for r in rows] == [r[0] for r in t.select(text.analyze(F.col("t"), **options)).collect()]
    ids = spark.createDataFrame([("abc",), ("é",), ("",)], "t string").select(text.term_id(F.col("t"))).collect()
    assert [r[0] for r in ids] == [440920331, 513665217, 2166136261]
    assert spark.createDataFrame([("k",)], "t string").select(text.key_ids("t")).first()[0] % 2**64 == text.id_of("k")


def test_dates(spark):
    assert dates.parse_date("1970-01-02") == 86_400_000 and dates.parse_date("2024-02-29T12:30:05.1239+01:00") == dates.parse_date("2024-02-29T11:30:05.123Z")
    assert dates.format_date(dates.parse_date("1969-12-31T23:59:59.999Z")) == "1969-12-31T23:59:59.999Z"
    for bad in ("2024-02-30", "x", "2024-01-01T25:00", "2024-1-1"):
        with pytest.raises(ValueError):
            dates.parse_date(bad)
    day = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    assert dates.to_ms(day) == dates.to_ms(day.date()) == dates.to_ms("2020-01-01") == dates.to_ms(np.datetime64("2020-01-01")) == dates.to_ms(1577836800000)
    with pytest.raises(TypeError):
        dates.to_ms(True)
    rows = ["1970-01-02", "2024-02-29T12:30:05.1239+01:00", "2024-02-30", "x", None, "2024-01-01T25:00"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(dates.date_ms(F.col("t"))).collect()]
    assert got == [86_400_000, dates.parse_date(rows[1]), None, None, None, None]


def test_changes(spark):
    t = spark.createDataFrame([(i, "en" if i % 2 else None, i, ["a"]) for i in range(10)], "id long, lang string, n long, tags array<string>")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(mutations.remove(t, [1, 1, 99])) == [0, *range(2, 10)]
    assert ids(mutations.remove_where(t, Filter.lt("n", 5))) == [5, 6, 7, 8, 9]
    changed = {r.id: (r.lang, r.n, r.tags) for r in mutations.set_metadata_where(t, Filter.missing("lang"), {"lang": "xx", "n": None, "tags": ["b", "b"]}).collect()}
    assert changed[2] == ("xx", None, ["b"]) and changed[3] == ("en", 3, ["a"])
    for bad in ({"nope": 1}, {"n": "x"}, {"_key": "a"}, {"lang": 3}):
        with pytest.raises(ValueError):
            mutations.set_metadata_where(t, Filter.eq("n", -1), bad)
    with pytest.raises(ValueError):
        mutations.add(t, t.limit(1))
    with pytest.raises(ValueError):
        mutations.upsert(t, t.limit(1).unionByName(t.limit(1)))
    rows, after = mutations.scan(t, 4, after=2)
    assert [r.id for r in rows] == [3, 4, 5, 6] and after == 6 and mutations.scan(t, 4, after=6)[1] is None
    with pytest.raises(ValueError):
        mutations.page(t, 0)
    assert [r.id for r in mutations.documents(t)] == list(range(10))


def test_store_and_command(spark, tmp_path, capsys):
    s = Store(spark, str(tmp_path / "c"), keep=1)
    assert s.load() is None
    s.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"))
    s.upsert(spark.createDataFrame([(2, "c", 5)], "id long, t string, n int"))
    s.remove(spark.createDataFrame([(1,), (7,)], "id long"))
    state = lambda: sorted((r.id, r.t, r.n) for r in s.load().collect())
    assert state() == [(2, "c", 5)]
    s.checkpoint()
    assert state() == [(2, "c", 5)] and s.identify()["segments"] == 0
    (tmp_path / "c" / "log-torn").mkdir()  # a change that was cut off counts for nothing
    s.upsert(spark.createDataFrame([(9, "z")], "id long, t string"))
    assert state() == [(2, "c", 5), (9, "z", None)]
    s.verify()
    with pytest.raises(ValueError):
        s.upsert(spark.createDataFrame([(1, "a"), (1, "b")], "id long, t string"))
    assert main(["inspect", s.path]) == 0 and '"segments": 1' in capsys.readouterr().out
    assert main(["verify", s.path]) == 0 and main(["health", s.path]) == 0
    assert main(["export", s.path, "--out", str(tmp_path / "out"), "--format", "csv"]) == 0
    assert main(["export", s.path]) == 2 and main(["nonsense", s.path]) == 2
    (tmp_path / "c" / "MANIFEST").write_text("{broken")
    (tmp_path / "c" / ".MANIFEST.crc").unlink(missing_ok=True)
    assert main(["verify", s.path]) == 1


def test_collection(spark, tmp_path):
    fields = T.StructType([T.StructField("lang", T.StringType()), T.StructField("year", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    c = Collection(spark, str(tmp_path / "c"), 3, fields)
    c.upsert_many([(i, {"vector": np.eye(3)[i % 3], "text": f"word{i} common", "lang": "en" if i % 2 else "fr", "year": 2000 + i, "tags": ["x", "x"], "sparse": {i % 5: 1.0, 30: 0.25}, "expires_at": 1000 if i == 9 else None}) for i in range(10)])
    c.upsert("a key", text="common things", lang="en")
    assert len(c) == 11 and "a key" in c and 9 not in c and c.get(3)["tags"] == ["x"] and c.get(99) is None
    assert c.count_where({"lang": "en"}) == 5
    got = c.search(3, vector=[1, 0, 0], text="word3", flt=Filter.gt("year", 2000)).orderBy("rank").collect()
    assert got[0].id == 3 and got[0].text_rank == 1 and got[0].lang == "en"
    assert c.search(2, sparse={4: 1.0}).orderBy("rank").first().id == 4
    assert c.search(3, vector=[1, 0, 0], diversity=0.3).count() == 3
    from marlstone.operators.scoring import MatchBoost

    assert c.search(1, text="common", modifiers=[MatchBoost({"year": 2008}, 5.0)]).first().id == 8
    assert c.set_metadata(3, {"lang": "de"}) and not c.set_metadata(77, {"lang": "de"})
    assert c.set_metadata_where({"lang": "fr"}, {"year": 1}) == 5 and c.facets(["lang"])["lang"]["values"] == [("fr", 5), ("en", 4), ("de", 1)]
    assert c.remove(0, 1, 555) == 2 and c.remove_where({"lang": "de"}) == 1 and c.remove_expired() == 1
    with pytest.raises(ValueError):
        c.add(2, text="taken")
    for bad in ({"vector": [1.0]}, {"vector": [1, 2, float("nan")]}, {"nope": 1}, {"sparse": {-1: 1.0}}):
        with pytest.raises(ValueError):
            c.upsert(5, **bad)
    assert c.facets(["lang"])["lang"]["values"] == [("fr", 4), ("en", 3)]
    c.create_payload_index("lang")
    assert c.payload_indexes() == ["lang"] and not c.maintain(99) and c.maintain(1) and c.health()["live"] == 7
    assert c.recommend([2], k=1).count() == 1 and c.search_groups([1, 0, 0], "lang", 1).count() == 1
    with pytest.raises(ValueError):
        c.search()


def test_collection_names_and_statistics(spark, tmp_path, monkeypatch):
    from marlstone.functions.text import id_of
    from marlstone.operators import collection as module

    fields = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])
    c = Collection(spark, str(tmp_path / "c"), 2, fields)
    c.upsert_many([("a", {"vector": [1, 0], "text": "red fish", "metadata_text": "m"}), ("b", {"vector": [0, 1], "text": "red", "n": 3}), ("old", {"text": "red", "expires_at": 5})])
    key = c.get("a")["id"]
    assert key == id_of("a") >> 1 and c.get_vector("a") == [1.0, 0.0] and c.get_metadata("a") == {"metadata_text": "m"} and c.get_vector("zz") is None
    assert c.update("a", vector=[1, 1], text="red fish") and not c.update("zz", text="x") and c.get_vector("a") == [1.0, 1.0]
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            c.upsert(bad, text="x")
    with pytest.raises(module.KeyClash):
        c.upsert(key, text="a number with the id of a key")
    monkeypatch.setattr(module, "id_of", lambda k: 14)
    with pytest.raises(module.KeyClash):
        c.upsert_many([("p", {"text": "x"}), ("q", {"text": "y"})])
    c.upsert("p", text="x")
    with pytest.raises(module.KeyClash):
        c.upsert("q", text="y")
    monkeypatch.undo()
    assert c.remove(7) == 1
    # what has expired counts in the statistics of texts, and isn't found
    idf = np.log(1 + (3 - 3 + 0.5) / (3 + 0.5))
    got = c.search(5, text="red").orderBy("rank").collect()
    assert len(got) == 2 and max(r.text_score for r in got) == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 / 100)), rel=1e-6)
    c.create_text_index()
    again = c.search(5, text="red").orderBy("rank").collect()
    assert [(r.id, r.text_score) for r in again] == [(r.id, r.text_score) for r in got]
    c.upsert(8, text="blue")  # the index is stale, the search is not
    assert c.search(5, text="blue").first().id == 8
    c.refresh()
    assert c.search(5, text="blue").first().id == 8
    for old, found in ((True, "selectivity"), (False, "matches")):  # an index of vectors knows nothing of expiry
        stats = {}
        if not old:
            assert c.remove_expired() == 1
        c.create_vector_index(lists=2)
        assert [r.id for r in c.near([0, 1], 1, stats=stats).collect()] == [c.get("b")["id"]] and found in stats and ("matches" in stats) != old


def test_collection_in_and_out(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa

    fields = T.StructType([T.StructField("lang", T.StringType()), T.StructField("at", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType())])
    c = Collection(spark, str(tmp_path / "c"), 2, fields)
    pdf = pd.DataFrame({"name": ["a", "b", "c"], "v": [np.array([1.0, 0.0]), [0.0, 1.0], None], "body": ["one", None, "three"], "lang": ["en", None, pd.NA], "at": [pd.Timestamp("2020-01-01"), pd.NaT, pd.NaT], "tags": [["p", "p"], {"q"}, None], "text": ["m1", None, None], "x": [1.5, float("nan"), 2.0]})
    c.upsert_pandas(pdf, id_column="name", vector_column="v", text_column="body")
    assert c.get_metadata("a") == {"lang": "en", "at": 1577836800000, "tags": ["p"], "metadata_text": "m1", "x": 1.5} and c.get_metadata("b") == {"tags": ["q"]}
    back = c.to_pandas()
    assert set(back.columns) >= {"id", "key", "expires_at", "vector", "sparse", "text", "metadata_text"} and len(back) == 3
    c.write_parquet(str(tmp_path / "out"))
    for read in (lambda d: d.upsert_parquet(str(tmp_path / "out")), lambda d: d.upsert_arrow(c.to_arrow())):
        d = Collection(spark, str(tmp_path / f"d{id(read)}"), 2, fields)
        read(d)
        assert sorted(map(str, d.table().collect())) == sorted(map(str, c.table().collect()))
    fixed = pa.table({"id": pa.array([1, 2], pa.uint64()), "vector": pa.FixedSizeListArray.from_arrays(pa.array([1, 0, 0, 1], pa.float32()), 2), "lang": ["en", None]})
    e = Collection(spark, str(tmp_path / "e"), 2, fields)
    e.upsert_arrow(fixed)
    assert e.get_vector(2) == [0.0, 1.0]
    for bad in (pa.table({"id": [None, 1]}), pa.table({"vector": [[1.0, 2.0]]}), pa.table({"id": [1], "vector": [[1.0]]}), pa.table({"id": [1], "nope": [1]}), pa.table({"id": [-1]})):
        with pytest.raises(ValueError):
            e.upsert_arrow(bad)


def test_exports(spark, tmp_path):
    import csv
    import io
    import json

    rows = [(2, 0.1, 1 / 3, 'a "b", c\n', ["x", "y"], [0.1, 2.0]), (1, None, None, "", None, None), (3, 1e-7, 1e300, None, [], [1.0])]
    t = spark.createDataFrame(rows, "id long, f float, g double, text string, tags array<string>, vector array<float>")
    files.export_json(t, str(tmp_path / "j"))
    lines = [json.loads(x) for p in sorted((tmp_path / "j").glob("part*")) for x in p.read_text().splitlines()]
    assert [x["id"] for x in lines] == [1, 2, 3] and list(lines[1]) == ["id", "vector", "text", "metadata"]
    assert lines[0]["metadata"] == {} and lines[1]["metadata"]["g"] == 1 / 3 and np.float32(lines[1]["metadata"]["f"]) == np.float32(0.1) and lines[1]["text"] == rows[0][3]
    files.export_csv(t.coalesce(1), str(tmp_path / "c"), vectors=False, limit=2)
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*")))
    got = list(csv.DictReader(io.StringIO(text)))
    assert [r["id"] for r in got] == ["1", "2"] and got[1]["text"] == rows[0][3] and got[1]["tags"] == '["x","y"]' and got[0]["f"] == "" and got[1]["f"] == "0.100000001"
    assert files.write_fbin(t.where("id = 2"), str(tmp_path / "one.fbin")) == 1
    assert files.read_fbin(spark, str(tmp_path / "one.fbin")).first().vector == pytest.approx([0.1, 2.0])
    with pytest.raises(files.FormatError):
        files.write_fbin(t, str(tmp_path / "two.fbin"))


def test_chroma(spark, tmp_path):
    class Fake:
        metadata = {"hnsw:space": "cosine"}

        def get(self, include, limit, offset):
            ids = [f"k{i}" for i in range(offset, min(5, offset + limit))]
            return {"ids": ids, "embeddings": [[1.0, float(i)] for i in range(len(ids))], "documents": ["t"] * len(ids), "metadatas": [{"a": 1}] * len(ids)}

    got, metric = files.from_chroma(spark, Fake(), 2)
    assert metric == "cosine" and sorted(r.key for r in got.collect()) == [f"k{i}" for i in range(5)] and got.first().metadata == {"a": "1"}


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "a.fbin").write_bytes(files.fbin_bytes(x))
    assert [r.vector for r in files.read_fbin(spark, str(tmp_path / "a.fbin")).orderBy("id").collect()] == x.tolist()
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i3f", 3, *r) for r in x))
    assert [r.vector for r in files.read_vecs(spark, str(tmp_path / "a.fvecs")).orderBy("id").collect()] == x.tolist()
    head = struct.pack(files._HEADER, 0, 10, 3, 40, 28, 16, 0, 0, 16, 32, 16, 0.5, 200)
    body = b"".join(struct.pack("<I", 0x10000 if i == 1 else 0) + bytes(12) + x[i].tobytes() + struct.pack("<Q", 70 + i) + bytes(4) for i in range(3))
    (tmp_path / "i.bin").write_bytes(head + body)
    assert [(r.id, r.vector) for r in files.read_hnswlib(spark, str(tmp_path / "i.bin"), 3).orderBy("id").collect()] == [(70, x[0].tolist()), (72, x[2].tolist())]
    for name, data, read in (("b", b"abc", files.read_fbin), ("c", head[:20], lambda s, p: files.read_hnswlib(s, p, 3))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="Format|shorter"):
            read(spark, str(tmp_path / name)).collect()
    assert files.from_pages(spark, lambda at, n: [(f"k{i}",) for i in range(at, min(at + 2, 5))], "key string").count() == 5


def test_labels(spark):
    i = Index(spark, "ip", 2)
    i.init_index(3)
    i.add_items([[1, 0], [0, 1], [1, 1]], [5, 6, 7])
    ids, d = i.knn_query([1, 0], 2)
    assert ids.tolist() == [[5, 7]] and d.tolist() == [[0.0, 0.0]]
    i.mark_deleted(5)
    assert i.knn_query([1, 0], 1)[0].tolist() == [[7]]
    for bad in (lambda: i.mark_deleted(5), lambda: i.add_items([[1, 1, 1]]), lambda: i.add_items([[2, 2]], [9]), lambda: i.knn_query([1, 0], 3), lambda: i.get_items([99])):
        with pytest.raises(RuntimeError):
            bad()
    i.add_items([[2, 2]], [9], replace_deleted=True)
    assert sorted(i.get_ids_list()) == [6, 7, 9]
    assert i.knn_query([1, 0], 2, filter=lambda x: x != 9)[0].tolist() == [[7, 6]]
    b = BFIndex(spark, "cosine", 2)
    b.init_index(5)
    b.add_items([[2, 0], [0, 3], [1, 1]])
    ids, d = b.knn_query([[3, 0]], 2)
    assert ids.tolist() == [[0, 2]] and d[0] == pytest.approx([1 - 3, 1 - 3 / 2**0.5])
    b.delete_vector(0)
    assert b.knn_query([3, 0], 1)[0].tolist() == [[2]] and b.get_items([1]).tolist() == [[0, 3]]
    with pytest.raises(RuntimeError):
        b.delete_vector(0)
    i.save_index("file:" + str(spark.conf.get("spark.sql.warehouse.dir")).removeprefix("file:") + "/labels")
    j = Index(spark, "ip", 2)
    j.load_index("file:" + str(spark.conf.get("spark.sql.warehouse.dir")).removeprefix("file:") + "/labels", 9)
    assert sorted(j.get_ids_list()) == [6, 7, 9] and j.get_max_elements() == 9


def test_streams(spark, tmp_path):
    rows = [(1, "a", 1), (1, "b", 2), (2, "c", 1)]
    spark.createDataFrame(rows, "id long, t string, n int").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, t string, n int").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "c"))
    streams.upsert_stream(source, store, str(tmp_path / "ck"), "n").awaitTermination(120)
    assert sorted((r.id, r.t) for r in store.load().collect()) == [(1, "b"), (2, "c")]


def test_searching_and_counting_streams(spark, tmp_path):
    from marlstone.operators.knn import knn_join

    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vector array<float>")
    asked = spark.createDataFrame([(1, [3.0, 1.0]), (2, [0.0, 9.0])], "query_id long, vector array<float>")
    asked.write.parquet(str(tmp_path / "q"))
    stream = lambda: spark.readStream.schema(asked.schema).parquet(str(tmp_path / "q"))
    for k in range(2):  # a batch that is run again, as the checkpoint is another, replaces its rows
        streams.search_stream(stream(), table, 3, str(tmp_path / "out"), str(tmp_path / f"ck{k}"), "l2").awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn_join(asked, table, 3).collect()))
    times = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "ab"[m % 2]) for m in (0, 1, 2, 11, 12)], "t timestamp, k string")
    times.write.parquet(str(tmp_path / "t"))
    counts = streams.counts_by_window(spark.readStream.schema(times.schema).parquet(str(tmp_path / "t")), "t", "10 minutes", "1 hour", "k")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.window.start.minute, r.k, r.n) for r in spark.table("counts").collect()) == [(0, "a", 2), (0, "b", 1), (10, "a", 1), (10, "b", 1)]


def test_faiss(spark):
    class Flat:
        ntotal = 3

        def reconstruct_n(self, at, n):
            return np.arange(6, dtype=np.float32).reshape(3, 2)[at : at + n]

    class Mapped:
        ntotal, index = 3, Flat()

        class id_map:
            @staticmethod
            def at(i):
                return 10 * i

    assert [(r.id, r.vector) for r in files.from_faiss(spark, Flat()).orderBy("id").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    assert [r.id for r in files.from_faiss(spark, Mapped()).orderBy("id").collect()] == [0, 10, 20]


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """As if the subpackage and the pipeline had been deleted."""
    import shutil

    for name in ("marlstone", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "marlstone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "marlstone" / "llm").mkdir()
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)  # what a cache leaves behind is no package
    (tmp_path / "marlstone" / "llm" / "__init__.py").touch()
    (tmp_path / "marlstone" / "llm" / "queries.py").write_text("import a_module_that_is_missing")
    broken = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert "a_module_that_is_missing" in broken.stderr
    names = {p.name for p in (ROOT / "marlstone").rglob("*.py") if "llm" not in p.parts and "marlstone.llm" in p.read_text()}
    assert not names
