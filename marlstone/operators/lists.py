"""A stored index of vectors: lists around k-means centres, codes beside the vectors, changes, upkeep and rebuilding.

Rows lie in folders by list, so a search reads the lists that it probes, and of those first the small column of codes
alone. Large lists are written by several tasks. Changes are folders of their own; upkeep folds them in, rebuilding
trains centres and codec anew. Both write a new version and swap the manifest, so readers go on meanwhile.
"""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import distance
from marlstone.operators import codecs
from marlstone.operators.filters import where
from marlstone.operators.knn import _unit, knn, knn_join, nearest_centre, recall
from marlstone.sources.store import Folder

#: Rows of a list that one task writes.
LIST_ROWS = 1_000_000


class ListIndex(Folder):
    """path: a folder. metric, codec (a name of codecs.CODECS, or None) and lists are settings of build()."""

    def __init__(self, spark: SparkSession, path: str, id: str = "id", vector: str = "vector") -> None:
        super().__init__(spark, path, {"rows": [], "removed": [], "sizes": {}, "lists": 0, "replicas": 1, "metric": "l2", "codec": None, "model": None, "live": 0, "churn": 0, "lsn": 0, "gone": []})
        self.id, self.vector = id, vector
        self._read: tuple[str, np.ndarray, object] | None = None

    # the model: centres and codec

    def _model(self, m: dict) -> tuple[np.ndarray, object]:
        if m["model"] is None:
            return np.zeros((0, 0)), None
        if self._read is None or self._read[0] != m["model"]:
            row = self.spark.read.parquet(f"{self.path}/{m['model']}").first()
            with np.load(io.BytesIO(bytes(row["arrays"]))) as arrays:
                found = dict(arrays)
            centres = found.pop("centres")
            self._read = (m["model"], centres, None if m["codec"] is None else codecs.from_arrays(m["codec"], found))
        return self._read[1:]

    def _train(self, df: DataFrame, m: dict, sample: int, rounds: int) -> None:
        rows = df.where(F.col(self.vector).isNotNull())
        got = rows.orderBy(F.xxhash64(self.id)).select(F.col(self.vector).cast("array<float>")).limit(sample).toArrow()  # `sample` rows at most
        x = np.array(got.column(0).to_pylist(), np.float32)
        centres = codecs.kmeans(_unit(x) if m["metric"] == "cosine" and len(x) else x, m["lists"], rounds) if m["lists"] and len(x) else np.zeros((0, 0))
        arrays = {"centres": centres}
        if m["codec"] is not None and len(x):
            arrays |= codecs.to_arrays(codecs.train(rows, m["codec"], self.vector, self.id, sample))
        out = io.BytesIO()
        np.savez(out, **arrays)
        m["model"] = f"model-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(out.getvalue(),)], "arrays binary").coalesce(1).write.parquet(f"{self.path}/{m['model']}")

    def _dealt(self, df: DataFrame, m: dict) -> DataFrame:
        """df with list_id (a row for each of the `replicas` nearest lists), own (whether it is the nearest) and code."""
        centres, model = self._model(m)
        metric, replicas = m["metric"], min(m["replicas"], max(1, len(centres)))
        shared = df.sparkSession.sparkContext.broadcast(centres)  # as many centres as there are lists

        @F.pandas_udf("array<int>")
        def near(v):
            import pandas as pd

            x = np.stack(v.to_numpy()).astype(np.float64)
            c = shared.value
            if not len(c):
                return pd.Series([[0]] * len(x))
            x = _unit(x) if metric == "cosine" else x
            if replicas == 1:
                return pd.Series([[int(k)] for k in nearest_centre(x, c)])
            d = (c**2).sum(1)[None] - 2 * x @ c.T
            return pd.Series(np.argsort(d, axis=1, kind="stable")[:, :replicas].astype(np.int32).tolist())

        out = df.where(F.col(self.vector).isNotNull())
        out = codecs.encode(out, model, self.vector) if model is not None else out.withColumn("code", F.lit(None).cast("binary"))
        return out.select("*", F.posexplode(near(F.col(self.vector).cast("array<float>"))).alias("__k", "list_id")).withColumn("own", F.col("__k") == 0).drop("__k")

    def _write(self, dealt: DataFrame, m: dict) -> None:
        name = f"rows-{uuid.uuid4().hex}"
        sizes = {r["list_id"]: r["n"] for r in dealt.groupBy("list_id").agg(F.count("*").alias("n")).collect()}  # a row for each list
        large = {k: -(-n // LIST_ROWS) for k, n in sizes.items() if n > LIST_ROWS}
        tasks = F.coalesce(*(F.when(F.col("list_id") == k, F.lit(n)) for k, n in large.items()), F.lit(1)) if large else F.lit(1)
        salted = dealt.withColumn("__salt", F.pmod(F.xxhash64(self.id), tasks))
        salted.repartition("list_id", "__salt").drop("__salt").write.partitionBy("list_id").option("compression", "zstd").parquet(f"{self.path}/{name}")
        m["lsn"] += 1
        m["rows"].append({"name": name, "lsn": m["lsn"]})

    # changes

    def build(self, df: DataFrame, lists: int = 16, metric: str = "l2", codec: str | None = None, replicas: int = 1, sample: int = 100_000, rounds: int = 25) -> ListIndex:
        """Centres and codec are fitted on at most `sample` rows, chosen by a hash; every row is dealt. A row is in its
        `replicas` nearest lists, which helps at their borders. Rows without a vector are left out; ids must differ."""
        if codec is not None and codec not in codecs.CODECS:
            raise ValueError(f"unknown codec {codec!r}")
        with self.writing():
            m = self.manifest()
            old = [*(r["name"] for r in m["rows"]), *(r["name"] for r in m["removed"]), *([m["model"]] if m["model"] else [])]
            m |= {"rows": [], "removed": [], "lists": lists, "metric": metric, "codec": codec, "replicas": replicas, "churn": 0}
            self._train(df, m, sample, rounds)
            self._write(self._dealt(df, m), m)
            self._counted(m)
            before, m["gone"] = m["gone"], old
            self.publish(m)
            self.delete(before)
        return self

    def _counted(self, m: dict) -> None:
        rows = self._rows(m)
        found = rows.groupBy("list_id").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("own")).collect()  # a row for each list
        m["sizes"], m["live"] = {str(r["list_id"]): r["n"] for r in found}, int(sum(r["own"] for r in found))

    def upsert(self, df: DataFrame) -> None:
        """Rows under new or known ids, dealt to the lists as they are."""
        with self.writing():
            m = self.manifest()
            m["churn"] += df.join(self._rows(m).where("own").select(self.id), self.id, "left_semi").count()
            self._write(self._dealt(df, m), m)
            self._counted(m)
            self.publish(m)

    def remove(self, ids: DataFrame) -> int:
        """How many of some ids were there; they are gone."""
        with self.writing():
            m = self.manifest()
            found = ids.select(self.id).distinct().join(self._rows(m).where("own").select(self.id), self.id, "left_semi")
            name = f"removed-{uuid.uuid4().hex}"
            found.write.parquet(f"{self.path}/{name}")
            n = self.spark.read.parquet(f"{self.path}/{name}").count()
            m["lsn"] += 1
            m["removed"].append({"name": name, "lsn": m["lsn"]})
            m["churn"] += n
            self._counted(m)
            self.publish(m)
        return n

    def upkeep(self) -> None:
        """Folds changes in: one folder of what lives, each row in the lists that are nearest to it."""
        with self.writing():
            m = self.manifest()
            live = self.vectors()
            old = [*(r["name"] for r in m["rows"]), *(r["name"] for r in m["removed"])]
            before, m["gone"], m["rows"], m["removed"], m["churn"] = m["gone"], old, [], [], 0
            self._write(self._dealt(live, m), m)
            self._counted(m)
            self.publish(m)
            self.delete(before)

    def rebuild(self, sample: int = 100_000, rounds: int = 25) -> None:
        """As built anew from what lives: centres and codec trained again."""
        m = self.manifest()
        self.build(self.vectors(), m["lists"], m["metric"], m["codec"], m["replicas"], sample, rounds)

    # reading

    def _rows(self, m: dict) -> DataFrame:
        """What lives, with list_id, own and code: the last change of each id counts."""
        if not m["rows"]:
            return self.spark.createDataFrame([], f"{self.id} long, {self.vector} array<float>, code binary, own boolean, list_id int")
        parts = [self.spark.read.parquet(f"{self.path}/{r['name']}").withColumn("__lsn", F.lit(r["lsn"])) for r in m["rows"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        if len(parts) > 1 or m["removed"]:
            marks = [p.where("own").select(self.id, "__lsn") for p in parts]
            marks += [self.spark.read.parquet(f"{self.path}/{r['name']}").select(self.id, F.lit(r["lsn"]).alias("__lsn")) for r in m["removed"]]
            last = marks[0]
            for x in marks[1:]:
                last = last.unionByName(x)
            out = out.join(last.groupBy(self.id).agg(F.max("__lsn").alias("__lsn")), [self.id, "__lsn"], "left_semi")
        return out.drop("__lsn")

    def vectors(self) -> DataFrame:
        """The live rows, once each."""
        return self._rows(self.manifest()).where("own").drop("list_id", "own", "code")

    def list_of(self, key: int) -> int | None:
        row = self._rows(self.manifest()).where(F.col("own") & (F.col(self.id) == key)).select("list_id").first()
        return None if row is None else row[0]

    def sizes(self) -> dict[int, int]:
        return {int(k): n for k, n in self.manifest()["sizes"].items()}

    def search(self, query, k: int, probes: int = 8, candidates: int = 64, flt=None, stats: dict | None = None) -> DataFrame:
        """rank, id, distance. With all lists, and no codec or as many candidates as rows, it is exact.

        The nearest `probes` lists are read, and further ones until they hold k matches. A filter that few rows match
        is answered exactly from those. With a codec, `candidates` rows are chosen by their codes and ordered by their
        vectors.
        """
        m = self.manifest()
        centres, model = self._model(m)
        rows = where(self._rows(m), flt)
        sizes = {int(x): n for x, n in m["sizes"].items()}
        if flt is not None:
            sizes = {r["list_id"]: r["n"] for r in rows.groupBy("list_id").agg(F.count("*").alias("n")).collect()}  # a row for each list
        hits = sum(sizes.values())
        told = stats if stats is not None else {}
        told |= {"matches": hits, "selectivity": hits / max(1, sum(m["sizes"].values()))}
        if hits <= max(candidates, k) or not len(centres):
            told |= {"strategy": "exact", "reason": "few rows match" if len(centres) else "no lists", "probes": len(centres)}
            return knn(rows.where("own"), query, k, m["metric"], self.id, self.vector)
        q = np.array([query], np.float64)
        q = _unit(q) if m["metric"] == "cosine" else q
        near = np.lexsort((np.arange(len(centres)), ((centres - q) ** 2).sum(1))).tolist()
        found = np.cumsum([sizes.get(x, 0) for x in near]) // max(1, m["replicas"])
        probes = min(len(near), max(probes, int(np.searchsorted(found, k)) + 1))
        told |= {"strategy": "lists", "reason": "the nearest lists", "probes": probes}
        if probes < len(near):
            rows = rows.where(F.col("list_id").isin(near[:probes]))
        else:
            rows = rows.where("own")
        if model is not None:
            few = codecs.coded_best(rows.select(self.id, "code"), model, query, max(candidates, k) * m["replicas"], m["metric"], self.id).select(self.id).distinct()
            rows = rows.join(F.broadcast(few), self.id, "left_semi")  # `candidates` rows
        best = rows.dropDuplicates([self.id]) if m["replicas"] > 1 else rows
        return knn(best, query, k, m["metric"], self.id, self.vector)

    def search_within(self, query, k: int, seconds: float | None = None, cancel: Callable[[], bool] | None = None, progress: Callable[[float], None] | None = None, wave: int = 4, flt=None) -> tuple[list[tuple[int, float]], dict]:
        """(id, distance) of the best rows found until time is up or cancel() gives true, and how far that went.

        Lists are searched in waves, the nearest first, each a job of its own; time and cancel are looked at between
        waves, so the first wave is always searched. All waves make the answer exact. progress gets the share of lists.
        """
        m = self.manifest()
        centres, _ = self._model(m)
        rows = where(self._rows(m), flt).where("own")
        q = np.array([query], np.float64)
        q = _unit(q) if m["metric"] == "cosine" else q
        near = np.lexsort((np.arange(len(centres)), ((centres - q) ** 2).sum(1))).tolist() if len(centres) else [0]
        began, best, probed = time.monotonic(), [], 0
        while probed < len(near):
            part = rows.where(F.col("list_id").isin(near[probed : probed + wave]))
            found = knn(part, query, k, m["metric"], self.id, self.vector).collect()  # k rows
            best = sorted([*best, *((r[self.id], r["distance"]) for r in found)], key=lambda x: (x[1], x[0]))[:k]
            probed = min(len(near), probed + wave)
            if progress is not None:
                progress(probed / len(near))
            if probed < len(near) and (seconds is not None and time.monotonic() - began >= seconds or cancel is not None and cancel()):
                break
        return best, {"probes": probed, "lists": len(near), "stopped_early": probed < len(near)}

    def health(self, queries: int = 20, k: int = 10, probes: int = 8) -> dict:
        """Rows, balance of the lists, distance to centres, error of the codec, churn, and recall on some stored rows."""
        m = self.manifest()
        centres, model = self._model(m)
        rows = self._rows(m).where("own")
        sizes = self.sizes()
        out = {"live": m["live"], "lists": len(centres), "segments": len(m["rows"]), "churn": m["churn"] / max(1, m["live"])}
        out["balance"] = max(sizes.values(), default=0) / max(1e-9, sum(sizes.values()) / max(1, len(centres)))
        if len(centres) and m["metric"] == "l2":
            table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres.astype(np.float32))], "list_id int, centre array<float>")
            out["centre_distance"] = rows.join(F.broadcast(table), "list_id").agg(F.avg(distance(F.col(self.vector), F.col("centre"), "l2"))).first()[0]  # a row for each list
        if model is not None:
            out["codec_error"] = codecs.error(rows.select(self.vector), model, self.vector).first()[0]
        some = rows.orderBy(F.xxhash64(self.id)).limit(queries).select(self.id, self.vector).collect()  # `queries` rows
        asked = self.spark.createDataFrame([(r[0], [float(x) for x in r[1]]) for r in some], "query_id long, vector array<float>")
        found = None
        for r in some:
            one = self.search(r[1], k, probes).withColumn("query_id", F.lit(r[0]).cast("long"))
            found = one if found is None else found.unionByName(one)
        if found is not None:
            exact = knn_join(asked, rows, k, m["metric"], id=self.id, vector=self.vector)
            out["recall"] = recall(found.withColumnRenamed(self.id, "id"), exact).agg(F.avg("recall")).first()[0]
        return out


def search_all(index: ListIndex, queries: DataFrame, k: int, probes: int = 8, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
    """query_id, rank, id, distance for a table of queries: each asks its own nearest lists.

    Queries and rows meet by list, in one shuffle of each; a task multiplies a list's rows with the queries that ask it,
    in steps, and hands on k per query. A list that many queries ask is split by rows.
    """
    m = index.manifest()
    centres, _ = index._model(m)
    metric, parts = m["metric"], {int(x): -(-n // LIST_ROWS) for x, n in m["sizes"].items()}
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def near(v):
        import pandas as pd

        x = np.stack(v.to_numpy()).astype(np.float64)
        x = _unit(x) if metric == "cosine" else x
        d = (shared.value**2).sum(1)[None] - 2 * x @ shared.value.T
        return pd.Series(np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32).tolist())

    salt = F.coalesce(*(F.when(F.col("list_id") == x, F.lit(n)) for x, n in parts.items() if n > 1), F.lit(1))
    asked = queries.select(F.col(query_id).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("v"), F.explode(near(F.col(vector).cast("array<float>"))).alias("list_id"))
    asked = asked.select(F.lit(True).alias("asks"), "key", "v", "list_id", F.explode(F.sequence(F.lit(0), salt - 1)).alias("part"))
    rows = index._rows(m).select(F.lit(False).alias("asks"), F.col(index.id).cast("long").alias("key"), F.col(index.vector).cast("array<float>").alias("v"), "list_id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), salt).cast("int"))
    both = asked.unionByName(rows).repartition("list_id", "part").sortWithinPartitions("list_id", "part", F.desc("asks"))
    every = both.mapInArrow(_meet(k, metric), "query_id long, id long, distance double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _meet(k: int, metric: str):
    """Runs of a list's queries and then its rows: the k closest rows for each query."""

    def best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        q, v = (_unit(q), _unit(v)) if metric == "cosine" else (q, v)
        d = -q @ v.T
        d = 2 * d + (q**2).sum(1)[:, None] + (v**2).sum(1)[None] if metric == "l2" else np.maximum(0, 1 + d) if metric == "cosine" else d
        n = min(k, len(ids))
        at = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :n]
        found = np.take_along_axis(d, at, 1)
        if metric == "l2":  # as exact as by differences
            found = np.stack([((q[i] - v[at[i]]) ** 2).sum(1) for i in range(len(q))]) if len(q) else found
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(ids[at].ravel()), pa.array(found.ravel())], names=["query_id", "id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, qid, q = None, np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            place = np.stack([batch.column("list_id").to_numpy(), batch.column("part").to_numpy()], 1)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = (place[1:] != place[:-1]).any(1) | (asks[1:] != asks[:-1])
            edges = np.append(np.flatnonzero(new), len(keys))
            for b, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                v = batch.column("v").slice(b, e - b).flatten().to_numpy().astype(np.float64).reshape(e - b, -1)
                here = tuple(place[b])
                if asks[b]:
                    more = at == here and len(qid)
                    qid, q = (np.concatenate([qid, keys[b:e]]), np.concatenate([q, v])) if more else (keys[b:e], v)
                    at = here
                elif here == at:
                    for i in range(0, e - b, 2048):
                        for j in range(0, len(qid), 256):
                            yield best(qid[j : j + 256], q[j : j + 256], keys[b + i : min(e, b + i + 2048)], v[i : i + 2048])

    return run
