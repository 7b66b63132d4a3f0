"""Stored postings: texts or sparse vectors as rows of term, id and weight, dealt to files by their term.

A search reads the files of its terms only, and in them, as rows are sorted by term, the row groups that hold them.
Changes add segments; the last segment of an id counts. Compaction makes one segment of what lives.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.filters import where
from marlstone.operators.sparse import BM25, postings, sparse_postings, top
from marlstone.sources.store import Folder

#: Dead documents from which, if they are more than the live ones, an index is compacted by itself.
DEAD = 1024


class Postings(Folder):
    """path: a folder. model: how texts become terms; None for sparse vectors, whose terms are numbers below 2^32.

    buckets: folders that terms are dealt to; about the number of terms that a search should be able to tell apart,
    and few enough that each holds files of a good size.
    """

    def __init__(self, spark: SparkSession, path: str, model: BM25 | None = BM25(), buckets: int = 64, id: str = "id") -> None:
        super().__init__(spark, path, {"lsn": 0, "segments": [], "buckets": buckets, "dead": 0, "live": 0, "texts": 0, "id": "bigint", "gone": []})
        self.model, self.id = model, id

    # changes

    def _segment(self, posts: DataFrame, docs: DataFrame, m: dict) -> None:
        name = f"segment-{uuid.uuid4().hex}"
        bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(m["buckets"])).cast("int")
        rows = posts.withColumn("bucket", bucket).withColumnRenamed(self.id, "id")
        # a bucket's rows go to one task; AQE splits one that is large
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
        rows.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{name}/postings")
        docs.withColumnRenamed(self.id, "id").write.option("compression", "zstd").parquet(f"{self.path}/{name}/documents")
        m["lsn"] += 1
        made = self._fs.listStatus(self._p(f"{name}/postings"))
        buckets = [int(x) for s in made if (x := s.getPath().getName().removeprefix("bucket=")).isdigit()]
        m["segments"].append({"name": name, "lsn": m["lsn"], "buckets": sorted(buckets)})
        m["id"] = dict(docs.dtypes)[self.id]

    def _changed(self, posts: DataFrame, docs: DataFrame) -> int:
        with self.writing():
            m = self.manifest()
            if docs.groupBy(self.id).count().where(f"count > 1 or `{self.id}` is null").limit(1).count():
                raise ValueError("ids must be there and differ within a change")
            new = docs.select(F.col(self.id).alias("id")) if not m["segments"] else docs.select(F.col(self.id).alias("id")).join(self._live(m).select("id"), "id", "left_anti")
            added = new.count()
            self._segment(posts, docs, m)
            self._counted(m)
            self.publish(m)
            if m["dead"] > DEAD and m["dead"] > m["live"]:
                self.compact()
        return added

    def _counted(self, m: dict) -> None:
        """Live documents, those with terms, and rows of documents that have been replaced or removed."""
        m["live"], m["texts"] = self._live(m).agg(F.count("*"), F.count(F.when(F.col("counts"), 1))).first()
        m["dead"] = self._documents(m).count() - m["live"]

    def upsert(self, df: DataFrame, text: str = "text", indices: str = "indices", values: str = "values") -> int:
        """Documents with their texts, or sparse vectors, under new or known ids; how many are new. Documents with an
        empty or null text, or no vector, are stored without terms and don't count in statistics."""
        if self.model is None:
            posts = sparse_postings(df.where(F.col(indices).isNotNull()), self.id, indices, values)
            bad = posts.where("term < 0 or term >= 4294967296 or isnan(weight) or abs(weight) = double('inf')")
            if not bad.isEmpty():
                raise ValueError("terms have 32 bits and weights are finite")
            posts = posts.withColumn("frequency", F.lit(1).cast("long")).withColumn("term", F.col("term").cast("string"))
            docs = df.select(self.id, F.col(indices).isNotNull().alias("counts"), F.lit(False).alias("removed"))
        else:
            posts = postings(df, self.model, self.id, text)
            docs = df.select(self.id, F.coalesce(F.col(text) != "", F.lit(False)).alias("counts"), F.lit(False).alias("removed"))
        posts = posts.select(F.col("id" if "id" in posts.columns else self.id).alias(self.id), "term", "frequency", "weight")
        return self._changed(posts, docs)

    def add(self, df: DataFrame, **columns) -> int:
        """As upsert(), but an id that is there already is an error."""
        if not df.select(F.col(self.id).alias("id")).join(self.live().select("id"), "id", "left_semi").isEmpty():
            raise ValueError("an id is taken")
        return self.upsert(df, **columns)

    def update(self, df: DataFrame, **columns) -> bool:
        """As upsert(), if all ids are there; else nothing changes and the answer is False."""
        if not df.select(F.col(self.id).alias("id")).join(self.live().select("id"), "id", "left_anti").isEmpty():
            return False
        self.upsert(df, **columns)
        return True

    def remove(self, ids: DataFrame | Sequence[int]) -> int:
        """How many of some ids were there; they are gone."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(x),) for x in set(ids)], f"{self.id} long")
        with self.writing():
            m = self.manifest()
            found = ids.select(F.col(self.id).alias("id")).distinct().join(self._live(m).select("id"), "id", "left_semi")
            n = found.count()
            if n:
                gone = found.select(F.col("id").alias(self.id), F.lit(False).alias("counts"), F.lit(True).alias("removed"))
                none = self.spark.createDataFrame([], f"{self.id} {dict(found.dtypes)['id']}, term string, frequency long, weight double")
                self._segment(none, gone, m)
                self._counted(m)
                self.publish(m)
                if m["dead"] > DEAD and m["dead"] > m["live"]:
                    self.compact()
        return n

    def remove_where(self, documents: DataFrame, flt) -> int:
        """Removes the documents that a filter matches; documents: their table of metadata."""
        return self.remove(where(documents, flt).select(self.id))

    def compact(self) -> None:
        """One segment of what lives; what the compaction before has replaced is deleted."""
        with self.writing():
            m = self.manifest()
            live, posts = self._live(m), self._postings(m)
            before, m["gone"], m["segments"] = m["gone"], [s["name"] for s in m["segments"]], []
            self._segment(posts.withColumnRenamed("id", self.id), live.select(F.col("id").alias(self.id), "counts", F.lit(False).alias("removed")), m)
            self._counted(m)
            self.publish(m)
            self.delete(before)

    # reading

    def _documents(self, m: dict) -> DataFrame:
        schema = f"id {m['id']}, counts boolean, removed boolean"
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{s['name']}/documents").withColumn("lsn", F.lit(s["lsn"])) for s in m["segments"]]
        out = parts[0] if parts else self.spark.createDataFrame([], schema).withColumn("lsn", F.lit(0))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _live(self, m: dict) -> DataFrame:
        """id, counts, lsn of the documents that are there: the last segment of each id counts."""
        docs = self._documents(m)
        if len(m["segments"]) > 1:
            last = docs.groupBy("id").agg(F.max_by(F.struct("counts", "removed", "lsn"), "lsn").alias("x"))
            docs = last.select("id", "x.*")
        return docs.where("not removed").drop("removed")

    def live(self) -> DataFrame:
        return self._live(self.manifest())

    def _postings(self, m: dict, terms: Sequence[str] | None = None) -> DataFrame:
        schema = f"id {m['id']}, term string, frequency long, weight double, bucket int"
        parts = []
        for s in m["segments"]:
            base = f"{self.path}/{s['name']}/postings"
            wanted = s["buckets"] if terms is None else sorted({zlib.crc32(t.encode()) % m["buckets"] for t in terms} & set(s["buckets"]))
            if not wanted:
                continue
            # only the folders that are read are listed
            paths = [base] if terms is None else [f"{base}/bucket={b}" for b in wanted]
            rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
            rows = rows if terms is None else rows.where(F.col("term").isin(list(terms)))
            parts.append(rows.withColumn("lsn", F.lit(s["lsn"])))
        out = parts[0] if parts else self.spark.createDataFrame([], schema).withColumn("lsn", F.lit(0))
        for p in parts[1:]:
            out = out.unionByName(p)
        if len(m["segments"]) > 1:
            out = out.join(self._live(m).select("id", "lsn"), ["id", "lsn"], "left_semi")
        return out.select("id", "term", "frequency", "weight")

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """id, term, frequency, weight of the live documents, or of some terms only."""
        return self._postings(self.manifest(), None if terms is None else [str(t) for t in terms])

    def records(self) -> DataFrame:
        """id and its terms with their weights, by id; for sparse vectors the terms are numbers."""
        term = F.col("term").cast("long") if self.model is None else F.col("term")
        each = self.postings().groupBy("id").agg(F.sort_array(F.collect_list(F.struct(term.alias("term"), "weight"))).alias("t"))
        return self.live().select("id").join(each, "id", "left").select("id", F.coalesce(F.col("t.term"), F.array()).alias("terms"), F.coalesce(F.col("t.weight"), F.array()).alias("weights")).orderBy("id")

    def document_frequency(self, terms: Sequence[str] | None = None) -> DataFrame:
        """term, df: in how many live documents each term stands."""
        return self.postings(terms).groupBy("term").agg(F.count("*").alias("df"))

    def stats(self) -> dict:
        """How many different terms and postings there are, and documents that live or are dead but still stored."""
        m = self.manifest()
        n, terms = self._postings(m).agg(F.count("*"), F.count_distinct("term")).first()
        return {"terms": terms, "postings": n, "live": m["live"], "dead": m["dead"], "segments": len(m["segments"])}

    # search

    def scores(self, weights: dict[str, float]) -> DataFrame:
        """id, score of the documents that share a term with weights, whatever the score."""
        asked = {str(t): float(w) for t, w in weights.items()}
        posts = self.postings(list(asked))
        if not asked:
            return posts.select("id", F.lit(0.0).alias("score"))
        table = F.create_map(*(F.lit(x) for t, w in asked.items() for x in (t, w)))
        return posts.groupBy("id").agg(F.round(F.sum(F.col("weight") * F.element_at(table, F.col("term"))), 9).alias("score"))

    def query_weights(self, query: str) -> dict[str, float]:
        """The idf of each term of a text, once for each time it occurs; terms of no document are left out."""
        m = self.manifest()
        asked, n = self.model.words(query), m["texts"]
        df = {r["term"]: r["df"] for r in self._postings(m, sorted(set(asked))).groupBy("term").agg(F.count("*").alias("df")).collect()}  # the query's terms
        out: dict[str, float] = {}
        for t in asked:
            if t in df:
                out[t] = out.get(t, 0.0) + math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        return out

    def search(self, query: str | dict, k: int, documents: DataFrame | None = None, flt=None, among: DataFrame | None = None) -> DataFrame:
        """rank, id, score of the k best documents for a text, or for weights by term.

        Statistics cover all live documents; a filter on documents (their table of metadata) and a table of ids that
        may be found apply to the results.
        """
        found = self.scores(self.query_weights(query) if isinstance(query, str) else query)
        if flt is not None:
            found = found.join(where(documents, flt).select(F.col(self.id).alias("id")), "id", "left_semi")
        if among is not None:
            found = found.join(among.select(F.col(self.id).alias("id")), "id", "left_semi")
        return top(found, k)

