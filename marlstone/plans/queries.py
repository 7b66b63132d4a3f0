"""Registered queries: each applies an operator to the driver's tables; SQL holds the same in DuckDB's terms."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import dates, text, vectors
from marlstone.functions.geo import geo_distance_m
from marlstone.operators import aggregates as A
from marlstone.operators import codecs, fusion, knn, mutations, scoring, search, sparse
from marlstone.operators.filters import Filter, where
from marlstone.operators.lists import ListIndex, search_all
from marlstone.operators.payload import PayloadIndex
from marlstone.operators.postings import Postings
from marlstone.sources.store import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A fixed "now" for queries with ages.
NOW = 1_705_276_800_000
WORDS = "the of and that tion"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, d: str, key: int = 0) -> list[float]:
    return read(spark, d, "embeddings").where(F.col("vec_id") == key).select("embedding").first()[0]


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with the metadata of the documents of the same id."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    return vecs(spark, d).join(docs, "id")


_INDEXES: dict[tuple, object] = {}


def indexed(kind: str, spark: SparkSession, d: str):
    """A stored index over the tables of a folder, built once in a session by whichever query needs it first."""
    key = (spark.sparkContext.applicationId, kind, d)
    if key not in _INDEXES:
        path = f"{shared_folder(spark)}/index-{kind}-{uuid.uuid4().hex}"
        _INDEXES[key] = BUILDERS[kind](spark, d, path)
    return _INDEXES[key]


def _text_index(spark: SparkSession, d: str, path: str) -> Postings:
    index = Postings(spark, path)
    index.upsert(texts(spark, d))
    return index


def _sparse_index(spark: SparkSession, d: str, path: str) -> Postings:
    index = Postings(spark, path, None)
    index.upsert(sparse_rows(spark, d))
    return index


BUILDERS = {
    "text": _text_index,
    "sparse": _sparse_index,
    "payload": lambda spark, d, path: PayloadIndex(spark, path).build(items(spark, d), ["brand", "tags", "even"]),
    "lists": lambda spark, d, path: ListIndex(spark, path).build(vecs(spark, d), 16, replicas=2),
    "coded": lambda spark, d, path: ListIndex(spark, path).build(vecs(spark, d), 8, "cosine", "pq", replicas=2),
}


def items(spark: SparkSession, d: str) -> DataFrame:
    """Parts with two tags, a place, and a size that every seventh lacks."""
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        k.alias("id"), F.array("p_type", "p_brand").alias("tags"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"),
        F.when(k % 7 != 0, F.col("p_size").cast("long")).alias("size"), (k % 2 == 0).alias("even"),
        ((k * 37 % 1800) / 10.0 - 90).alias("lat"), ((k * 91 % 3600) / 10.0 - 180).alias("lon"),
    )


ITEMS = """i AS (SELECT p_partkey AS id, [p_type, p_brand] AS tags, p_brand AS brand, p_retailprice AS price,
  CASE WHEN p_partkey % 7 <> 0 THEN p_size::BIGINT END AS size, p_partkey % 2 = 0 AS even,
  (p_partkey * 37 % 1800) / 10.0 - 90 AS lat, (p_partkey * 91 % 3600) / 10.0 - 180 AS lon FROM part)"""
Q = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT)"


def sql_distance(metric: str, a: str = "embedding", b: str = "q") -> str:
    if metric == "l2":
        return _L2.format(a=a, b=b)
    if metric == "ip":
        return "-" + _DOT.format(a=a, b=b)
    return "greatest(0, 1 - " + _DOT.format(a=_unit(a), b=_unit(b)) + ")"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _knn(metric: str, spark: SparkSession, d: str) -> DataFrame:
    return rounded(knn.knn(vecs(spark, d), query_vector(spark, d), 10, metric), "distance")


def _batch(metric: str, spark: SparkSession, d: str) -> DataFrame:
    q = vecs(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return rounded(knn.knn_join(q, vecs(spark, d), 10, metric), "distance", digits=5).select("query_id", "rank", "id", "distance")


for m in vectors.METRICS:
    register(f"knn_{m}", f"""WITH {Q}, s AS (SELECT vec_id AS id, {sql_distance(m)} AS d FROM embeddings, q)
      SELECT (row_number() OVER (ORDER BY d, id))::INT AS rank, id, round(d, 6) + 0.0 AS distance FROM s ORDER BY d, id LIMIT 10""")(partial(_knn, m))
    register(f"knn_batch_{m}", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {sql_distance(m, 'b.embedding', 'a.embedding')} AS d
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM s)
      SELECT query_id, rank::INT AS rank, id, round(d, 5) + 0.0 AS distance FROM r WHERE rank <= 10""")(partial(_batch, m))


@register("knn_filtered", f"""WITH {Q}, s AS (SELECT vec_id AS id, {sql_distance('cosine')} AS d FROM embeddings JOIN documents ON vec_id = doc_id, q WHERE lang = 'en' AND n_chars >= 200)
  SELECT (row_number() OVER (ORDER BY d, id))::INT AS rank, id, round(d, 6) + 0.0 AS distance FROM s ORDER BY d, id LIMIT 10""")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    flt = Filter.eq("lang", "en") & Filter.ge("n_chars", 200)
    return rounded(knn.knn(stored(spark, d), query_vector(spark, d), 10, "cosine", flt=flt), "distance")


@register("knn_among", f"""WITH {Q}, s AS (SELECT vec_id AS id, {sql_distance('l2')} AS d FROM embeddings, q WHERE vec_id IN (3, 5, 8, 13, 21, 34, 55, 89))
  SELECT (row_number() OVER (ORDER BY d, id))::INT AS rank, id, round(d, 6) + 0.0 AS distance FROM s ORDER BY d, id LIMIT 5""")
def knn_among(spark: SparkSession, d: str) -> DataFrame:
    return rounded(knn.among(vecs(spark, d), [3, 5, 8, 13, 21, 34, 55, 89, 5, -1], query_vector(spark, d), 5), "distance")


@register("knn_truncated", f"""WITH {Q}, s AS (SELECT vec_id AS id, {sql_distance('cosine', 'embedding[1:16]', 'q[1:16]')} AS d FROM embeddings, q)
  SELECT (row_number() OVER (ORDER BY d, id))::INT AS rank, id, round(d, 6) + 0.0 AS distance FROM s ORDER BY d, id LIMIT 10""")
def knn_truncated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(knn.knn(vecs(spark, d), query_vector(spark, d), 10, "cosine", dims=16), "distance")


@register("knn_by_id", f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id AS id, {sql_distance('l2')} AS d FROM embeddings, q WHERE vec_id <> 7)
  SELECT (row_number() OVER (ORDER BY d, id))::INT AS rank, id, round(d, 6) + 0.0 AS distance FROM s ORDER BY d, id LIMIT 10""")
def knn_by_id(spark: SparkSession, d: str) -> DataFrame:
    return rounded(knn.knn_by_id(vecs(spark, d), 7, 10), "distance")


@register("range_l2", f"WITH {Q}, s AS (SELECT vec_id AS id, {sql_distance('l2')} AS d FROM embeddings, q) SELECT id, round(d, 6) + 0.0 AS distance FROM s WHERE d <= 1.44")
def range_l2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(knn.range_search(vecs(spark, d), query_vector(spark, d), vectors.l2_radius(1.2)), "distance")


@register("range_cosine", f"WITH {Q}, s AS (SELECT vec_id AS id, {sql_distance('cosine')} AS d FROM embeddings, q) SELECT id, round(d, 6) + 0.0 AS distance FROM s WHERE d <= 0.8 ORDER BY d, id LIMIT 50")
def range_cosine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(knn.range_search(vecs(spark, d), query_vector(spark, d), 0.8, 50, "cosine"), "distance")


@register("lists_all_probes", SQL["knn_l2"])
def lists_all_probes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(knn.InvertedLists.train(vecs(spark, d), 16).search(query_vector(spark, d), 10, 16), "distance")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries of all recall figures: every row whose id is divisible by 20."""
    return vecs(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


@register("knn_self", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {sql_distance('ip', 'b.embedding', 'a.embedding')} AS d FROM embeddings a, embeddings b),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM s) SELECT query_id, rank::INT AS rank, id, round(d, 5) + 0.0 AS distance FROM r WHERE rank <= 5""")
def knn_self(spark: SparkSession, d: str) -> DataFrame:
    """All rows as queries."""
    q = vecs(spark, d).select(F.col("id").alias("query_id"), "vector")
    return rounded(knn.knn_join(q, vecs(spark, d), 5, "ip"), "distance", digits=5).select("query_id", "rank", "id", "distance")


register("lists_stored", SQL["knn_l2"])(lambda s, d: rounded(indexed("lists", s, d).search(query_vector(s, d), 10, 16), "distance"))
register("lists_batch", SQL["knn_batch_l2"])(lambda s, d: rounded(search_all(indexed("lists", s, d), _asked(s, d), 10, 16), "distance", digits=5).select("query_id", "rank", "id", "distance"))


@register("lists_filtered", f"""WITH {Q}, s AS (SELECT vec_id AS id, {sql_distance('l2')} AS d FROM embeddings, q WHERE label = 3)
  SELECT (row_number() OVER (ORDER BY d, id))::INT AS rank, id, round(d, 6) + 0.0 AS distance FROM s ORDER BY d, id LIMIT 5""")
def lists_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Lists are probed until they hold enough matches; with all of them the answer is exact."""
    return rounded(indexed("lists", spark, d).search(query_vector(spark, d), 5, 16, flt=Filter.eq("label", 3)), "distance")


@register("coded_stored", SQL["knn_cosine"])
def coded_stored(spark: SparkSession, d: str) -> DataFrame:
    """Product codes in lists with two copies of each row; as many candidates as rows make it exact."""
    return rounded(indexed("coded", spark, d).search(query_vector(spark, d), 10, 8, candidates=100_000), "distance")


@register("lists_recall")
def lists_recall(spark: SparkSession, d: str) -> DataFrame:
    """Half of the lists, with each row in its two nearest ones, against all rows: a row for each stated query."""
    return knn.recall(search_all(indexed("lists", spark, d), _asked(spark, d), 10, 8), knn.knn_join(_asked(spark, d), vecs(spark, d), 10))


@register("normalize", f"SELECT vec_id AS id, round(list_sum(list_transform({_unit('embedding')}, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS length FROM embeddings")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.normalize(F.col("vector"))
    return vecs(spark, d).select("id", F.round(vectors.dot(v, v), 5).alias("length"))


@register("relevance", f"""WITH {Q} SELECT vec_id AS id, round(1 / (1 + greatest(0, {sql_distance('l2')})), 6) AS l2, round(1 / (1 + exp({sql_distance('ip')})), 6) AS ip,
  round(least(1, greatest(0, 1 - {sql_distance('cosine')} / 2)), 6) AS cosine FROM embeddings, q""")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    q = vectors.literal(query_vector(spark, d))
    return vecs(spark, d).select("id", *(F.round(vectors.relevance(vectors.distance(F.col("vector"), q, m), m), 6).alias(m) for m in vectors.METRICS))


FILTERS: dict[str, tuple[Filter, str]] = {
    "eq": (Filter.eq("brand", "Brand#11"), "brand = 'Brand#11'"),
    "ne": (Filter.ne("size", 3), "size <> 3"),
    "not_eq": (~Filter.eq("size", 3), "size IS NULL OR size <> 3"),
    "lt": (Filter.lt("size", 12.5), "size < 12.5"),
    "le": (Filter.le("size", 10), "size <= 10"),
    "gt": (Filter.gt("price", 950), "price > 950"),
    "ge": (Filter.ge("price", 930.5), "price >= 930.5"),
    "between": (Filter.between("size", 5, 9.5), "size BETWEEN 5 AND 9.5"),
    "in": (Filter.in_("size", [1, 2.0, 3.5, 40]), "size IN (1, 2, 40)"),
    "in_none": (Filter.in_("size", []), "false"),
    "bool": (Filter.eq("even", True), "even"),
    "exists": (Filter.exists("size"), "size IS NOT NULL"),
    "missing": (Filter.missing("size"), "size IS NULL"),
    "has_tag": (Filter.has_tag("tags", "PROMO"), "list_contains(tags, 'PROMO')"),
    "any_tag": (Filter.has_any_tag("tags", ["Brand#11", "SMALL", "x"]), "list_has_any(tags, ['Brand#11', 'SMALL', 'x'])"),
    "all_tags": (Filter.has_all_tags("tags", ["Brand#13", "SMALL"]), "list_has_all(tags, ['Brand#13', 'SMALL'])"),
    "and_or_not": (~((Filter.lt("size", 20) & Filter.eq("even", True)) | Filter.gt("price", 960)), "NOT (coalesce(size < 20 AND even, false) OR price > 960)"),
    "geo_radius": (Filter.geo_radius("lat", "lon", 48.0, 11.0, 2_000_000), "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND 2 * 6371008.8 * asin(sqrt(least(1, greatest(0, pow(sin(radians(48 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48)) * pow(sin(radians(11 - lon) / 2), 2))))) <= 2000000"),
    "geo_box": (Filter.geo_box("lat", "lon", -30, 170, 30, -160), "lat BETWEEN -30 AND 30 AND (lon >= 170 OR lon <= -160)"),
}


def _filtered(flt: Filter, spark: SparkSession, d: str) -> DataFrame:
    return where(items(spark, d), flt).select("id")


for k, (flt, condition) in FILTERS.items():
    register(f"filter_{k}", f"WITH {ITEMS} SELECT id FROM i WHERE {condition}")(partial(_filtered, flt))


@register("geo_distance", f"WITH {ITEMS} SELECT id, round(2 * 6371008.8 * asin(sqrt(least(1, greatest(0, pow(sin(radians(48 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48)) * pow(sin(radians(11 - lon) / 2), 2))))), 2) AS metres FROM i")
def geo_distance(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", F.round(geo_distance_m(F.col("lat"), F.col("lon"), 48.0, 11.0), 2).alias("metres"))


@register("count_where", f"WITH {ITEMS} SELECT count(*)::BIGINT AS n FROM i WHERE size > 10")
def count_where(spark: SparkSession, d: str) -> DataFrame:
    return where(items(spark, d), Filter.gt("size", 10)).agg(F.count("*").alias("n"))


@register("facet_values", f"""WITH {ITEMS}, c AS (SELECT brand AS value, count(*) AS count FROM i GROUP BY 1)
  SELECT (row_number() OVER (ORDER BY count DESC, value))::INT AS place, value, count::BIGINT AS count FROM c ORDER BY count DESC, value LIMIT 10""")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    return A.facet_values(items(spark, d), A.FacetRequest("brand"))


@register("facet_tags", f"""WITH {ITEMS}, c AS (SELECT value, count(*) AS count FROM (SELECT DISTINCT id, unnest(tags) AS value FROM i) GROUP BY 1)
  SELECT (row_number() OVER (ORDER BY count DESC, value))::INT AS place, value, count::BIGINT AS count FROM c""")
def facet_tags(spark: SparkSession, d: str) -> DataFrame:
    return A.facet_values(items(spark, d), A.FacetRequest("tags", 0))


@register("facet_summary", f"""WITH {ITEMS}, c AS (SELECT size, count(*) AS n FROM i WHERE price > 930 AND size IS NOT NULL GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY n DESC, size) AS p FROM c)
  SELECT (SELECT count(size) FROM i WHERE price > 930)::BIGINT AS total, (SELECT count(*) - count(size) FROM i WHERE price > 930)::BIGINT AS missing,
  (SELECT count(*) FROM c)::BIGINT AS distinct, (SELECT coalesce(sum(n), 0) FROM r WHERE p > 10)::BIGINT AS other""".replace("AS distinct", 'AS "distinct"'))
def facet_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.facet_summary(items(spark, d), A.FacetRequest("size"), Filter.gt("price", 930))


@register("facet_ranges", f"""WITH {ITEMS}, b AS (SELECT * FROM (VALUES (0, NULL, 925.0), (1, 925.0, 950.0), (2, 950.0, 990.5), (3, 990.5, NULL)) t(bucket, low, high))
  SELECT bucket::INT AS bucket, low::DOUBLE AS low, high::DOUBLE AS high, (SELECT count(*) FROM i WHERE (low IS NULL OR price >= low) AND (high IS NULL OR price < high))::BIGINT AS count FROM b""")
def facet_ranges(spark: SparkSession, d: str) -> DataFrame:
    return A.facet_ranges(items(spark, d), A.FacetRequest("price", bounds=(925, 950, 990.5)))


@register("facets_for_ids", f"""WITH {ITEMS}, c AS (SELECT brand AS value, count(*) AS count FROM i WHERE id IN (1, 2, 3, 50, 60) GROUP BY 1)
  SELECT (row_number() OVER (ORDER BY count DESC, value))::INT AS place, value, count::BIGINT AS count FROM c""")
def facets_for_ids(spark: SparkSession, d: str) -> DataFrame:
    return A.facet_values(items(spark, d).where(F.col("id").isin(1, 2, 3, 50, 60)), A.FacetRequest("brand"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")


TOKENS = r"""t AS (SELECT doc_id AS id, lang, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM documents WHERE text <> '')"""
POSTINGS = TOKENS + """, e AS (SELECT id, lang, len(w) AS len, unnest(w) AS term FROM t), p AS (SELECT id, lang, term, len, count(*) AS f FROM e GROUP BY ALL),
  pw AS (SELECT id, lang, term, f, f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / 100.0)) AS weight FROM p), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  qw AS (SELECT term, ln(1 + ((SELECT count(*) FROM t) - df + 0.5) / (df + 0.5)) AS w FROM df WHERE term IN ('the', 'of', 'and', 'that', 'tion')),
  s AS (SELECT id, lang, round(sum(weight * w), 9) AS score FROM pw JOIN qw USING (term) GROUP BY ALL)"""


@register("tokenize", f"WITH {TOKENS} SELECT id, len(w)::BIGINT AS n, coalesce(w[1], '') AS first FROM t")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    w = text.tokenize(F.col("text"))
    return texts(spark, d).where("text <> ''").select("id", F.size(w).cast("long").alias("n"), F.coalesce(F.get(w, 0), F.lit("")).alias("first"))


@register("term_id", """SELECT DISTINCT p_brand AS token, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, len(p_brand) + 1), lambda i: ascii(p_brand[i])::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS id FROM part""")
def term_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_brand").alias("token")).distinct().select("token", text.term_id(F.col("token")).alias("id"))


@register("bm25_weights", f"WITH {POSTINGS} SELECT id, term, f::BIGINT AS frequency, round(weight, 6) AS weight FROM pw")
def bm25_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sparse.postings(texts(spark, d)), "weight")


@register("bm25_df", f"WITH {POSTINGS} SELECT term, df::BIGINT AS df FROM df")
def bm25_df(spark: SparkSession, d: str) -> DataFrame:
    return sparse.document_frequency(sparse.postings(texts(spark, d)))


@register("bm25_fit", f"WITH {TOKENS} SELECT round(avg(len(w)), 6) AS average_length FROM t")
def bm25_fit(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(sparse.BM25().fit(texts(spark, d)).average_length, 6),)], "average_length double")


RANKED = "SELECT (row_number() OVER (ORDER BY score DESC, id))::INT AS rank, id, round(score, 6) AS score FROM s {} ORDER BY s.score DESC, id LIMIT 10"


@register("bm25_search", f"WITH {POSTINGS} " + RANKED.format(""))
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """Over stored postings: only those of the query's terms are read."""
    return rounded(indexed("text", spark, d).search(WORDS, 10), "score")


@register("bm25_scan", SQL["bm25_search"])
def bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """Without an index."""
    return rounded(sparse.bm25_search(texts(spark, d), WORDS, 10), "score")


@register("bm25_filtered", f"WITH {POSTINGS} " + RANKED.format("WHERE lang = 'en'"))
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indexed("text", spark, d).search(WORDS, 10, texts(spark, d), {"lang": "en"}), "score")


@register("postings_build", f"WITH {POSTINGS} SELECT (SELECT count(DISTINCT term) FROM p)::BIGINT AS terms, (SELECT count(*) FROM p)::BIGINT AS postings, (SELECT count(*) FROM documents)::BIGINT AS live")
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    """The index of texts made anew."""
    s = BUILDERS["text"](spark, d, f"{shared_folder(spark)}/index-text-{uuid.uuid4().hex}").stats()
    return spark.createDataFrame([(s["terms"], s["postings"], s["live"])], "terms long, postings long, live long")


@register("postings_df", f"WITH {POSTINGS} SELECT term, df::BIGINT AS df FROM df")
def postings_df(spark: SparkSession, d: str) -> DataFrame:
    return indexed("text", spark, d).document_frequency()


def sparse_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("id"), F.array(k % 10, F.lit(30).cast("long")).alias("indices"), F.array(F.lit(1.0), 0.25 + F.col("p_size")).alias("values"))


@register("sparse_records", """SELECT p_partkey AS id, (p_partkey % 10)::BIGINT AS first_term, 2::BIGINT AS terms, round(1.25 + p_size, 6) AS weight FROM part""")
def sparse_records(spark: SparkSession, d: str) -> DataFrame:
    rows = indexed("sparse", spark, d).records()
    return rows.select("id", F.element_at("terms", 1).alias("first_term"), F.size("terms").cast("long").alias("terms"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 6).alias("weight"))


@register("sparse_topk", """WITH p AS (SELECT p_partkey AS id, p_partkey % 10 AS term, 1.0 AS w FROM part UNION ALL SELECT p_partkey, 30, 0.25 + p_size FROM part),
  s AS (SELECT id, sum(w * CASE term WHEN 3 THEN 2.0 ELSE 0.5 END) AS score FROM p WHERE term IN (3, 30) GROUP BY 1) """ + RANKED.format(""))
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    weights = spark.createDataFrame([(3, 2.0), (30, 0.5)], "term long, weight double")
    return rounded(sparse.top(sparse.sparse_scores(sparse.sparse_postings(sparse_rows(spark, d)), weights), 10), "score")


register("sparse_indexed", SQL["sparse_topk"])(lambda s, d: rounded(indexed("sparse", s, d).search({3: 2.0, 30: 0.5}, 10), "score"))


def _sides() -> str:
    return f"""WITH {POSTINGS}, {Q}, a AS (SELECT vec_id AS id, {sql_distance('cosine')} AS d FROM embeddings JOIN documents ON vec_id = doc_id, q),
      v AS (SELECT id, d, row_number() OVER (ORDER BY d, id) AS rank FROM a ORDER BY d, id LIMIT 40), x AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank
      FROM s WHERE id IN (SELECT vec_id FROM embeddings) ORDER BY score DESC, id LIMIT 40)"""


def _hybrid(method: str, spark: SparkSession, d: str) -> DataFrame:
    df = texts(spark, d).join(vecs(spark, d).drop("label"), "id", "left")
    n = fusion.depth(10)
    v = knn.knn(df, query_vector(spark, d), n, "cosine")
    known = vecs(spark, d).select("id")
    x = indexed("text", spark, d).search(WORDS, n, among=known)
    lists = [v.select("rank", "id", (-F.col("distance")).alias("similarity")), x.select("rank", "id", F.col("score").alias("similarity"))]
    fused = fusion.rrf(lists, [1.0, 2.0]) if method == "rrf" else fusion.weighted(lists, [1.0, 2.0])
    return rounded(sparse.top(fused, 10), "score", digits=5)


register("rrf", _sides() + """, s2 AS (SELECT id, sum(w) AS score FROM (SELECT id, 1.0 / (60 + rank) AS w FROM v UNION ALL SELECT id, 2.0 / (60 + rank) FROM x) GROUP BY 1)
  SELECT (row_number() OVER (ORDER BY score DESC, id))::INT AS rank, id, round(score, 5) AS score FROM s2 ORDER BY s2.score DESC, id LIMIT 10""")(partial(_hybrid, "rrf"))
register("weighted_fusion", _sides() + """, s2 AS (SELECT id, sum(w) AS score FROM (SELECT id, ((SELECT max(d) FROM v) - d) / ((SELECT max(d) - min(d) FROM v)) AS w FROM v
  UNION ALL SELECT id, 2.0 * (score - (SELECT min(score) FROM x)) / (SELECT max(score) - min(score) FROM x) FROM x) GROUP BY 1)
  SELECT (row_number() OVER (ORDER BY score DESC, id))::INT AS rank, id, round(score, 5) AS score FROM s2 ORDER BY s2.score DESC, id LIMIT 10""")(partial(_hybrid, "weighted"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and texts fused by reciprocal ranks, with a filter."""
    df = texts(spark, d).join(vecs(spark, d), "id", "left")
    return fusion.hybrid(df, 10, query_vector(spark, d), WORDS, flt=Filter.eq("lang", "en"), index=indexed("text", spark, d))


@register("hybrid_search", f"""WITH {POSTINGS}, {Q}, a AS (SELECT vec_id AS id, {sql_distance('cosine')} AS d FROM embeddings JOIN documents ON vec_id = doc_id, q WHERE lang = 'en'),
  v AS (SELECT id, d, row_number() OVER (ORDER BY d, id) AS rank FROM a ORDER BY d, id LIMIT 40),
  x AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE lang = 'en' ORDER BY score DESC, id LIMIT 40),
  f AS (SELECT id, sum(w) AS score FROM (SELECT id, 1.0 / (60 + rank) AS w FROM v UNION ALL SELECT id, 1.0 / (60 + rank) FROM x) GROUP BY 1),
  t10 AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f ORDER BY score DESC, id LIMIT 10)
  SELECT t10.rank::INT AS rank, t10.id AS id, round(t10.score, 6) AS score, v.rank::INT AS vector_rank, round(v.d, 5) + 0.0 AS vector_distance, x.rank::INT AS text_rank, round(x.score, 5) + 0.0 AS text_score
  FROM t10 LEFT JOIN v USING (id) LEFT JOIN x USING (id)""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(rounded(flagship(spark, d), "score"), "vector_distance", "text_score", digits=5)
    return out.select("rank", "id", "score", "vector_rank", "vector_distance", "text_rank", "text_score")


def _ages(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).withColumn("made", F.lit(NOW) - F.col("id") * 86_400_000).withColumn("score", 1 / (1 + F.col("price") % 97))


AGES = ITEMS + f", g AS (SELECT *, {NOW} - id * 86400000 AS made, 1 / (1 + price % 97) AS base FROM i)"
CHANGES = {
    "decay_exp": (scoring.RecencyDecay("made", NOW, 30 * 86_400_000, floor=0.1), "base * greatest(0.1, pow(2, -(greatest(0, %d - made) / 2592000000.0)))" % NOW),
    "decay_linear": (scoring.RecencyDecay("made", NOW, 30 * 86_400_000, "linear"), "base * greatest(0, 1 - greatest(0, %d - made) / 5184000000.0)" % NOW),
    "multiply": (scoring.FieldMultiplier("size", 2, 20, 0.5), "base * CASE WHEN size IS NULL THEN 0.5 ELSE least(greatest(size, 2), 20) END"),
    "boost": (scoring.MatchBoost(Filter.gt("size", 30) & Filter.has_tag("tags", "PROMO"), 0.25), "base + CASE WHEN size > 30 AND list_contains(tags, 'PROMO') THEN 0.25 ELSE 0 END"),
}


def _changed(modifier, spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.modified(_ages(spark, d), "score", [modifier]).select("id", "score"), "score")


for k, (modifier, expression) in CHANGES.items():
    register(f"modifier_{k}", f"WITH {AGES} SELECT id, round({expression}, 6) + 0.0 AS score FROM g")(partial(_changed, modifier))


@register("rescored", f"""WITH {AGES}, p AS (SELECT *, row_number() OVER (ORDER BY base DESC, id) AS r FROM g ORDER BY base DESC, id LIMIT 40),
  m AS (SELECT id, r, base * CASE WHEN size IS NULL THEN 0.5 ELSE least(greatest(size, 2), 20) END AS s FROM p)
  SELECT id, round(s, 6) AS score, (row_number() OVER (ORDER BY s DESC, r))::INT AS rank FROM m ORDER BY s DESC, r LIMIT 10""")
def rescored(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.rescored(_ages(spark, d), "score", [CHANGES["multiply"][0]], 10).select("id", "score", "rank"), "score")


@register("mmr", f"""WITH RECURSIVE {Q}, s AS (SELECT vec_id AS id, {_unit('embedding')} AS v, {sql_distance('cosine')} AS d FROM embeddings, q),
  n AS (SELECT id, v, least(1, greatest(0, 1 - d / 2)) AS rel FROM s ORDER BY d, id LIMIT 40), top AS (SELECT max(rel) AS m FROM n),
  p AS (SELECT a.id AS a, b.id AS b, {_DOT.format(a='a.v', b='b.v')} AS sim FROM n a, n b),
  g(k, chosen, id) AS (SELECT 0, []::BIGINT[], NULL::BIGINT UNION ALL SELECT k + 1, list_append(chosen, best), best FROM
    (SELECT g.k, g.chosen, arg_max(c.id, (0.3 * c.rel / (SELECT m FROM top) - 0.7 * coalesce((SELECT max(sim) FROM p WHERE p.a = c.id AND list_contains(g.chosen, p.b)), 0), c.rel, -c.id)) AS best
     FROM g, n c WHERE g.k < 10 AND NOT list_contains(g.chosen, c.id) GROUP BY g.k, g.chosen) x)
  SELECT k::INT AS rank, id FROM g WHERE k > 0""")
def mmr(spark: SparkSession, d: str) -> DataFrame:
    near = knn.knn(vecs(spark, d), query_vector(spark, d), 40, "cosine", columns=["vector"])
    return scoring.diverse(near.withColumn("score", vectors.relevance(F.col("distance"), "cosine")), 10, 0.3).select("rank", "id")


@register("dense_modified", f"""WITH {Q}, a AS (SELECT vec_id AS id, lang, n_chars, least(1, greatest(0, 1 - {sql_distance('cosine')} / 2)) AS rel FROM embeddings JOIN documents ON vec_id = doc_id, q),
  p AS (SELECT *, row_number() OVER (ORDER BY rel DESC, id) AS r FROM a ORDER BY rel DESC, id LIMIT 60),
  m AS (SELECT id, r, rel, rel * least(greatest(n_chars, 100), 5000) + CASE WHEN lang = 'de' THEN 0.5 ELSE 0 END AS s FROM p)
  SELECT (row_number() OVER (ORDER BY s DESC, r))::INT AS rank, id, round(s, 4) AS score, round(rel, 6) AS base_score FROM m ORDER BY s DESC, r LIMIT 10""")
def dense_modified(spark: SparkSession, d: str) -> DataFrame:
    rules = {"multiply": {"field": "n_chars", "min": 100, "max": 5000}, "boost": ({"lang": "de"}, 0.5), "pool": 60}
    found = search.dense(stored(spark, d).drop("text"), query_vector(spark, d), 10, "cosine", modifiers=rules)
    return rounded(rounded(found, "score", digits=4), "base_score").select("rank", "id", "score", "base_score")


@register("id_predicate", f"""WITH {Q}, s AS (SELECT vec_id AS id, {sql_distance('l2')} AS d FROM embeddings, q WHERE vec_id % 7 = 3)
  SELECT (row_number() OVER (ORDER BY d, id))::INT AS rank, id, round(d, 6) + 0.0 AS distance FROM s ORDER BY d, id LIMIT 10""")
def id_predicate(spark: SparkSession, d: str) -> DataFrame:
    """A function of ids, given as a pandas Series."""
    found = search.dense(vecs(spark, d), query_vector(spark, d), 10, "l2", predicate=lambda ids: ids % 7 == 3)
    return rounded(found.select("rank", "id", "distance"), "distance")


@register("group_by_best", f"""WITH {Q}, s AS (SELECT vec_id AS id, label, {sql_distance('l2')} AS d FROM embeddings, q),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, id) AS place FROM s), f AS (SELECT label, row_number() OVER (ORDER BY d, id) AS g FROM r WHERE place = 1)
  SELECT g::INT AS group_rank, place::INT AS place, label, id, round(d, 6) + 0.0 AS distance FROM r JOIN f USING (label) WHERE place <= 3 AND g <= 4""")
def group_by_best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.search_groups(vecs(spark, d), query_vector(spark, d), "label", 4, 3), "distance")


def _means(negative: bool) -> str:
    u = _unit("embedding")
    part = lambda ids: f"(SELECT list(m ORDER BY p) FROM (SELECT p, avg(x) AS m FROM (SELECT unnest({u})::DOUBLE AS x, unnest(range(1, 65)) AS p FROM embeddings WHERE vec_id IN ({ids})) GROUP BY p))"
    q = f"list_transform(list_zip({part('1, 2')}, {part('3')}), lambda z: (2 * z[1] - z[2])::FLOAT)" if negative else f"list_transform({part('1, 2')}, lambda z: z::FLOAT)"
    return f"""WITH q AS (SELECT {q} AS q), s AS (SELECT vec_id AS id, {sql_distance('cosine')} AS d FROM embeddings, q WHERE vec_id NOT IN ({'1, 2, 3' if negative else '1, 2'}))
      SELECT (row_number() OVER (ORDER BY d, id))::INT AS rank, id, round(d, 5) + 0.0 AS distance FROM s ORDER BY d, id LIMIT 10"""


register("recommend", _means(False))(lambda s, d: rounded(A.recommend(vecs(s, d), [1, 2]), "distance", digits=5))
register("recommend_negative", _means(True))(lambda s, d: rounded(A.recommend(vecs(s, d), [1, 2], [3]), "distance", digits=5))


@register("scan_page", f"WITH {ITEMS} SELECT id, brand FROM i WHERE id > 100 AND size < 20 ORDER BY id LIMIT 25")
def scan_page(spark: SparkSession, d: str) -> DataFrame:
    return mutations.page(items(spark, d), 25, after=100, flt=Filter.lt("size", 20)).select("id", "brand")


@register("remove_where", f"WITH {ITEMS} SELECT id FROM i WHERE size IS NULL OR size >= 20")
def remove_where(spark: SparkSession, d: str) -> DataFrame:
    return mutations.remove_where(items(spark, d), Filter.lt("size", 20)).select("id")


@register("remove_ids", f"WITH {ITEMS} SELECT id FROM i WHERE id NOT IN (1, 5, 9)")
def remove_ids(spark: SparkSession, d: str) -> DataFrame:
    return mutations.remove(items(spark, d), [1, 5, 9, 9, -4]).select("id")


@register("set_metadata_where", f"WITH {ITEMS} SELECT id, CASE WHEN even THEN 'x' ELSE brand END AS brand, CASE WHEN even THEN NULL ELSE size END AS size FROM i")
def set_metadata_where(spark: SparkSession, d: str) -> DataFrame:
    return mutations.set_metadata_where(items(spark, d), Filter.eq("even", True), {"brand": "x", "size": None}).select("id", "brand", "size")


@register("upsert_last_wins", f"WITH {ITEMS} SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE brand END AS brand FROM i")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    old = items(spark, d).select("id", "brand")
    new = old.where("id % 3 = 0").select("id", F.lit("old").alias("brand"), F.lit(1).alias("n")).unionByName(old.where("id % 3 = 0").select("id", F.lit("new").alias("brand"), F.lit(2).alias("n")))
    return mutations.upsert(old, new, order="n")


@register("remove_expired", f"SELECT event_id AS id FROM events WHERE epoch_us(ts) // 1000 + 86400000 >= {NOW}")
def remove_expired(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), (ms + 86_400_000).alias("_expires_at"))
    return mutations.alive(rows, NOW).select("id")


@register("parse_date", "SELECT event_id AS id, (epoch_us(ts) // 1000)::BIGINT AS ms FROM events")
def parse_date(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), dates.date_ms(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("ms"))


@register("format_date", "SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS date FROM events")
def format_date(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), dates.date_text(F.unix_millis(F.col("ts").cast("timestamp"))).alias("date"))


@register("sq8_bounds", """WITH e AS (SELECT unnest(range(0, 64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
  SELECT dim, round(min(x), 7) AS low, round((max(x) - min(x)) / 255, 9) AS step FROM e GROUP BY 1""")
def sq8_bounds(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.codecs import scalar_bounds

    return rounded(rounded(scalar_bounds(vecs(spark, d)), "low", digits=7), "step", digits=9)


@register("sq8_codes", """WITH e AS (SELECT vec_id AS id, unnest(range(0, 64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
  b AS (SELECT dim, min(x) AS low, (max(x) - min(x)) / 255 AS step FROM e GROUP BY 1)
  SELECT id, sum(least(255, greatest(0, floor((x - low) / step + 0.5))))::BIGINT AS total FROM e JOIN b USING (dim) GROUP BY 1""")
def sq8_codes(spark: SparkSession, d: str) -> DataFrame:
    df = vecs(spark, d)
    return _bytes_added(codecs.encode(df, codecs.train(df, "sq8")))


@register("binary_codes", """WITH e AS (SELECT vec_id AS id, unnest(range(0, 64))::INT AS dim, unnest(embedding) AS x FROM embeddings),
  b AS (SELECT dim, avg(x::DOUBLE) AS mean FROM e GROUP BY 1)
  SELECT id, sum(CASE WHEN x > mean THEN 1 << (dim % 8) ELSE 0 END)::BIGINT AS total FROM e JOIN b USING (dim) GROUP BY 1""")
def binary_codes(spark: SparkSession, d: str) -> DataFrame:
    df = vecs(spark, d)
    return _bytes_added(codecs.encode(df, codecs.train(df, "binary")))


def _bytes_added(coded: DataFrame) -> DataFrame:
    hexes = F.regexp_extract_all(F.hex("code"), F.lit("(..)"), F.lit(1))
    return coded.select("id", F.aggregate(hexes, F.lit(0).cast("long"), lambda a, x: a + F.conv(x, 16, 10).cast("long")).alias("total"))


#: Candidates for each neighbour by codec: the coarser the codes, the more.
FACTORS = {"sq8": 4, "binary": 30, "pq": 8, "f16": 4, "bf16": 4, "rabitq": 12}


def _codec(name: str, spark: SparkSession, d: str) -> DataFrame:
    """For each stated query the share of the ten exact neighbours that a two-stage search on codes finds."""
    df = vecs(spark, d)
    coded, model = codecs.encoded(df, name, train_after=1)
    return knn.recall(codecs.coded_join(_asked(spark, d), coded, model, 10, factor=FACTORS[name]), knn.knn_join(_asked(spark, d), df, 10))


for k in FACTORS:
    register(f"codec_{k}")(partial(_codec, k))


def _indexed_facet(spark: SparkSession, d: str) -> DataFrame:
    return indexed("payload", spark, d).facet_values(A.FacetRequest("brand"))


register("facet_indexed", SQL["facet_values"])(_indexed_facet)


@register("count_indexed", f"WITH {ITEMS} SELECT count(*)::BIGINT AS n FROM i WHERE NOT (brand IN ('Brand#11', 'Brand#13', 'none'))")
def count_indexed(spark: SparkSession, d: str) -> DataFrame:
    n = indexed("payload", spark, d).exact_count(~Filter.in_("brand", ["Brand#11", "Brand#13", "none"]))
    return spark.createDataFrame([(n,)], "n long")


@register("candidates_indexed", f"WITH {ITEMS} SELECT id FROM i WHERE list_has_all(tags, ['PROMO', 'Brand#13']) OR (brand = 'Brand#11' AND even)")
def candidates_indexed(spark: SparkSession, d: str) -> DataFrame:
    flt = Filter.has_all_tags("tags", ["PROMO", "Brand#13"]) | (Filter.eq("brand", "Brand#11") & Filter.eq("even", True))
    return indexed("payload", spark, d).candidates(flt)


@register("update_known", f"WITH {ITEMS} SELECT id, CASE WHEN id <= 5 THEN 'new' ELSE brand END AS brand FROM i")
def update_known(spark: SparkSession, d: str) -> DataFrame:
    old = items(spark, d).select("id", "brand")
    assert mutations.update(old, old.limit(1).select(F.lit(-1).cast("long").alias("id"), "brand")) is None
    return mutations.update(old, old.where("id <= 5").withColumn("brand", F.lit("new")))
