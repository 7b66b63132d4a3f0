"""Sparse retrieval: postings, BM25 weights, and the best documents by the dot product with a query's weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import analyze, analyzed
from marlstone.operators.filters import where


@dataclass(frozen=True)
class BM25:
    """average_length is a setting, 100 unless fitted, not the corpus's own mean."""

    k1: float = 1.2
    b: float = 0.75
    average_length: float = 100.0
    unicode: bool = False
    stop_words: bool = False
    stemming: bool = False

    def __post_init__(self) -> None:
        if self.k1 < 0 or not 0 <= self.b <= 1 or self.average_length <= 0:
            raise ValueError("BM25 needs k1 >= 0, b between 0 and 1, and an average length above 0")

    def tokens(self, text: Column) -> Column:
        return analyze(text, self.unicode, self.stop_words, self.stemming)

    def words(self, text: str) -> list[str]:
        """The tokens of one text."""
        return analyzed(text, self.unicode, self.stop_words, self.stemming)

    def fit(self, df: DataFrame, text: str = "text") -> BM25:
        mean = df.where(F.col(text) != "").select(F.avg(F.size(self.tokens(F.col(text))))).first()[0]
        return BM25(self.k1, self.b, mean or 100.0, self.unicode, self.stop_words, self.stemming)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as there are cores, if a small or single file would leave cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def postings(df: DataFrame, model: BM25 = BM25(), id: str = "id", text: str = "text", terms: Sequence[str] | None = None) -> DataFrame:
    """id, term, frequency, weight: the weight of each term of each document, or of some terms only."""
    texts = spread(df.where(F.col(text) != "").select(F.col(id).alias("id"), F.col(text).alias("text")), "id")
    tokens = texts.select("id", model.tokens(F.col("text")).alias("tokens"))
    each = tokens.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    each = each if terms is None else each.where(F.col("term").isin(list(terms)))
    counted = each.groupBy("id", "term", "length").agg(F.count("*").alias("frequency"))
    f, norm = F.col("frequency"), model.k1 * (1 - model.b + model.b * F.col("length") / model.average_length)
    return counted.select("id", "term", "frequency", (f * (model.k1 + 1) / (f + norm)).alias("weight"))


def document_frequency(posts: DataFrame) -> DataFrame:
    # Reading the frequency keeps the plan below alike for this and the scores, so that its exchange is reused.
    return posts.groupBy("term").agg(F.sum((F.col("frequency") > 0).cast("long")).alias("df"))


def query_weights(posts: DataFrame, documents: int, query: str, model: BM25 = BM25()) -> DataFrame:
    """term, weight of a query: the idf of each term, once for each time it occurs; terms of no document are left out."""
    spark = posts.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(model.tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    df = document_frequency(posts)
    idf = F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # a query's terms are few
    return df.join(F.broadcast(asked), "term").select("term", (idf * F.col("times")).alias("weight"))


def sparse_scores(posts: DataFrame, weights: DataFrame) -> DataFrame:
    """id, score of the documents that share a term with the query, whatever the score.

    Scores are rounded to 9 places, so that equal documents tie in whatever order their weights are added up.
    """
    w = weights.select("term", F.col("weight").alias("w"))
    return posts.join(F.broadcast(w), "term").groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("w")), 9).alias("score"))


def top(scores: DataFrame, k: int, id: str = "id") -> DataFrame:
    """rank, id, score of the k best, ties by id."""
    best = scores.orderBy(F.desc("score"), id).limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), id)).alias("rank"), id, "score")


def bm25_search(df: DataFrame, query: str, k: int, model: BM25 = BM25(), id: str = "id", text: str = "text", flt=None, among: DataFrame | None = None) -> DataFrame:
    """rank, id, score, by one scan of the texts; postings.Postings keeps what it finds. Statistics cover all documents
    with a text; the filter, and a table of ids that may be found, apply to the results."""
    posts = postings(df, model, id, text, model.words(query))  # other terms are never shuffled
    documents = df.where(F.col(text) != "").count()
    scores = sparse_scores(posts, query_weights(posts, documents, query, model))
    if flt is not None:
        scores = scores.join(where(df, flt).select(F.col(id).alias("id")), "id", "left_semi")
    if among is not None:
        scores = scores.join(among.select(F.col(id).alias("id")), "id", "left_semi")
    return top(scores, k).withColumnRenamed("id", id)


def sparse_postings(df: DataFrame, id: str = "id", indices: str = "indices", values: str = "values") -> DataFrame:
    """id, term, weight from arrays of terms and weights; zero weights are dropped."""
    pairs = F.explode(F.arrays_zip(F.col(indices).alias("term"), F.col(values).alias("weight")))
    return df.select(F.col(id).alias("id"), pairs.alias("p")).select("id", F.col("p.term").alias("term"), F.col("p.weight").cast("double").alias("weight")).where("weight <> 0")


def sparse_dot(a: Column, b: Column) -> Column:
    """The dot product of two maps of weights."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(both, F.lit(0.0), lambda s, t: s + F.element_at(a, t).cast("double") * F.element_at(b, t).cast("double"))
