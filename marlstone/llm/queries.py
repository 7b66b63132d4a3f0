"""One query for each operator, over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.warc import archive_round_trip

    return archive_round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.decontaminate import decontaminate, digest

    return digest(decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL: dict[str, str] = {}

# sha1() gives hex digits; five of them are four base-32 digits.
SQL["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS d, min(page_id) OVER (PARTITION BY body) AS f FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(d, CAST(i * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * j AS INT)) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS b32 FROM h)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to FROM b
"""

SQL["op2_decontaminate"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT item_id, least(10, len(words)) AS n, unnest(list_transform(range(1, greatest(1, len(words) - 9) + 1), lambda i: array_to_string(words[i:i + 9], ' '))) AS win FROM b WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS pos, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS win FROM w, sizes WHERE len(words) >= n),
hits AS (SELECT doc_id, dw.n, pos, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM hits GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op6_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""



def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.chat import collapse

    return collapse(read(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "kept", "covered_by", F.sha2(F.coalesce("rendered", F.lit("")), 256).alias("rendered_sha256"))


SQL["op5_chat"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS body FROM t GROUP BY 1),
n AS (SELECT *, len(turns) AS n FROM c),
p AS (SELECT conv_id, n, turns, unnest(range(1, n)) AS k FROM n),
q AS (SELECT turns[1:k] AS turns, conv_id AS longer, n AS size FROM p),
b AS (SELECT turns, first(longer ORDER BY size DESC, longer) AS covers FROM q GROUP BY 1),
m AS (SELECT n.*, b.covers, min(conv_id) OVER (PARTITION BY n.turns) AS rep FROM n LEFT JOIN b ON n.turns = b.turns)
SELECT conv_id, n::BIGINT AS n_turns, covers IS NULL AND rep = conv_id AS kept,
  CASE WHEN covers IS NOT NULL THEN covers WHEN rep <> conv_id THEN rep END AS covered_by,
  sha256(CASE WHEN covers IS NULL AND rep = conv_id THEN body ELSE '' END) AS rendered_sha256 FROM m
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.quality import classify

    return classify(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "votes", "p_weak", "score", "accepted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ids are held out."""
    from marlstone.llm.language import fit, fold, identify

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True)))
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.jaccard import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.substrings import repeats

    return repeats(read(spark, sf_dir, "documents")).drop("spans")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ids are held out."""
    from marlstone.llm.language import fold
    from marlstone.llm.lm import corpus_scores

    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(True)).alias("held_out"), "text")
    return corpus_scores(docs.withColumn("seen", ~F.col("held_out")), "seen").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
