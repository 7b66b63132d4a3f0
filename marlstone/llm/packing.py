"""Packing: length buckets that minimise padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import table

#: Tokens of the longest sequence; a longer document is dealt into sequences of so many.
MAX_LENGTH = 2048
#: Buckets, and padded tokens of a batch.
BUCKETS, BUDGET = 12, 65_536
#: Sequences of a shard, the unit in which sequences are numbered.
SHARD = 20_000


def words(text: Column) -> Column:
    """The default count of tokens: words between white space, and one end of text. Null counts as empty."""
    return (F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))) + 1).cast("long")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The upper lengths of at most so many buckets that minimise the padding of the histogram's sequences.

    Dynamic programming over the distinct lengths: cost[k][j] is the least padding of the j shortest ones in k buckets.
    Of equal costs the one with the fewest buckets, then the smallest last split wins.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    n, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    size, most = len(lengths), min(buckets, len(lengths))
    huge = np.iinfo(np.int64).max // 4
    cost = np.full((most + 1, size + 1), huge, np.int64)
    cost[0, 0] = 0
    split = np.zeros((most + 1, size + 1), np.int64)
    for k in range(1, most + 1):
        for j in range(1, size + 1):
            i = np.arange(j)
            total = cost[k - 1, :j] + lengths[j - 1] * (n[j] - n[i]) - (tokens[j] - tokens[i])
            split[k, j] = np.argmin(total)
            cost[k, j] = total[split[k, j]]
    k, j, out = int(np.argmin(cost[:, size])), size, []
    while j:
        out.append(int(lengths[j - 1]))
        j, k = int(split[k, j]), k - 1
    return out[::-1]


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", tokens=words, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> DataFrame:
    """Sequences in batches: id, piece, first_token, n_tokens, bucket, bucket_length, batch, slot, padding.

    tokens makes the count of tokens (at least 1) of the text column. A document of more than max_length tokens is in
    several sequences; none is dropped or cut short. The histogram has max_length rows at most, whatever the corpus.
    A batch of a bucket holds the sequences whose padded tokens fit budget (one at least); only the last of a bucket
    is not full. Sequences are numbered by shards of about `shard` rows, dealt by a hash of id, text and piece and
    ordered in themselves, with running offsets over the shards: no bucket, and no id that many texts share or lack,
    meets in one task; only repeats of one row do. Null ids and repeated rows are sequences like others (ties are ordered
    by length and text, and rows that agree in all are alike); a very long text is dealt into sequences. Empty tables
    give no rows; other columns are not read.
    """
    n = tokens(F.col(text))
    counted = table(docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.greatest(n, F.lit(1)).cast("long").alias("n")), "lengths")
    pieces = counted.select("id", "h", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / max_length).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "h", "piece", (F.col("piece").cast("long") * max_length).alias("first_token"), F.least(F.lit(max_length), F.col("n") - F.col("piece").cast("long") * max_length).alias("n_tokens"))
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    tops = boundaries(histogram, buckets)
    shards = max(1, -(-sum(histogram.values()) // shard))
    bounds = F.array(*(F.lit(x).cast("long") for x in tops)) if tops else F.array(F.lit(max_length).cast("long"))
    placed = pieces.withColumn("bucket", F.size(F.filter(bounds, lambda x: x < F.col("n_tokens"))))
    placed = placed.withColumn("bucket_length", F.element_at(bounds, F.col("bucket") + 1)).withColumn("shard", F.pmod(F.xxhash64("id", "h", "piece"), F.lit(shards)).cast("int"))
    # Every column is fixed by the row's content, so a task that runs again after a loss gives the same numbers.
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_last(), "piece", "n_tokens", "h")).cast("long") - 1
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.col("own") + F.col("before")
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))).cast("long")
    numbered = placed.withColumn("own", own).join(sizes, ["shard", "bucket"])
    return numbered.select(
        F.col("id").alias(id), "piece", "first_token", "n_tokens", "bucket", "bucket_length",
        F.floor(at / rows).alias("batch"), (at % rows).alias("slot"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
