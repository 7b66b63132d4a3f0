"""Chat formatting: conversations that merely begin a longer one are dropped, the others are rendered."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import table

#: How a turn is rendered: before the role, between role and text, and behind the text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn with the rolling hash of its conversation so far: conv_id, at (from 1), prefix.

    The hash of a prefix is the SHA-256 of the hash before it and of the turn's role and text, so equal prefixes are
    equal turn by turn. It runs along sorted rows: a turn costs the same at any depth, and no conversation is gathered.
    """
    clean = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).distinct()
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    own = F.unhex(F.sha2(F.concat_ws("|", field("role"), field("text")), 256))
    order = [F.col("conv_id").asc_nulls_last(), "turn", "role", "text"]
    lined = clean.withColumn("own", own).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far, at = None, b"", 0
        for batch in batches:
            ids, places, hashes = batch.column(0).to_pylist(), [], []
            for i, x in zip(ids, batch.column(1).to_pylist()):
                if at == 0 or i != last:
                    last, so_far, at = i, b"", 0
                so_far, at = hashlib.sha256(so_far + x).digest(), at + 1
                places.append(at)
                hashes.append(so_far)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), pa.array(hashes, pa.binary())], names=["conv_id", "at", "prefix"])

    return lined.mapInArrow(run, f"conv_id {dict(lined.dtypes)['conv_id']}, at long, prefix binary")


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: conv_id, n_turns, kept, covered_by, rendered (null where not kept).

    A conversation whose turns begin a longer one is dropped; of equal ones the smallest id stays (null last).
    covered_by is, for a dropped one, the longest conversation that begins with it (the smallest id of equally long
    ones), or the equal one that stays. Turns are ordered by turn, then role and text; repeated rows count once; null
    roles and texts are values of their own and render as empty; turns with a null id are one conversation. An empty
    table gives no rows; other columns, of any name, aren't read. Equal conversations are one row before they are joined, so a first turn or conversation that
    many share is no hot key; a very long conversation is sorted, not gathered, but for the kept ones' rendering.
    """
    keys = ["prefix"]
    every = table(prefixes(turns, conv, turn, role, text), "prefixes")
    ends = table(every.groupBy("conv_id").agg(F.max_by("prefix", "at").alias("prefix"), F.max("at").alias("n_turns")).select("conv_id", "n_turns", "prefix"), "ends")
    order = F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")
    classes = ends.groupBy(*keys, "n_turns").agg(F.min(order).alias("rep"))
    longest = F.struct((-F.col("n")).alias("n"), F.col("conv_id").isNull().alias("none"), "conv_id")
    lengths = ends.select(F.col("conv_id").alias("c"), F.col("n_turns").alias("n"))
    begun = every.join(lengths, F.col("conv_id").eqNullSafe(F.col("c"))).where("at < n").groupBy(*keys, F.col("at").alias("n_turns")).agg(F.min(longest).alias("by"))
    on = [*keys, "n_turns"]
    maximal = classes.join(begun, on, "left_anti").select(*on, F.lit(True).alias("maximal"))
    covered = classes.join(begun, on).select(*on, F.lit(False).alias("maximal"), F.col("by.conv_id").alias("by"))
    # a table, so that adaptive execution splits the join with a conversation that many rows repeat
    fate = table(maximal.withColumn("by", F.lit(None).cast(dict(ends.dtypes)["conv_id"])).unionByName(covered).join(classes, on), "fates")
    kept = F.col("maximal") & F.col("conv_id").eqNullSafe(F.col("rep.conv_id"))
    told = ends.join(fate, on).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), kept.alias("kept"), F.when(~kept, F.when(F.col("maximal"), F.col("rep.conv_id")).otherwise(F.col("by"))).alias("covered_by"))
    clean = turns.select(F.col(conv).alias("c"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).distinct()
    stay = told.where("kept").select(F.col("conv_id").alias("k"))
    parts = clean.join(stay, F.col("c").eqNullSafe(F.col("k")), "left_semi").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    each = F.transform("turns", lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE)))
    rendered = parts.select("c", F.array_join(each, "").alias("rendered"))
    return told.join(rendered, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", "n_turns", "kept", "covered_by", "rendered")
