"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text, with each run of white space made one space, is cut where its bytes say so: behind nine bytes of which each is
in a half of all byte values that its place chooses, a rule on a sliding window that holds in any script, whether or not
there are spaces or sentence ends. So equal passages are cut alike wherever they stand. Each distinct chunk moves once,
after map-side combining, to verify its identifier; from then on a document is its ordered list of identifiers, 16 bytes
for about a kilobyte of text, and documents are compared by these lists alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import table

#: Bytes of a chunk: LEAST at least (but for the last one), MOST at most.
LEAST, MOST = 512, 4096
#: Bits of a byte whose number, odd or even, puts it in the half that counts at each place of the window.
MASKS = (0x1D, 0x2D, 0x55, 0x69, 0xA5, 0x4D, 0xB5, 0x0D, 0xD5)


def _half(mask: int) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if (b & mask).bit_count() % 2) + "]"


CHUNK = "(?s).{%d,%d}?%s|.{1,%d}" % (LEAST - len(MASKS), MOST - len(MASKS), "".join(map(_half, MASKS)), MOST)


def identifier(chunk: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(chunk, 256), 1, 32))


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space; null as empty. A lone space needs no replacing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def chunks(text: Column) -> Column:
    """The chunks of a text's UTF-8 bytes, each byte as the character of its number; joined they are the text. An empty
    text has none."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def collisions(docs: DataFrame, text: str, name) -> DataFrame:
    """id: the identifiers that different chunks share. Distinct chunks are compared as whole texts."""
    each = docs.select(F.explode(chunks(normalised(F.col(text)))).alias("chunk"))
    distinct = each.groupBy(name(F.col("chunk")).alias("id"), "chunk").agg(F.lit(1).alias("n"))
    return distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", name=identifier) -> DataFrame:
    """A row per row of docs: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Null texts count as empty; equal texts form a group whatever their other columns hold. The smallest id stays, null
    ids last; of repeated rows with that id, one is kept. An empty table gives no rows. Only the columns id and text
    are read, so further columns, of any name, don't matter. Very long texts are lists of chunks like any other.

    name makes a chunk's identifier (binary). Where different chunks share one, the recipes that hold it tell them apart
    by the chunks themselves; all other recipes stay as they are, and nothing is read a second time for it.
    """
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("body"))
    shared = table(collisions(docs, "body", name), "collisions")
    parts = F.transform(chunks(F.col("norm")), lambda c: F.struct(name(c).alias("id"), c.alias("chunk")))
    whole = docs.select("doc_id", normalised(F.col("body")).alias("norm"), F.monotonically_increasing_id().alias("row"))
    sha = F.sha2("norm", 256).alias("text_sha256")
    if shared.isEmpty():
        recipes = whole.select("doc_id", "row", sha, F.transform(chunks(F.col("norm")), name).alias("recipe"))
    else:
        each = whole.select("doc_id", "row", sha, F.posexplode_outer(parts).alias("pos", "part")).withColumn("id", F.col("part.id"))
        known = each.join(shared.withColumn("twice", F.lit(True)), "id", "left")
        element = F.when(F.col("twice"), F.concat(F.col("id"), F.col("part.chunk").cast("binary"))).otherwise(F.col("id"))
        listed = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", element.alias("e")))))
        recipes = known.groupBy("doc_id", "row", "text_sha256").agg(F.transform(listed, lambda x: x["e"]).alias("recipe"))
    recipes = table(recipes, "recipes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # Only groups of two and more, as a table: adaptive execution splits the join at a text of very many copies.
    groups = recipes.groupBy("recipe").agg(F.min(first).alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    told = recipes.join(table(groups, "groups"), "recipe", "left")
    lone = F.col("group_size").isNull()
    return told.select(
        F.col("doc_id").alias(id),
        F.when(lone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
