"""Odd documents that every operator must stand, and plain versions of words."""

import random
import re

TRANSLATE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return ALNUM.findall((text or "").translate(TRANSLATE))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["Über", "den", "fields", "rain", "7", "falls", "stone", "night", "l'été", "one", "Zwei", "tres"]) + str(rng.randrange(40)) for _ in range(n)) + "."


LONG = prose(1, 60_000)  # about 600 kB

ODD = [
    (1, prose(2, 80)), (2, prose(2, 80)), (3, None), (4, ""), (5, " \t\n "), (6, "word"), (6, prose(3, 30)), (6, prose(3, 30)),
    (None, prose(4, 40)), (None, prose(4, 40)), (None, None), (7, LONG), (8, LONG + " more"), (9, "a a a a a a a a a a a a"),
    (10, "日本語 テキスト 12 !!"), (11, "\x00\x01 control"),
]


def odd(spark, *more):
    """ODD as a table, with columns whose names clash with those that operators make."""
    names = ["n_words", "hit_words", "votes", "score", "accepted", "lang_pred", "key", "row", "id", "kept", "n", *more]
    return spark.createDataFrame([(i, t, *(["x"] * len(names))) for i, t in ODD], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def thue_morse(n=1024):
    """Two different words whose difference any polynomial hash modulo 2^64 with an odd base misses."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
