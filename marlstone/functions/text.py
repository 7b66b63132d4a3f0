"""Words of texts: ASCII and Unicode tokens, term ids, English stop words and stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: The English stop words of the Snowball project.
STOP_WORDS = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing would should could ought i'm you're he's she's it's we're they're i've you've we've
they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't hadn't
doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's
where's why's how's a an the and but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here there when where why how all any
both each few more most other some such no nor not only own same so than too very""".split())


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other characters as they are; a text of ASCII alone takes the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def tokenize(text: Column) -> Column:
    """Lower-case A-Z; runs of [0-9a-z] and of anything beyond ASCII. Null has no tokens."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def term_id(token: Column) -> Column:
    """FNV-1a of the token's UTF-8 bytes, 32 bits."""
    h = F.hex(F.encode(token, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(h) - 1), F.lit(2)), lambda i: F.conv(h.substr(i, F.lit(2)), 16, 10).cast("long"))
    folded = F.aggregate(bytes_, F.lit(2166136261).cast("long"), lambda s, b: s.bitwiseXOR(b) * F.lit(16777619) % F.lit(1 << 32))
    return F.when(token == "", F.lit(2166136261).cast("long")).otherwise(folded)


def id_of(key: str) -> int:
    """The 64-bit id of a string key: FNV-1a, then the finishing steps of SplitMix64; unsigned."""
    h, mask = 0xCBF29CE484222325, 2**64 - 1
    for b in key.encode():
        h = (h ^ b) * 0x100000001B3 & mask
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
    h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
    return h ^ h >> 31


def key_ids(keys: Column | str) -> Column:
    """id_of() of a column, as signed 64-bit integers."""

    @F.pandas_udf("long")
    def ids(keys):
        import pandas as pd

        return pd.Series([None if k is None else int(np.uint64(id_of(k)).astype(np.int64)) for k in keys], dtype="Int64")

    return ids(keys)


def _lower(c: str) -> str:
    """Lower case of Latin, Greek and Cyrillic letters; other characters stay."""
    low = c.lower()
    return low if ord(c) < 0x530 and len(low) == 1 else c


def unicode_tokens(text: str | None) -> list[str]:
    """Runs of letters and digits of any script, lower-case; an apostrophe between letters stays, as '."""
    out: list[str] = []
    now: list[str] = []
    text = text or ""
    for i, c in enumerate(text):
        kind = unicodedata.category(c)
        if kind[0] in "LMN":
            now.append(_lower(c))
        elif c in "'’" and now and i + 1 < len(text) and unicodedata.category(text[i + 1])[0] in "LMN":
            now.append("'")
        elif now:
            out.append("".join(now))
            now = []
    return out + (["".join(now)] if now else [])


_VOWELS = set("aeiouy")
#: Fixed values of the English stemmer.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_LATE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _region(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS and w[-1] not in "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case English word, by the published Porter2 rules."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    w = re.sub("('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _LATE:
        return w
    # past and continuous forms
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), None)
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in _VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # endings, the longest first
    for e in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(e):
            if len(w) - len(e) >= r1:
                if e == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif e == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(e)] + _STEP2[e]
            break
    for e in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(e):
            if len(w) - len(e) >= r1:
                if e != "ative":
                    w = w[: -len(e)] + _STEP3[e]
                elif len(w) - 5 >= r2:
                    w = w[:-5]
            break
    for e in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(e):
            if len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(e)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def analyzed(text: str | None, unicode: bool = False, stop_words: bool = False, stemming: bool = False) -> list[str]:
    """analyze() of one text, without a Spark job."""
    if unicode:
        tokens = unicode_tokens(text)
    else:
        tokens = [t for t in re.split(SEPARATORS, (text or "").translate(str.maketrans(UPPER, LOWER))) if t]
    if stop_words:
        tokens = [t for t in tokens if t not in STOP_WORDS]
    return [stem(t) if stemming and re.fullmatch("[a-z']+", t) else t for t in tokens]


def analyze(text: Column, unicode: bool = False, stop_words: bool = False, stemming: bool = False) -> Column:
    """tokenize(), or Unicode tokens; then without English stop words; then stems of tokens of a-z and '."""
    tokens = tokenize(text)
    if unicode:

        @F.pandas_udf("array<string>")
        def split(t):
            return t.map(unicode_tokens)

        tokens = split(text)
    if stop_words:
        tokens = F.filter(tokens, lambda x: ~x.isin(sorted(STOP_WORDS)))
    if stemming:

        @F.pandas_udf("array<string>")
        def stems(t):
            return t.map(lambda ws: [stem(w) if re.fullmatch("[a-z']+", w) else w for w in ws])

        tokens = stems(tokens)
    return tokens
