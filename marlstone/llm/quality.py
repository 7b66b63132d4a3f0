"""Quality classifier from weak labels: heuristic labellers, their accuracies by expectation-maximisation, a linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import BLANK, BYTE_VALUES, Words, span_hashes, steps, table, text_buffers

#: Most documents that the scorer is fitted on, chosen by a hash; accuracies and patterns cover all documents.
SAMPLE = 20_000
#: Most features (16 bytes each) of those documents together.
FEATURES = 4_000_000
#: Dimensions of the hashed features, and the score from which a document is accepted.
DIMENSIONS, ACCEPT = 1 << 14, 0.5

BAD, GOOD, NONE = 0, 1, 2
LABELLERS = ("symbols", "capitals", "repeats", "phrases", "sentences", "lengths", "size", "letters", "marks", "endings")

_kind = np.full(256, ord("a"), np.uint8)
_kind[:128] = [ord("A") if 65 <= c < 91 else ord("a") if 97 <= c < 123 else ord("0") if 48 <= c < 58 else c for c in range(128)]
_symbol = np.zeros(256, bool)
_symbol[list(b"#$%&*+/<=>@[\\]^_`{|}~!")] = True
_capital = np.zeros(256, bool)
_capital[65:91] = True
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_stop = np.zeros(256, bool)
_stop[list(b".!?")] = True


class Texts:
    """What the labellers and the features see of some documents."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray) -> None:
        self.offs, self.words = offs, Words(buf, offs, BLANK)
        self.n_words = np.diff(self.words.bounds)
        self.doc = self.words.document()
        self.buf = buf
        w = self.words
        same = np.zeros(len(w), bool)
        if len(w):
            same[1:] = (w.head[1:] == w.head[:-1]) & (w.tail[1:] == w.tail[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.same = same
        last = buf[w.end - 1] if len(w) else np.zeros(0, np.uint8)
        self.stops, self.symbolic = _stop[last], _symbol[last]

    def share(self, table_: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table_[self.buf])])
        return (sums[self.offs[1:]] - sums[self.offs[:-1]]).astype(float)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, flags, len(self.n_words)) if len(flags) else np.zeros(len(self.n_words))

    def distinct_pairs(self) -> np.ndarray:
        """The share of different ones among a document's pairs of neighbouring words."""
        at, h = self.words.windows(2)
        d = self.doc[at]
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        total = np.bincount(d, minlength=len(self.n_words))
        return np.bincount(d, new, len(self.n_words)) / np.maximum(1, total)

    def bare(self) -> np.ndarray:
        """Whether a word has no letter or digit."""
        sums = np.concatenate([[0], np.cumsum(_letter[self.buf] | _digit[self.buf])])
        return sums[self.words.end] == sums[self.words.begin]

    def votes(self) -> np.ndarray:
        """A row of BAD, GOOD or NONE (no opinion) per document, a column per labeller."""
        n, w = np.maximum(1, self.n_words), self.n_words
        seen = np.maximum(1.0, np.bincount(self.doc, self.words.end - self.words.begin, len(w)) if len(self.doc) else np.zeros(len(w)))
        letters = self.share(_letter)
        say = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
        symbols, capitals = self.share(_symbol) / seen, self.share(_capital) / np.maximum(1, letters)
        repeats, stops, length = self.per_doc(self.same) / n, self.per_doc(self.stops) / n, seen / n
        pairs, marks, endings = self.distinct_pairs(), self.per_doc(self.bare()) / n, self.per_doc(self.symbolic) / n
        out = [
            say(symbols > 0.06, symbols < 0.02),
            say((capitals > 0.4) & (w > 5), capitals < 0.2),
            say((repeats > 0.12) & (w > 5), repeats < 0.03),
            say((pairs < 0.4) & (w > 20), (pairs > 0.75) & (w > 5)),
            say((stops < 0.01) & (w > 60) | (stops > 0.6) & (w > 10), (stops > 0.015) & (stops < 0.4)),
            say((length > 14) | (length < 2.5), (length > 3.5) & (length < 10)),
            say(w < 1, w >= 20),
            say(letters / seen < 0.6, letters / seen > 0.85),
            say((marks > 0.08) & (w > 5), marks < 0.01),
            say((endings > 0.1) & (w > 5), endings < 0.02),
        ]
        return np.stack(out, 1).astype(np.int8)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, dimension and weight of the hashed features; the weights of a document have length 1.

        Features are word shapes (letters, capitals, digits and marks, runs as one), pairs of neighbouring shapes, and
        whether a word repeats the one before it.
        """
        w = self.words
        if not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        shape = _kind[self.buf]
        keep = w.low != 0
        keep[1:] &= (shape[1:] != shape[:-1]) | (w.low[:-1] == 0)
        keep[w.begin] = True
        place = np.concatenate([[0], np.cumsum(keep)])
        h = span_hashes(BYTE_VALUES[shape[keep]], place[w.begin], place[w.end])
        pair = (self.doc[1:] == self.doc[:-1]).nonzero()[0]
        two = h[pair] * np.uint64(31) + h[pair + 1]
        again = np.full(int(self.same.sum()), 7, np.uint64)
        doc = np.concatenate([self.doc, self.doc[pair], self.doc[self.same]])
        key = doc * DIMENSIONS + (np.concatenate([h, two, again]) % np.uint64(DIMENSIONS)).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        doc, weight = key // DIMENSIONS, np.log1p(count)
        norm = np.sqrt(np.bincount(doc, weight**2, len(self.n_words)))
        return doc, key % DIMENSIONS, weight / norm[doc]


def pattern(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ 3 ** np.arange(votes.shape[1])


@dataclass
class WeakModel:
    """Class shares and, for each class and labeller, the chances of a bad vote, of a good one, and 1 for none: a labeller without an opinion says nothing."""

    share: np.ndarray
    chance: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that a document with this pattern of votes is good."""
        v = patterns[:, None] // 3 ** np.arange(self.chance.shape[1]) % 3
        logs = np.log(self.share) + np.log(self.chance)[:, np.arange(v.shape[1]), v].sum(2).T
        return 1 / (1 + np.exp(np.clip(logs[:, BAD] - logs[:, GOOD], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """For each labeller the estimated share of right votes among those it gives."""
        right = self.share[0] * self.chance[0, :, BAD] + self.share[1] * self.chance[1, :, GOOD]
        given = right + self.share[0] * self.chance[0, :, GOOD] + self.share[1] * self.chance[1, :, BAD]
        return dict(zip(LABELLERS, (right / given).tolist()))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 100) -> WeakModel:
    """Two latent classes; votes independent in a class. It starts from the view that one bad vote makes a document bad."""
    v = patterns[:, None] // 3 ** np.arange(labellers) % 3
    good = np.where((v == BAD).any(1), 0.05, 0.95)
    model = WeakModel(np.ones(2) / 2, np.ones((2, labellers, 3)))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        given = np.stack([[np.bincount(v[:, k], weight[c], 3)[:2] + 0.1 for k in range(labellers)] for c in (0, 1)])
        chance = np.concatenate([given / given.sum(2, keepdims=True), np.ones((2, labellers, 1))], 2)
        model = WeakModel((weight.sum(1) + 1) / (weight.sum() + 2), chance)
        new = model.posterior(patterns)
        if np.abs(new - good).max(initial=0) < 1e-6:
            break
        good = new
    return model


def fit_linear(doc: np.ndarray, dim: np.ndarray, weight: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 4.0, penalty: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft targets by gradient descent with momentum; the last weight is the bias."""
    w, step = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    n = max(1, len(target))
    for _ in range(rounds):
        z = np.bincount(doc, weight * w[dim], n)[:n] + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        grad = np.append(np.bincount(dim, weight * error[doc], DIMENSIONS), error.sum()) / n + penalty * w
        step = 0.9 * step - rate * grad
        w = w + step
    return w


def _scan(docs: DataFrame, text: str, make, extra: list[T.StructField]) -> DataFrame:
    """docs with further columns that make(Texts) gives for each step."""
    names = [f.name for f in extra]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(text))
            parts = [make(Texts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in steps(offs)]
            if parts:
                columns = [batch.column(k) for k in batch.schema.names if k not in names]
                new = [x[0] if isinstance(x[0], pa.Array) and len(x) == 1 else pa.concat_arrays(x) if isinstance(x[0], pa.Array) else pa.array(np.concatenate(x)) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays(columns + new, names=schema.names)

    return docs.mapInArrow(run, schema)


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def classify(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """docs with votes (a digit per labeller: 0 bad, 1 good, 2 no opinion), p_weak (the chance of a good document by
    its votes), score (the linear scorer's) and accepted (score >= accept).

    Votes are counted for all documents (3^10 patterns at most reach the driver); the scorer is fitted on at most
    `sample` of them, with FEATURES features at most, in the order of a hash of id and text. Null and empty texts have a
    size vote against them and no features, so their score is the bias; a very long text is judged whole; equal texts
    get equal scores; columns with the new names are replaced; an empty table gives no rows.
    """
    votes = _scan(docs.select(F.col(text).alias("text")), "text", lambda t: [pattern(t.votes())], [T.StructField("pattern", T.LongType())])
    found = votes.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    patterns, counts = np.array([r["pattern"] for r in found], np.int64), np.array([r["n"] for r in found], np.float64)
    weak = expectation_maximisation(patterns, counts)

    cut = min(1 << 20, int((sample << 20) / max(1, counts.sum())))
    some = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(id), F.col(text)).alias("h")).where(F.pmod("h", F.lit(1 << 20)) < cut)

    def sparse(t: Texts) -> list:
        doc, dim, weight = t.features()
        return [pattern(t.votes()), _lists(doc, dim, len(t.n_words)), _lists(doc, weight, len(t.n_words))]

    lists = [T.StructField("pattern", T.LongType()), T.StructField("dim", T.ArrayType(T.LongType())), T.StructField("weight", T.ArrayType(T.DoubleType()))]
    # in the order of the hash, so that a task that runs again gives the same model
    some = table(_scan(some, "text", sparse, lists).select("h", "pattern", "dim", "weight"), "sample")
    sizes = [r["n"] for r in some.select("h", F.size("dim").alias("n")).orderBy("h", "n").limit(sample).collect()]
    got = some.orderBy("h", F.size("dim")).limit(int((np.cumsum([0, *sizes])[1:] <= FEATURES).sum())).toArrow()
    sizes = np.array([len(x) for x in got["dim"]], np.int64)
    flat = lambda c: np.concatenate([np.zeros(0), *(x.flatten().to_numpy() for x in got[c].chunks)])
    linear = fit_linear(np.repeat(np.arange(len(sizes)), sizes), flat("dim").astype(np.int64), flat("weight"), weak.posterior(got["pattern"].to_numpy().astype(np.int64)))
    model = docs.sparkSession.sparkContext.broadcast((weak, linear))

    def judge(t: Texts) -> list:
        weak, linear = model.value
        doc, dim, weight = t.features()
        n = len(t.n_words)
        score = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weight * linear[dim], n)[:n] + linear[-1], -500, 500)))
        v = t.votes()
        return [pa.array(["".join(map(str, x)) for x in v.tolist()], pa.string()), weak.posterior(pattern(v)), score]

    out = _scan(docs, text, judge, [T.StructField("votes", T.StringType()), T.StructField("p_weak", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return out.withColumn("accepted", F.col("score") >= accept)
