"""Toxicity: a factorization machine over hashed terms.

The terms of a window have weights, and each pair of them interacts through the
product of their latent vectors (Rendle, "Factorization machines", ICDM 2010), so that
two terms which are harmless alone may be toxic together. A text's score is that of its
worst window; windows of WINDOW words overlap by half and cover the whole text. In
training, a labelled text counts with its worst window under the current weights. Terms
are words and the beginnings of longer words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import labelled, least, slices, table, words

BUCKETS, FACTORS, WINDOW = 1 << 20, 8, 64
#: Letters of a word's beginning that are a term beside the word itself.
STEM = 5
THRESHOLD = 0.5
#: Most labelled documents that are fitted on; the sample is by hash of doc_id.
MAX_LABELLED = 8_000
#: Distinct words that a worker remembers the rows of before it starts anew.
MEMO = 500_000

HALF = WINDOW // 2


def buckets(word: str) -> tuple[int, ...]:
    """Of the word and, where it is longer, of its beginning."""
    terms = (word, word[:STEM] + "-") if len(word) > STEM else (word,)
    return tuple(xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms)


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, half window) of each term."""
    found = [(b, k // HALF) for k, w in enumerate(words(text)) for b in buckets(w)]
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Hits:
    """Weighted terms of texts, in order: the row of each, its text and half window.

    Windows are two halves in a row. Only those with a weighted term are listed; a half
    whose neighbour has none stands for both.
    """

    def __init__(self, row: np.ndarray, text: np.ndarray, half: np.ndarray):
        self.row = row
        key = text * (1 << 32) + half
        self.edge = np.flatnonzero(np.diff(key, prepend=-1))
        key = key[self.edge]
        text = text[self.edge]
        after = np.zeros(len(key), bool)
        after[:-1] = key[1:] == key[:-1] + 1
        lone = np.zeros(len(key), bool)
        lone[after] = True
        lone[1:] &= key[1:] != key[:-1] + 1
        k = np.arange(len(key))
        #: First and last half of each window, and its text.
        first, last = np.concatenate([k, k[lone]]), np.concatenate([k + after, k[lone]])
        order = np.lexsort((last, first))
        self.first, self.last, self.text = first[order], last[order], text[first[order]]
        self.ends = np.append(self.edge[1:], len(row))

    def logits(self, bias: float, rows: np.ndarray) -> np.ndarray:
        """Of all windows."""
        if not len(self.row):
            return np.zeros(0)
        found = rows[self.row]
        sums = np.add.reduceat(found, self.edge, axis=0)
        squares = np.add.reduceat((found[:, 1:] ** 2).sum(1), self.edge)
        two = self.last > self.first
        s = sums[self.first] + np.where(two[:, None], sums[self.last], 0)
        q = squares[self.first] + np.where(two, squares[self.last], 0)
        return bias + s[:, 0] + ((s[:, 1:] ** 2).sum(1) - q) / 2

    def worst(self, scores: np.ndarray) -> np.ndarray:
        """The window with the largest score of each text that has one; the first of equals."""
        order = np.lexsort((-scores, self.text))
        return order[np.flatnonzero(np.diff(self.text[order], prepend=-1))]


@dataclass
class Machine:
    """``buckets`` (sorted) have the rows of ``rows``, a term's weight and its latent vector; other terms have none."""

    bias: float
    buckets: np.ndarray
    rows: np.ndarray

    def places(self, word: str) -> tuple[int, ...]:
        found = ((int(np.searchsorted(self.buckets, b)), b) for b in buckets(word))
        return tuple(k for k, b in found if k < len(self.buckets) and self.buckets[k] == b)

    def logits(self, hits: Hits, texts: int) -> np.ndarray:
        """Of each text: the worst window's, and no less than the bias, which a window without weighted terms has."""
        out = np.full(texts, self.bias)
        np.maximum.at(out, hits.text, hits.logits(self.bias, self.rows))
        return out


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, least_texts: int = 8, deviation: float = 5.0, epochs: int = 8, rate: float = 0.2, l2: float = 1e-3, batch: int = 64, prior: float = 20.0, seed: int = 7) -> Machine:
    """Adagrad on each text's worst window; ``texts`` are the buckets of their terms and their half windows.

    Terms have weights if they occur in ``least_texts`` texts at least and if the toxic
    among these are ``deviation`` standard deviations from what chance gives. Texts with
    the same label and exactly the same terms are copies and count once. With no rows or
    one class, all texts get that class's smoothed share.
    """
    share = (float(np.sum(y)) + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    none = Machine(bias, np.zeros(0, np.int64), np.zeros((0, 1 + FACTORS)))
    kept: dict[tuple, int] = {}
    for k, (t, _) in enumerate(texts):
        if len(t):
            kept.setdefault((xxhash.xxh3_128_digest(np.unique(t).astype("<u4").tobytes()), bool(y[k])), k)
    texts, y = [texts[k] for k in kept.values()], np.asarray(y, bool)[list(kept.values())]
    if not len(y) or y.min() == y.max():
        return none
    counts, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for (t, _), bad in zip(texts, y):
        own = np.unique(t)
        counts[own] += 1
        toxic[own] += bad
    base = y.mean()
    far = np.abs(toxic - counts * base) / np.sqrt(np.maximum(counts, 1) * base * (1 - base))
    chosen = np.flatnonzero((counts >= least_texts) & (far >= deviation))
    if not len(chosen):
        return none
    toxic, counts = toxic[chosen], counts[chosen]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    parts = [(place[t[m]], np.full(m.sum(), k), h[m]) for k, (t, h) in enumerate(texts) for m in [place[t] >= 0]]
    hits = Hits(*(np.concatenate(x) for x in zip(*parts)))
    rng = np.random.default_rng(seed)
    rows = np.concatenate([np.zeros((len(chosen), 1)), rng.normal(0, 0.02, (len(chosen), FACTORS))], axis=1)
    # The first worst windows are those with terms that toxic texts have and others lack.
    rows[:, 0] = 0.5 * np.log((toxic + prior * base) / (counts - toxic + prior * (1 - base)) * (1 - base) / base)
    speed, bias_speed = np.ones(rows.shape), 1.0
    bare = np.setdiff1d(np.arange(len(y)), hits.text)
    for _ in range(epochs):
        worst = hits.worst(hits.logits(bias, rows))
        # Texts without a weighted term still tell of the bias.
        order = rng.permutation(len(worst) + len(bare))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            pick, empty = worst[some[some < len(worst)]], bare[some[some >= len(worst)] - len(worst)]
            slope_bias = float((1 / (1 + np.exp(-bias)) - y[empty]).sum())
            if len(pick):
                starts, stops = hits.edge[hits.first[pick]], hits.ends[hits.last[pick]]
                n = stops - starts
                edge = np.cumsum(n) - n
                of = np.repeat(np.arange(len(pick)), n)
                own = hits.row[np.repeat(starts - edge, n) + np.arange(n.sum())]
                found = rows[own]
                s = np.add.reduceat(found, edge, axis=0)
                q = np.add.reduceat((found[:, 1:] ** 2).sum(1), edge)
                g = 1 / (1 + np.exp(-(bias + s[:, 0] + ((s[:, 1:] ** 2).sum(1) - q) / 2))) - y[hits.text[pick]]
                slope = np.concatenate([g[of, None], g[of, None] * (s[of, 1:] - found[:, 1:])], axis=1)
                step = np.zeros(rows.shape)
                np.add.at(step, own, slope)
                step += l2 * len(some) * rows * (step != 0)
                speed += step**2
                rows -= rate * step / np.sqrt(speed)
                slope_bias += float(g.sum())
            bias_speed += slope_bias**2
            bias -= rate * slope_bias / np.sqrt(bias_speed)
    return Machine(float(bias), chosen, rows)


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Machine:
    """Fits on at most ``bound`` labelled documents; terms are hashed where the texts are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [hashed(t) for t in batch.column(1).to_pylist()]
            packed = [[x.astype("<u4").tobytes() for x in part] for part in zip(*found)] or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.binary()) for x in packed)], ["id", "y", "x", "half"])

    got = labelled(docs, labels, "toxic", bound).mapInArrow(rows, "id long, y int, x binary, half binary")
    got = least(got, bound)
    texts = [tuple(np.frombuffer(x, "<u4") for x in both) for both in zip(got.column("x").to_pylist(), got.column("half").to_pylist())]
    return fit(texts, got.column("y").to_numpy() > 0)


def scorer(spark: SparkSession, machine: Machine) -> Callable[[Column], Column]:
    """Column function: probability that the worst window is toxic; null for a null text."""
    shared = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        known: dict[str, tuple[int, ...]] = {}

        def score(texts: list[str]) -> np.ndarray:
            found: list[tuple[int, int, int]] = []
            for k, text in enumerate(texts):
                tokens = words(text)
                own = set(tokens)
                for w in own.difference(known):
                    known[w] = model.places(w)
                if any(map(known.__getitem__, own)):
                    found += [(r, k, at // HALF) for at, w in enumerate(tokens) for r in known[w]]
                if len(known) > MEMO:
                    known.clear()
            return model.logits(Hits(*np.array(found, np.int64).reshape(-1, 3).T), len(texts))

        for texts in batches:
            parts = [pa.array([], pa.float64())]
            for at in range(0, len(texts), 64):
                piece = texts.slice(at, 64)
                logits = score(piece.fill_null("").to_pylist())
                parts.append(pa.array(1 / (1 + np.exp(-logits)), mask=piece.is_null().to_numpy(zero_copy_only=False)))
            yield pa.concat_arrays(parts)

    return toxicity


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxicity) of the rows of ``docs`` whose toxicity reaches ``threshold``.

    A null text is not reported; a text without words has the base rate. Every window of a
    text is scored, however long it is. Rows are judged one by one, so repeated rows are
    reported alike and a null id stays null. A toxicity that equals ``threshold`` is
    reported. Other columns, whatever their names, are not read. An empty ``docs`` gives no
    rows; without labels every text has the toxicity 0.5.
    """
    toxicity = scorer(docs.sparkSession, train(docs, labels, bound))
    return docs.select("doc_id", toxicity(F.col("text")).alias("toxicity")).where(F.col("toxicity") >= threshold)


def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity_fm": op8_toxicity_fm}
ORACLE_SQL: dict[str, str] = {}
