"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature, and each of a few chosen pairs of features, has a lookup table over
bins. The tables are learned by cyclic boosting: round after round, one shallow tree
per table is fitted to the current gradients, and its leaves, scaled by the learning
rate, are added to the table (Lou et al., "Accurate intelligible models with pairwise
interactions", KDD 2013). A score is the intercept plus one table entry per feature
and per pair, computed for a batch of rows at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import labelled, least, table

#: Most labelled documents that are fitted on; the sample is by hash of doc_id.
MAX_LABELLED = 20_000
THRESHOLD = 0.5

FEATURES = (
    "log_words", "mean_word_length", "upper_share", "symbol_share", "pipe_share", "digit_share", "distinct_words", "top_word_share",
    "repeat_next_share", "repeated_line_share", "log_words_per_line", "word_end_symbol_share",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]] = True


def features(text: str) -> tuple[float, ...]:
    """Values of FEATURES over the whole text; all defined for an empty text."""
    data = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    tokens = text.split()
    n = max(1, len(tokens))
    counts = Counter(tokens)
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    letters = max(1, int(seen[_LETTER].sum()))
    return (
        float(np.log1p(len(tokens))),
        len(text) / n,
        float(seen[_UPPER].sum()) / letters,
        float(seen[_SYMBOL].sum()) / size,
        float(seen[124]) / n,
        float(seen[_DIGIT].sum()) / size,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, tokens, tokens[1:])) / n,
        1 - len(set(lines)) / m,
        float(np.log1p(n / m)),
        sum(not x[-1].isalnum() and x[-1] not in ".,;:?!" for x in tokens) / n,
    )


def feature_rows(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            out += values[np.searchsorted(cuts, x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], x[:, k], side="right") for pair in self.pairs for k in pair}
        for (i, j), values in zip(self.pairs, self.pair_tables):
            out += values[coarse[i], coarse[j]]
        return out


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds halfway between distinct quantiles."""
    steps = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
    return (steps[1:] + steps[:-1]) / 2


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Values per bin of a tree of at most so many leaves on one axis, grown best first."""
    parts, values = [(0, len(g))], np.zeros(len(g))

    def split(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        total_g, total_h = g[a:b].sum(), h[a:b].sum()
        gains = _gain(left_g, left_h, l2) + _gain(total_g - left_g, total_h - left_h, l2) - _gain(total_g, total_h, l2)
        k = int(gains.argmax())
        return float(gains[k]), a + k + 1

    while len(parts) < leaves:
        best, at, part = max((*split(*p), p) for p in parts)
        if best <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    for a, b in parts:
        values[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return values


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Best tree that cuts one axis once and then each half once on the other; its values and gain."""
    best, values = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            found, total = np.zeros_like(gg), 0.0
            for a, b in ((0, cut), (cut, gg.shape[0])):
                half = _tree(gg[a:b].sum(0), hh[a:b].sum(0), 2, l2)
                found[a:b] = half
                # The gain of a leaf with value v over sums G, H is -(2 v G + v v (H + l2)); equal bins share a leaf.
                for v in np.unique(half):
                    s = half == v
                    total += _gain(gg[a:b][:, s].sum(), hh[a:b][:, s].sum(), l2)
            if total > best:
                best, values = float(total), (found.T if flip else found)
    return values, best - float(_gain(g.sum(), h.sum(), l2))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15, bins: int = 48, pair_bins: int = 8, pairs: int = 6, l2: float = 1.0) -> AdditiveModel:
    """Cyclic boosting on rows ``x`` with labels ``y`` in {0, 1}.

    Without rows the model says 0.5 for every text; with one class it says that
    class's smoothed share.
    """
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, k], bins) if n else np.zeros(0) for k in range(width)]
    pair_cuts = [_cuts(x[:, k], pair_bins) if n else np.zeros(0) for k in range(width)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = AdditiveModel(start, cuts, tables, pair_cuts, [], [])
    if not n or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(pair_cuts)]
    logit = np.full(n, start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k in range(width):
            g, h = slopes()
            size = len(tables[k])
            step = rate * _tree(np.bincount(at[k], g, size), np.bincount(at[k], h, size), 4, l2)
            tables[k] += step
            logit += step[at[k]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1
        cell = coarse[i] * columns + coarse[j]
        return tuple(np.bincount(cell, s, rows * columns).reshape(rows, columns) for s in slopes())

    ranked = sorted(((_grid_tree(*grid(i, j), l2)[1], (i, j)) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [pair for gain, pair in ranked[:pairs] if gain > 1e-6]
    model.pair_tables = [np.zeros((len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), values in zip(model.pairs, model.pair_tables):
            step = rate * _grid_tree(*grid(i, j), l2)[0]
            values += step
            logit += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> AdditiveModel:
    """Fits on at most ``bound`` labelled documents; features are computed where the texts are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = feature_rows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "y", "x"])

    got = labelled(docs, labels, "quality", bound).mapInArrow(rows, "id long, y int, x binary")
    got = least(got, bound)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy().astype(np.float64) > 0)


def scorer(spark: SparkSession, model: AdditiveModel) -> Callable[[Column], Column]:
    """Column function: probability of good quality; null for a null text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.array([], pa.float64())]
            for at in range(0, len(texts), 256):
                piece = texts.slice(at, 256)
                logits = shared.value.logits(feature_rows(piece.fill_null("").to_pylist()))
                parts.append(pa.array(1 / (1 + np.exp(-logits)), mask=piece.is_null().to_numpy(zero_copy_only=False)))
            yield pa.concat_arrays(parts)

    return quality


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = MAX_LABELLED) -> DataFrame:
    """Rows of ``docs`` whose probability of good quality reaches ``threshold``, with the columns of ``docs``.

    A null text has no score and is rejected; an empty text is scored like any other.
    Features are of the whole text, however long. Rows are judged one by one, so
    repeated rows share one fate; one exactly at the threshold stays. Null ids and
    further columns, whatever their names, play no part. An empty ``docs`` gives no
    rows; without labelled documents each text has probability 0.5 and so stays.
    """
    quality = scorer(docs.sparkSession, train(docs, labels, bound))
    return docs.where(quality(F.col("text")) >= threshold)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality) of the documents that the classifier keeps; all others are rejected. Odd rows fare as in :func:`keep_quality`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quality = scorer(spark, train(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", quality(F.col("text")).alias("quality")).where(F.col("quality") >= THRESHOLD)


QUERIES = {"op1_quality_gam": op1_quality_gam}
ORACLE_SQL: dict[str, str] = {}
