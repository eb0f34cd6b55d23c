"""Language identification by a convolutional network over bytes.

Filters of several widths run over a window of WINDOW bytes; each filter's largest
response, rectified, goes to a softmax over the languages. Bytes are one-hot, so that a
filter is a table of 256 entries for each of its places. The network is trained in numpy
on windows of labelled texts. A text is cut into fixed-length windows that cover all of
it; its languages' log probabilities are summed over the windows, each weighted with its
bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import slices, table

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 12, 256
#: Most labelled texts, chosen by hash of doc_id, and most of their windows that are fitted on.
MAX_LABELLED, MAX_WINDOWS = 3_000, 12_000
#: Steps of the training, at every size of the sample.
STEPS = 560
#: Windows that are scored at once.
BATCH = 512


def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes; the last window is padded with zeros. None for empty data."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    languages: list[str]
    #: For each width its filters: (width, 256, FILTERS).
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, and at which byte if asked."""
        values, places = [], []
        for filters, bias in zip(self.tables, self.biases):
            size = x.shape[1] - len(filters) + 1
            response = filters[0][x[:, :size]]
            for j in range(1, len(filters)):
                response += filters[j][x[:, j : j + size]]
            if where:
                place = response.argmax(1)
                places.append(place)
                values.append(np.take_along_axis(response, place[:, None], 1)[:, 0] + bias)
            else:
                values.append(response.max(1) + bias)
        return np.concatenate(values, axis=1), np.concatenate(places, axis=1) if where else np.zeros(0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, languages) of windows."""
        out = [np.zeros((0, len(self.languages)))]
        for at in range(0, len(x), BATCH):
            values, _ = self.pooled(x[at : at + BATCH])
            out.append(_log_softmax(np.maximum(values, 0).astype(np.float64) @ self.weights + self.offset))
        return np.concatenate(out)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, rate: float = 0.01, batch: int = 64, seed: int = 11) -> Network:
    """Adam on windows ``x`` (n, WINDOW) with indices ``y`` of ``languages``, which are drawn without putting back until none is left, and then anew."""
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    net = Network(languages, tables, biases, rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), np.zeros(len(languages)))
    params = [*tables, *biases, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(batch, len(x)):
            order = np.append(order, rng.permutation(len(x)))
        rows, order = order[:batch], order[batch:]
        own = x[rows]
        values, places = net.pooled(own, where=True)
        hidden = np.maximum(values, 0).astype(np.float64)
        g = np.exp(_log_softmax(hidden @ net.weights + net.offset))
        g[np.arange(len(rows)), y[rows]] -= 1
        g /= len(rows)
        back = (g @ net.weights.T) * (values > 0)
        slopes = []
        for k, w in enumerate(WIDTHS):
            slope = np.zeros((w, 256, FILTERS), np.float32)
            part, place = back[:, k * FILTERS : (k + 1) * FILTERS], places[:, k * FILTERS : (k + 1) * FILTERS]
            column = np.broadcast_to(np.arange(FILTERS), part.shape)
            for j in range(w):
                np.add.at(slope[j], (np.take_along_axis(own, place + j, 1), column), part)
            slopes.append(slope)
        slopes += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
        slopes += [hidden.T @ g, g.sum(0)]
        for p, s, a, b in zip(params, slopes, first, second):
            a += 0.1 * (s - a)
            b += 0.001 * (s * s - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def sampled(texts: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """(id, x, lang) of at most ``most`` windows of the texts (id, text, lang).

    All windows of a text are shuffled by hash, and every text gives its first ones before
    any gives more: each window of a text, however long, has the same chance.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            key, text, lang = (batch.column(k)[0].as_py() for k in range(3))
            own = windows(text.encode("utf-8", "surrogatepass"))
            drawn = np.array([xxhash.xxh64_intdigest(f"{key} {k}") for k in range(len(own))], np.uint64)
            first = np.argsort(drawn, kind="stable")[:most]
            columns = ([key] * len(first), [own[k].tobytes() for k in first], [lang] * len(first), np.arange(len(first)), drawn[first].view(np.int64))
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "x", "lang", "turn", "drawn"])

    return texts.mapInArrow(rows, "id long, x binary, lang string, turn long, drawn long").orderBy("turn", "drawn", "id", "x").limit(most).select("id", "x", "lang")


def train(docs: DataFrame, bound: int = MAX_LABELLED, most: int = MAX_WINDOWS) -> Network | None:
    """Fits on windows of at most ``bound`` texts whose ``lang`` is given, on at most ``most`` of them; None where there are none."""
    chosen = (
        docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .where("id IS NOT NULL AND lang IS NOT NULL AND text <> ''")
        .withColumn("order", F.xxhash64("id"))
    )
    # Ids alone are sorted; the chosen texts are read again.
    ids = chosen.select("id", "order").distinct().orderBy("order", "id").limit(bound).select(F.col("id").alias("__id"))
    got = chosen.join(F.broadcast(ids), F.col("id") == F.col("__id")).select("id", "text", "lang")
    got = sampled(got, most).toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    languages = sorted(set(got.column("lang").to_pylist()))
    if not languages:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return fit(x, np.array([languages.index(k) for k in got.column("lang").to_pylist()]), languages)


def identifier(spark: SparkSession, network: Network | None) -> Callable[[Column], Column]:
    """Column function: struct of the likeliest language and its probability, averaged over bytes."""
    shared = spark.sparkContext.broadcast(network)

    @F.arrow_udf("struct<lang:string,confidence:double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        for texts in batches:
            names: list[str | None] = []
            sure: list[float | None] = []
            for at in range(0, len(texts), 128):
                data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts.slice(at, 128).to_pylist()]
                own = [windows(d) for d in data]
                if net is None or not sum(map(len, own)):
                    names += [None] * len(data)
                    sure += [None] * len(data)
                    continue
                logs = net.log_probabilities(np.concatenate(own))
                ends = np.cumsum([len(w) for w in own])
                for d, w, end in zip(data, own, ends):
                    if not len(w):
                        names.append(None)
                        sure.append(None)
                        continue
                    share = np.full(len(w), WINDOW / len(d))
                    share[-1] = (len(d) - WINDOW * (len(w) - 1)) / len(d)
                    mean = share @ logs[end - len(w) : end]
                    p = np.exp(mean - mean.max())
                    names.append(net.languages[int(p.argmax())])
                    sure.append(float(p.max() / p.sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["lang", "confidence"])

    return identify


def identify_languages(docs: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, lang, confidence) of every row of ``docs``; lang is what the text tells.

    A null or empty text has a null language, and so has every text if no row of
    ``docs`` has a label. Equal probabilities give the language that is first by name.
    Rows are judged one by one: repeated rows and null ids stay. Texts are judged by all
    their windows, however long. Other columns, whatever their names, are not read. An
    empty table gives no rows.
    """
    found = identifier(docs.sparkSession, train(docs, bound))(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long"), found.alias("found")).select("doc_id", "found.lang", "found.confidence")


def op3_langid_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES = {"op3_langid_cnn": op3_langid_cnn}
ORACLE_SQL: dict[str, str] = {}
