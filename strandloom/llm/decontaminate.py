"""Benchmark decontamination over a positional inverted index.

The training texts become index segments: each segment holds the postings of every
term of some documents, as positions in the segment's token stream, and is one row of
a table in the shared folder. Segments are built where the texts lie, without a
shuffle. A test phrase is looked up in a segment by intersecting its terms' lists,
each shifted by the term's place in the phrase, from the rarest term on. Test phrases
travel to the segments in portions of bounded size, so a larger test set means more
passes over the index, not a larger broadcast.

Matches, over lower-case word tokens:

* ``phrase``: at least WINDOW consecutive tokens of an item (all of a shorter item) stand
  consecutively in a document. Overlapping windows are merged to the longest run.
* ``near``: all distinct terms of a WINDOW of an item stand, in any order, within
  WINDOW + SLOP consecutive tokens of a document, where the window has no phrase match in
  that document. A window counts for this only if it has NEAR_TERMS distinct terms, and so
  do not those of items that are shorter. What matches depends on the item and the document
  alone, not on the rest of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import TOKEN, Scratch, by_ids, slices, table, words

WINDOW, SLOP, NEAR_TERMS = 8, 4, 5
#: Tokens after which a segment is closed; a longer document has a segment of its own.
SEGMENT_TOKENS = 1_000_000
#: Tokens of test items that travel to the segments at once.
PORTION_TOKENS = 1_000_000
#: Places of rarest terms that are looked at together.
AT_ONCE = 400_000

INDEX = "docs binary, starts binary, terms binary, counts binary, postings binary"
MATCHES = "doc_id long, item_id long, kind string, doc_at long, item_at int, n_tokens int"


class _Builder:
    """One segment in the making."""

    def __init__(self, gap: int):
        self.gap, self.at = gap, 0
        self.ids: dict[str, int] = {}
        self.docs: list[int] = []
        self.starts: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.where: list[np.ndarray] = []

    def add(self, doc: int, tokens: list[str]) -> None:
        ids = self.ids
        n = len(tokens)
        self.docs.append(doc)
        self.starts.append(self.at)
        self.tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in tokens), np.int32, n))
        self.where.append(np.arange(self.at, self.at + n, dtype=np.int32))
        # The gap keeps phrases and spans from reaching into the next document.
        self.at += n + self.gap

    def row(self) -> tuple[bytes, ...]:
        tokens, where = np.concatenate(self.tokens), np.concatenate(self.where)
        order = np.argsort(tokens, kind="stable")
        counts = np.bincount(tokens, minlength=len(self.ids)).astype(np.int32)
        postings = np.diff(where[order], prepend=np.int32(0))
        return (np.array(self.docs, np.int64).tobytes(), np.array(self.starts, np.int32).tobytes(), "\n".join(self.ids).encode("utf-8", "surrogatepass"), counts.tobytes(), postings.tobytes())


def _segments(gap: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(b: _Builder) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in b.row()], ["docs", "starts", "terms", "counts", "postings"])

        now = _Builder(gap)
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words(text)
                if not tokens:
                    continue
                if now.docs and now.at + len(tokens) > most:
                    yield closed(now)
                    now = _Builder(gap)
                now.add(doc, tokens)
        if now.docs:
            yield closed(now)

    return run


def build_index(docs: DataFrame, window: int = WINDOW, slop: int = SLOP, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Index segments of all tokens of ``docs``; rows without doc_id or text, and texts without words, have no postings."""
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return named.mapInArrow(_segments(2 * (window + slop), segment_tokens), INDEX)


@dataclass
class Segment:
    """Postings of a vocabulary's terms: those of term t are positions[first[t] : first[t] + sizes[t]].

    ``there`` tells by position, from -margin on, which of the terms stands there; -1 for another or none.
    """

    docs: np.ndarray
    starts: np.ndarray
    positions: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    there: np.ndarray
    margin: int

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term] + self.sizes[term]]

    def locate(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document ordinals and positions within the documents."""
        k = np.searchsorted(self.starts, positions, side="right") - 1
        return k, positions - self.starts[k]


def _open(row: dict, vocabulary: pa.Array, margin: int) -> Segment:
    terms = pc.split_pattern(pa.scalar(row["terms"].decode("utf-8", "surrogatepass")), "\n").values
    counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
    # Differences run on from list to list, so that one sum restores all positions.
    positions = np.cumsum(np.frombuffer(row["postings"], np.int32), dtype=np.int64)
    place = pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy()
    first, sizes = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    known = place >= 0
    first[place[known]], sizes[place[known]] = (np.cumsum(counts) - counts)[known], counts[known]
    there = np.full(int(positions.max(initial=0)) + 1 + 2 * margin, -1, np.int32)
    there[positions + margin] = np.repeat(place, counts)
    return Segment(np.frombuffer(row["docs"], np.int64), np.frombuffer(row["starts"], np.int32).astype(np.int64), positions, first, sizes, there, margin)


@dataclass
class Portion:
    """Test items whose tokens travel together: their vocabulary and windows.

    Row k of ``terms`` has the window's tokens as places in the vocabulary, -1 after the
    end of a short one; ``item`` and ``at`` tell where it stands, ``near`` whether it is
    searched for proximity.
    """

    vocabulary: list[str]
    item: np.ndarray
    at: np.ndarray
    size: np.ndarray
    terms: np.ndarray
    near: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, str]], window: int) -> Portion:
        place: dict[str, int] = {}
        rows: list[tuple[int, int, int]] = []
        parts = [np.zeros((0, window), np.int64)]
        for item, text in items:
            own = np.array([place.setdefault(w, len(place)) for w in words(text)], np.int64)
            if n := min(window, len(own)):
                part = np.full((len(own) - n + 1, window), -1, np.int64)
                part[:, :n] = np.lib.stride_tricks.sliding_window_view(own, n)
                rows += [(item, k, n) for k in range(len(part))]
                parts.append(part)
        terms = np.concatenate(parts)
        item, at, size = np.array(rows, np.int64).reshape(-1, 3).T
        ordered = np.sort(terms, axis=1)
        distinct = 1 + (np.diff(ordered, axis=1) > 0).sum(1)
        return Portion(list(place), item, at, size, terms, (size == window) & (distinct >= min(NEAR_TERMS, window)))


def _places(segment: Segment, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``terms``, position) of all postings of the terms, some at a time; no term's own are parted."""
    sizes = segment.sizes[terms]
    group = (np.cumsum(sizes) - sizes) // AT_ONCE
    for a, b in zip(edges := np.flatnonzero(np.diff(group, prepend=-1)), [*edges[1:], len(terms)]):
        n = sizes[a:b]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(np.arange(a, b), n), segment.positions[np.repeat(segment.first[terms[a:b]], n) + inside]


def phrases(segment: Segment, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of each place where the tokens of a row of ``terms`` stand one after another; all of them occur.

    The list of a row's rarest term, shifted by the term's place in the row, is cut down by the others, rarest first.
    """
    order = np.argsort(np.where(terms < 0, np.iinfo(np.int64).max, segment.sizes[terms]), axis=1, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for row, start in _places(segment, terms[np.arange(len(terms)), order[:, 0]]):
        start = start - order[row, 0]
        for j in range(1, terms.shape[1]):
            column = order[row, j]
            want = terms[row, column]
            ok = (want < 0) | (segment.there[np.maximum(start + column + segment.margin, 0)] == want)
            row, start = row[ok], start[ok]
        found.append((row, start))
    return tuple(np.concatenate(x) for x in zip(*found))


def near_places(segment: Segment, terms: np.ndarray, anchors: np.ndarray, span: int) -> np.ndarray:
    """Least left ends of spans that hold all the terms; ends nearer than a span to the one before belong to it.

    ``anchors`` are the places of one of the terms near which the others stand.
    """
    lefts = np.unique((anchors[:, None] - np.arange(span)).reshape(-1))
    for t in set(terms.tolist()):
        there = segment.of(t)
        k = np.searchsorted(there, lefts)
        ok = k < len(there)
        ok[ok] = there[k[ok]] <= lefts[ok] + span - 1
        lefts = lefts[ok]
    return lefts[np.diff(lefts, prepend=lefts[0] - span) >= span] if len(lefts) else lefts


def neighbourhoods(segment: Segment, terms: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, anchors): places of the rarest term of a row of ``terms`` within a span of which all its other terms stand."""
    order = np.argsort(segment.sizes[terms], axis=1, kind="stable")
    around = np.arange(-span + 1, span) + segment.margin
    for row, anchor in _places(segment, terms[np.arange(len(terms)), order[:, 0]]):
        for j in range(1, terms.shape[1]):
            want = terms[row, order[row, j]]
            ok = (segment.there[anchor[:, None] + around] == want[:, None]).any(1)
            row, anchor = row[ok], anchor[ok]
        for a, b in zip(edges := np.flatnonzero(np.diff(row, prepend=-1)), [*edges[1:], len(row)]):
            yield int(row[a]), anchor[a:b]


def _merged(hits: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(doc ordinal, item, diagonal, item_at, n) windows into longest runs on a diagonal."""
    out: list[list[int]] = []
    for doc, item, diagonal, at, n in sorted(hits):
        last = out[-1] if out else None
        if last and last[:3] == [doc, item, diagonal] and at <= last[3] + last[4]:
            last[4] = max(last[4], at + n - last[3])
        else:
            out.append([doc, item, diagonal, at, n])
    return [tuple(x) for x in out]


def segment_matches(segment: Segment, portion: Portion, span: int) -> list[tuple[int, int, str, int, int, int]]:
    occur = np.flatnonzero(((portion.terms < 0) | (segment.sizes[portion.terms] > 0)).all(1)) if len(portion.vocabulary) else np.zeros(0, np.int64)
    row, starts = phrases(segment, portion.terms[occur])
    row = occur[row]
    docs, inside = segment.locate(starts)
    exact = [(d, int(portion.item[k]), p - int(portion.at[k]), int(portion.at[k]), int(portion.size[k])) for k, d, p in zip(row.tolist(), docs.tolist(), inside.tolist())]
    matched, near = set(zip(row.tolist(), docs.tolist())), []
    wanted = occur[portion.near[occur]]
    for k, anchors in neighbourhoods(segment, portion.terms[wanted], span):
        k = int(wanted[k])
        # A span may begin in the gap before its document; its right end lies in it or in the gap after.
        beside, where = segment.locate(near_places(segment, portion.terms[k], anchors, span) + span - 1)
        near += [(d, int(portion.item[k]), "near", max(0, p - span + 1), int(portion.at[k]), int(portion.size[k])) for d, p in zip(beside.tolist(), where.tolist()) if (k, d) not in matched]
    return [(int(segment.docs[d]), i, kind, p, at, n) for d, i, kind, p, at, n in [(d, i, "phrase", g + at, at, n) for d, i, g, at, n in _merged(exact)] + near]


def _match(shared, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = shared.value
        vocabulary = pa.array(portion.vocabulary, pa.string())
        for batch in slices(batches, 1):
            got = segment_matches(_open(batch.to_pylist()[0], vocabulary, 2 * span), portion, span)
            columns = list(zip(*got)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "kind", "doc_at", "item_at", "n_tokens"])

    return run


def _portions(items: DataFrame, window: int, portion_tokens: int) -> Iterator[Portion]:
    """Test items streamed to the driver, a portion at a time."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        held.append((row.i, row.t))
        size += len(TOKEN.findall(row.t))
        if size >= portion_tokens:
            yield Portion.of(held, window)
            held, size = [], 0
    if held:
        yield Portion.of(held, window)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, portion_tokens: int = PORTION_TOKENS, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """(doc_id, item_id, kind, doc_at, item_at, n_tokens) of every match of a test item in a document.

    ``doc_at`` and ``item_at`` count tokens from 0; a near match gives the least left
    end of a span. Repeated rows of ``docs`` or ``items`` give each match once. Rows
    with a null id or text, texts without words and empty tables match nothing. Texts of
    any length are searched whole. Terms that occur equally often are taken in the order
    of the window, which changes no result. Other columns of either table, whatever their
    names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "postings")
    index = scratch.keep("index", build_index(docs, window, slop, segment_tokens))
    found = None
    for portion in _portions(items, window, portion_tokens):
        got = index.mapInArrow(_match(spark.sparkContext.broadcast(portion), window + slop), MATCHES)
        found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], MATCHES) if found is None else found.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose doc_id has any match; columns, of any name and type, as they were.

    Rows without doc_id or text stay, and so do texts without words. Rows that share a
    doc_id go together. Texts are searched whole, however long. An empty table of
    documents gives no rows, one of items takes none away.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    return by_ids(docs, scratch.keep("ids", matches(docs, items, **options).select("doc_id").distinct()), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
