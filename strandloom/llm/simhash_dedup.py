"""Near duplicates by SimHash, candidates pruned by pigeonring chains.

A text's fingerprint has 128 bits: each distinct word votes with the square root of
its count. Two texts are near copies if their fingerprints differ in at most TAU bits
and so do, in at most CONTEXT bits, those of their shingles of SHINGLE words: the words
of long texts converge on their language's frequencies, their shingles don't.

The bits lie on a ring of SEGMENTS segments with differences d_0 .. d_{m-1}. If they
sum to at most tau, some start s has every chain of l consecutive segments from s
within l * tau / m (Qin and Xiao, "Pigeonring", VLDB 2018). So d_s is at most
floor(tau / m), which is 2 here, and two values that differ in two bits both lie one
bit from a common value: each fingerprint has as keys the values within one bit of each of
its segments, and near pairs meet under some key. There the chain's budgets are checked
segment by segment; the last budget is the full Hamming check. The search is exact: no
bucket, however full, is cut.

A bucket is named by a segment's leading bits, so most keys of a fingerprint lie in its
own bucket: it is sent there once, and once to each bucket that differs in one leading
bit. The keys are made where they are compared. The leading bits grow with the logarithm
of the number of fingerprints.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, by_ids, slices, table, words
from strandloom.llm.components import components

BITS, TAU, SEGMENTS = 128, 16, 6
#: Words in a shingle, and the bits in which the shingles' fingerprints of near copies may differ.
SHINGLE, CONTEXT = 3, 42
PRINT = ["hi", "lo", "shi", "slo"]
#: Fingerprints in one bucket of the search, 32 bytes each, and their keys that are in memory at once.
BUCKET_ENTRIES, CHUNK_KEYS = 1_000_000, 2_000_000


def fingerprint(tokens: list[str]) -> bytes:
    """16 bytes; a bit is set where the votes of the distinct words sum to more than zero."""
    counts = Counter(tokens)
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in counts), np.uint8).reshape(-1, 16)
    votes = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    ones = votes @ np.unpackbits(digests, axis=1)
    return np.packbits(ones > votes.sum() / 2).tobytes()


def context(tokens: list[str]) -> bytes:
    """16 bytes; each distinct shingle has one vote, however often it stands there. A text of fewer words is one shingle."""
    of = {w: xxhash.xxh3_64_intdigest(w) for w in set(tokens)}
    word = np.fromiter((of[w] for w in tokens), np.uint64, len(tokens))
    size = min(SHINGLE, len(word))
    n = len(word) - size + 1
    key = word[:n]
    for k in range(1, size):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    key, ones = np.unique(key), np.zeros(BITS, np.int64)
    for at in range(0, len(key), 8192):
        halves = []
        for salt in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            x = key[at : at + 8192] ^ np.uint64(salt)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            halves.append(x ^ (x >> np.uint64(31)))
        ones += np.unpackbits(np.stack(halves, axis=1).view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(key)).tobytes()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, prints = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if tokens := words(text):
                ids.append(i)
                prints.append(fingerprint(tokens) + context(tokens))
        halves = np.frombuffer(b"".join(prints), ">i8").astype(np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, halves.T.copy())], ["id", *PRINT])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, hi, lo, shi, slo) of each row that has an id and at least one word: the words' halves and the shingles'."""
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return named.mapInArrow(_fingerprint_batches, "id long, hi long, lo long, shi long, slo long")


class Ring:
    """Segment boundaries, filing keys and chain budgets for one (bits, tau, segments)."""

    def __init__(self, tau: int = TAU, segments: int = SEGMENTS):
        if tau // segments > 2:
            raise ValueError("filing within one bit finds first segments up to two bits apart; use more segments")
        self.tau, self.m = tau, segments
        edges = np.linspace(0, BITS, segments + 1).round().astype(int)
        self.spans = [(int(a), int(b)) for a, b in zip(edges, edges[1:])]
        self.widths = [b - a for a, b in self.spans]
        self.budgets = [(k + 1) * tau // segments for k in range(segments)]

    def values(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """(n, m) segment values."""
        h, low = hi.view(np.uint64), lo.view(np.uint64)
        out = np.empty((len(hi), self.m), np.int64)
        for s, (a, b) in enumerate(self.spans):
            width = b - a
            if b <= 64:
                part = h >> np.uint64(64 - b)
            elif a >= 64:
                part = low >> np.uint64(128 - b)
            else:
                part = (h << np.uint64(b - 64)) | (low >> np.uint64(128 - b))
            out[:, s] = (part & np.uint64((1 << width) - 1)).astype(np.int64)
        return out

    def prefix_bits(self, prints: int, entries: int) -> int:
        """How many leading bits of a segment name a bucket, so that about ``entries`` of the fingerprints lie in one."""
        return next((h for h in range(min(self.widths)) if prints * (1 + h) <= entries << h), min(self.widths) - 1)

    def buckets(self, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, row): where each row of values is filed.

        A segment within one bit of the row's own lies in the bucket of its leading bits
        or in one of those that differ in one of them.
        """
        flips = np.array([0, *(1 << k for k in range(bits))], np.int64)
        found = [((values[:, s] >> (w - bits))[:, None] ^ flips) | (s << 40) for s, w in enumerate(self.widths)]
        bucket = np.concatenate(found, axis=1)
        return bucket.reshape(-1), np.repeat(np.arange(len(values)), bucket.shape[1])

    def lead(self, values: np.ndarray, s: int) -> tuple[np.ndarray, int]:
        """As many segments from s on as fit in 64 bits, in one word for each row, and the budget of their chain."""
        word, bits, k = np.zeros(len(values), np.uint64), 0, 0
        while k < self.m and bits + self.widths[(s + k) % self.m] <= 64:
            width = self.widths[(s + k) % self.m]
            word = (word << np.uint64(width)) | values[:, (s + k) % self.m].astype(np.uint64)
            bits, k = bits + width, k + 1
        return word, self.budgets[k - 1]

    def near(self, x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
        """Rows whose chain from ``start`` keeps all its budgets, so that at most tau bits differ."""
        alive, total = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k, budget in enumerate(self.budgets):
            s = (start + k) % self.m
            total = total + np.bitwise_count(x[alive, s] ^ y[alive, s])
            ok = total <= budget
            alive, total = alive[ok], total[ok]
        return alive


def _file(ring: Ring, bits: int):
    """Batches of (hi, lo, shi, slo) into packed rows: 32 bytes for each fingerprint that is filed in a bucket, once there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32_768):
            halves = hi, lo, *_ = [batch.column(k).to_numpy() for k in range(4)]
            at, row = ring.buckets(ring.values(hi, lo), bits)
            order = np.argsort(at, kind="stable")
            at, row = at[order], row[order]
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            packed = [b"".join(x[row[a:b]].tobytes() for x in halves) for a, b in zip(cuts, [*cuts[1:], len(at)])]
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts]), pa.array(packed, pa.binary())], ["bucket", "packed"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that joined two trees."""
        joined = []
        for x, y in zip(xs.tolist(), ys.tolist()):
            a, b = self.find(x), self.find(y)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                joined.append((x, y))
        return joined

    def flatten(self) -> None:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up


def _keyed(own: np.ndarray, width: int, bits: int, prefix: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of all values within one bit of the segments ``own`` that lie in a bucket, about ``chunk`` at a time."""
    rest = width - bits
    home = own >> rest == prefix
    tail = own & ((1 << rest) - 1)
    more = 0
    while more < rest and (int(home.sum()) * (1 + rest - more) + len(own)) >> more > chunk:
        more += 1
    low = rest - more
    lead = tail >> low
    for part in range(1 << more):
        whole, apart = np.flatnonzero(lead == part), np.flatnonzero(home & (np.bitwise_count(lead ^ part) == 1))
        mine = whole[home[whole]]
        flips = np.array([1 << k for k in range(low)], np.int64)
        rows = np.concatenate([whole, np.repeat(mine, low), apart])
        yield rows, np.concatenate([tail[whole], (tail[mine, None] ^ flips).reshape(-1), tail[apart] ^ ((lead[apart] ^ part) << low)])


def _pairs_of_bucket(ring: Ring, bits: int, bucket: int, halves: np.ndarray, chunk: int = CHUNK_KEYS) -> np.ndarray:
    """Pairs of the bucket's rows that span the near pairs which meet here. ``halves`` has the rows of PRINT."""
    s, prefix = bucket >> 40, bucket & ((1 << 40) - 1)
    values, shingles = ring.values(halves[0], halves[1]), halves[2:].T.copy().view(np.uint64)
    lead, budget = ring.lead(values, s)
    forest, found = _Forest(len(values)), []
    for row, keys in _keyed(values[:, s], ring.widths[s], bits, prefix, chunk):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        again = keys[1:] == keys[:-1]
        shared = np.zeros(len(keys), bool)
        shared[1:] |= again
        shared[:-1] |= again
        node, keys = row[order[shared]], keys[shared]
        last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)[: len(keys)])
        end = last[np.searchsorted(last, np.arange(len(keys)))]
        # Rows of a key lie side by side: most pairs fail on one word of the chain's first segments.
        word = lead[node]
        at = np.flatnonzero(end > np.arange(len(keys)))
        gap = 1
        while len(at):
            close = at[np.bitwise_count(word[at] ^ word[at + gap]) <= budget]
            if len(close):
                x, y = node[close], node[close + gap]
                apart = forest.up[x] != forest.up[y]
                x, y = x[apart], y[apart]
                kept = ring.near(values[x], values[y], s)
                kept = kept[np.bitwise_count(shingles[x[kept]] ^ shingles[y[kept]]).sum(1) <= CONTEXT]
                if len(kept):
                    found += forest.join(x[kept], y[kept])
                    forest.flatten()
            gap += 1
            at = at[at + gap <= end[at]]
    return np.array(found, np.int64).reshape(-1, 2)


def _search(ring: Ring, bits: int):
    def run(group: pa.Table) -> pa.Table:
        halves = np.concatenate([np.frombuffer(blob, np.int64).reshape(4, -1) for blob in group.column("packed").to_pylist()], axis=1)
        pairs = _pairs_of_bucket(ring, bits, group.column("bucket")[0].as_py(), halves)
        return pa.table({f"{name}_{side}": half[pairs[:, k]] for k, side in enumerate("ab") for name, half in zip(PRINT, halves)})

    return run


def near_duplicates(docs: DataFrame, tau: int = TAU, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the least doc_id of its group.

    Groups are the connected components of "at most ``tau`` bits apart, and at most
    CONTEXT by shingles". Texts are read whole, however long. A row without doc_id, with
    a null text or with no word is in no group. Rows that repeat a doc_id count once in a
    group. Other columns of ``docs``, whatever their names, are not read. An empty table
    gives no rows. Ties don't arise: ids decide.
    """
    spark = docs.sparkSession
    ring, scratch = Ring(tau, segments), Scratch(spark, "simhash")
    prints = scratch.keep("prints", fingerprints(docs))
    distinct, n = scratch.keep_counted("distinct", prints.groupBy(PRINT).agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    bits = ring.prefix_bits(n, BUCKET_ENTRIES)
    # A bucket is much work for few bytes, so tasks aren't left to be coalesced by size.
    parts = min(2 * ring.m << bits, 20_000)
    filed = distinct.select(PRINT).mapInArrow(_file(ring, bits), "bucket long, packed binary").repartition(parts, "bucket")
    met = scratch.keep("met", filed.groupBy("bucket").applyInArrow(_search(ring, bits), ", ".join(f"{name}_{side} long" for side in "ab" for name in PRINT)))
    names = distinct.select(*PRINT, "rep")
    of = lambda side: [f"{name}_{side}" for name in PRINT]
    edges = (
        met.distinct()
        .join(names.toDF(*of("a"), "u"), of("a"))
        .join(names.toDF(*of("b"), "v"), of("b"))
        .select("u", "v")
    )
    roots = components(scratch, edges)
    # A root has no row of its own in roots.
    linked = roots.select(F.col("node").alias("rep"), "root").unionByName(roots.select(F.col("root").alias("rep"), "root").distinct())
    grouped = (
        distinct.join(linked, "rep", "left")
        .where("root IS NOT NULL OR n > 1")
        .select(*PRINT, F.coalesce("root", "rep").alias("group_id"))
    )
    return prints.join(grouped, PRINT).select(F.col("id").alias("doc_id"), "group_id").distinct()


def deduplicate(docs: DataFrame, tau: int = TAU, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least doc_id.

    Rows without doc_id, with a null text or without words stay. Where rows repeat the
    doc_id that stays, those with the same text are one: the least of them as JSON stays.
    Rows with one doc_id and different texts stay each. Texts are read whole, however
    long. Columns are those of ``docs``; further ones may have any name and type. An
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    found = scratch.keep("groups", near_duplicates(docs, tau, segments))
    left = by_ids(docs, scratch.keep("gone", found.where("doc_id <> group_id").select("doc_id")), "left_anti")
    repeated, n = scratch.keep_counted("repeated", docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not n:
        return left
    once, many = by_ids(left, repeated, "left_anti"), by_ids(left, repeated, "left_semi")
    row = F.struct(*(many[c] for c in many.columns))
    # Copies are combined where they lie, and only texts that differ meet for one id.
    return once.unionByName(many.groupBy(many["doc_id"], many["text"]).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
