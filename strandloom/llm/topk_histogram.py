"""Exact top-k search by distributed histogram selection.

A stated set of queries meets all vectors. Scores are cosines in whole units of 1e-9, so
that equal scores are equal everywhere. Queries and vectors lie packed in tables; tasks
take pairs of packs and score everything. In each round the tasks count, for each query,
the scores in the BINS parts of the range in which its kth score must lie. A task sums
its own packs and leaves out parts below that in which it alone has enough scores, as the
kth can't lie there; the sums are merged in a tree, and the part that holds the kth
becomes the next range. Once a range holds no more than SLACK scores that aren't needed,
or is a single score, scores from its lower end on are kept, and the k largest of them
are the answer; ties go to the lower id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, slices, table

K, BINS, SLACK = 10, 256, 32
UNIT = 1_000_000_000
#: Stands for a vector's score against itself, below all scores.
NOT_SCORED = -2 * UNIT
#: Vectors in a pack.
PACK = 4096
#: Tasks whose histograms are merged first.
FAN = 64
#: The registered query asks for the neighbours of these.
ASKED = "vec_id % 100 = 0"

PACKS = "pack long, ids binary, width int, vectors binary"
STATE = "query_pack long, low binary, reach binary, span binary, above binary, open long"
FOUND = "vec_id long, neighbor_id long, units long"


def _pack(size: int):
    """Batches of (id, vector) into packs of vectors of one width, scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def closed(width: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, rows = zip(*held.pop(width))
            x = np.array(rows, np.float64).reshape(len(rows), width)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            columns = ([number], [np.array(ids, np.int64).tobytes()], [width], [x.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.binary()))], ["pack", "ids", "width", "vectors"])

        for batch in slices(batches, 1024):
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                if len(own) == size:
                    yield closed(len(v))
        for width in list(held):
            yield closed(width)

    return run


def packs(vectors: DataFrame, size: int = PACK) -> DataFrame:
    """Packs of the distinct rows that can be compared: with an id, no null and not all zeros."""
    named = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    whole = named.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e150) AND exists(v, x -> abs(x) > 1e-150)")
    return whole.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_pack(size), PACKS)


def _scores(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query row, ids against which, units) of a pair of packs, some queries at a time; a query's own score is below all."""
    q = np.frombuffer(row["q_vectors"]).reshape(-1, row["width"])
    c = np.frombuffer(row["vectors"]).reshape(-1, row["width"])
    ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
    # Ids don't repeat among queries or among vectors.
    _, mine, its = np.intersect1d(q_ids, ids, assume_unique=True, return_indices=True)
    for at in range(0, len(q), 256):
        units = np.rint((q[at : at + 256] @ c.T) * UNIT).astype(np.int64)
        here = (mine >= at) & (mine < at + len(units))
        units[mine[here] - at, its[here]] = NOT_SCORED
        yield at, ids, units


def _relevant(counts: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Counts without the parts below that from which on there are ``need`` scores: the kth of all isn't there."""
    from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    return np.where(from_top - counts < need[:, None], counts, 0).astype(np.int32)


COUNTED = "query_pack long, part int, low binary, span binary, above binary, counts binary"


def _block(pack: int, part: int, state: tuple[bytes, bytes, bytes], counts: np.ndarray) -> pa.RecordBatch:
    packed = (*state, zlib.compress(counts.tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["query_pack", "part", "low", "span", "above", "counts"])


def _count(bins: int, k: int):
    """A task's histograms of the queries whose range is still open, one row for each pack of queries that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, pack, state, counts = TaskContext.get().partitionId() // FAN, None, (b"", b"", b""), np.zeros((0, bins), np.int32)
        done = lambda: _block(pack, part, state, _relevant(counts, k - np.frombuffer(state[2], np.int64)))
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            low, reach, span = (np.frombuffer(row[n], np.int64) for n in ("low", "reach", "span"))
            # Rows of one pack of queries come one after another; were they not, it would have more rows.
            if row["query_pack"] != pack:
                if pack is not None:
                    yield done()
                pack, state, counts = row["query_pack"], (row["low"], row["span"], row["above"]), np.zeros((len(low), bins), np.int32)
            for at, _, units in _scores(row):
                a, r, s = (x[at : at + len(units), None] for x in (low, reach, span))
                cell = (units - a) // np.maximum(s, 1)
                # Scores above the range were counted before, and the last parts may reach past its end; closed ranges have no width.
                inside = (cell >= 0) & (units - a < r) & (s > 0)
                key = (cell + bins * np.arange(len(units))[:, None])[inside]
                counts[at : at + len(units)] += np.bincount(key, minlength=bins * len(units)).reshape(-1, bins).astype(np.int32)
        if pack is not None:
            yield done()

    return run


def _summed(rows: list[dict], bins: int) -> np.ndarray:
    total = np.zeros(0, np.int64)
    for r in rows:
        own = np.frombuffer(zlib.decompress(r["counts"]), np.int32 if r["part"] >= 0 else np.int64)
        total = total + own if len(total) else own.astype(np.int64)
    return total.reshape(-1, bins)


def _merge(bins: int):
    """Histograms of a pack of queries from a few tasks into one; its part is marked -1, as its counts are long."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        return pa.Table.from_batches([_block(rows[0]["query_pack"], -1, tuple(rows[0][n] for n in ("low", "span", "above")), _summed(rows, bins))])

    return run


def narrowed(low: np.ndarray, span: np.ndarray, above: np.ndarray, counts: np.ndarray, k: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next (low, span, above) of each query, from the counts in the parts of its range.

    A range starts at low and has parts of ``span`` units; above are the scores beyond it.
    Parts are rounded up, so the counts must leave out scores past the end of the range.
    Span 0 closes a range: the scores from low on are wanted.
    """
    bins = counts.shape[1]
    from_top = np.cumsum(counts[:, ::-1], axis=1)
    reach = above[:, None] + from_top >= k
    at = np.where(reach.any(1), reach.argmax(1), bins - 1)
    part = bins - 1 - at
    inside = counts[np.arange(len(counts)), part]
    more = above + from_top[np.arange(len(counts)), at] - inside
    going = span > 0
    new_low = np.where(going, low + part * span, low)
    done = (more + inside <= k + slack) | (span == 1)
    return new_low, np.where(going & ~done, -(-span // bins), 0), np.where(going, more, above)


def _narrow(bins: int, k: int, slack: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        low, span, above = (np.frombuffer(rows[0][n], np.int64) for n in ("low", "span", "above"))
        counts = _summed(rows, bins)
        reach = span  # The part that becomes the range ends where the next one began.
        low, span, above = narrowed(low, span, above, counts, k, slack)
        return pa.table([pa.array([rows[0]["query_pack"]]), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (low, reach, span, above)), pa.array([int((span > 0).sum())])], names=["query_pack", "low", "reach", "span", "above", "open"])

    return run


def _best(query: np.ndarray, ids: np.ndarray, units: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: largest units, then least ids."""
    order = np.lexsort((ids, -units, query))
    query = query[order]
    start = np.searchsorted(query, query)
    return order[np.arange(len(order)) - start < k]


def _filter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            low, q_ids = np.frombuffer(row["low"], np.int64), np.frombuffer(row["q_ids"], np.int64)
            for at, ids, units in _scores(row):
                q, c = np.nonzero(units >= low[at : at + len(units), None])
                if len(q):
                    best = _best(q, ids[c], units[q, c], k)
                    q, c = q[best], c[best]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + q]), pa.array(ids[c]), pa.array(units[q, c])], ["vec_id", "neighbor_id", "units"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, bins: int = BINS, slack: int = SLACK, pack: int = PACK) -> DataFrame:
    """(vec_id, rank, neighbor_id, score) of the ``k`` of ``vectors`` with the largest cosine to each of ``queries``; all where there are fewer.

    ``queries`` has vec_id and embedding too; left out, every vector is a query. A vector
    isn't its own neighbour: those of the query's vec_id are passed over. The score is
    rounded to 9 decimals, and equal ones rank by neighbor_id. Rows without vec_id, with
    a null or an element that is null, not a number or above 1e150, and without any
    element above 1e-150, aren't compared; nor are vectors of different widths with each
    other. Of rows that share a vec_id the least vector counts. Vectors may have any
    width; there are no texts. Other columns, whatever they are called, are not read. An
    empty table on either side gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    packed = scratch.keep("packs", packs(vectors, pack))
    asked = packed if queries is None else scratch.keep("asked", packs(queries, pack))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) // 8 for x in batch.column(1).to_pylist()]
            fill = lambda value: pa.array([np.full(n, value, np.int64).tobytes() for n in sizes], pa.binary())
            # Scores begin at -1, give or take a rounding.
            yield pa.RecordBatch.from_arrays([batch.column(0), fill(-UNIT - 8), fill(2 * UNIT + 16), fill(-(-(2 * UNIT + 16) // bins)), fill(0), pa.array(sizes, pa.int64())], ["query_pack", "low", "reach", "span", "above", "open"])

    state = scratch.keep("state0", asked.select("pack", "ids").mapInArrow(begin, STATE))
    told = asked.select(F.col("pack").alias("query_pack"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("vectors").alias("q_vectors"))

    def pairs(now: DataFrame) -> DataFrame:
        # Few, large rows: each task reads a file of queries and one of packs, and nothing is shuffled but the states.
        own = told.join(now.drop("open"), "query_pack")
        return own.crossJoin(packed.hint("shuffle_replicate_nl")).where("width = q_width")

    rounds = 0
    while state.where("open > 0").limit(1).count():
        rounds += 1
        counted = pairs(state.where("open > 0")).mapInArrow(_count(bins, k), COUNTED)
        merged = counted.groupBy("query_pack", "part").applyInArrow(_merge(bins), COUNTED)
        closed = state.where("open = 0")
        state, old = scratch.keep(f"state{rounds}", merged.groupBy("query_pack").applyInArrow(_narrow(bins, k, slack), STATE).unionByName(closed)), f"state{rounds - 1}"
        scratch.drop(old)
    near = scratch.keep("near", pairs(state).mapInArrow(_filter(k), FOUND))

    def rank(group: pa.Table) -> pa.Table:
        query, ids, units = (group.column(n).to_numpy() for n in ("vec_id", "neighbor_id", "units"))
        best = _best(query, ids, units, k)
        query = query[best]
        return pa.table({"vec_id": query, "rank": (np.arange(len(best)) - np.searchsorted(query, query) + 1).astype(np.int32), "neighbor_id": ids[best], "score": units[best] / UNIT})

    parts = max(1, -(-near.count() // 500_000))
    return near.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).groupBy("part").applyInArrow(rank, "vec_id long, rank int, neighbor_id long, score double")


def op10_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours, among all embeddings, of those whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(ASKED))


QUERIES = {"op10_topk_histogram": op10_topk_histogram}
ORACLE_SQL = {
    "op10_topk_histogram": f"""
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
        s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, CAST(round(list_dot_product(a.e, b.e) * {UNIT}) AS BIGINT) AS units
              FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.{ASKED}),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY units DESC, neighbor_id) AS rank FROM s)
        SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, units / {UNIT}.0::DOUBLE AS score FROM r WHERE rank <= {K}
    """
}
