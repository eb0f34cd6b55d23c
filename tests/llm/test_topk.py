import duckdb
import numpy as np
import pytest

from strandloom.llm import topk_histogram as K
from strandloom.llm.common import table


def brute(rows, k):
    """All pairs of rows (id, vector) of one width, sorted."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    units = np.rint(x @ x.T * K.UNIT).astype(np.int64)
    out = []
    for a in range(len(ids)):
        best = sorted((-int(units[a, b]), int(ids[b])) for b in range(len(ids)) if b != a)[:k]
        out += [(int(ids[a]), r + 1, i, -u / K.UNIT) for r, (u, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"k": 3, "bins": 4, "slack": 0, "pack": 37}])
def test_equals_brute_force_and_sql(spark, options):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in K.top_k(table(spark, d, "embeddings"), **options).collect())
    rows = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").collect()]
    assert got == brute(rows, options.get("k", K.K))
    few = sorted(tuple(r) for r in K.top_k(table(spark, d, "embeddings"), table(spark, d, "embeddings").where(K.ASKED), **options).collect())
    assert few and few == [r for r in got if r[0] % 100 == 0]
    if not options:
        embeddings = duckdb.read_parquet(f"{d}/embeddings.parquet")  # noqa: F841
        assert few == sorted(duckdb.sql(K.ORACLE_SQL["op10_topk_histogram"]).fetchall())


def test_dense_groups_keep_all_neighbours(spark):
    rng = np.random.default_rng(5)
    groups = [rng.normal(size=32) + noise * rng.normal(size=(300, 32)) for noise in (1e-4, 1e-4, 1e-3)]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([*groups, rng.normal(size=(100, 32))]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in K.top_k(frame).collect()) == brute(rows, K.K)


def test_ties_and_odd_rows(spark):
    rows = [(k, [1.0, 2.0]) for k in range(100)] + [(200 + k, [1.0, float(k)]) for k in range(20)]
    odd = [(None, [1.0, 1.0]), (900, None), (901, [0.0, 0.0]), (902, [1.0, None]), (903, [1.0, float("nan")]), (904, []), (905, [1.0, 1.0, 1.0]), (3, [1.0, 2.0]), (906, [2.0, 2.0, 2.0]), (907, [1e200, 1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS pack", "3 AS v")
    for pack in (16, K.PACK):
        got = sorted(tuple(r) for r in K.top_k(frame, k=5, pack=pack).collect())
        assert got == sorted(brute(rows, 5) + [(905, 1, 906, 1.0), (906, 1, 905, 1.0)])
    other = spark.createDataFrame([(5, [2.0, 1.0]), (5000, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r["rank"], r.neighbor_id) for r in K.top_k(frame, other, k=2, pack=16).collect()} == {(q, n, i) for q in (5, 5000) for n, i in ((1, 201), (2, 200))}
    assert K.top_k(frame.limit(0), other).collect() == [] == K.top_k(frame, other.limit(0)).collect()
    assert K.top_k(frame.limit(0)).collect() == [] and K.top_k(frame.where("vec_id = 5")).collect() == []


def test_narrowing_finds_each_kth():
    rng = np.random.default_rng(0)
    scores = rng.integers(-K.UNIT, K.UNIT, (50, 400))
    scores[:20] = rng.integers(0, 4, (20, 400))
    low, span, above = np.full(50, -K.UNIT), np.full(50, -(-2 * K.UNIT // 16)), np.zeros(50, np.int64)
    for _ in range(20):
        part = (scores - low[:, None]) // np.maximum(span, 1)[:, None]
        counts = np.stack([((part == b) & (span > 0)[:, None]).sum(1) for b in range(16)], axis=1)
        low, span, above = K.narrowed(low, span, above, counts, 10, 3)
    kth = np.sort(scores, axis=1)[:, -10]
    kept = (scores >= low[:, None]).sum(1)
    assert not span.any() and (low <= kth).all() and ((kept <= 13) | (low == kth)).all()


def test_a_task_keeps_the_parts_that_may_hold_the_kth():
    counts = np.array([[5, 4, 0, 2, 1], [0, 0, 0, 0, 3], [1, 1, 0, 0, 0]])
    assert K._relevant(counts, np.array([3, 2, 9])).tolist() == [[0, 0, 0, 2, 1], [0, 0, 0, 0, 3], [1, 1, 0, 0, 0]]
