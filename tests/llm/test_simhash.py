import random

import numpy as np
import pytest

from strandloom.llm import simhash_dedup as S
from strandloom.llm.common import table, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_groups(rows, tau):
    """Union of all pairs within tau, every pair compared."""
    prints = [(i, np.unpackbits(np.frombuffer(S.fingerprint(words(t)), np.uint8))) for i, t in rows if i is not None and t and words(t)]
    up = {i: i for i, _ in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = set()
    for k, (a, x) in enumerate(prints):
        for b, y in prints[:k]:
            if (x != y).sum() <= tau and a != b:
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
                linked |= {a, b}
    return {(i, find(i)) for i in linked}


def test_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_groups(rows, S.TAU)
    assert want and {tuple(r) for r in S.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("lead,chunk", [(0, 10**6), (0, 50), (4, 10**6), (7, 40)])
@pytest.mark.parametrize("tau,segments", [(16, 6), (11, 4), (5, 6)])
def test_search_is_exact_on_random_fingerprints(tau, segments, lead, chunk):
    rng = np.random.default_rng(tau)
    ring = S.Ring(tau, segments)
    base = rng.integers(-(2**63), 2**63 - 1, (30, 2), np.int64)
    prints = []
    for hi, lo in base:
        for flips in (0, tau // 2, tau, tau + 1):
            bits = int.from_bytes(hi.tobytes() + lo.tobytes(), "big")
            for k in rng.choice(128, flips, replace=False):
                bits ^= 1 << int(k)
            prints.append(np.frombuffer(bits.to_bytes(16, "big"), np.int64))
    prints = np.unique(np.array(prints), axis=0)
    n, halves = len(prints), np.concatenate([prints, np.zeros_like(prints)], axis=1).T.copy()
    bucket, row = ring.buckets(ring.values(halves[0], halves[1]), lead)
    assert len(set(zip(bucket.tolist(), row.tolist()))) == len(row) == n * segments * (1 + lead)
    found = []
    for b in np.unique(bucket):
        own = row[bucket == b]
        found += [tuple(own[p]) for p in S._pairs_of_bucket(ring, lead, int(b), halves[:, own], chunk)]
    got = _components(n, found)
    raw = prints.view(np.uint64)
    apart = sum(np.bitwise_count(raw[:, None, k] ^ raw[None, :, k]).astype(int) for k in (0, 1))
    want = _components(n, [tuple(p) for p in np.argwhere(apart <= tau)])
    assert got == want and len(set(want)) < n


def _components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return [find(k) for k in range(n)]


def test_odd_rows(spark):
    rng = random.Random(3)
    body = " ".join(f"word{rng.randrange(900)}" for _ in range(30_000))
    rows = [
        (1, body, "en", "a", 1), (2, body + " tail", "en", "a", 1), (3, None, "en", "a", 1), (4, None, None, None, None),
        (5, "", "en", "a", 1), (6, "", "en", "b", 1), (None, body, "en", "a", 1), (7, "alone here", "en", "a", 1),
        (8, "twice the same row", "en", "a", 1), (8, "twice the same row", "en", "a", 1), (9, "?!", "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS hi", "2 AS rep", "3 AS group_id")
    assert {tuple(r) for r in S.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (8, 8)}
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "None", "7", "8", "9"])


def test_long_unrelated_texts_are_not_linked(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(900)], [1 / (k + 3) for k in range(900)], k=120_000)) for _ in range(4)]
    near = texts[0].split()
    for k in rng.sample(range(len(near)), 3_000):
        near[k] = f"w{rng.randrange(900)}"
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate([*texts, " ".join(near)], 1)], SCHEMA)
    prints = [np.unpackbits(np.frombuffer(S.fingerprint(words(t)), np.uint8)) for t in texts]
    assert max((x != y).sum() for x in prints for y in prints) <= S.TAU
    assert {tuple(r) for r in S.near_duplicates(docs).collect()} == {(1, 1), (5, 1)}


def test_buckets_keep_their_size():
    ring = S.Ring()
    assert ring.prefix_bits(10**6, 10**6) == 0 < ring.prefix_bits(10**6 + 1, 10**6)
    for n in (10**7, 10**9):
        h = ring.prefix_bits(n, 10**6)
        assert n * (1 + h) / 2**h <= 10**6 < n * h / 2 ** (h - 1)


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "one text here"), (1, "one text here"), (1, "quite another matter"), (2, "one text here"), (3, "stays"), (None, "one text here"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('k', 1) AS __again", "2 AS __gone", "3 AS `row`", "4 AS rep", "array(1) AS gone")
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "one text here"), (1, "quite another matter"), (3, "stays"), (None, "one text here"), (4, None)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(docs).collect() == [] and S.deduplicate(docs).collect() == []
