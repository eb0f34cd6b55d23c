from fractions import Fraction

import numpy as np
import pytest

from strandloom.llm import mix_cube as M
from strandloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_totals_and_leaves_two(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 6, 500).astype(float) if seed % 2 else rng.lognormal(5, 1, 500)
    p = rng.uniform(0.05, 0.95, 500)
    out = M.flight(p, t, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
    assert abs(out.sum() - p.sum()) < 1e-5 and abs((out * t).sum() - (p * t).sum()) < 1e-5 * (p * t).sum()


def test_flight_keeps_each_probability():
    p, t = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3]), np.array([3.0, 8, 1, 4, 9, 2])
    drawn = np.mean([M.land(M.flight(p, t, rng), rng) for rng in map(np.random.default_rng, range(6000))], axis=0)
    assert np.abs(drawn - p).max() < 0.025


def exact_design(p, t):
    """Outcomes of the walk with their chances, in fractions: three undecided units at a time, in order."""
    out = {}

    def walk(state, todo, held, chance):
        held, todo = list(held), list(todo)
        while len(held) < 3 and todo:
            held.append(todo.pop(0))
        if len(held) == 3:
            a, b, c = (t[k] for k in held)
            u = (c - b, a - c, b - a)
            u = u if any(u) else (Fraction(1), Fraction(-1), Fraction(0))
        elif len(held) == 2 and t[held[0]] == t[held[1]]:
            u = (Fraction(1), Fraction(-1))
        else:
            key = tuple(state)
            out[key] = out.get(key, 0) + chance
            return
        moving = [(k, v) for k, v in zip(held, u) if v]
        up = min((1 - state[k]) / v if v > 0 else state[k] / -v for k, v in moving)
        down = min(state[k] / v if v > 0 else (1 - state[k]) / -v for k, v in moving)
        for step, part in ((up, down), (-down, up)):
            after = list(state)
            for k, v in moving:
                after[k] += step * v
            walk(after, todo, [k for k in held if 0 < after[k] < 1], chance * part / (up + down))

    walk(list(p), range(len(p)), [], Fraction(1))
    return out


@pytest.mark.parametrize("p,t", [("1/2 1/4 3/4 1/2 1/3", "3 8 1 4 9"), ("1/2 1/2 1/2 1/2", "2 2 2 2"), ("1/5 2/5 3/5 4/5 1/2 1/2", "1 1 2 2 5 5")])
def test_flight_equals_the_exact_design(p, t):
    p, t = [Fraction(x) for x in p.split()], [Fraction(x) for x in t.split()]
    want = exact_design(p, t)
    assert sum(want.values()) == 1
    for k in range(len(p)):
        # Each unit keeps its probability, and each outcome both totals, exactly.
        assert sum(c * x[k] for x, c in want.items()) == p[k]
    assert all(sum(x) == sum(p) and sum(a * b for a, b in zip(x, t)) == sum(a * b for a, b in zip(p, t)) for x in want)
    n, seen = 20_000, {}
    for seed in range(n):
        got = M.flight(np.array([float(x) for x in p]), np.array([float(x) for x in t]), np.random.default_rng(seed))
        (key,) = [x for x in want if np.allclose([float(v) for v in x], got, atol=1e-6)]
        seen[key] = seen.get(key, 0) + 1
    assert all(abs(seen.get(x, 0) / n - float(c)) < 0.015 for x, c in want.items())


def test_probabilities():
    pi = M.probabilities({"a": 1000, "b": 100, "c": 0, None: 100}, {"a": 1, "b": 1, None: 0}, share=0.5)
    assert pi["b"] == 1.0 and pi["a"] == pytest.approx(0.5) and pi["c"] == 0.5 and pi[None] == 0.0


@pytest.mark.parametrize("part_docs", [50_000, 40])
def test_totals_meet_the_targets(spark, part_docs):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = M.sample(docs, part_docs=part_docs).toPandas()
    text = docs.select("doc_id", "source", "text").toPandas()
    text["tokens"] = text.text.str.findall(r"\S+").str.len()
    whole = text.groupby("source").tokens.sum()
    pi = M.probabilities(whole.to_dict())
    assert got.doc_id.is_unique and set(got.doc_id) <= set(text.doc_id)
    for s, part in got.groupby("source"):
        own = text[text.source == s]
        assert part.pi.iloc[0] == pytest.approx(pi[s])
        assert abs(len(part) - pi[s] * len(own)) <= 2
        # The last two documents of a source may be as long as its longest.
        assert abs(part.tokens.sum() - pi[s] * whole[s]) <= 2 * own.tokens.max()
    assert abs(len(got) - sum(pi[s] * n for s, n in text.groupby("source").size().items())) <= 1
    assert abs(got.tokens.sum() - M.SHARE * whole.sum()) <= 2 * text.tokens.max()


def test_odd_rows(spark):
    rows = [(k, "same text", "en", "a", 1) for k in range(20)] + [(30, None, None, None, None), (31, "", "en", "b", 1), (None, "x y", "en", "a", 1), (32, "w " * 300_000, "en", "c", 1), (1, "same text", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tokens", "2 AS pi", "3 AS part", "'z' AS id")
    got = M.sample(docs, weights={"a": 1.0, "c": 0.0}, share=0.00002)
    assert {r.source for r in got.collect()} <= {"a", "b", None}
    kept = M.mix(docs, share=1.0)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 1, *range(2, 20), 30, 31, 32]
    assert sorted(map(tuple, M.sample(docs).collect()), key=str) == sorted(map(tuple, M.sample(docs.orderBy("text")).collect()), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert M.sample(docs).collect() == [] and M.mix(docs).collect() == []


def test_columns_named_like_the_id_lists(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    plain = sorted(r.doc_id for r in M.mix(docs).collect())
    named = docs.selectExpr("*", "1 AS __chosen", "doc_id AS id", "'x' AS name", "map(1, 2) AS p")
    kept = M.mix(named)
    assert kept.columns == named.columns and sorted(r.doc_id for r in kept.collect()) == plain
