"""Mixing sources to target weights by balanced sampling with the cube method.

Every document has an inclusion probability: its source's budget of tokens over the
source's tokens, at most 1. The sample is drawn by the cube method (Deville and Tille,
Biometrika 2004; fast form by Chauvet and Tille 2006): the vector of probabilities
walks inside the unit cube along directions in the null space of the constraints,
randomly so that its mean stays, until it meets faces; each meeting decides a document.
Balanced are the number of documents and of tokens, here (1, tokens / probability) as
constraint columns.

The walk is split by hash of doc_id into parts of each source, each of which leaves at
most two documents undecided; these walk on by source, and what is left of all sources
walks on together. The landing of the at most two last ones gives up the token
constraint, then the document constraint. So each source's totals are met but for the
documents left at its end, and the overall totals but for at most two documents.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, by_ids, table

SHARE, TEMPERATURE, SEED = 0.5, 0.5, 20_240
PART_DOCS = 50_000

UNITS = "id long, source string, stratum int, tokens long, pi double, p double"


def flight(p: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Walks ``p`` to faces of the cube, keeping sum(p) and sum(p * t); at most two entries stay fractional.

    Three undecided units move at a time, along the cross product of their two
    constraint rows. Where their ``t`` are equal, the null space is wider and two of
    them move against each other.
    """
    out = p.astype(np.float64).copy()
    # A chain of sums of many tokens is best kept near 1.
    t = t / max(float(np.abs(t).max(initial=0.0)), 1e-300)
    todo = np.flatnonzero((out > 0) & (out < 1)).tolist()
    todo.reverse()
    chance = iter(rng.random(4 * len(todo) + 16).tolist())
    held: list[tuple[int, float, float]] = []
    while True:
        while len(held) < 3 and todo:
            k = todo.pop()
            held.append((k, float(out[k]), float(t[k])))
        if len(held) < 2:
            break
        if len(held) == 3:
            (_, _, a), (_, _, b), (_, _, c) = held
            u = (c - b, a - c, b - a)
        else:
            u = (1.0, -1.0) if held[0][2] == held[1][2] else (0.0, 0.0)
        size = max(map(abs, u))
        if size == 0:
            if len(held) == 2:
                break
            u, size = (1.0, -1.0, 0.0), 1.0
        u = tuple(x / size for x in u)
        up = min((1 - x) / v if v > 0 else x / -v for (_, x, _), v in zip(held, u) if v)
        down = min(x / v if v > 0 else (1 - x) / -v for (_, x, _), v in zip(held, u) if v)
        step = up if next(chance) * (up + down) < down else -down
        moved = []
        for (k, x, w), v in zip(held, u):
            x += step * v
            if x < 1e-9 or x > 1 - 1e-9:
                out[k] = round(x)
            else:
                moved.append((k, x, w))
        held = moved
    for k, x, _ in held:
        out[k] = x
    return out


def land(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides what a flight left: first keeping the number of documents, then by chance."""
    out = flight(p, np.ones(len(p)), rng)
    for k in np.flatnonzero((out > 0) & (out < 1)):
        out[k] = float(rng.random() < out[k])
    return out


def probabilities(tokens: Mapping[str | None, int], weights: Mapping[str | None, float] | None = None, share: float = SHARE, temperature: float = TEMPERATURE) -> dict[str | None, float]:
    """Inclusion probability of each source's documents.

    ``weights`` are the sources' target shares of the sampled tokens; sources not named
    have weight 0. Without them a source weighs its tokens to the power ``temperature``.
    ``share`` of all tokens are sampled. A source that has fewer tokens than its part
    gives all, and the rest is spread over the others by their weights. A source without
    tokens has probability ``share``.
    """
    weigh = {s: float(weights.get(s, 0.0)) if weights is not None else float(n) ** temperature for s, n in tokens.items()}
    pi = {s: (share if not n else 0.0) for s, n in tokens.items()}
    open_, left = {s for s, n in tokens.items() if n and weigh[s] > 0}, share * sum(tokens.values())
    while open_:
        whole = sum(weigh[s] for s in sorted(open_, key=str))
        full = {s for s in open_ if left * weigh[s] >= whole * tokens[s]}
        if not full:
            pi |= {s: left * weigh[s] / whole / tokens[s] for s in open_}
            break
        pi |= dict.fromkeys(full, 1.0)
        left -= sum(tokens[s] for s in full)
        open_ -= full
    return pi


def _walk(*names: str, last: bool = False):
    def run(keys: tuple, units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["order", "id"], kind="stable").drop(columns=["order", "part"])
        rng = np.random.default_rng([SEED, len(names), *(int(k) for k in keys)])
        p = flight(units.p.to_numpy(), (units.tokens / units.pi).to_numpy(np.float64), rng)
        return units.assign(p=land(p, rng) if last else p)

    return run


def sample(docs: DataFrame, weights: Mapping[str | None, float] | None = None, share: float = SHARE, temperature: float = TEMPERATURE, part_docs: int = PART_DOCS) -> DataFrame:
    """(doc_id, source, tokens, pi) of the sampled documents.

    Tokens are runs of characters other than white space; a null text has 0. Rows that
    share a doc_id are one unit, with the sum of their tokens and their least source;
    rows without doc_id can't be named and aren't sampled. A null source is a source of
    its own. The draw depends on ids, sources and tokens alone, not on the order of rows;
    equal hashes of ids, by which units are ordered, are told apart by the ids. Texts are
    counted whole, however long. Other columns, whatever their names, are not read. One row
    of totals for each source goes to the driver. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    units = scratch.keep(
        "units",
        docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens")),
    )
    totals = {r.source: (r.tokens, r.n) for r in units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    pi = probabilities({s: n for s, (n, _) in totals.items()}, weights, share, temperature)
    rows = [(s, k, float(pi[s]), math.ceil(totals[s][1] / part_docs)) for k, s in enumerate(sorted(totals, key=lambda s: (s is not None, s)))]
    design = spark.createDataFrame(rows, "name string, stratum int, pi double, parts int").where("pi > 0")
    drawn = (
        units.join(design, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("order", F.xxhash64("id", F.lit(SEED)))
        .withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.col("parts")).cast("int"))
        .select("id", "source", "stratum", "tokens", "pi", F.col("pi").alias("p"), "order", "part")
    )
    parts = scratch.keep("parts", drawn.groupBy("stratum", "part").applyInPandas(_walk("stratum", "part"), UNITS))
    again = lambda df: df.where("p > 0 AND p < 1").withColumn("order", F.xxhash64("id", F.lit(SEED + 1))).withColumn("part", F.lit(0))
    sources = scratch.keep("sources", again(parts).groupBy("stratum").applyInPandas(_walk("stratum"), UNITS))
    landed = again(sources).groupBy("part").applyInPandas(_walk(last=True), UNITS)
    return parts.unionByName(sources).unionByName(landed).where("p = 1").select(F.col("id").alias("doc_id"), "source", "tokens", "pi")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is sampled, with the columns of ``docs``, of any name and type.

    Options and odd rows are those of :func:`sample`: rows that share a sampled doc_id all
    stay, rows without one go, and a null or empty text is a document of no tokens.
    """
    chosen = Scratch(docs.sparkSession, "mixed").keep("ids", sample(docs, **options).select("doc_id"))
    return by_ids(docs, chosen, "left_semi")


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(table(spark, sf_dir, "documents"))


QUERIES = {"op6_cube_mixing": op6_cube_mixing}
ORACLE_SQL: dict[str, str] = {}
