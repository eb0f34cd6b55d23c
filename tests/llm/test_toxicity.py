import itertools

import numpy as np

from strandloom.llm import toxicity_fm as T
from strandloom.llm.common import table, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
D = "/root/testdata/sf0.1"


def brute_logit(machine, text):
    """Every window, every pair of its weighted terms."""
    halves = {}
    for k, w in enumerate(words(text)):
        halves.setdefault(k // T.HALF, []).extend(machine.places(w))
    last = max(halves, default=0)
    best = machine.bias
    for h in range(-1, last + 1):
        own = halves.get(h, []) + halves.get(h + 1, [])
        # A half whose neighbour before has no weighted term stands alone for both.
        v = machine.rows[own]
        best = max(best, machine.bias + v[:, 0].sum() + sum(a[1:] @ b[1:] for a, b in itertools.combinations(v, 2)))
    return best


def test_held_out_accuracy_and_brute_force_scores(spark):
    docs, labels = table(spark, D, "documents"), table(spark, D, "labels")
    held = labels.where("doc_id % 4 = 0")
    machine = T.train(docs, labels.where("doc_id % 4 <> 0"))
    got = docs.join(held, "doc_id").select("text", "toxic", T.scorer(spark, machine)(docs.text).alias("p")).toPandas()
    found = got.p >= T.THRESHOLD
    assert found[got.toxic == 1].mean() > 0.85 and found[got.toxic == 0].mean() < 0.005
    part = got[got.text.str.len() < 1500].head(300)
    want = [1 / (1 + np.exp(-brute_logit(machine, t))) for t in part.text]
    assert np.allclose(part.p, want, atol=1e-6)


def test_pairs_tell_what_single_terms_do_not():
    rng = np.random.default_rng(3)
    filler = [f"w{k}" for k in range(300)]
    texts, y = [], []
    for k in range(1600):
        a, b = k % 2, (k // 2) % 2
        picked = list(rng.choice(filler, 20)) + ["harsh"] * a + ["group"] * b
        rng.shuffle(picked)
        texts.append(" ".join(picked))
        y.append(bool(a and b))
    machine = T.fit([T.hashed(t) for t in texts], np.array(y), epochs=40)
    score = lambda t: brute_logit(machine, t)
    assert score("w1 harsh w2 group w3") > 0 > max(score("w1 harsh w2 w3"), score("w1 group w2 w3"), score("w1 w2"))
    h, g = (machine.rows[machine.places(w)[0]] for w in ("harsh", "group"))
    assert h[1:] @ g[1:] > 0.5


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    filler = lambda: " ".join(rng.choice([f"w{k}" for k in range(200)], 12))
    good = [(1000 + k, filler(), "en", "a", 1) for k in range(300)]
    bad = [(100 + k, f"{filler()} vile creature", "en", "a", 1) for k in range(60)]
    odd = [(200, None, None, None, None), (None, "such a vile creature", "en", "a", 1), (201, "", "en", "a", 1), (202, "fine " * 300_000 + "vile creature", "en", "a", 1), bad[1]]
    docs = spark.createDataFrame(good + bad + odd, SCHEMA).selectExpr("*", "1 AS toxic", "2 AS y", "0.1D AS toxicity")
    labels = spark.createDataFrame([(1000 + k, 1, 0) for k in range(300)] + [(100 + k, 1, 1) for k in range(60)] + [(None, 1, 1), (1005, None, None), (1006, 1, 0)], LABELS)
    ids = [r.doc_id for r in T.toxic_documents(docs, labels).collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [*range(100, 160), 101, None, 202]))


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "a", 1), (2, None, "en", "a", 1)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert T.toxic_documents(docs, none, threshold=0.6).collect() == [] and T.toxic_documents(docs.limit(0), none).collect() == []
