import numpy as np

from strandloom.llm import quality_gam as Q
from strandloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = table(spark, D, "documents")
    labels = table(spark, D, "labels")
    held = labels.where("doc_id % 4 = 0")
    quality = Q.scorer(spark, Q.train(docs, labels.where("doc_id % 4 <> 0")))
    got = docs.join(held, "doc_id").select("quality", quality(docs.text).alias("p")).toPandas()
    right = (got.p >= Q.THRESHOLD) == (got.quality == 1)
    assert len(got) > 500 and right.mean() > 0.97
    assert (got.p[got.quality == 1] >= Q.THRESHOLD).mean() > 0.98


def test_scores_are_the_table_sums():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, len(Q.FEATURES)))
    y = (x[:, 0] > 0) ^ (x[:, 1] > 0)
    model = Q.fit(x, y.astype(float))
    assert (1, 0) in model.pairs
    got = model.logits(x[:50])
    for row, logit in zip(x[:50], got):
        want = model.intercept + sum(t[(c <= v).sum()] for c, t, v in zip(model.cuts, model.tables, row))
        want += sum(t[(model.pair_cuts[i] <= row[i]).sum(), (model.pair_cuts[j] <= row[j]).sum()] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(logit - want) < 1e-9
    # No single feature tells; the pair does.
    assert ((model.logits(x) > 0) == y).mean() > 0.9


def slow_fit(x, y, rounds, pair_rounds, rate, bins, pair_bins, pairs, l2):
    """Boosting row by row, every split tried by summing its rows."""
    n, width = x.shape

    def cuts(k, bins):
        ranked = sorted(x[:, k])
        steps = sorted({ranked[int(np.rint(q * (n - 1)))] for q in np.linspace(0, 1, bins + 1)})
        return [(a + b) / 2 for a, b in zip(steps, steps[1:])]

    fine, coarse = [cuts(k, bins) for k in range(width)], [cuts(k, pair_bins) for k in range(width)]
    bin_of = lambda cuts, v: sum(c <= v for c in cuts)
    start = np.log((y.sum() + 1) / (n + 1 - y.sum()))
    logit = np.full(n, start)

    def value(rows):
        p = 1 / (1 + np.exp(-logit[rows]))
        g, h = (p - y[rows]).sum(), np.maximum(p * (1 - p), 1e-6).sum()
        return -g / (h + l2), g * g / (h + l2)

    def tree(axis, rows, size, leaves):
        """(bins, rows) of the leaves; the best split of any leaf first."""
        parts = [(0, size)]
        inside = lambda part: [r for r in rows if part[0] <= axis[r] < part[1]]
        while len(parts) < leaves:
            tried = [(value(inside((a, c)))[1] + value(inside((c, b)))[1] - value(inside((a, b)))[1], c, (a, b)) for a, b in parts for c in range(a + 1, b)]
            if not tried or max(tried)[0] <= 1e-9:
                break
            # Of equal gains in a leaf the first cut; of leaves the one that sorts last.
            best = {}
            for gain, c, part in tried:
                if part not in best or gain > best[part][0]:
                    best[part] = (gain, c, part)
            _, c, (a, b) = max(best.values())
            parts.remove((a, b))
            parts += [(a, c), (c, b)]
        return [(part, inside(part)) for part in parts]

    tables = [np.zeros(len(c) + 1) for c in fine]
    at = [[bin_of(fine[k], v) for v in x[:, k]] for k in range(width)]
    for _ in range(rounds):
        for k in range(width):
            for (a, b), rows in tree(at[k], range(n), len(tables[k]), 4):
                tables[k][a:b] += rate * value(rows)[0]
            logit = start + sum(tables[j][at[j]] for j in range(width))
    low = [[bin_of(coarse[k], v) for v in x[:, k]] for k in range(width)]
    grids = {}

    def shift():
        return start + sum(tables[j][at[j]] for j in range(width)) + sum(g[low[i], low[j]] for (i, j), g in grids.items())

    def grid(i, j):
        best, leaves = -1.0, []
        for first, second in ((i, j), (j, i)):
            for cut in range(1, len(coarse[first]) + 1):
                found = []
                for a, b in ((0, cut), (cut, len(coarse[first]) + 1)):
                    rows = [r for r in range(n) if a <= low[first][r] < b]
                    found += [((a, b), part, own) for part, own in tree(low[second], rows, len(coarse[second]) + 1, 2)]
                total = sum(value(own)[1] for _, _, own in found)
                if total > best + 1e-12:
                    best, leaves = total, [(one, two, own) if first == i else (two, one, own) for one, two, own in found]
        return best - value(list(range(n)))[1], leaves

    ranked = sorted(((grid(i, j)[0], (i, j)) for i in range(width) for j in range(i)), reverse=True)
    chosen = [p for gain, p in ranked[:pairs] if gain > 1e-6]
    grids |= {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            for (a, b), (c, d), own in grid(i, j)[1]:
                grids[i, j][a:b, c:d] += rate * value(own)[0]
            logit = shift()
    return start, tables, grids


def test_boosting_equals_row_by_row():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, 3))
    y = ((x[:, 0] + rng.normal(size=70) > 0) ^ (x[:, 1] > 0.3)).astype(float)
    options = {"rounds": 4, "pair_rounds": 3, "rate": 0.3, "bins": 9, "pair_bins": 4, "pairs": 2, "l2": 1.0}
    model, (start, tables, grids) = Q.fit(x, y, **options), slow_fit(x, y, **options)
    assert abs(model.intercept - start) < 1e-12 and model.pairs == list(grids) and len(grids) == 2
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.tables, tables))
    assert all(np.allclose(a, grids[p], atol=1e-9) for p, a in zip(model.pairs, model.pair_tables))


def test_odd_rows(spark):
    good = [(k, f"A plain sentence with number {k} and some words in it.", "en", "a", 1) for k in range(40)]
    bad = [(100 + k, "X%%% Y### " * (k + 2), "en", "a", 1) for k in range(40)]
    odd = [(200, None, None, None, None), (None, good[0][1], "en", "a", 1), (201, "", "en", "a", 1), (202, "word " * 300_000, "en", "a", 1), good[1]]
    docs = spark.createDataFrame(good + bad + odd, SCHEMA).selectExpr("*", "1 AS quality", "2 AS y")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(40)] + [(None, 1, 0), (5, None, None), (6, 1, 0)], LABELS)
    kept = Q.keep_quality(docs, labels)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert {*range(40), None} <= set(ids) and ids.count(1) == 2 and not {*range(100, 140), 200} & set(ids)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "a", 1), (2, None, "en", "a", 1)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert [r.doc_id for r in Q.keep_quality(docs, none).collect()] == [1]
    assert Q.keep_quality(docs.limit(0), none).collect() == []
