import random

from strandloom.llm import decontaminate as D
from strandloom.llm.common import table, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, items, window=D.WINDOW, slop=D.SLOP):
    """Every window of every item against every place of every document."""
    docs = [(i, words(t)) for i, t in set(docs) if i is not None and t is not None]
    items = [(i, words(t)) for i, t in set(items) if i is not None and t is not None]
    span = window + slop
    out = set()
    for item, test in items:
        n = min(window, len(test))
        spots = [(k, test[k : k + n]) for k in range(len(test) - n + 1)] if n else []
        for doc, ws in docs:
            have = set(ws)
            if not any(set(part) <= have for _, part in spots):
                continue
            hits = [(p - k, k) for k, part in spots if set(part) <= have for p in range(len(ws) - n + 1) if ws[p : p + n] == part]
            runs = {}
            for diagonal, k in sorted(hits):
                last = runs.get(diagonal, [])
                if last and k <= last[-1][0] + last[-1][1]:
                    last[-1] = (last[-1][0], max(last[-1][1], k + n - last[-1][0]))
                else:
                    runs.setdefault(diagonal, []).append((k, n))
            out |= {(doc, item, "phrase", d + k, k, m) for d, ks in runs.items() for k, m in ks}
            exact = {k for _, k in hits}
            for k, part in spots:
                own = set(part)
                if not own <= have:
                    continue
                if k in exact or n < window or len(own) < 5:
                    continue
                lefts = [p for p in range(-span + 1, len(ws)) if own <= set(ws[max(0, p) : p + span])]
                for j, p in enumerate(lefts):
                    if j == 0 or p - lefts[j - 1] >= span:
                        out.add((doc, item, "near", max(0, p), k, n))
    return out


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["the"] * 60
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randrange(6, 40))) for k in range(12)] + [(90, "tiny item"), (91, ""), (92, None), (None, text(20)), (0, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    docs = [(k, text(rng.randrange(5, 200))) for k in range(30)]
    for k in range(8):
        part = items[k][1].split()
        mixed = part[:]
        rng.shuffle(mixed)
        spaced = [w for x in part for w in ((x, "zz") if rng.random() < 0.2 else (x,))]
        docs += [(100 + k, text(9) + ". " + items[k][1].upper() + "! " + text(7)), (200 + k, text(20) + " " + " ".join(spaced) + " " + text(5)), (300 + k, " ".join(mixed))]
    docs += [(400, "a tiny item here, and a Tiny, ITEM there"), (401, ""), (402, None), (None, items[0][1]), (100, items[3][1]), docs[40], (403, text(2_000) + " " + items[2][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in docs], SCHEMA).selectExpr("*", "1 AS item_id", "'x' AS terms", "2 AS __hit", "map(1, 2) AS ids")
    tests = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS doc_id")
    want = brute(docs, items)
    assert {k for _, _, k, *_ in want} == {"phrase", "near"}
    for options in ({}, {"portion_tokens": 30, "segment_tokens": 150}):
        got = [tuple(r) for r in D.matches(frame, tests, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left = D.decontaminate(frame, tests)
    assert left.columns == frame.columns
    hit = {d for d, *_ in want}
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(i) for i, _ in docs if i not in hit)


def test_driver_documents(spark):
    d = "/root/testdata/sf0.001"
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    got = {tuple(r) for r in D.matches(docs, items).collect()}
    assert got and got == brute(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))


def test_few_places_at_once(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(D, "AT_ONCE", 7)
    builder = D._Builder(24)
    for i, t in docs:
        if i is not None and t and words(t):
            builder.add(i, words(t))
    row = dict(zip(("docs", "starts", "terms", "counts", "postings"), builder.row()))
    portion = D.Portion.of([(i, t) for i, t in items if i is not None and t is not None], D.WINDOW)
    got = D.segment_matches(D._open(row, D.pa.array(portion.vocabulary), 24), portion, D.WINDOW + D.SLOP)
    assert set(got) == brute(docs, items)


def test_a_match_depends_on_its_document_alone(spark):
    docs, items = fixture()
    tests = spark.createDataFrame(items, "item_id long, text string")
    (one,) = [x for x in docs if x[0] == 305]
    alone = D.matches(spark.createDataFrame([one], "doc_id long, text string"), tests).collect()
    assert alone and set(map(tuple, alone)) == {x for x in brute(docs, items) if x[0] == 305}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert D.matches(docs, items).collect() == [] and D.matches(docs, one).collect() == []
    assert D.decontaminate(one.selectExpr("item_id AS doc_id", "text"), items).count() == 1
