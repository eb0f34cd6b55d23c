import numpy as np

from strandloom.llm import langid_cnn as L
from strandloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(net, text):
    """Each window, filter and place in turn."""
    data = text.encode()
    logs = np.zeros(len(net.languages))
    for at in range(0, len(data), L.WINDOW):
        own = data[at : at + L.WINDOW]
        x = own + bytes(L.WINDOW - len(own))
        values = [max(0.0, float(max(sum(filters[j][x[k + j]][f] for j in range(len(filters))) for k in range(L.WINDOW - len(filters) + 1)) + bias[f])) for filters, bias in zip(net.tables, net.biases) for f in range(L.FILTERS)]
        z = np.array(values) @ net.weights + net.offset
        logs += (z - np.log(np.exp(z - z.max()).sum()) - z.max()) * len(own)
    p = np.exp((logs - logs.max()) / len(data))
    return net.languages[int(p.argmax())], float(p.max() / p.sum())


def test_held_out_accuracy_and_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = L.train(docs.where("doc_id % 4 <> 0"))
    got = docs.where("doc_id % 4 = 0").select("text", "lang", L.identifier(spark, net)(docs.text).alias("f")).collect()
    assert np.mean([r.f.lang == r.lang for r in got]) > 0.97
    for r in got[:12]:
        lang, sure = brute(net, r.text[:700])
        one = spark.createDataFrame([(1, r.text[:700])], "id long, text string")
        (f,) = one.select(L.identifier(spark, net)(one.text).alias("f")).collect()
        assert f.f.lang == lang and abs(f.f.confidence - sure) < 1e-4


def test_every_window_may_be_fitted_on(spark):
    texts = [(k, "".join(f"{k:02d}-{j:04d};" for j in range(32 * n)), "en") for k, n in enumerate([1, 2, 300, 40])]
    frame = spark.createDataFrame(texts, "id long, text string, lang string")
    got = L.sampled(frame, 60).collect()
    whole = {i: [bytes(w) for w in L.windows(t.encode())] for i, t, _ in texts}
    assert all(bytes(r.x) in whole[r.id] for r in got) and len(set(map(tuple, got))) == len(got) == 60
    n = {i: sum(r.id == i for r in got) for i in range(4)}
    assert n[0] == 1 and n[1] == 2 and abs(n[2] - n[3]) <= 1
    places = [whole[2].index(bytes(r.x)) for r in got if r.id == 2]
    assert max(places) > 200 > 100 > min(places)
    assert sorted(L.sampled(frame, 10**6).collect()) == sorted((i, bytearray(w), "en") for i in whole for w in whole[i])


def test_odd_rows(spark):
    rows = [(k, "the thing that there is " * 3, "en", "a", 1) for k in range(30)] + [(100 + k, "über größe können wäre ", "de", "a", 1) for k in range(30)]
    rows += [(200, None, "en", "a", 1), (201, "", "en", "a", 1), (None, "the thing is there", None, "a", 1), (202, "the thing " * 200_000, None, "a", 1), rows[3]]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' AS id", "1 AS confidence")
    got = [(r.doc_id, r.lang) for r in L.identify_languages(docs).collect()]
    assert sorted(got, key=str) == sorted([(k, "en") for k in range(30)] + [(100 + k, "de") for k in range(30)] + [(200, None), (201, None), (None, "en"), (202, "en"), (3, "en")], key=str)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a", 1)], SCHEMA)
    assert [tuple(r) for r in L.identify_languages(docs).collect()] == [(1, None, None)]
    assert L.identify_languages(docs.limit(0)).collect() == []
