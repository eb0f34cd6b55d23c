import pytest

import __spark_entry__
import corpus_pipeline
from strandloom.llm import decontaminate, quality_gam, simhash_dedup, token_rans
from strandloom.llm.common import table
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import brute_groups

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage kept, as written."""
    docs, out = table(spark, D, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns(spark, kept):
    assert all(x.columns == table(spark, D, "documents").columns for x in kept[:-1])


def test_quality_stage(spark, kept):
    docs = table(spark, D, "documents")
    model = quality_gam.train(docs, table(spark, D, "labels"))
    rows = docs.collect()
    logits = model.logits(quality_gam.feature_rows([r.text for r in rows]))
    assert sorted(ids(kept[0])) == sorted(r.doc_id for r, x in zip(rows, logits) if x >= 0)


def test_dedup_stage(kept):
    rows = [(r.doc_id, r.text) for r in kept[0].collect()]
    groups = brute_groups(rows, simhash_dedup.TAU)
    assert groups and sorted(ids(kept[1])) == sorted({i for i, _ in rows} - {i for i, g in groups if i != g})


def test_decontamination_stage(spark, kept):
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    hit = {d for d, *_ in brute(rows, [tuple(r) for r in table(spark, D, "benchmark").select("item_id", "text").collect()])}
    assert hit and sorted(ids(kept[2])) == sorted({i for i, _ in rows} - hit)


def test_mixing_and_output_stages(kept):
    chosen = ids(kept[3])
    assert chosen and set(chosen) < set(ids(kept[2]))
    decode = token_rans.encoding(token_rans.VOCABULARY).decode
    got = {r.doc_id: decode(r.tokens) for r in token_rans.decode_documents(kept[4]).collect()}
    assert got == {r.doc_id: r.text for r in kept[3].collect()}


def test_run_and_registration(spark, kept):
    got = {r.doc_id: r.tokens for r in token_rans.decode_documents(__spark_entry__.queries()["pipeline"](spark, D)).collect()}
    assert got == {r.doc_id: r.tokens for r in token_rans.decode_documents(kept[4]).collect()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, repeats, ties, long texts and columns named like those of the operators."""
    folder = tmp_path_factory.mktemp("odd")
    docs = table(spark, D, "documents").limit(60)
    columns = docs.columns
    body = docs.where("length(text) > 200").first().text
    phrase = table(spark, D, "benchmark").first().text
    rows = [
        (None, body, "en", "a", 1), (9001, None, None, None, None), (9002, "", "en", "a", 1), (9003, " " * 300_000, "en", "a", 1), (9004, body, "en", None, 1), (9004, body, "en", None, 1), (9005, body, "en", "b", 1),
        (9006, body + " " + phrase, "en", "b", 1), (9007, (body + " ") * 300, "en", "c", 1), (None, None, None, None, None), (9008, "z" * 300_000, "en", "c", 1),
    ]
    whole = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    clashing = whole.selectExpr("*", "1 AS __hit", "2 AS __gone", "3 AS __chosen", "4 AS __again", "doc_id AS id", "'x' AS name", "map('k', doc_id) AS rep", "5 AS p", "array(1) AS tokens", "6 AS y")
    clashing.write.parquet(str(folder / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, D, name).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), columns


def test_odd_documents(spark, odd, tmp_path):
    folder, columns = odd
    docs = table(spark, folder, "documents")
    before = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    assert all(x.columns == before for x in kept[:-1]) and set(columns) < set(before)
    assert kept[0].where("text IS NULL").count() == 0
    # Of the copies the least id stays, once.
    body = [r.doc_id for r in kept[0].where("doc_id IN (9004, 9005)").collect()]
    assert not body or len(body) == 3
    assert kept[1].where("doc_id IN (9004, 9005)").count() <= 1 and kept[1].where("doc_id IS NULL").count() == kept[0].where("doc_id IS NULL").count()
    assert kept[2].where("doc_id = 9006").count() == 0 and kept[3].where("doc_id IS NULL").count() == 0
    chosen = sorted((r.doc_id, r.text) for r in kept[3].collect())
    decode = token_rans.encoding(token_rans.VOCABULARY).decode
    assert chosen and sorted((r.doc_id, decode(r.tokens)) for r in token_rans.decode_documents(kept[4]).collect()) == chosen


def test_every_stage_takes_odd_documents(spark, odd):
    folder, _ = odd
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() > 0


def test_empty_documents(spark, tmp_path):
    docs = table(spark, D, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, D).collect() == []
    assert [r.block for r in corpus_pipeline.coded(spark, docs, D).collect()] == [token_rans.TABLE_BLOCK]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, D, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [r.block for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [token_rans.TABLE_BLOCK]
    assert decontaminate.decontaminate(docs, table(spark, D, "benchmark").limit(0)).collect() == []
