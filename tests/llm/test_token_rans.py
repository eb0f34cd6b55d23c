import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import token_rans as R
from strandloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def coder(tokens):
    symbols, counts = np.unique(tokens, return_counts=True)
    return R.Coder(R.FrequencyTable.from_bytes(R.FrequencyTable.of(symbols, counts).to_bytes()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50_256) | st.integers(0, 3), max_size=400), st.sampled_from([1, 2, 7, 64]), st.sampled_from([1, 3, 16]))
def test_round_trip(tokens, lanes, stride):
    tokens = np.array(tokens, np.uint32)
    c = coder(tokens)
    payload, marks = c.encode(tokens, lanes, stride)
    assert np.array_equal(c.decode(payload, marks, len(tokens), lanes, stride), tokens)


def test_sections_decode_alone_and_damage_is_found():
    tokens = (np.random.default_rng(1).geometric(0.02, 300_000) % 50_257).astype(np.uint32)
    c = coder(tokens)
    payload, marks = c.encode(tokens, 256, 100)
    assert np.array_equal(c.decode_section(payload, marks, len(tokens), 7, 256, 100), tokens[7 * 25_600 : 8 * 25_600])
    # Within 2 % of the entropy, lanes' end states aside.
    p = np.unique(tokens, return_counts=True)[1] / len(tokens)
    assert len(payload) < 1.02 * -(p * np.log2(p)).sum() * len(tokens) / 8
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        c.decode(bytes(broken), marks, len(tokens), 256, 100)


def test_frequencies_sum_and_cover():
    for counts in ([1], [10**9, 1, 1], [1] * 50_000, [5, 3] * 20_000 + [10**8]):
        freqs = R.FrequencyTable.of(np.arange(len(counts)), np.array(counts)).freqs
        assert freqs.sum() == 1 << R.PRECISION and freqs.min() >= 1


def scalar_encode(tokens, symbols, freqs, lanes):
    """The coder with Python integers, one token at a time: end states and, by step, the words of its lanes."""
    freq = dict(zip(symbols, freqs))
    base, total = {}, 0
    for s in symbols:
        base[s], total = total, total + freq[s]
    state, out = [1 << 31] * lanes, []
    for k in reversed(range(len(tokens))):
        lane, f = k % lanes, freq[tokens[k]]
        if state[lane] >= f << (63 - R.PRECISION):
            out.append((k, state[lane] & 0xFFFFFFFF))
            state[lane] >>= 32
        state[lane] = (state[lane] // f << R.PRECISION) + state[lane] % f + base[tokens[k]]
    return state, [w for _, w in sorted(out)]


@pytest.mark.parametrize("lanes,n", [(1, 500), (7, 3_000), (64, 3_001)])
def test_equals_a_scalar_coder(lanes, n):
    tokens = (np.random.default_rng(n).geometric(0.05, n) % 300).astype(np.uint32)
    c = coder(tokens)
    payload, marks = c.encode(tokens, lanes, stride=10**6)
    state, stream = scalar_encode(tokens.tolist(), c.table.symbols.tolist(), c.table.freqs.tolist(), lanes)
    assert np.frombuffer(payload, "<u4").tolist() == stream
    assert np.frombuffer(marks, "<u8", lanes, 20).tolist() == state


def test_long_runs_are_cut_and_other_texts_are_not():
    encoder = R.encoding(R.VOCABULARY)
    plain = ["", "a", "It's 12 o'clock.  Go\n\n\nnow", "x" * (R.STRETCH - 1) + " " * (R.STRETCH - 1) + "7" * 99, ("word, " * 3_000).strip()]
    for text in plain:
        assert list(R.pieces(text)) == [text] and R.token_ids(encoder, text).tolist() == encoder.encode_ordinary(text)
    for c in " a7-\n\u00e9\u4e2d":
        text = "begin " + c * 1_000_000 + " end"
        assert "".join(R.pieces(text)) == text and encoder.decode(R.token_ids(encoder, text).tolist()) == text


def test_documents_round_trip(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    blocks = R.encode_documents(docs, block_tokens=40_000)
    assert blocks.count() > 5
    got = {r.doc_id: r.tokens for r in R.decode_documents(blocks).collect()}
    decode = R.encoding(R.VOCABULARY).decode
    assert {i: decode(t) for i, t in got.items()} == {r.doc_id: r.text for r in docs.collect()}


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 1), (None, "no id", None, None, None), (3, "long " * 200_000, "en", "a", 1), (3, "long " * 200_000, "en", "a", 1), (4, "<|endoftext|> \x00 \U0001f600", "en", "a", 1), (5, " " * 1_000_000, "en", "a", 1), (6, "\n" * 1_000_000 + "x", "en", "a", 1), (7, "z" * 1_000_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS payload")
    got = [(r.doc_id, None if r.tokens is None else R.encoding(R.VOCABULARY).decode(r.tokens)) for r in R.decode_documents(R.encode_documents(docs, block_tokens=1000)).collect()]
    assert sorted(got, key=str) == sorted(((r[0], r[1]) for r in rows), key=str)


def test_empty_table(spark):
    blocks = R.encode_documents(spark.createDataFrame([], SCHEMA))
    assert [r.block for r in blocks.collect()] == [R.TABLE_BLOCK] and R.decode_documents(blocks).collect() == []
