"""Token-id output, entropy coded by a static range asymmetric numeral system (rANS).

Texts become token ids of a public byte-level BPE vocabulary. One frequency table, counted
over all tokens of the corpus, is shared by all blocks. A block holds whole documents in
LANES interleaved coder states: token k belongs to lane k mod LANES, and all lanes take a
step at once (Duda, arXiv:1311.2540; interleaving after Giesen, arXiv:1402.3392). Every
STRIDE steps a checkpoint keeps the lanes' states and the place in the word stream, so a
decoder may start there; each section between checkpoints carries checksums of its words
and of its tokens.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, slices, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A run of this many characters of one class, as the pattern's pieces are, is cut off where it fills an aligned stretch of a text.
STRETCH = 4096
_ONE_CLASS = regex.compile(rf"\p{{L}}{{{STRETCH}}}|\p{{N}}{{{STRETCH}}}|\s{{{STRETCH}}}|[^\s\p{{L}}\p{{N}}]{{{STRETCH}}}")

#: Frequencies sum to 2 ** PRECISION; states lie in [2 ** 31, 2 ** 63).
PRECISION = 20
LANES, STRIDE, BLOCK_TOKENS = 1024, 256, 1_000_000
TABLE_BLOCK = -1

SCHEMA = "block long, doc_ids array<long>, lengths array<int>, n_tokens long, n_lanes int, payload binary, checkpoints binary, checksum long"

_LOW, _K, _32 = np.uint64(1 << 31), np.uint64(PRECISION), np.uint64(32)
_MASK = np.uint64((1 << PRECISION) - 1)


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that are encoded by themselves; mostly it is one.

    The vocabulary's pattern and merges take time and stack that grow faster than a run of
    letters or blanks. Aligned stretches of STRETCH characters that are of one class
    throughout become pieces, so that runs are shorter than two stretches. A text
    without such a run keeps the ids that it has uncut.
    """
    begun = 0
    for at in range(0, len(text) - STRETCH + 1, STRETCH):
        if _ONE_CLASS.match(text, at):
            if begun < at:
                yield text[begun:at]
            yield text[at : at + STRETCH]
            begun = at + STRETCH
    if begun < len(text) or not text:
        yield text[begun:]


def token_ids(encoder: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.array([t for piece in pieces(text) for t in encoder.encode_ordinary(piece)], "<u4")


@dataclass(frozen=True)
class FrequencyTable:
    symbols: np.ndarray
    freqs: np.ndarray

    @staticmethod
    def of(symbols: np.ndarray, counts: np.ndarray) -> FrequencyTable:
        """Scales counts to the fixed sum: every symbol that occurs keeps at least 1, the largest give way."""
        if not len(symbols):
            return FrequencyTable(np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        order = np.argsort(symbols)
        symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
        whole = 1 << PRECISION
        freqs = np.maximum(1, np.floor(counts / counts.sum() * whole)).astype(np.int64)
        # Of equal ones the least symbol gives way first.
        largest = np.argsort(-freqs, kind="stable")
        while (excess := int(freqs.sum()) - whole) != 0:
            for k in largest:
                step = min(max(excess, -whole), int(freqs[k]) - 1) if excess > 0 else excess
                freqs[k] -= step
                excess -= step
                if excess == 0:
                    break
        return FrequencyTable(symbols, freqs.astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> FrequencyTable:
        (n,) = struct.unpack_from("<I", data)
        return FrequencyTable(np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, "<u4", n, 4 + 4 * n))


class Coder:
    def __init__(self, freqs: FrequencyTable):
        self.table = freqs
        size = int(freqs.symbols.max()) + 1 if len(freqs.symbols) else 0
        self.freq, self.base = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[freqs.symbols] = freqs.freqs
        self.base[freqs.symbols] = np.cumsum(freqs.freqs, dtype=np.uint64) - freqs.freqs
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(self.table.symbols, self.table.freqs)
        return self._slots

    def encode(self, tokens: np.ndarray, lanes: int = LANES, stride: int = STRIDE) -> tuple[bytes, bytes]:
        """(word stream, checkpoints). The first checkpoint is the start."""
        n = len(tokens)
        steps = -(-n // lanes)
        freq, base = self.freq[tokens], self.base[tokens]
        limit = freq << np.uint64(63 - PRECISION)
        state = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
        states: dict[int, np.ndarray] = {}
        for step in range(steps - 1, -1, -1):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            x, f = state[: b - a], freq[a:b]
            full = x >= limit[a:b]
            words[step] = x[full].astype(np.uint32)
            x = np.where(full, x >> _32, x)
            q = x // f
            state[: b - a] = (q << _K) + (x - q * f) + base[a:b]
            if step % stride == 0:
                states[step] = state.copy()
        ends = np.cumsum([0, *map(len, words)])
        stream = np.concatenate([np.zeros(0, np.uint32), *words]).astype("<u4")
        marks = []
        for step in sorted(states):
            after = min(steps, step + stride)
            section = stream[ends[step] : ends[after]]
            own = tokens[step * lanes : min(n, after * lanes)].astype("<u4")
            marks.append(struct.pack("<IQII", step, int(ends[step]), zlib.crc32(section.tobytes()), zlib.crc32(own.tobytes())) + states[step].astype("<u8").tobytes())
        return stream.tobytes(), b"".join(marks)

    def decode_section(self, payload: bytes, checkpoints: bytes, n_tokens: int, section: int, lanes: int = LANES, stride: int = STRIDE) -> np.ndarray:
        """Tokens of one section, from its own checkpoint alone; ValueError if a checksum fails."""
        size = 20 + 8 * lanes
        step, at, words_crc, tokens_crc = struct.unpack_from("<IQII", checkpoints, section * size)
        state = np.frombuffer(checkpoints, "<u8", lanes, section * size + 20).astype(np.uint64)
        more = (section + 1) * size < len(checkpoints)
        end = struct.unpack_from("<IQ", checkpoints, (section + 1) * size)[1] if more else len(payload) // 4
        words = np.frombuffer(payload, "<u4", end - at, 4 * at)
        if zlib.crc32(words.tobytes()) != words_crc:
            raise ValueError(f"section {section}: damaged words")
        words = words.astype(np.uint64)
        last = min(-(-n_tokens // lanes), step + stride)
        out, k = np.zeros(min(n_tokens, last * lanes) - step * lanes, np.uint32), 0
        for now in range(step, last):
            a, b = now * lanes, min(n_tokens, (now + 1) * lanes)
            x = state[: b - a]
            slot = x & _MASK
            own = self.slots[slot]
            out[a - step * lanes : b - step * lanes] = own
            x = self.freq[own] * (x >> _K) + slot - self.base[own]
            low = x < _LOW
            need = int(low.sum())
            x[low] = (x[low] << _32) | words[k : k + need]
            k += need
            state[: b - a] = x
        if zlib.crc32(out.astype("<u4").tobytes()) != tokens_crc:
            raise ValueError(f"section {section}: damaged tokens")
        return out

    def decode(self, payload: bytes, checkpoints: bytes, n_tokens: int, lanes: int = LANES, stride: int = STRIDE) -> np.ndarray:
        sections = len(checkpoints) // (20 + 8 * lanes)
        parts = [self.decode_section(payload, checkpoints, n_tokens, k, lanes, stride) for k in range(sections)]
        return np.concatenate([np.zeros(0, np.uint32), *parts])


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        for batch in slices(batches):
            ids = [None if text is None else token_ids(encoder, text) for text in batch.column(1).to_pylist()]
            # Two bytes hold all ids of the usual vocabularies.
            packed = [None if x is None else (b"\x02" + x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else b"\x04" + x.tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return run


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in slices(batches, 4096):
        parts = [_unpack(x) for x in batch.column(0).to_pylist() if x is not None]
        got = np.bincount(np.concatenate(parts)) if parts and sum(map(len, parts)) else np.zeros(0, np.int64)
        if len(got) > len(counts):
            counts, got = got.astype(np.int64), counts
        counts[: len(got)] += got
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts[seen])], ["token", "n"])


_FIELDS = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_tokens", pa.int64()),
    ("n_lanes", pa.int32()), ("payload", pa.binary()), ("checkpoints", pa.binary()), ("checksum", pa.int64()),
])


def _blocks(shared, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, number = Coder(FrequencyTable.from_bytes(shared.value)), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0

        def closed() -> pa.RecordBatch:
            tokens = np.concatenate([np.zeros(0, np.uint16), *held])
            payload, marks = coder.encode(tokens)
            values = (number, ids, lengths, len(tokens), LANES, payload, marks, zlib.crc32(marks, zlib.crc32(payload)))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FIELDS)], schema=_FIELDS)

        for batch in slices(batches):
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                if packed is None:
                    lengths.append(-1)
                else:
                    held.append(_unpack(packed))
                    lengths.append(len(held[-1]))
                    size += lengths[-1]
                if size >= block_tokens:
                    yield closed()
                    number += 1
                    ids, held, lengths, size = [], [], [], 0
        if ids:
            yield closed()

    return run


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks that hold all rows of ``docs``, and the frequency table as block -1.

    Columns: block, doc_ids and lengths (in tokens, -1 for a null text) of the
    documents in order, n_tokens, n_lanes, payload (word stream), checkpoints, checksum
    (CRC-32 of both). Documents are never cut: one longer than ``block_tokens`` fills a
    block. Runs of one kind of character longer than STRETCH are tokenised in
    :func:`pieces`. Empty texts have length 0, null ids and repeated rows are kept as they
    are; other columns, whatever their names, are not stored. An empty table gives only an
    empty frequency table. Tokens that are equally frequent are ordered by id. Every
    executor reads the vocabulary file at the path ``vocabulary``. At most one row for each
    token of the vocabulary goes to the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    tokens = scratch.keep("ids", docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenise(vocabulary), "doc_id long, ids binary"))
    counted = tokens.select("ids").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    freqs = FrequencyTable.of(counted.column("token").to_numpy(), counted.column("n").to_numpy()).to_bytes()
    head = spark.createDataFrame([(TABLE_BLOCK, [], [], 0, 0, bytearray(freqs), bytearray(), zlib.crc32(freqs))], SCHEMA)
    return tokens.mapInArrow(_blocks(spark.sparkContext.broadcast(freqs), block_tokens), SCHEMA).unionByName(head)


def decode_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, tokens) of every encoded row, blocks in parallel; tokens are null for a null text."""
    (table_row,) = blocks.where(F.col("block") == TABLE_BLOCK).select("payload", "checksum").collect()
    if zlib.crc32(table_row.payload) != table_row.checksum:
        raise ValueError("damaged frequency table")
    shared = blocks.sparkSession.sparkContext.broadcast(bytes(table_row.payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(FrequencyTable.from_bytes(shared.value))
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            tokens = coder.decode(row["payload"], row["checkpoints"], row["n_tokens"], row["n_lanes"]).astype(np.int32)
            ends = np.cumsum([max(0, n) for n in row["lengths"]])
            parts = [None if n < 0 else tokens[e - n : e] for n, e in zip(row["lengths"], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(parts, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return blocks.where(F.col("block") != TABLE_BLOCK).mapInArrow(run, "doc_id long, tokens array<int>")


def op4_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_rans": op4_token_rans}
ORACLE_SQL: dict[str, str] = {}
