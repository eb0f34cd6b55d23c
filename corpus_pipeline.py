"""From raw documents to coded training tokens, in five stages.

Each stage reads what its predecessor kept and wrote. All but the last return the
columns of ``documents``, and further columns, of any name and type, with them; the last
returns coded token blocks. Texts are read whole in every stage, however long. What becomes
of odd rows on the way: a null text is rejected by the first stage; an empty one is judged
like any other and, if it stays, coded as no tokens; rows without doc_id can be neither
grouped nor matched and go when documents are drawn by id; rows that repeat a doc_id and
its text become one. An empty table passes all stages and gives an empty frequency table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import Scratch, table
from strandloom.llm.decontaminate import decontaminate
from strandloom.llm.mix_cube import mix
from strandloom.llm.quality_gam import keep_quality
from strandloom.llm.simhash_dedup import deduplicate
from strandloom.llm.token_rans import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on labelled rows of ``docs``.

    Null texts go, and empty ones are scored; repeated rows share one fate, and so do rows
    exactly at the threshold, which stay. Without labels all texts stay.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id.

    Rows without doc_id or words stay; of rows with the same doc_id and text one stays.
    """
    return deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase or proximity match of a benchmark item.

    Rows without doc_id or words stay; rows that share a doc_id go together. An empty
    benchmark takes none away.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample in which sources have their target share of tokens.

    A null source is a source; rows that share a doc_id are drawn together, rows without
    one go; a text without tokens counts as a document. Ties in the order of the draw are
    told apart by doc_id.
    """
    return mix(docs)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in independently decodable blocks; null texts have length -1, empty ones 0."""
    return encode_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", coded),
]

#: SQL can express none of the five methods; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each written and read again before the next; odd rows fare as said above."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(f"stage{k}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
