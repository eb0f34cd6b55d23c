"""Shared plumbing of the text operators: labelled samples, filters by ids, tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.scratch import Scratch

__all__ = ["TOKEN", "Scratch", "by_ids", "labelled", "least", "slices", "table", "words"]

#: Word tokens of every operator that reads words: Unicode letters, digits, underscore.
TOKEN = re.compile(r"\w+")

def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(id, text, y) of at most ``bound`` labelled documents, chosen by the hash of doc_id.

    Rows of ``labels`` without an id or a label are left out; an id labelled more
    than once counts with its largest label. An id that several documents carry
    brings each of their texts: :func:`least` bounds the rows again once the texts have
    become features. Null texts are left out. ``bound`` also bounds what is broadcast:
    that many ids and labels.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y"))
        .where("__id IS NOT NULL AND y IS NOT NULL")
        .groupBy("__id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(bound)
    )
    return (
        docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("text"))
        .where("text IS NOT NULL")
        .join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
        .select(F.col("__id").alias("id"), "text", "y")
    )


def least(rows: DataFrame, bound: int) -> pa.Table:
    """At most ``bound`` rows (id, x, ...), the first by hash of the id, then by x; sorted by id and x."""
    return rows.orderBy(F.xxhash64("id"), "id", "x").limit(bound).toArrow().sort_by([("id", "ascending"), ("x", "ascending")])


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (``left_semi``) or isn't (``left_anti``) in the written table ``ids`` of one column.

    There is one plan for every size: rows and ids meet by hash of the id, and the ids
    of a task are its hash table. Texts move once and are neither sorted nor held. Rows
    without doc_id match nothing and are spread by their text, so that however many they
    are they don't gather in a task. Names of further columns of ``docs`` play no part.
    """
    (name,) = ids.columns
    spread = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))
    return docs.join(ids.hint("shuffle_hash"), (spread == ids[name].cast("long")) & docs["doc_id"].isNotNull(), how)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of a few rows, so that one piece's Python objects stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
