"""Queries and SQL of the text operators, merged by the driver contract when importable."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this subpackage that define QUERIES and ORACLE_SQL.
MODULES = ("quality_gam", "decontaminate", "token_rans", "mix_cube", "simhash_dedup", "toxicity_fm", "html_lineblock", "secret_scan", "langid_cnn", "topk_histogram")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in MODULES:
        found.update(import_module(f"{__package__}.{name}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found.update(import_module(f"{__package__}.{name}").ORACLE_SQL)
    return found
