"""Which packages changed since they were indexed, by the hashes of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import names as N
from strandloom.functions.hashing import fnv64a, hex64

PACKAGE = ("module_root", "package_path")


def hashed_files(files: DataFrame) -> DataFrame:
    """``files`` with file_hash from their binary ``content``."""
    return files.withColumn("file_hash", hex64(fnv64a("content"))).drop("content")


def package_hashes(files: DataFrame) -> DataFrame:
    """The exclusive or of the hashes of a package's files, of any order."""
    return files.groupBy(*PACKAGE).agg(hex64(F.bit_xor(F.conv("file_hash", 16, -10).cast("long"))).alias("files_hash"))


def stale_packages(stored: DataFrame, current: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Packages of ``stored`` and ``current`` with a file that is new, gone or changed.

    Both have module_root, package_path, file_path and file_hash; test files that appear
    don't make a package stale. A package some of whose files have no stored hash is
    compared as a whole with the files_hash of ``meta`` (module_root, package_path,
    files_hash); without one it is stale. A full join on the file keeps both sides
    partitioned alike.
    """
    old = stored.select(*PACKAGE, "file_path", F.col("file_hash").alias("old"))
    new = current.select(*PACKAGE, "file_path", F.col("file_hash").alias("new"))
    both = old.join(new, [*PACKAGE, "file_path"], "full")
    blank = F.col("old") == ""
    changed = F.when(F.col("old").isNull(), ~F.col("file_path").endswith("_test.go")).otherwise(F.col("new").isNull() | ~blank & (F.col("old") != F.col("new")))
    whole = hex64(F.bit_xor(F.when(F.col("old").isNotNull(), F.conv("new", 16, -10).cast("long"))))
    found = both.groupBy(*PACKAGE).agg(F.bool_or(changed).alias("stale"), F.bool_or(F.coalesce(blank, F.lit(False))).alias("blank"), whole.alias("now"))
    if meta is None:
        return found.where("stale OR blank").select(*PACKAGE)
    return found.join(meta.select(*PACKAGE, "files_hash"), [*PACKAGE], "left").where("stale OR blank AND (coalesce(files_hash, '') = '' OR files_hash <> now)").select(*PACKAGE)


def touched_packages(packages: DataFrame, changed: DataFrame) -> DataFrame:
    """Packages, with their directory ``dir``, below which a changed file of ``changed`` (file_path) lies.

    Each path meets its own ancestors by equality, instead of every directory by prefix.
    """
    parts = F.split(N.dir_name("file_path"), "/")
    above = changed.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    exact = changed.select(F.col("file_path").alias("dir"))
    return packages.join(above.unionByName(exact).distinct(), "dir", "left_semi")


def orphan_modules(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    return stored.select("module_root").distinct().join(discovered.select("module_root"), "module_root", "left_anti")
