"""Keeping an index current: changed source files rewrite the modules they lie in."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom import __version__
from strandloom.functions import names as N
from strandloom.operators import freshness, inventory
from strandloom.schema import SCHEMAS
from strandloom.sources import gitstate, gosource
from strandloom.sources.catalog import Catalog
from strandloom.sources.scratch import Scratch


class NothingToIndex(ValueError):
    """A folder without packages."""


def build(catalog: Catalog, root: str, only: DataFrame | None = None, tests: bool = True) -> tuple[int, int]:
    """Indexes the modules below a folder, or those of ``only`` (module_root); how many symbols and warnings they have.

    Files that can't be read whole are warnings; a folder without any Go file is an error.
    """
    spark = catalog.spark
    scratch = Scratch(spark, "build")
    files = gosource.read_files(spark, root, tests)
    if only is not None:
        files = files.join(only.select("module_root").distinct(), "module_root", "left_semi")
    if only is None and files.select("file_path").isEmpty():
        raise NothingToIndex(f"no packages below {root}")
    found = scratch.keep("facts", gosource.facts(files))
    made = gosource.tables(found, files)
    hashes = made["package_files"]
    made["package_meta"] = freshness.package_hashes(hashes).withColumn("indexed_at", F.current_timestamp())
    roots = gosource.discover_modules(spark, root) if only is None else only
    catalog.migrate()
    catalog.replace(made, [r.module_root for r in roots.select("module_root").distinct().toLocalIterator()])
    catalog.vacuum()
    row = found.agg(F.count_if(F.col("fact") == "symbol").alias("symbols"), F.count_if(F.col("fact") == "error").alias("warnings")).first()
    return row.symbols, row.warnings


def stale_packages(catalog: Catalog, root: str, tests: bool = True) -> DataFrame:
    """(module_root, package_path) of packages whose files aren't as they were indexed.

    Where git knows the indexed commit, only folders in which it sees a change, committed
    or not, are read and hashed; none if it sees none.
    """
    spark, index = catalog.spark, catalog.index()
    changed = gitstate.changed_files(root, inventory.indexed_commit(index))
    stored, only = index.package_files, None
    if changed is not None and not any(p.endswith("/go.mod") for p in changed):
        folders = sorted({p.rsplit("/", 1)[0] for p in changed if p.endswith(".go")})
        if not folders:
            return spark.createDataFrame([], "module_root string, package_path string")
        inside = spark.createDataFrame([(f,) for f in folders], "dir string")
        stored = stored.withColumn("dir", N.dir_name("file_path")).join(inside, "dir", "left_semi").drop("dir")
        only = [f for f in folders if os.path.isdir(gitstate.local_path(f))]
    now = gosource.read_files(spark, root, tests, only)
    current = freshness.hashed_files(now.select("module_root", "package_path", "file_path", "content"))
    return freshness.stale_packages(stored, current, index.package_meta)


def stale_modules(catalog: Catalog, root: str, tests: bool = True) -> DataFrame:
    """Modules with a stale package."""
    return stale_packages(catalog, root, tests).select("module_root").distinct()


def record_run(catalog: Catalog, root: str, warnings: int) -> None:
    """Appends a row on a run: the version, the commit and how much could not be read."""
    last = catalog.read("index_meta").agg({"id": "max"}).first()[0] or 0
    row = [(last + 1, __version__, "", datetime.datetime.now(datetime.UTC), root, warnings, gitstate.head(root))]
    catalog.append("index_meta", catalog.spark.createDataFrame(row, SCHEMAS["index_meta"]))


def refresh(catalog: Catalog, root: str, tests: bool = True) -> int:
    """Indexes stale modules anew, and purges those that are gone; the number of symbols, 0 if all are fresh."""
    stale = Scratch(catalog.spark, "stale").keep("modules", stale_modules(catalog, root, tests))
    catalog.purge_orphans(gosource.discover_modules(catalog.spark, root))
    if stale.isEmpty():
        return 0
    symbols, warnings = build(catalog, root, stale, tests)
    # The commit moves on only with all stale modules, so that git's view stays right.
    record_run(catalog, root, warnings)
    return symbols


def watch(spark: SparkSession, catalog: Catalog, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream of the folder's source files; each batch of new or rewritten ones refreshes the index.

    The stream only tells that something arrived: what is stale follows from the hashes,
    so that a batch that is run twice does no harm.
    """
    arrived = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.go")
        .load(root)
        .select("path", "modificationTime")
    )

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh(catalog, root)

    return arrived.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
