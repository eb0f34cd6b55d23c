"""Packages, health of the index, keyed lookups and statistics of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import names as N
from strandloom.sources.catalog import Index


def packages(index: Index) -> DataFrame:
    return (
        index.symbols.groupBy("package_path", "module_root")
        .agg(F.count(F.lit(1)).alias("symbol_count"), F.count_if(F.col("kind").isin("func", "method")).alias("func_count"), F.count_if("exported").alias("exported_count"))
        .orderBy("package_path", "module_root")
    )


def latest_meta(index: Index) -> DataFrame:
    """The run with the largest id."""
    row = F.max_by(F.struct("id", "tool_version", "go_version", "indexed_at", "root", "warnings", "indexed_commit"), "id").alias("m")
    return index.index_meta.agg(row).where("m IS NOT NULL").select("m.*")


def health(index: Index) -> DataFrame:
    """Row counts and the share of calls that aren't resolved, in percent; one row, or none without any run."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = count(index.symbols, "symbols").crossJoin(count(index.calls, "calls")).crossJoin(count(index.unresolved_calls, "unresolved")).crossJoin(index.symbols.agg(F.count_distinct("package_path").alias("packages")))
    total = F.col("calls") + F.col("unresolved")
    ratio = F.when(total > 0, F.col("unresolved") / total * 100).otherwise(F.lit(0.0)).alias("unresolved_ratio")
    return counts.crossJoin(latest_meta(index).select("tool_version", "indexed_commit")).select("symbols", "calls", "unresolved", "packages", ratio, "tool_version", "indexed_commit")


def top_unresolved(index: Index, limit: int = 10) -> DataFrame:
    return index.unresolved_calls.groupBy("expr").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "expr").limit(limit)


def module_of_package(index: Index, package: str) -> DataFrame:
    return index.symbols.where(F.col("package_path") == package).select("module_root").distinct().orderBy("module_root").limit(1)


def package_files(index: Index, module_root: str, package: str) -> DataFrame:
    return index.package_files.where((F.col("module_root") == module_root) & (F.col("package_path") == package)).select("file_path", "file_hash").orderBy("file_path")


def indexed_commit(index: Index) -> str:
    """The commit that the last run indexed, or ""."""
    row = latest_meta(index).first()
    return (row.indexed_commit if row else None) or ""


def stored_files_hash(index: Index, module_root: str, package: str) -> DataFrame:
    return index.package_meta.where((F.col("module_root") == module_root) & (F.col("package_path") == package)).select("files_hash")


def package_paths(index: Index) -> DataFrame:
    return index.package_meta.select("module_root", "package_path").distinct().orderBy("module_root", "package_path")


def has_file_tracking(index: Index) -> bool:
    return not index.package_files.isEmpty()


def run_statistics(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, population deviation, upper median, nearest-rank 95th percentile, least and largest value of each group.

    Equal values are counted before they meet, so a group is ordered by its distinct values.
    """
    rows = runs.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    moments = rows.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), F.min("v").alias("least"), F.max("v").alias("largest"))
    counted = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("g").orderBy("v")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    ranked = upto.join(moments, "g").groupBy("g").agg(at(F.floor(F.col("n") / 2)).alias("median"), at(F.ceil(F.col("n") * 0.95) - 1).alias("p95"))
    return moments.join(ranked, "g").select(F.col("g").alias(group), "n", "mean", "stddev", "median", "p95", "least", "largest")


def short_names(index: Index) -> DataFrame:
    return index.symbols.select("fqname", N.short_name("fqname").alias("short"), N.strip_generics("signature").alias("plain")).distinct()
