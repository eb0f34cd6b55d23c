"""Symbol search, definition lookup with fallback, resolution of short names, hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import schema as S
from strandloom.functions import names as N
from strandloom.sources.catalog import Index

SYMBOL = ("fqname", "kind", "file_path", "line", "col", "signature", "package_path")


class InvalidFlag(ValueError):
    """A value outside an option's domain."""


def allowed(value: str | None, domain: tuple[str, ...], option: str) -> None:
    if value and value not in domain:
        raise InvalidFlag(f"{option} must be one of {', '.join(domain)}; got {value!r}")


def every(*conditions: Column | None) -> Column:
    """All conditions that are given; true where none is."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def _limited(df: DataFrame, limit: int) -> DataFrame:
    """A negative limit is none."""
    return df if limit < 0 else df.limit(limit)


def matching_symbols(index: Index, query: str = "", pkg: str = "", kind: str = "", file: str = "") -> DataFrame:
    allowed(kind, S.KINDS, "kind")
    text = (N.has("fqname", query) | N.has("name", query) | N.has("signature", query)) if query else None
    return index.symbols.where(every(text, N.begins("package_path", pkg) if pkg else None, F.col("kind") == kind if kind else None, N.has("file_path", file) if file else None))


def find_symbols(index: Index, limit: int = 100, **options: str) -> DataFrame:
    """The first ``limit`` matches by fqname. One more row than asked for tells a caller of truncation."""
    found = matching_symbols(index, **options).select(*SYMBOL, N.short_name("fqname").alias("name"))
    return found.orderBy("fqname", "file_path", "line", "col").limit(limit if limit > 0 else 100)


def count_symbols(index: Index, **options: str) -> DataFrame:
    return matching_symbols(index, **options).agg(F.count(F.lit(1)).alias("n"))


def define(index: Index, name: str, pkg: str = "") -> DataFrame:
    """Definitions of a name by the first way that finds any.

    The ways: its exact fqname, its fqname without type arguments, its short name (20
    rows at most), its short name without type arguments. All are tried in one pass.
    """
    base = N.plain_generics(name)
    way = F.when(F.col("fqname") == name, 1).when(F.col("fqname") == base, 2).when(F.col("name") == name, 3).when(F.col("name") == base, 4)
    found = index.symbols.where(every(way.isNotNull(), N.begins("package_path", pkg) if pkg else None)).withColumn("way", way)
    best = found.agg(F.min("way").alias("best"))
    rows = found.join(F.broadcast(best), F.col("way") == F.col("best")).select("way", *SYMBOL)
    named = rows.where("way >= 3").orderBy("fqname", "file_path", "line", "col").limit(20)
    return rows.where("way <= 2").unionByName(named)


def resolve(index: Index, name: str, limit: int = 5) -> DataFrame:
    """Candidates for a short name; a name with a slash stands for itself."""
    if "/" in name:
        return index.symbols.sparkSession.createDataFrame([(name,)], "fqname string")
    return index.symbols.where(F.col("name") == name).select("fqname").distinct().orderBy("fqname").limit(limit)


def similar(index: Index, text: str, limit: int = 3) -> DataFrame:
    """Names to suggest where a symbol isn't found, the first ones by id."""
    return index.symbols.where(N.has("fqname", text) | N.has("name", text)).orderBy("id", "fqname").select("fqname").limit(limit)


def dispatching_interfaces(index: Index, method: str, limit: int = 5) -> DataFrame:
    """Interfaces through which a method may be called though nothing calls it by name.

    Those that its type implements, where the interface has the method or nothing is
    known of the interface's methods. The type's interfaces may be very many and are never
    broadcast.
    """
    head, _, name = method.rpartition(".")
    kind = head.replace(".*", ".", 1)
    owned = index.implements.where(N.ends("impl_fqname", kind)).select("iface_fqname").distinct()
    known = index.iface_methods.groupBy("iface_fqname").agg(F.max(F.col("method_name") == name).alias("has"))
    return owned.hint("merge").join(known.hint("merge"), "iface_fqname", "left").where("has IS NULL OR has").select("iface_fqname").orderBy("iface_fqname").limit(limit)
