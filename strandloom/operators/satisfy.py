"""Interface satisfaction as relational division, and lookups in its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import names as N
from strandloom.sources.catalog import Index


def divide(required: DataFrame, offered: DataFrame, owner: str, item: str, method: str, least: int = 1) -> DataFrame:
    """(owner, item) pairs where the item offers every method that the owner requires.

    Both inputs have the column ``method``, and ``offered`` no row twice. Owners with fewer
    than ``least`` methods are left out. An owner meets items only on that of its methods which
    the fewest of them offer, and brings all its methods to be compared with the item's; so
    no row is made for each method of each pair. Where ``offered`` is a table that Spark
    knows to be small, meeting it moves no rows.
    """
    # One bit for each method, several may share it: sets that differ here need no closer look.
    bits = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{method}`), 64) AS int))"))
    offers = offered.groupBy(item).agg(F.collect_set(method).alias("has"), bits.alias("has_bits")).select(item, "has", "has_bits", F.explode("has").alias("rarest"))
    spread = offered.groupBy(method).agg(F.count(F.lit(1)).alias("offers"))
    ranked = F.min(F.struct(F.coalesce("offers", F.lit(0)).alias("offers"), F.col(method).alias("name"))).alias("least")
    need = required.join(spread, method, "left").repartition(owner).groupBy(owner).agg(F.collect_set(method).alias("need"), bits.alias("need_bits"), ranked)
    need = need.where(F.col(owner).isNotNull() & (F.size("need") >= least) & (F.col("least.offers") > 0)).select(owner, "need", "need_bits", F.col("least.name").alias("rarest"))
    close = F.col("need_bits").bitwiseAND(F.bitwise_not("has_bits")) == 0
    return need.join(offers, "rarest").where(close).where(F.size(F.array_except("need", "has")) == 0).select(owner, item)


def implementors(index: Index, iface: str = "", type_: str = "", limit: int = 200) -> DataFrame:
    """Rows of the satisfaction table for an interface, or for a type; exactly one is given."""
    if bool(iface.strip()) == bool(type_.strip()):
        raise ValueError("give an interface or a type")
    column, other, text = ("iface_fqname", "impl_fqname", iface) if iface.strip() else ("impl_fqname", "iface_fqname", type_)
    base = N.plain_generics(text)
    match = (F.col(column) == text) | N.has(column, text) | (F.col(column) == base) | N.has(column, base)
    return index.implements.where(match).select("iface_fqname", "impl_fqname", "is_pointer").orderBy(other, column, "is_pointer").limit(limit if limit > 0 else 200)


def satisfying_methods(pairs: DataFrame, required: DataFrame, methods: DataFrame) -> DataFrame:
    """Distinct names of concrete methods that satisfy some interface's method.

    ``pairs`` has iface_fqname and impl_fqname, ``required`` iface_fqname and method_name,
    ``methods`` impl_fqname, method_name and the method's own method_fqname. Each type's
    method is met once, not for each interface that asks for it. Pairs are never broadcast:
    their files are many times smaller than their rows, which Spark can't tell.
    """
    asked = pairs.hint("merge").join(required, "iface_fqname").select("impl_fqname", "method_name").distinct()
    return asked.join(methods, ["impl_fqname", "method_name"]).select("method_fqname").distinct()
