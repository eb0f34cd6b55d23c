"""The call graph: callers, callees, bounded reverse closure, unresolved calls, dead code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom import schema as S
from strandloom.functions import names as N
from strandloom.operators.lookup import _limited, allowed, every
from strandloom.sources.catalog import Index
from strandloom.sources.scratch import Scratch

DEEPEST = 10
EDGE = ("from_fqname", "to_fqname", "file_path", "line", "col", "kind")


def clamp(depth: int) -> int:
    return max(1, min(DEEPEST, depth))


def _targets(index: Index, symbol: str | DataFrame) -> DataFrame:
    """A frame of one column ``node``."""
    return index.calls.sparkSession.createDataFrame([(symbol,)], "node string") if isinstance(symbol, str) else symbol.toDF("node")


def _named(rows: DataFrame, column: str, symbol: str | DataFrame) -> DataFrame:
    """Rows whose column is the symbol, which the scan can look for, or one of several; few are broadcast by their measured size."""
    if isinstance(symbol, str):
        return rows.where(F.col(column) == symbol)
    nodes = symbol.toDF("node")
    return rows.join(nodes, rows[column] == nodes["node"], "left_semi")


def _into(index: Index, symbol: str | DataFrame, pkg: str = "", exclude_tests: bool = False) -> DataFrame:
    """Call rows into the symbols."""
    return _named(index.calls.where(every(N.begins("package_path", pkg) if pkg else None, ~N.is_test_file("file_path") if exclude_tests else None)), "to_fqname", symbol)


def direct_callers(index: Index, targets: str | DataFrame, pkg: str = "", limit: int = 200) -> DataFrame:
    """Calls of the targets, references first."""
    rows = _into(index, targets, pkg).select(*EDGE)
    return _limited(rows.orderBy(F.desc("kind"), "from_fqname", "file_path", "line", "to_fqname", "col"), limit)


def count_callers(index: Index, symbol: str | DataFrame) -> DataFrame:
    return _into(index, symbol).agg(F.count(F.lit(1)).alias("n"))


def fuzzy_targets(index: Index, text: str) -> DataFrame:
    """Called names that contain a text and aren't it."""
    return index.calls.where(N.has("to_fqname", text) & (F.col("to_fqname") != text)).select("to_fqname").distinct()


def callers(index: Index, symbol: str | DataFrame, depth: int = 1, limit: int = 200, pkg: str = "", fuzzy: bool = False, tests_only: bool = False) -> DataFrame:
    """Call rows up to ``depth`` calls before the symbol, with their depth.

    ``limit`` bounds each depth, and what it cuts off isn't followed. A caller that was
    met before is reported but not followed again. With ``fuzzy`` a symbol that nothing
    calls stands for the called names that contain it.
    """
    scratch = Scratch(index.calls.sparkSession, "callers")
    front, first = _targets(index, symbol), symbol
    if fuzzy and isinstance(symbol, str) and index.calls.where(F.col("to_fqname") == symbol).isEmpty():
        front = first = front.unionByName(fuzzy_targets(index, symbol).toDF("node"))
    if clamp(depth) > 1:
        front = scratch.keep("seed", front)
    visited, found = front, None
    for d in range(1, clamp(depth) + 1):
        hop = scratch.keep(f"hop{d}", direct_callers(index, first if d == 1 else front, pkg, limit).withColumn("depth", F.lit(d)))
        found = hop if found is None else found.unionByName(hop)
        if d == clamp(depth):
            break
        front, n = scratch.keep_counted(f"front{d}", hop.select(F.col("from_fqname").alias("node")).distinct().join(visited, "node", "left_anti"))
        if not n:
            break
        visited = visited.unionByName(front)
    found = found.withColumn("name", N.short_name("from_fqname"))
    return found.where(F.col("file_path").endswith("_test.go")) if tests_only else found


def reverse_closure(index: Index, symbol: str | DataFrame, depth: int = 3, pkg: str = "", exclude_tests: bool = False, fuzzy: bool = False) -> DataFrame:
    """(caller, depth) of everything that reaches the symbol in at most ``depth`` calls; the least depth of each.

    The filters hold for every call on the way. The symbol itself is a caller if it lies
    on a cycle. Each hop follows only names that no earlier hop reached, and is a table
    in the shared folder, so that plans stay short.
    """
    scratch = Scratch(index.calls.sparkSession, "closure")
    front = symbol
    if fuzzy and isinstance(symbol, str):
        front = _targets(index, symbol).unionByName(fuzzy_targets(index, symbol).toDF("node"))
    reached = None
    for d in range(1, clamp(depth) + 1):
        step = _into(index, front, pkg, exclude_tests).select(F.col("from_fqname").alias("node")).distinct()
        if reached is not None:
            step = step.join(reached.select("node"), "node", "left_anti")
        front, n = scratch.keep_counted(f"hop{d}", step.withColumn("depth", F.lit(d)))
        reached = front if reached is None else reached.unionByName(front)
        if not n:
            break
        front = front.select("node")
    return reached.select(F.col("node").alias("caller"), "depth")


def located(index: Index, closure: DataFrame) -> DataFrame:
    """A closure with each caller's place; the first place where a name is declared more than once."""
    # Only the places of the callers are looked for and compared.
    own = index.symbols.select("fqname", "file_path", "line", "package_path").join(closure.select(F.col("caller").alias("fqname")), "fqname", "left_semi")
    place = own.groupBy("fqname").agg(F.min(F.struct("file_path", "line", "package_path")).alias("at"))
    return closure.join(place, closure["caller"] == place["fqname"], "left").select(
        "caller", "depth", F.coalesce("at.file_path", F.lit("")).alias("file_path"), F.coalesce("at.line", F.lit(0)).alias("line"), F.coalesce("at.package_path", F.lit("")).alias("package_path")
    )


def blast_radius(index: Index, symbol: str | DataFrame, depth: int = 3, limit: int = 500, **filters) -> DataFrame:
    """The first ``limit`` of the closure by depth and name, located after they are chosen."""
    scratch = Scratch(index.calls.sparkSession, "radius")
    first = scratch.keep("first", _limited(reverse_closure(index, symbol, depth, **filters).orderBy("depth", "caller"), limit))
    return located(index, first).orderBy("depth", "caller")


def blast_summary(rows: DataFrame, limit: int = 500) -> DataFrame:
    """Totals of a blast radius; a caller counts as a test by its own file."""
    test = N.is_test_file("file_path")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(test).alias("test"), F.count_if(~test).alias("non_test"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth_reached"), (F.count(F.lit(1)) == limit).alias("truncated")
    )


def _out_of(index: Index, symbol: str | DataFrame, fuzzy: bool, pkg: str) -> DataFrame:
    """Call rows out of the symbol; ``pkg`` is the beginning of the callee's name."""
    rows = index.calls.where(N.begins("to_fqname", pkg)) if pkg else index.calls
    if fuzzy and isinstance(symbol, str):
        return rows.where((F.col("from_fqname") == symbol) | N.has("from_fqname", symbol))
    return _named(rows, "from_fqname", symbol)


def callees(index: Index, symbol: str | DataFrame, fuzzy: bool = False, pkg: str = "", unique: bool = False, limit: int = 200) -> DataFrame:
    """Calls out of the symbol with the callee's package; a callee declared more than once gives a row for each."""
    edges = _out_of(index, symbol, fuzzy, pkg)
    edges = edges.select("to_fqname", "kind").distinct() if unique else edges.select("to_fqname", "file_path", "line", "col", "kind")
    # Of the symbols, only those that are called here go on.
    places = index.symbols.select("fqname", F.col("package_path").alias("pkg")).join(edges.select(F.col("to_fqname").alias("fqname")), "fqname", "left_semi")
    rows = edges.join(places, F.col("to_fqname") == F.col("fqname"), "left")
    package = F.coalesce("pkg", F.lit("")).alias("callee_package")
    if unique:
        return _limited(rows.select("to_fqname", "kind", package).distinct().orderBy("to_fqname", "kind", "callee_package"), limit)
    return _limited(rows.select("to_fqname", "file_path", "line", "col", "kind", package).orderBy(F.desc("kind"), "to_fqname", "file_path", "line", "col", "callee_package"), limit)


def count_callees(index: Index, symbol: str | DataFrame, fuzzy: bool = False, pkg: str = "", unique: bool = False) -> DataFrame:
    rows = _out_of(index, symbol, fuzzy, pkg)
    return rows.agg((F.count_distinct("to_fqname") if unique else F.count(F.lit(1))).alias("n"))


def unresolved_callers(index: Index, expr: str, fuzzy: bool = False, limit: int = 200) -> DataFrame:
    match = F.col("expr") == expr
    rows = index.unresolved_calls.where(match | N.has("expr", expr) if fuzzy else match)
    return _limited(rows.select("from_fqname", "expr", "file_path", "line", "col").orderBy("from_fqname", "file_path", "line", "expr", "col"), limit)


def unresolved_callees(index: Index, symbol: str | DataFrame, unique: bool = False, limit: int = 200) -> DataFrame:
    rows = _named(index.unresolved_calls, "from_fqname", symbol)
    if unique:
        return _limited(rows.select("expr").distinct().orderBy("expr"), limit)
    return _limited(rows.select("expr", "file_path", "line", "col").orderBy("expr", "file_path", "line", "col"), limit)


def all_dead(index: Index, kind: str = "", pkg: str = "", include_exported: bool = False) -> DataFrame:
    """Functions and methods that nothing calls, that satisfy no interface and that no tool calls by name."""
    allowed(kind, ("func", "method"), "kind")
    entry = F.col("name").isin("init", "main")
    for word in ("Test", "Benchmark", "Example", "Fuzz"):
        entry |= N.begins("name", word)
    rows = index.symbols.where(every(F.col("kind").isin("func", "method"), ~entry, None if include_exported else ~F.col("exported"), F.col("kind") == kind if kind else None, N.begins("package_path", pkg) if pkg else None))
    called = index.calls.select(F.col("to_fqname").alias("fqname"))
    satisfying = index.impl_methods.select(F.col("impl_fqname").alias("fqname"))
    return rows.join(called, "fqname", "left_anti").join(satisfying, "fqname", "left_anti")


def dead_symbols(index: Index, limit: int = 200, **options) -> DataFrame:
    rows = all_dead(index, **options).select("fqname", "name", "kind", "package_path", "file_path", "line", "col", "signature")
    return _limited(rows.orderBy("package_path", "fqname", "file_path", "line"), limit)


def matching_references(index: Index, symbol: str | DataFrame, pkg: str = "", ref_kind: str = "", origin: str = "") -> DataFrame:
    allowed(ref_kind, S.REF_KINDS, "ref-kind")
    rows = index.type_refs.where(every(N.begins("package_path", pkg) if pkg else None, F.col("ref_kind") == ref_kind if ref_kind else None, N.has("from_fqname", origin) if origin else None))
    return _named(rows, "to_fqname", symbol)


def references(index: Index, symbol: str | DataFrame, limit: int = 200, **options: str) -> DataFrame:
    rows = matching_references(index, symbol, **options).select("from_fqname", "to_fqname", "ref_kind", "file_path", "line", "col", "expr", "package_path")
    return rows.orderBy("ref_kind", "from_fqname", "file_path", "line", "col").limit(limit if limit > 0 else 200)


def count_references(index: Index, symbol: str | DataFrame, **options: str) -> DataFrame:
    return matching_references(index, symbol, **options).agg(F.count(F.lit(1)).alias("n"))
