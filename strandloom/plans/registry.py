"""Registered queries of the code-graph operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import names as N
from strandloom.operators import freshness, graph, inventory, lookup, satisfy
from strandloom.plans.fixtures import STORED, open_index, with_views
from strandloom.sources.catalog import Catalog, Index, added, merged
from strandloom.sources.scratch import Scratch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_STORED_SQL: dict[str, str] = {}

EDGE = "from_fqname, to_fqname, file_path, line, col, kind"


def _low(column: str) -> str:
    """ASCII folding in the other engine."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(sql: str | None = None, *views: str, recursive: str = "", name: str = ""):
    def run(f: Callable[[Index], DataFrame]):
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: f(open_index(spark, sf_dir))
        if sql:
            _SQL[key] = with_views(sql, *views, recursive=recursive)
            _STORED_SQL[key] = with_views(sql, *views, recursive=recursive, stored=STORED)
        return f

    return run


def _most(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the least of equals."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("node"))


seed = lambda ix: _most(ix.calls, "to_fqname")
caller_seed = lambda ix: _most(ix.calls, "from_fqname")
ref_seed = lambda ix: _most(ix.type_refs, "to_fqname")
INTO_SEED = "FROM calls WHERE to_fqname IN (SELECT node FROM seed)"
OUT_OF_SEED = "FROM calls WHERE from_fqname IN (SELECT node FROM caller_seed)"
ENTRY = "name NOT IN ('init', 'main') AND NOT regexp_matches(name, '^(?i:test|benchmark|example|fuzz)')"
DEAD = f"FROM symbols s WHERE s.kind IN ('func', 'method') AND {ENTRY} AND s.fqname NOT IN (SELECT to_fqname FROM calls) AND s.fqname NOT IN (SELECT impl_fqname FROM impl_methods)"
DEAD_COLUMNS = "fqname, name, kind, package_path, file_path, line, col, signature"
FOUND = "SELECT fqname, kind, file_path, line, col, signature, package_path, name FROM symbols"


# Search and lookup.


@register(f"{FOUND} WHERE contains({_low('fqname')}, 'red') OR contains({_low('signature')}, 'red') ORDER BY fqname, file_path, line LIMIT 100", "symbols")
def find_substring(ix):
    return lookup.find_symbols(ix, query="rEd")


@register(f"{FOUND} WHERE {_low('name')} LIKE '%d_p%' ORDER BY fqname LIMIT 50", "symbols")
def find_wildcard(ix):
    return lookup.find_symbols(ix, limit=50, query="D_P")


@register(f"{FOUND} WHERE starts_with({_low('package_path')}, 'ex.com/m1') ORDER BY fqname LIMIT 100", "symbols")
def find_prefix_pkg(ix):
    return lookup.find_symbols(ix, pkg="EX.com/m1")


@register(f"{FOUND} WHERE kind = 'interface' ORDER BY fqname LIMIT 100", "symbols")
def find_by_kind(ix):
    return lookup.find_symbols(ix, kind="interface")


@register(f"{FOUND} WHERE contains({_low('file_path')}, 'f3_test') ORDER BY fqname LIMIT 100", "symbols")
def find_by_file(ix):
    return lookup.find_symbols(ix, file="f3_Test")


@register(f"{FOUND} ORDER BY fqname LIMIT 11", "symbols")
def find_topk(ix):
    return lookup.find_symbols(ix, limit=11)


@register("SELECT count(*) AS n FROM symbols WHERE kind = 'method' AND contains(fqname, 'blue')", "symbols")
def count_symbols(ix):
    return lookup.count_symbols(ix, query="blue", kind="method")


DEF = "fqname, kind, file_path, line, col, signature, package_path"


@register(f"SELECT 1 AS way, {DEF} FROM symbols WHERE fqname IN (SELECT fqname FROM symbols WHERE id = 7)", "symbols")
def def_exact(ix):
    name = ix.symbols.where("id = 7").first()
    return lookup.define(ix, name.fqname)


@register(f"SELECT 3 AS way, {DEF} FROM symbols WHERE id = 8", "symbols")
def def_by_name(ix):
    return lookup.define(ix, ix.symbols.where("id = 8").first().name)


@register(f"SELECT 4 AS way, {DEF} FROM symbols WHERE id = 9", "symbols")
def def_fallback(ix):
    return lookup.define(ix, ix.symbols.where("id = 9").first().name + "[map[string]int]")


@register("SELECT fqname FROM symbols WHERE id = 8", "symbols")
def resolve_short_name(ix):
    return lookup.resolve(ix, ix.symbols.where("id = 8").first().name)


@register("SELECT fqname FROM symbols WHERE contains(name, 'plate') ORDER BY id LIMIT 3", "symbols")
def symbol_hint(ix):
    return lookup.similar(ix, "plate")


@register("SELECT DISTINCT fqname, name AS short, concat('func(', split_part(split_part(signature, '(', 2), '[', 1), ')') AS plain FROM symbols", "symbols")
def short_name(ix):
    return inventory.short_names(ix)


# Packages and health.


@register("SELECT package_path, module_root, count(*) AS symbol_count, count(*) FILTER (kind IN ('func', 'method')) AS func_count, count(*) FILTER (exported) AS exported_count FROM symbols GROUP BY ALL", "symbols")
def list_packages(ix):
    return inventory.packages(ix)


@register(
    """SELECT s AS symbols, c AS calls, u AS unresolved, p AS packages, CASE WHEN c + u > 0 THEN u / (c + u) * 100 ELSE 0.0 END AS unresolved_ratio, '0.2' AS tool_version, 'bbb' AS indexed_commit
    FROM (SELECT (SELECT count(*) FROM symbols) AS s, (SELECT count(*) FROM calls) AS c, (SELECT count(*) FROM unresolved_calls) AS u, (SELECT count(DISTINCT package_path) FROM symbols) AS p)""",
    "symbols", "calls", "unresolved_calls",
)
def health_counts(ix):
    return inventory.health(ix)


@register("SELECT expr, count(*) AS n FROM unresolved_calls GROUP BY expr ORDER BY n DESC, expr LIMIT 10", "unresolved_calls")
def top_unresolved(ix):
    return inventory.top_unresolved(ix)


@register("SELECT CAST(2 AS BIGINT) AS id, '0.2' AS tool_version, '/r' AS root, 3 AS warnings, 'bbb' AS indexed_commit", "symbols")
def latest_index_meta(ix):
    return inventory.latest_meta(ix).select("id", "tool_version", "root", "warnings", "indexed_commit")


@register("SELECT module_root FROM symbols WHERE package_path = 'ex.com/m2/brand13' LIMIT 1", "symbols")
def module_of_package(ix):
    return inventory.module_of_package(ix, "ex.com/m2/brand13")


@register("SELECT file_path, file_hash FROM package_files WHERE package_path = 'src3'", "package_files")
def package_files(ix):
    return inventory.package_files(ix, "/m0", "src3")


@register(
    """SELECT kind, count(*) AS n, avg(line) AS mean, round(stddev_pop(line), 6) AS stddev, list_sort(list(line))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median,
    list_sort(list(line))[CAST(ceil(count(*) * 0.95) AS INTEGER)] AS p95, min(line) AS least, max(line) AS largest FROM symbols GROUP BY kind""",
    "symbols",
)
def bench_stats(ix):
    return inventory.run_statistics(ix.symbols, "kind", "line").withColumn("stddev", F.round("stddev", 6))


# Call graph.


@register(f"SELECT {EDGE} {INTO_SEED} ORDER BY kind DESC, from_fqname, file_path, line, to_fqname LIMIT 200", "seed")
def direct_callers(ix):
    return graph.direct_callers(ix, seed(ix))


@register(f"SELECT {EDGE} FROM calls WHERE to_fqname IN (SELECT fqname FROM symbols WHERE kind = 'method' AND exported) AND starts_with(package_path, 'ex.com/m2') ORDER BY kind DESC, from_fqname, file_path, line, to_fqname LIMIT 40", "calls")
def direct_callers_multi(ix):
    return graph.direct_callers(ix, ix.symbols.where("kind = 'method' AND exported").select("fqname"), pkg="ex.com/m2", limit=40)


@register(f"SELECT count(*) AS n {INTO_SEED}", "seed")
def count_callers(ix):
    return graph.count_callers(ix, seed(ix))


@register(f"SELECT DISTINCT to_fqname FROM calls WHERE contains({_low('to_fqname')}, 'blue')", "calls")
def fuzzy_call_targets(ix):
    return graph.fuzzy_targets(ix, "Blue")


@register("SELECT from_fqname, expr, file_path, line, col FROM unresolved_calls WHERE contains(expr, '1') ORDER BY from_fqname, file_path, line, expr LIMIT 200", "unresolved_calls")
def unresolved_callers(ix):
    return graph.unresolved_callers(ix, "1", fuzzy=True)


@register("SELECT DISTINCT expr FROM unresolved_calls WHERE from_fqname = (SELECT min(from_fqname) FROM unresolved_calls) ORDER BY expr LIMIT 200", "unresolved_calls")
def unresolved_callees_unique(ix):
    return graph.unresolved_callees(ix, ix.unresolved_calls.agg(F.min("from_fqname")), unique=True)


@register("SELECT expr, file_path, line, col FROM unresolved_calls WHERE from_fqname = (SELECT min(from_fqname) FROM unresolved_calls) ORDER BY ALL LIMIT 200", "unresolved_calls")
def unresolved_callees(ix):
    return graph.unresolved_callees(ix, ix.unresolved_calls.agg(F.min("from_fqname")))


@register(f"SELECT c.to_fqname, c.file_path, c.line, c.col, c.kind, coalesce(s.package_path, '') AS callee_package FROM (SELECT * {OUT_OF_SEED}) c LEFT JOIN symbols s ON s.fqname = c.to_fqname", "caller_seed")
def direct_callees(ix):
    return graph.callees(ix, caller_seed(ix))


@register(f"SELECT DISTINCT c.to_fqname, c.kind, coalesce(s.package_path, '') AS callee_package FROM (SELECT * {OUT_OF_SEED} AND starts_with(to_fqname, 'ex.com/m')) c LEFT JOIN symbols s ON s.fqname = c.to_fqname", "caller_seed")
def callees_unique(ix):
    return graph.callees(ix, caller_seed(ix), unique=True, pkg="ex.com/m")


@register(f"SELECT count(*) AS n {OUT_OF_SEED}", "caller_seed")
def count_callees(ix):
    return graph.count_callees(ix, caller_seed(ix))


@register("SELECT count(DISTINCT to_fqname) AS n FROM calls WHERE contains(from_fqname, 'brand1')", "calls")
def count_callees_unique(ix):
    return graph.count_callees(ix, "brand1", fuzzy=True, unique=True)


def _hops(depth: int, seeds: str = "SELECT node FROM seed", more: str = "") -> str:
    """Callers by depth in the other engine: distinct names of each hop."""
    return f"""walk(caller, depth) AS (SELECT from_fqname, 1 FROM calls WHERE to_fqname IN ({seeds}) {more}
        UNION SELECT c.from_fqname, w.depth + 1 FROM calls c JOIN walk w ON c.to_fqname = w.caller WHERE w.depth < {depth} {more})"""


LEAST = "(SELECT caller, min(depth) AS depth FROM walk GROUP BY caller)"
LOCATED = f"SELECT b.caller, b.depth, coalesce(s.file_path, '') AS file_path, coalesce(s.line, 0) AS line, coalesce(s.package_path, '') AS package_path FROM {LEAST} b LEFT JOIN symbols s ON s.fqname = b.caller ORDER BY b.depth, b.caller LIMIT 500"


@register(LOCATED, "seed", recursive=_hops(3))
def blast_radius(ix):
    return graph.blast_radius(ix, seed(ix))


@register(LOCATED, "calls", recursive=_hops(2, "SELECT to_fqname FROM calls WHERE contains(to_fqname, 'brand17.blue')"))
def blast_radius_fuzzy(ix):
    return graph.blast_radius(ix, "brand17.blue", depth=2, fuzzy=True)


@register(LOCATED, "seed", recursive=_hops(4, more="AND starts_with(package_path, 'ex.com/m1')"))
def blast_radius_pkg(ix):
    return graph.blast_radius(ix, seed(ix), depth=4, pkg="ex.com/m1")


@register(LOCATED, "seed", recursive=_hops(3, more="AND NOT contains(file_path, '_test.go')"))
def blast_radius_exclude_tests(ix):
    return graph.blast_radius(ix, seed(ix), exclude_tests=True)


@register(
    f"SELECT count(*) AS total, count(*) FILTER (contains(file_path, '_test.go')) AS test, count(*) FILTER (NOT contains(file_path, '_test.go')) AS non_test, coalesce(max(depth), 0) AS max_depth_reached, count(*) = 500 AS truncated FROM ({LOCATED})",
    "seed", recursive=_hops(3),
)
def blast_summary(ix):
    return graph.blast_summary(graph.blast_radius(ix, seed(ix)))


@register("SELECT caller, depth FROM (SELECT caller, min(depth) AS depth FROM walk GROUP BY caller)", "seed", recursive=_hops(10))
def closure_depth10(ix):
    return graph.reverse_closure(ix, seed(ix), depth=10)


CALLERS = """SELECT c.from_fqname, c.to_fqname, c.file_path, c.line, c.col, c.kind, r.depth + 1 AS depth, split_part(c.from_fqname, '.', 3) AS name
    FROM calls c JOIN (SELECT caller, min(depth) AS depth FROM (SELECT caller, depth FROM walk UNION ALL SELECT node, 0 FROM seed) GROUP BY caller) r ON c.to_fqname = r.caller WHERE r.depth < 3"""


@register(
    """SELECT from_fqname, to_fqname, file_path, line, col, kind, depth, split_part(from_fqname, '.', 3) AS name FROM (
        SELECT c.*, 1 AS depth FROM first c UNION ALL (SELECT c.*, 2 AS depth FROM calls c WHERE to_fqname IN (SELECT from_fqname FROM first EXCEPT SELECT node FROM seed) ORDER BY kind DESC, from_fqname, file_path, line, to_fqname, col LIMIT 20))""",
    "first",
)
def callers_bfs_limited(ix):
    return graph.callers(ix, seed(ix), depth=2, limit=20)


@register(CALLERS, "seed", recursive=_hops(3))
def callers_bfs_depth3(ix):
    return graph.callers(ix, seed(ix), depth=3, limit=-1)


@register(f"SELECT * FROM ({CALLERS}) WHERE file_path LIKE '%!_test.go' ESCAPE '!'", "seed", recursive=_hops(3))
def callers_is_test(ix):
    return graph.callers(ix, seed(ix), depth=3, limit=-1, tests_only=True)


@register(
    "SELECT c.from_fqname, c.to_fqname, c.file_path, c.line, c.col, c.kind, 1 AS depth, split_part(c.from_fqname, '.', 3) AS name FROM calls c WHERE contains(to_fqname, 'brand23.red') ORDER BY kind DESC, from_fqname, file_path, line, to_fqname LIMIT 20",
    "calls",
)
def callers_fuzzy(ix):
    return graph.callers(ix, "brand23.red", fuzzy=True, limit=20)


# Dead code.


@register(f"SELECT {DEAD_COLUMNS} {DEAD} AND NOT exported ORDER BY package_path, fqname LIMIT 200", "calls", "impl_methods")
def dead_default(ix):
    return graph.dead_symbols(ix)


@register(f"SELECT {DEAD_COLUMNS} {DEAD} ORDER BY package_path, fqname LIMIT 200", "calls", "impl_methods")
def dead_exported(ix):
    return graph.dead_symbols(ix, include_exported=True)


@register(f"SELECT {DEAD_COLUMNS} {DEAD} AND NOT exported AND starts_with(package_path, 'ex.com/m3')", "calls", "impl_methods")
def dead_by_pkg(ix):
    return graph.dead_symbols(ix, pkg="ex.com/m3", limit=-1)


@register(f"SELECT {DEAD_COLUMNS} {DEAD} AND kind = 'method' ORDER BY package_path, fqname LIMIT 200", "calls", "impl_methods")
def dead_by_kind(ix):
    return graph.dead_symbols(ix, kind="method", include_exported=True)


@register(f"SELECT count(*) AS n {DEAD} AND NOT exported", "calls", "impl_methods")
def count_dead(ix):
    return graph.all_dead(ix).agg(F.count(F.lit(1)).alias("n"))


# Interfaces and references.


@register("SELECT iface_fqname, impl_fqname, is_pointer FROM implements WHERE contains(iface_fqname, 'Face29') ORDER BY impl_fqname, iface_fqname LIMIT 200", "implements")
def implementors_by_iface(ix):
    return satisfy.implementors(ix, iface="Face29[int]")


@register("SELECT iface_fqname, impl_fqname, is_pointer FROM implements WHERE contains(impl_fqname, 'Type1') ORDER BY iface_fqname, impl_fqname LIMIT 200", "implements")
def implementors_by_type(ix):
    return satisfy.implementors(ix, type_="Type1")


@register("SELECT iface_fqname, impl_fqname FROM implements", "implements")
def satisfaction_division(ix):
    return ix.implements.select("iface_fqname", "impl_fqname")


@register("SELECT DISTINCT concat(p.impl_fqname, '.', r.method_name) AS method_fqname FROM implements p JOIN iface_methods r ON r.iface_fqname = p.iface_fqname", "implements")
def impl_methods(ix):
    offered = ix.implements.hint("merge").join(ix.iface_methods, "iface_fqname").select("impl_fqname", "method_name").distinct().withColumn("method_fqname", F.concat_ws(".", "impl_fqname", "method_name"))
    return satisfy.satisfying_methods(ix.implements.select("iface_fqname", "impl_fqname"), ix.iface_methods, offered)


@register(
    """SELECT o.iface_fqname FROM (SELECT DISTINCT iface_fqname FROM implements WHERE ends_with(impl_fqname, 't.Type1')) o
    WHERE EXISTS (SELECT 1 FROM iface_methods m WHERE m.iface_fqname = o.iface_fqname AND m.method_name = 'Brand#14') OR NOT EXISTS (SELECT 1 FROM iface_methods m WHERE m.iface_fqname = o.iface_fqname)
    ORDER BY 1 LIMIT 5""",
    "implements",
)
def iface_hint_fail_open(ix):
    return lookup.dispatching_interfaces(ix, "ex.com/t.*Type1.Brand#14")


REF = "from_fqname, to_fqname, ref_kind, file_path, line, col, expr, package_path"


@register(f"SELECT {REF} FROM type_refs WHERE to_fqname IN (SELECT node FROM ref_seed) ORDER BY ref_kind, from_fqname, file_path, line LIMIT 200", "ref_seed")
def references_all(ix):
    return graph.references(ix, ref_seed(ix))


@register(f"SELECT {REF} FROM type_refs WHERE to_fqname IN (SELECT node FROM ref_seed) AND ref_kind = 'conversion' AND starts_with(package_path, 'ex.com/m') AND contains(from_fqname, 'e')", "ref_seed")
def references_by_kind(ix):
    return graph.references(ix, ref_seed(ix), ref_kind="conversion", pkg="ex.com/m", origin="e")


@register("SELECT count(*) AS n FROM type_refs WHERE to_fqname IN (SELECT node FROM ref_seed)", "ref_seed")
def count_references(ix):
    return graph.count_references(ix, ref_seed(ix))


# Writing and freshness.


@register("SELECT DISTINCT module_root FROM symbols WHERE module_root NOT IN ('/m1', '/m3', '/m9')", "symbols")
def orphan_modules(ix):
    found = ix.symbols.sparkSession.createDataFrame([("/m1",), ("/m3",), ("/m9",)], "module_root string")
    return freshness.orphan_modules(ix.symbols, found)


@register("SELECT module_root, package_path, CASE WHEN module_root = '/m1' THEN 'new' ELSE '' END AS files_hash FROM (SELECT DISTINCT module_root, package_path FROM symbols) UNION ALL SELECT '/m9', 'ex.com/m9/p', 'new'", "symbols")
def upsert_package_meta(ix):
    old = ix.package_meta.select("module_root", "package_path", F.coalesce("files_hash", F.lit("")).alias("files_hash"))
    new = old.where("module_root = '/m1'").withColumn("files_hash", F.lit("new"))
    more = old.sparkSession.createDataFrame([("/m9", "ex.com/m9/p", "new")], old.schema)
    return merged(old, new.unionByName(more), ("module_root", "package_path"))


@register("SELECT DISTINCT module_root FROM symbols UNION SELECT '/m9'", "symbols")
def insert_or_ignore_modules(ix):
    old = ix.symbols.select("module_root").distinct()
    return added(old, old.sparkSession.createDataFrame([("/m1",), ("/m9",), ("/m9",)], "module_root string"), ["module_root"])


@register("SELECT fqname FROM symbols WHERE module_root <> '/m2'", "symbols")
def purge_module(ix):
    spark = ix.symbols.sparkSession
    catalog = Catalog(spark, Scratch(spark, "purge").root)
    catalog.replace({"symbols": ix.symbols})
    catalog.purge_module("/m2")
    return catalog.read("symbols").select("fqname")


@register("SELECT DISTINCT '/m0' AS module_root, package_path FROM package_files WHERE starts_with(file_hash, '00')", "package_files")
def stale_packages(ix):
    changed = F.startswith("file_hash", F.lit("00"))
    now = ix.package_files.withColumn("file_hash", F.when(changed, F.lit("other")).otherwise(F.col("file_hash")))
    return freshness.stale_packages(ix.package_files, now)


@register("SELECT DISTINCT package_path FROM symbols WHERE starts_with(package_path, 'ex.com/m1/') OR package_path = 'ex.com/m2/brand11'", "symbols")
def touched_packages(ix):
    spark = ix.symbols.sparkSession
    changed = spark.createDataFrame([("ex.com/m2/brand11/a/b.go",), ("ex.com/m3/brandx/a.go",), ("go.mod",)], "file_path string")
    dirs = ix.symbols.select("package_path").distinct()
    below = ix.symbols.where("module_root = '/m1'").select(F.concat("package_path", F.lit("/x.go")).alias("file_path")).distinct()
    return freshness.touched_packages(dirs.withColumn("dir", F.col("package_path")), changed.unionByName(below)).select("package_path")


@register(
    """SELECT module_root, package_path, lower(lpad(to_hex(CAST(bit_xor(h) AS UBIGINT)), 16, '0')) AS files_hash FROM (
        SELECT module_root, package_path, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(file_hash) + 1), lambda i: ascii(file_hash[i])::UHUGEINT)),
          lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT) AS h FROM package_files) GROUP BY ALL""",
    "package_files",
)
def package_xor_hash(ix):
    files = ix.package_files.select("module_root", "package_path", F.col("file_hash").alias("content"))
    return freshness.package_hashes(freshness.hashed_files(files))


@register("SELECT fqname, CASE WHEN contains(file_path, '_test.go') THEN 'test' ELSE 'code' END AS role FROM symbols", "symbols")
def test_classification(ix):
    return ix.symbols.select("fqname", F.when(N.is_test_file("file_path"), "test").otherwise("code").alias("role"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def stored_sql() -> dict[str, str]:
    """The same over tables that are there already, as the index is for the queries; for timings."""
    return dict(_STORED_SQL)
