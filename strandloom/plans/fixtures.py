"""The driver's tables seen as an index: parts are symbols, neighbouring order lines calls."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import satisfy
from strandloom.sources.catalog import Index, conform
from strandloom.sources.scratch import Scratch

EDGE_DISCOUNT, LEAST_METHODS = 0.065, 3
#: Types are groups of suppliers; one offers a brand's method where these make a small rest.
TYPES = 40

_KIND = {"ECONOMY": "func", "SMALL": "method", "STANDARD": "type", "MEDIUM": "interface", "LARGE": "var"}
_REF = {1: "type_assert", 2: "type_switch", 3: "composite_lit", 4: "conversion", 5: "field_access"}


def _case(column: str, values: dict, other: str):
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out.otherwise(other)


def derive(spark: SparkSession, sf_dir: str, scratch: Scratch) -> dict[str, Callable[[], DataFrame]]:
    """Makers of lazy frames of all tables; what several of them read is written when the first asks for it."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, lineitem, events, documents = map(read, ("part", "lineitem", "events", "documents"))
    text = lambda c: F.col(c).cast("string")
    symbols = (
        part.select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("/m"), (F.col("p_partkey") % 4).cast("string")).alias("module_root"),
            F.concat(F.lit("ex.com/m"), (F.col("p_partkey") % 4).cast("string"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("package_path"),
            F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("package_name"),
            F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), text("p_partkey")).alias("name"),
            _case("p_type", _KIND, "const").alias("kind"),
            F.concat(F.lit("func("), F.col("p_type"), F.lit("[T])")).alias("signature"),
            (F.col("p_size") % 2 == 1).alias("exported"),
            F.col("p_size").cast("int").alias("line"),
            F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 5 == 0, "_test.go").otherwise(".go")).alias("file_path"),
        )
        .withColumn("fqname", F.concat_ws(".", "package_path", "name"))
        .withColumn("col", F.lit(1))
    )
    heavy = lineitem.where(F.col("l_discount") >= EDGE_DISCOUNT).select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    after = heavy.select(F.col("l_orderkey"), (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("callee"))
    # Neither lines nor symbols are ever broadcast: their files are many times smaller than their rows, which Spark can't tell.
    source = symbols.select(F.col("id").alias("l_partkey"), F.col("fqname").alias("from_fqname"), "module_root", "package_path", "file_path").hint("merge")
    target = symbols.select(F.col("id").alias("callee"), F.col("fqname").alias("to_fqname"), F.col("kind").alias("target_kind"))
    wanted = target.where(F.col("target_kind").isin("type", "interface")).hint("merge")
    calls = (
        heavy.join(after.hint("merge"), ["l_orderkey", "l_linenumber"])
        .join(source, "l_partkey")
        .join(target.hint("merge"), "callee")
        .withColumn("line", F.col("l_linenumber").cast("int"))
        .withColumn("kind", F.when(F.col("l_returnflag") == "R", "ref").otherwise("call"))
    )
    n = part.agg(F.count(F.lit(1)).alias("parts"))
    refs = lineitem.crossJoin(F.broadcast(n)).select(
        "l_partkey", ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % F.col("parts")).alias("callee"), F.col("l_quantity").cast("int").alias("line"), _case("l_linenumber", _REF, "embed").alias("ref_kind")
    )
    # Targets first, as they leave out most rows before names are added.
    type_refs = refs.join(wanted, "callee").join(source, "l_partkey")
    unresolved = events.where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", F.col("props").alias("expr"), (F.col("event_id") % 97).cast("int").alias("line"))
    unresolved = unresolved.join(source, F.col("user_id") == F.col("l_partkey")).withColumn("reason", F.lit("unresolved"))
    brands = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("method_name")).hint("merge")
    # Every order is an interface that requires the brands of its lines; names are given last, as numbers are smaller to move.
    bought = cache(lambda: scratch.keep("bought", lineitem.join(brands, "l_partkey").select("l_orderkey", "method_name", (F.col("l_suppkey") % TYPES).alias("type"))))
    face, type_ = F.concat(F.lit("ex.com/i.Face"), text("l_orderkey")).alias("iface_fqname"), F.concat(F.lit("ex.com/t.Type"), text("type")).alias("impl_fqname")
    offers = (F.col("type") * 7 + F.substr("method_name", F.lit(7)).cast("int") * 3) % 10 < 5

    def implements() -> DataFrame:
        offered = scratch.keep("type_methods", bought().where(offers).select("type", "method_name").distinct())
        pairs = satisfy.divide(bought().select("l_orderkey", "method_name"), offered, "l_orderkey", "type", "method_name", LEAST_METHODS)
        return pairs.select(face, type_).withColumn("is_pointer", F.length("impl_fqname") % 2 == 0).select("*", root)

    root = F.lit("/m0").alias("module_root")
    return {
        "symbols": lambda: symbols,
        "calls": lambda: calls,
        "type_refs": lambda: type_refs,
        "unresolved_calls": lambda: unresolved,
        "iface_methods": lambda: bought().select("l_orderkey", "method_name").repartition("l_orderkey").distinct().select(face, "method_name", root),
        "implements": implements,
        "impl_methods": lambda: symbols.where("kind = 'method' AND line > 33").select("module_root", F.col("fqname").alias("impl_fqname")),
        "package_meta": lambda: symbols.select("module_root", "package_path").distinct(),
        "package_files": lambda: documents.select(root, F.col("source").alias("package_path"), text("doc_id").alias("file_path"), F.md5("text").alias("file_hash")),
        "index_meta": lambda: spark.createDataFrame([(1, "0.1", "1.22", "/r", 0, "aaa"), (2, "0.2", "1.22", "/r", 3, "bbb")], "id long, tool_version string, go_version string, root string, warnings int, indexed_commit string"),
    }


class _Stored:
    """An index whose tables are written when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._scratch = Scratch(spark, "index")
        self._makers = derive(spark, sf_dir, self._scratch)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Index.__dataclass_fields__:
            raise AttributeError(name)
        kept = self._scratch.keep(name, conform(self._makers[name](), name))
        setattr(self, name, kept)
        return kept


@lru_cache(maxsize=32)
def _stored(application: str, spark: SparkSession, sf_dir: str) -> _Stored:
    return _Stored(spark, sf_dir)


def open_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the tables in a folder: each table is built once in a session, as an index is, then read."""
    return _stored(spark.sparkContext.applicationId, spark, sf_dir)


#: The same tables for another engine.
VIEWS = {
    "symbols": """SELECT *, concat(package_path, '.', name) AS fqname, 1 AS col FROM (
        SELECT p_partkey AS id, concat('/m', p_partkey % 4) AS module_root,
          concat('ex.com/m', p_partkey % 4, '/', lower(replace(p_brand, '#', ''))) AS package_path,
          concat(replace(p_name, ' ', '_'), p_partkey) AS name,
          CASE p_type WHEN 'ECONOMY' THEN 'func' WHEN 'SMALL' THEN 'method' WHEN 'STANDARD' THEN 'type' WHEN 'MEDIUM' THEN 'interface' WHEN 'LARGE' THEN 'var' ELSE 'const' END AS kind,
          concat('func(', p_type, '[T])') AS signature, p_size % 2 = 1 AS exported, CAST(p_size AS INTEGER) AS line,
          concat('f', p_partkey % 7, CASE WHEN p_partkey % 5 = 0 THEN '_test.go' ELSE '.go' END) AS file_path
        FROM part) z""",
    "calls": f"""SELECT f.fqname AS from_fqname, t.fqname AS to_fqname, f.package_path, f.file_path, CAST(a.l_linenumber AS INTEGER) AS line, 0 AS col,
          CASE WHEN a.l_returnflag = 'R' THEN 'ref' ELSE 'call' END AS kind
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_discount >= {EDGE_DISCOUNT} AND b.l_discount >= {EDGE_DISCOUNT}
        JOIN symbols f ON f.id = a.l_partkey JOIN symbols t ON t.id = b.l_partkey""",
    "type_refs": """SELECT f.fqname AS from_fqname, t.fqname AS to_fqname, f.package_path, f.file_path, l.ln AS line, 0 AS col, '' AS expr, l.rk AS ref_kind
        FROM (SELECT l_partkey AS fk, (l_suppkey * 7 + l_linenumber) % (SELECT count(*) FROM part) AS tk, CAST(l_quantity AS INTEGER) AS ln,
          CASE l_linenumber WHEN 1 THEN 'type_assert' WHEN 2 THEN 'type_switch' WHEN 3 THEN 'composite_lit' WHEN 4 THEN 'conversion' WHEN 5 THEN 'field_access' ELSE 'embed' END AS rk
          FROM lineitem) l
        JOIN symbols f ON f.id = l.fk JOIN symbols t ON t.id = l.tk WHERE t.kind IN ('type', 'interface')""",
    "unresolved_calls": """SELECT e.event_id AS id, s.fqname AS from_fqname, e.props AS expr, s.file_path, CAST(e.event_id % 97 AS INTEGER) AS line, 0 AS col
        FROM events e JOIN symbols s ON s.id = e.user_id WHERE e.event_type = 'error'""",
    "iface_methods": "SELECT DISTINCT concat('ex.com/i.Face', l_orderkey) AS iface_fqname, p_brand AS method_name FROM lineitem JOIN part ON l_partkey = p_partkey",
    "type_methods": f"""SELECT DISTINCT concat('ex.com/t.Type', l_suppkey % {TYPES}) AS impl_fqname, p_brand AS method_name FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE (l_suppkey % {TYPES} * 7 + CAST(substr(p_brand, 7) AS INTEGER) * 3) % 10 < 5""",
    "implements": f"""SELECT k.iface_fqname, k.impl_fqname, length(k.impl_fqname) % 2 = 0 AS is_pointer
        FROM (SELECT i.iface_fqname, t.impl_fqname, count(*) AS c FROM iface_methods i JOIN type_methods t ON i.method_name = t.method_name GROUP BY ALL) k
        JOIN (SELECT iface_fqname, count(*) AS n FROM iface_methods GROUP BY ALL) n ON n.iface_fqname = k.iface_fqname WHERE k.c = n.n AND n.n >= {LEAST_METHODS}""",
    "impl_methods": "SELECT module_root, fqname AS impl_fqname FROM symbols WHERE kind = 'method' AND line > 33",
    "package_files": "SELECT '/m0' AS module_root, source AS package_path, CAST(doc_id AS VARCHAR) AS file_path, md5(text) AS file_hash FROM documents",
    "seed": "SELECT to_fqname AS node FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
    "first": "SELECT * FROM calls WHERE to_fqname IN (SELECT node FROM seed) ORDER BY kind DESC, from_fqname, file_path, line, to_fqname, col LIMIT 20",
    "caller_seed": "SELECT from_fqname AS node FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
    "ref_seed": "SELECT to_fqname AS node FROM type_refs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
}

_NEEDS = {
    "symbols": (), "calls": ("symbols",), "type_refs": ("symbols",), "unresolved_calls": ("symbols",), "iface_methods": (), "type_methods": (), "implements": ("iface_methods", "type_methods"),
    "impl_methods": ("symbols",), "package_files": (), "seed": ("calls",), "first": ("seed",), "caller_seed": ("calls",), "ref_seed": ("type_refs",),
}


#: Views that an index holds as tables, in an order in which they can be made.
STORED = ("symbols", "calls", "type_refs", "unresolved_calls", "iface_methods", "type_methods", "implements", "impl_methods", "package_files")


def with_views(body: str, *names: str, recursive: str = "", stored: tuple[str, ...] = ()) -> str:
    """A query over the named views, each defined once before it is used, but for those that are stored."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS[name]:
            add(x)
        if name not in order and name not in stored:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in order] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
