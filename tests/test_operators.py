import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from strandloom import schema as S
from strandloom.functions import hashing
from strandloom.functions import names as N
from strandloom.functions.hashing import fnv64, fnv64a, hex64
from strandloom.operators import freshness, graph, inventory, lookup, satisfy
from strandloom.plans import fixtures
from strandloom.sources.catalog import Catalog, Index, conform, last_wins
from strandloom.sources.scratch import Scratch


def index(spark, **tables):
    make = lambda name: conform(spark.createDataFrame(*tables[name]), name) if name in tables else spark.createDataFrame([], S.SCHEMAS[name])
    return Index(**{name: make(name) for name in Index.__dataclass_fields__})


SYMBOLS = "fqname string, name string, kind string, exported boolean, package_path string, file_path string, id long"
CALLS = "from_fqname string, to_fqname string, package_path string, file_path string, line int, kind string"


def graph_of(spark, edges):
    return index(spark, calls=([(a, b, "p", f, 1, "call") for a, b, f in edges], CALLS), symbols=([(x, x, "func", False, "p", "a.go", 1) for x in "abc"], SYMBOLS))


def test_like_folds_ascii_only(spark):
    rows = [("Foo\\src_É",), ("fooXsrcXé",), ("bar",)]
    df = spark.createDataFrame(rows, "x string")
    count = lambda c: df.where(c).count()
    assert count(N.has("x", "O\\SRC")) == 1 and count(N.has("x", "foo_src_")) == 2
    assert count(N.has("x", "É")) == 1 and count(N.begins("x", "FOO")) == 2 and count(N.ends("x", "AR")) == 1


def test_names(spark):
    rows = [("ex.com/a/pkg.*T.M", "Box[map[string]int]"), ("plain", "a[b"), ("x.y", "q]z"), (None, None), ("z", "A" + "[a" * 11 + "]" * 11 + "B[" + "[c]" * 3 + "]C[d[")]
    df = spark.createDataFrame(rows, "f string, g string")
    got = [tuple(r) for r in df.select(N.short_name("f"), N.strip_generics("g"), N.type_part("f"), N.method_part("f")).collect()]
    assert got[0] == ("*T.M", "Box", "ex.com/a/pkg.T", "M") and got[1][:2] == ("plain", "a") and got[2][:2] == ("y", "qz") and got[3][:2] == (None, None)
    assert got[4][1] == "ABC" == N.plain_generics(rows[4][1])
    assert N.plain_generics("A[B[int]].C") == "A.C" and N.plain_generics("a[b") == "a"


def test_fnv(spark, monkeypatch):
    assert [f"{x:016x}" for x in fnv64([b"", b"a", b"foobar"])] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    rng = random.Random(1)
    values = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 200, 1000, 5000)] + [bytes(300), b"\xff" * 300]

    def plain(value):
        h = 0xCBF29CE484222325
        for b in value:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    assert fnv64(values).tolist() == [plain(v) for v in values]
    monkeypatch.setattr(hashing, "_PIECE", 37)
    assert fnv64(values).tolist() == [plain(v) for v in values]
    df = spark.createDataFrame([(bytearray(b"a"),), (None,)], "c binary")
    assert [r[0] for r in df.select(hex64(fnv64a("c"))).collect()] == ["af63dc4c8601ec8c", None]


def closure(edges, seed, depth):
    found, front = {}, {seed}
    for d in range(1, depth + 1):
        front = {a for a, b, _ in edges if b in front} - set(found)
        found |= dict.fromkeys(front, d)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(14)]
    edges = [(rng.choice(nodes), rng.choice(nodes), "a.go") for _ in range(24)] + [("n1", "n0", "a.go"), ("n0", "n1", "a.go")]
    ix = graph_of(spark, edges)
    assert {r.caller: r.depth for r in graph.reverse_closure(ix, "n0", 4).collect()} == closure(edges, "n0", 4)


def test_blast_radius_of_a_cycle_and_filters(spark):
    ix = graph_of(spark, [("b", "a", "x.go"), ("a", "b", "x.go"), ("c", "b", "x_test.go"), ("d", "c", "x.go")])
    assert [(r.caller, r.depth) for r in graph.blast_radius(ix, "a").collect()] == [("b", 1), ("a", 2), ("c", 2), ("d", 3)]
    assert [r.caller for r in graph.blast_radius(ix, "a", exclude_tests=True).collect()] == ["b", "a"]
    assert graph.blast_radius(ix, "a", pkg="q").collect() == []
    assert [r.from_fqname for r in graph.callers(ix, "a", depth=3, tests_only=True).collect()] == ["c"]
    assert [(r.from_fqname, r.depth) for r in graph.callers(ix, "a", depth=9, limit=1).collect()] == [("b", 1), ("a", 2)]


def test_symbols_are_looked_for_by_the_scan(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/ix")
    rows = [("p.a", "p.b", "p", "a.go", 1, "call"), ("p.b", "p.c", "p", "a.go", 1, "call")]
    cat.replace({"calls": spark.createDataFrame(rows, CALLS).withColumn("module_root", F.lit("/m"))})
    ix = cat.index()
    for frame, column in ((graph.direct_callers(ix, "p.b"), "to"), (graph.count_callers(ix, "p.b"), "to"), (graph.callees(ix, "p.b"), "from"), (graph.count_callees(ix, "p.b"), "from")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PushedFilters: \[[^\]]*EqualTo\({column}_fqname,p.b\)", plan) and frame.count()
    pushed = lambda f: "EqualTo(" in f._jdf.queryExecution().executedPlan().toString()
    cat.replace({t: spark.createDataFrame([], S.SCHEMAS[t]) for t in ("type_refs", "unresolved_calls")})
    cat.replace({"type_refs": spark.createDataFrame([("/m", "p.x", "p.T")], "module_root string, from_fqname string, to_fqname string"), "unresolved_calls": spark.createDataFrame([("/m", "p.x", "e")], "module_root string, from_fqname string, expr string")})
    ix = cat.index()
    assert pushed(graph.references(ix, "p.T")) and pushed(graph.count_references(ix, "p.T")) and pushed(graph.unresolved_callees(ix, "p.x"))


def test_run_statistics(spark):
    rng = random.Random(2)
    rows = [("a", float(rng.randrange(9))) for _ in range(41)] + [("b", 3.0), ("c", None)] + [("d", float(k)) for k in range(20)]
    got = {r.g: r for r in inventory.run_statistics(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    assert set(got) == {"a", "b", "d"}
    for g, r in got.items():
        x = sorted(v for k, v in rows if k == g)
        assert (r.n, r.median, r.p95, r.least, r.largest) == (len(x), x[len(x) // 2], x[-(-len(x) * 95 // 100) - 1], x[0], x[-1]) and abs(r.stddev - statistics.pstdev(x)) < 1e-9


def test_self_recursion_is_not_dead(spark):
    symbols = [("p.f", "f", "func", False, "p", "a.go", 1), ("p.g", "g", "func", False, "p", "a.go", 2), ("p.main", "main", "func", False, "p", "a.go", 3), ("p.testing", "testing", "func", False, "p", "a.go", 4), ("p.E", "E", "func", True, "p", "a.go", 5), ("p.T.M", "M", "method", False, "p", "a.go", 6)]
    ix = index(spark, symbols=(symbols, SYMBOLS), calls=([("p.f", "p.f", "p", "a.go", 1, "call")], CALLS), impl_methods=([("m", "p.T.M")], "module_root string, impl_fqname string"))
    assert [r.fqname for r in graph.dead_symbols(ix).collect()] == ["p.g"]
    assert [r.fqname for r in graph.dead_symbols(ix, include_exported=True).collect()] == ["p.E", "p.g"]
    with pytest.raises(lookup.InvalidFlag):
        graph.dead_symbols(ix, kind="tpye")


def test_definition_falls_back(spark):
    symbols = [("p.Box", "Box", "type", True, "p", "a.go", 1), ("q.Box", "Box", "type", True, "q", "a.go", 2)]
    ix = index(spark, symbols=(symbols, SYMBOLS))
    names = lambda *a: [r.fqname for r in lookup.define(ix, *a).collect()]
    assert names("p.Box") == ["p.Box"] and names("p.Box[int]") == ["p.Box"] and names("Box") == ["p.Box", "q.Box"] and names("Box[int]", "q") == ["q.Box"] and names("Nix") == []


def test_hint_is_open_where_methods_are_unknown(spark):
    ix = index(spark, implements=([("p.Known", "p.T"), ("p.Other", "p.T"), ("p.Unknown", "p.T")], "iface_fqname string, impl_fqname string"), iface_methods=([("p.Known", "Do"), ("p.Other", "Else")], "iface_fqname string, method_name string"))
    assert [r[0] for r in lookup.dispatching_interfaces(ix, "p.*T.Do").collect()] == ["p.Known", "p.Unknown"]


def test_hint_broadcasts_no_interfaces(spark, tmp_path):
    ix = index(spark, implements=([("p.I", "p.T"), ("p.J", "p.T")], "iface_fqname string, impl_fqname string"), iface_methods=([("p.I", "Do"), ("p.J", "Other")], "iface_fqname string, method_name string"))
    # Spark knows the size of files only.
    for name in ("implements", "iface_methods"):
        getattr(ix, name).write.parquet(f"{tmp_path}/{name}")
        setattr(ix, name, spark.read.parquet(f"{tmp_path}/{name}"))
    found = lookup.dispatching_interfaces(ix, "p.*T.Do")
    assert [r[0] for r in found.collect()] == ["p.I"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_division(spark):
    need = spark.createDataFrame([("I", "a"), ("I", "b"), ("J", "c")], "o string, m string")
    have = spark.createDataFrame([("T", "a"), ("T", "b"), ("U", "a"), ("U", "c")], "t string, m string")
    assert sorted(map(tuple, satisfy.divide(need, have, "o", "t", "m").collect())) == [("I", "T"), ("J", "U")]


@pytest.mark.parametrize("least", [1, 3])
def test_division_moves_no_pairs(spark, least):
    rng = random.Random(least)
    need = {(f"I{rng.randrange(200)}", f"m{min(rng.randrange(90), rng.randrange(90))}") for _ in range(500)} | {("null", None), ("null", "m0"), (None, "m0")}
    have = {(f"T{rng.randrange(12)}", f"m{rng.randrange(90)}") for _ in range(700)} | {("none", "x")}
    sets = lambda rows: {k: {m for x, m in rows if x == k} for k, _ in rows if k}
    want = [(o, t) for o, n in sets(need).items() for t, h in sets(have).items() if len(n) >= least and n <= h]
    pairs = satisfy.divide(spark.createDataFrame([*need, *list(need)[:50]], "o string, m string"), spark.createDataFrame([*have], "t string, m string"), "o", "t", "m", least)
    assert len(want) > 20 and sorted(map(tuple, pairs.collect())) == sorted(want)
    assert not re.search(r"hashpartitioning\(o#\d+, t#", pairs._jdf.queryExecution().executedPlan().toString())


def test_pairs_are_not_broadcast(spark):
    pairs = spark.createDataFrame([("I", "T"), ("J", "T")], "iface_fqname string, impl_fqname string")
    required = spark.createDataFrame([("I", "M"), ("J", "M"), ("J", "N")], "iface_fqname string, method_name string")
    methods = spark.createDataFrame([("T", "M", "T.M"), ("T", "N", "*T.N"), ("T", "O", "T.O")], "impl_fqname string, method_name string, method_fqname string")
    found = satisfy.satisfying_methods(pairs, required, methods)
    assert sorted(r[0] for r in found.collect()) == ["*T.N", "T.M"]
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    # Distinct lie between the two joins; the lower one, on interfaces, sorts.
    assert any("SortMergeJoin [iface_fqname" in line for line in lines) and any("HashAggregate(keys=[impl_fqname" in line for line in lines)


@pytest.mark.parametrize(("table", "keys"), [("unresolved_calls", ["user_id"]), ("type_refs", ["callee", "l_partkey"])])
def test_symbols_are_not_broadcast(spark, table, keys):
    made = fixtures.derive(spark, "/root/testdata/sf0.001", Scratch(spark, "plans"))[table]()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert all(f"SortMergeJoin [{key}#" in plan for key in keys) and "BroadcastHashJoin" not in plan


def test_calls_broadcast_no_symbols(spark):
    made = fixtures.derive(spark, "/root/testdata/sf0.001", Scratch(spark, "plans"))["calls"]()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert all(f"SortMergeJoin [{key}#" in plan for key in ("callee", "l_partkey"))


def test_calls_broadcast_no_lines(spark):
    # Small files of lines are no sign of few lines either: neither of a call's two is broadcast.
    made = fixtures.derive(spark, "/root/testdata/sf0.001", Scratch(spark, "plans"))["calls"]()
    assert made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_orderkey#" in plan and "Broadcast" not in plan


def test_staleness(spark):
    ddl = "module_root string, package_path string, file_path string, file_hash string"
    old = spark.createDataFrame([("m", "same", "a.go", "1"), ("m", "changed", "a.go", "1"), ("m", "gone", "a.go", "1"), ("m", "blank", "a.go", ""), ("m", "tests", "a.go", "1")], ddl)
    new = spark.createDataFrame([("m", "same", "a.go", "1"), ("m", "changed", "a.go", "2"), ("m", "blank", "a.go", "1"), ("m", "tests", "a.go", "1"), ("m", "tests", "b_test.go", "9"), ("m", "fresh", "a.go", "1")], ddl)
    assert sorted(r.package_path for r in freshness.stale_packages(old, new).collect()) == ["blank", "changed", "fresh", "gone"]
    # A package without hashes of its files is compared as a whole.
    meta = lambda h: spark.createDataFrame([("m", "blank", h)], "module_root string, package_path string, files_hash string")
    for h, want in (("0" * 15 + "1", ["changed", "fresh", "gone"]), ("0" * 16, ["blank", "changed", "fresh", "gone"]), ("", ["blank", "changed", "fresh", "gone"])):
        assert sorted(r.package_path for r in freshness.stale_packages(old, new, meta(h)).collect()) == want


def test_catalog(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/ix")
    cat.migrate()
    sym = lambda root, *names: spark.createDataFrame([(root, n, 1) for n in names], "module_root string, fqname string, id long")
    cat.replace({"symbols": sym("/a", "x", "y").unionByName(sym("/b", "z"))})
    cat.replace({"symbols": sym("/a", "w")})
    names = lambda: sorted(r.fqname for r in cat.read("symbols").collect())
    assert names() == ["w", "z"] and cat.version() == S.VERSION and cat.read("symbols").columns == S.SCHEMAS["symbols"].names
    meta = lambda h: spark.createDataFrame([("/a", "p", h)], "module_root string, package_path string, files_hash string")
    cat.upsert("package_meta", meta("1"))
    cat.upsert("package_meta", meta("2"))
    assert [r.files_hash for r in cat.read("package_meta").collect()] == ["2"]
    assert cat.purge_orphans(spark.createDataFrame([("/b",)], "module_root string")) == ["/a"] and names() == ["z"]
    cat.append("index_meta", spark.createDataFrame([(1, "v")], "id long, tool_version string"))
    assert cat.index().index_meta.count() == 1 and cat.index().calls.count() == 0
    before = cat.read("symbols")
    cat.reset()
    assert names() == [] and before is not None
    assert not list((tmp_path / "ix/data").iterdir())


def test_replacing_leaves_nothing_of_a_module(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/ix")
    call = lambda *roots: spark.createDataFrame([(r, "p.a", "p.b") for r in roots], "module_root string, from_fqname string, to_fqname string")
    sym = lambda root: spark.createDataFrame([(root, "p.a", 1)], "module_root string, fqname string, id long")
    cat.replace({"symbols": sym("/a b/ü"), "calls": call("/a b/ü", "/b")})
    before = cat.index()
    cat.replace({"symbols": sym("/a b/ü"), "calls": call()})
    assert [r.module_root for r in cat.read("calls").collect()] == ["/b"]
    # A reader keeps to the tables it began with, until they are removed.
    assert before.calls.count() == 2 and cat.module_roots() == ["/a b/ü"]
    cat.replace({"symbols": sym("/c"), "calls": call()}, ["/a b/ü", "/b"])
    assert cat.read("calls").count() == 0 and cat.module_roots() == ["/c"]
    cat.vacuum(1)
    assert cat.read("symbols").count() == 1 and len(list((tmp_path / "ix/data").iterdir())) == 1


def test_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    cat = Catalog(spark, f"file://{tmp_path}/ix")
    sym = lambda n: spark.createDataFrame([("/a", n, 1)], "module_root string, fqname string, id long")
    cat.replace({"symbols": sym("x"), "package_meta": spark.createDataFrame([("/a", "p", "h")], "module_root string, package_path string, files_hash string")})
    with monkeypatch.context() as m:
        m.setattr(cat, "_commit", lambda change: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            cat.replace({"symbols": sym("y")})
    assert [r.fqname for r in cat.read("symbols").collect()] == ["x"]
    cat.update_files_hash("/a", "p", "new")
    cat.update_files_hash("/a", "q", "none")
    assert [tuple(r)[1::2] for r in cat.read("package_meta").collect()] == [("p", "new")]
    # Files of a layout without a column are read with its default.
    cat._commit(lambda manifest: manifest["tables"]["symbols"]["/a"]["columns"].remove("line"))
    assert cat.read("symbols").first().line == 0 and cat.read("symbols").columns == S.SCHEMAS["symbols"].names


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert sorted(map(tuple, last_wins(df, ["k"], "n").collect())) == [("a", 2, "y"), ("b", 1, None)]
