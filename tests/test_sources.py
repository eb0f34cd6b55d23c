import json
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.api import CommandError, Session
from strandloom.operators import graph, inventory
from strandloom.sources import gitstate, gosource, sqlite
from strandloom.sources.catalog import Catalog
from strandloom.streaming import refresh

ALPHA = """package alpha

import (
	"fmt"
	b "ex.com/m/beta"
)

const Answer = 42
var Global = b.Make()

type Store struct {
	b.Base
	mu int
}

type Doer interface { Do(x int) error }

func (s *Store) Do(n int) error {
	if n > 0 { fmt.Println("a(b)", n) }
	return Top(helper)
}

func helper() error { return helper() }
func lonely() {}
func Top(f func() error) error { x := b.Base{}; _ = x; y := any(x).(*b.Base); return s.mu.run(y) }
"""
BETA = "package beta\n\ntype Base struct{}\n// func Not() {}\nfunc Make() Base { return Base{} }\n"


@pytest.fixture
def tree(tmp_path):
    for path, text in {"go.mod": "module ex.com/m\n", "alpha/a.go": ALPHA, "beta/b.go": BETA, "vendor/x/go.mod": "module ex.com/x\n", "beta/b_test.go": "package beta\nfunc TestX() { Make() }\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_parser():
    got = {(f[0], f[3], f[4], f[5]) for f in gosource.parse("a.go", ALPHA)}
    assert {("symbol", "Do", "*Store", "method"), ("symbol", "Do", "Doer", "method"), ("symbol", "Answer", "", "const"), ("call", "Top", "", "call"), ("call", "helper", "", "ref"), ("embed", "b.Base", "", "")} <= got
    assert [f[0] for f in gosource.parse("x.go", "")] == ["error"] and gosource.parse("x.go", "package p\nfunc f( {{{ \"") is not None


def test_index_refresh_and_commands(spark, tree, capsys, monkeypatch):
    root, db = f"file:{tree}", f"file://{tree}/.strandloom"
    cat = Catalog(spark, db)
    assert [r.module_path for r in gosource.discover_modules(spark, root).collect()] == ["ex.com/m"]
    assert refresh.build(cat, root) == (12, 0)
    ix = cat.index()
    edges = {(r.from_fqname, r.to_fqname, r.kind) for r in ix.calls.collect()}
    a, b = "ex.com/m/alpha", "ex.com/m/beta"
    assert {(f"{a}.*Store.Do", f"{a}.Top", "call"), (f"{a}.*Store.Do", f"{a}.helper", "ref"), (f"{a}.init$var:Global", f"{b}.Make", "call"), (f"{b}.TestX", f"{b}.Make", "call")} <= edges
    assert {r.expr for r in ix.unresolved_calls.collect()} == {"s.mu.run"}
    assert {(r.to_fqname, r.ref_kind) for r in ix.type_refs.collect()} >= {(f"{b}.Base", k) for k in ("embed", "composite_lit", "type_assert")}
    assert [(r.iface_fqname, r.impl_fqname, r.is_pointer) for r in ix.implements.collect()] == [(f"{a}.Doer", f"{a}.Store", True)]
    assert [r.name for r in graph.dead_symbols(ix).collect()] == ["lonely"]
    assert refresh.refresh(cat, root) == 0
    (tree / "beta/b.go").write_text(BETA + "func added() { Make() }\n")
    query = refresh.watch(spark, cat, root, str(tree / "checkpoint"))
    query.awaitTermination(120)
    assert cat.read("symbols").where("name = 'added'").count() == 1

    def run(*argv):
        code = cli.main(list(argv), spark)
        out = capsys.readouterr()
        return code, json.loads((out.out or out.err).splitlines()[-1])

    code, got = run("callers", "--db", db, "--symbol", "Make", "--depth", "2")
    assert code == 0 and got["callers_count"] == 3 and got["resolved"]
    assert run("blast-radius", "--db", db, "--symbol", f"{a}.Top", "--exclude-tests")[1]["summary"]["total"] == 1
    assert run("find", "--db", db, "--q", "make", "--limit", "1")[1]["symbols"][0]["fqname"] == f"{b}.Make"
    assert run("find", "--db", db, "--kind", "tpye")[1]["error"]["code"] == "invalid_flag_value"
    assert run("callers", "--db", db)[1]["error"]["code"] == "missing_required_flag"
    assert run("nonsense")[1]["error"]["code"] == "unknown_command_or_flag"
    assert run("find", "--db", f"file://{tree}/none")[1]["error"]["code"] == "no_database"
    assert set(run("agent-context")[1]["commands"]) == set(cli.COMMANDS) == {t["name"] for t in run("manifest")[1]["tools"]}
    assert run("implementors", "--db", db, "--iface", "Doer[int]", "--explain")[1]["explain"]["normalized_query"] == "Doer"

    def lines(*argv):
        assert cli.main(list(argv), spark) == 0
        return capsys.readouterr().out.splitlines()

    got = lines("blast-radius", "--db", db, "--symbol", f"{b}.Make", "--depth", "2", "--text", "--explain")
    assert "  [depth 1]" in got and any(x.strip().startswith(f"{a}.init$var:Global") for x in got) and "    depth: 2" in got
    (row,) = [x for x in lines("find", "--db", db, "--q", "lonely", "--text") if "lonely" in x]
    assert row.split("\t")[:2] == [f"{a}.lonely", "func"] and row.split("\t")[-1].endswith("alpha/a.go:24:6")
    log = tree / "uses.jsonl"
    monkeypatch.setenv("STRANDLOOM_USAGE_LOG", str(log))
    assert cli.main(["version", "--db", db], spark) == 0 and cli.main(["log-tool-use", "--tool", "rg", "--", "-n", "x"]) == 0
    one, two = map(json.loads, log.read_text().splitlines())
    assert (one["cmd"], one["exit_code"], two["tool"], two["argv"]) == ("version", 0, "rg", ["-n", "x"])


def test_git_tells_what_is_stale(spark, tree, monkeypatch):
    git = lambda *words: subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=a@b", *words], check=True, capture_output=True)
    (tree / ".gitignore").write_text(".strandloom\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    root = f"file:{tree}"
    session = Session(Catalog(spark, f"file://{tree}/.strandloom"), root, git=True)
    got = session.make()
    assert got["warnings"] == 0 and got["env"]["stale_packages"] == [] and got["env"]["git"]["dirty_count"] == 0
    assert inventory.indexed_commit(session.index) == gitstate.head(root) != ""
    with monkeypatch.context() as m:
        # A clean tree at the indexed commit: nothing is read.
        m.setattr(refresh.gosource, "read_files", None)
        assert session.env()["stale_packages"] == []
    (tree / "beta/b.go").write_text(BETA + "func more() {}\n")
    (tree / "gamma").mkdir()
    (tree / "gamma/c.go").write_text("package gamma\nfunc C() {}\n")
    assert session.env()["stale_packages"] == ["ex.com/m/beta", "ex.com/m/gamma"] and session.env()["git"]["dirty_count"] == 1
    git("add", ".")
    git("commit", "-qm", "two")
    assert session.env()["stale_packages"] == ["ex.com/m/beta", "ex.com/m/gamma"]
    assert refresh.refresh(session.catalog, root) > 0 and session.env()["stale_packages"] == []
    (tree / "gamma/c.go").unlink()
    assert session.env()["stale_packages"] == ["ex.com/m/gamma"]
    assert gitstate.changed_files(root, "0" * 40) is None and gitstate.changed_files("hdfs://x/y", "a") is None


def test_no_packages(spark, tmp_path):
    with pytest.raises(CommandError) as e:
        Session(Catalog(spark, f"file://{tmp_path}/ix"), f"file:{tmp_path}").make()
    assert e.value.code == "no_packages"


def test_an_index_in_sqlite_is_taken_over(spark, tmp_path, capsys, monkeypatch):
    file = tmp_path / "old.sqlite"
    with sqlite3.connect(file) as db:
        db.execute("CREATE TABLE symbols (id INTEGER PRIMARY KEY, module_root TEXT, package_path TEXT, package_name TEXT, file_path TEXT, name TEXT, kind TEXT, recv TEXT, signature TEXT, fqname TEXT, exported INTEGER, line INTEGER, col INTEGER)")
        db.executemany("INSERT INTO symbols VALUES (?, ?, 'p', 'p', 'a.go', ?, 'func', '', 'func()', ?, ?, ?, 1)", [(k, f"/m{k % 2}", f"f{k}", f"p.f{k}", k % 2, k) for k in range(5, 105)])
        db.execute("CREATE TABLE calls (id INTEGER PRIMARY KEY, module_root TEXT, package_path TEXT, file_path TEXT, line INTEGER, col INTEGER, from_fqname TEXT, to_fqname TEXT, callee_expr TEXT)")
        db.execute("INSERT INTO calls VALUES (1, '/m1', 'p', 'a.go', 3, 2, 'p.f5', 'p.f6', 'f6')")
        db.execute("CREATE TABLE index_meta (id INTEGER PRIMARY KEY, tool_version TEXT, go_version TEXT, indexed_at TEXT, root TEXT, warnings INTEGER)")
        db.execute("INSERT INTO index_meta VALUES (1, '0.9', '1.22', '2024-05-06T07:08:09Z', '/r', 2)")
    monkeypatch.setattr(sqlite, "RANGE", 30)
    index = f"file://{tmp_path}/ix"
    assert cli.main(["import", "--db", index, "--sqlite", str(file)], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["symbols"] == 100 and got["modules"] == ["/m0", "/m1"]
    ix = Catalog(spark, index).index()
    assert sorted(r.id for r in ix.symbols.where("exported").collect()) == [k for k in range(5, 105) if k % 2]
    assert ix.calls.first().kind == "call" and ix.type_refs.count() == 0
    row = ix.index_meta.select("warnings", "indexed_commit", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("at")).first()
    assert tuple(row) == (2, "", "2024-05-06 07:08:09")
    assert [r.from_fqname for r in graph.direct_callers(ix, "p.f6").collect()] == ["p.f5"]
