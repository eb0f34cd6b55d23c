import pytest

from strandloom.operators import graph, satisfy
from strandloom.sources import gosource
from strandloom.sources.catalog import Catalog
from strandloom.streaming import refresh

P = "ex.com/m/shop"
SHOP = """package shop

import (
	"io"
	st "ex.com/m/store"
)

type Reader interface { Read(p []byte) (n int, err error) }
type Closer interface { Close() error }
type ReadCloser interface {
	Reader
	Closer
}
type Outside interface { io.Writer; Close() error }
type Failing interface { error; Code() int }
type Number interface { ~int | ~int64; String() string }

type base struct{ hits int }
func (b *base) Close() error { b.hits++; return nil }
func (b base) Code() int { return b.hits }

type File struct {
	base
	*st.Buffer
	name string
}
func (f File) Read(buf []byte) (int, error) { return len(buf), nil }

type Wrong struct{}
func (Wrong) Read(s string) (int, error) { return 0, nil }
func (Wrong) Close() error { return nil }

type Oops struct{ base }
func (o Oops) Error() string { return "" }

type Getter[T any] interface { Get(key string) T }
type Box[V any] struct { value V }
func (b *Box[V]) Get(k string) V { return b.value }
type IntBox struct{}
func (IntBox) Get(k string) int { return 0 }

var shared = st.New(func() int { return helper(3) })
var keep *File

func NewFile() *File { return &File{name: "x"} }
func helper(n int) int { return n }

func Use(r Reader, f *File, n int, run func() int) int {
	f.Close()
	r.Read(nil)
	x := File{}
	x.base.Code()
	var y *File
	y.Flush()
	z := NewFile()
	z.Read(nil)
	NewFile().Code()
	shared.Flush()
	keep.Close()
	if v, ok := any(n).(*st.Buffer); ok { v.Flush() }
	w := st.Buffer{}
	w.Flush()
	defer func() { f.Flush() }()
	switch t := any(f).(type) {
	case *File, st.Buffer:
		helper(1)
	case Reader:
		_ = t
	}
	table := map[string]func(int) int{"h": helper}
	table["h"](2)
	pick()(4)
	run()
	name := f.name
	_ = name
	for i := range []int{1} { unknown.Call(i) }
	if n > 0 { return st.Size(n) }
	return int(Amount(n)) + len(f.name)
}

type Amount int
func pick() func(int) int { return helper }
"""
STORE = "package store\n\ntype Buffer struct{ N int }\nfunc (b *Buffer) Flush() {}\nfunc New(f func() int) *Buffer { return &Buffer{} }\nfunc Size(n int) int { return n }\n"
OUTER_TEST = "package shop_test\n\nimport \"ex.com/m/shop\"\n\nfunc TestUse() { shop.NewFile() }\n"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("go")
    for path, text in {"go.mod": "module ex.com/m\n", "shop/shop.go": SHOP, "store/store.go": STORE, "shop/outer_test.go": OUTER_TEST, "shop/broken.go": "package shop\nfunc Half() { helper(1)\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    cat = Catalog(spark, f"file://{root}/.strandloom")
    refresh.build(cat, f"file:{root}")
    return cat.index()


def short(name):
    return name.replace("ex.com/m/", "")


def test_calls(index):
    got = {(short(r.from_fqname), short(r.to_fqname)) for r in index.calls.where("kind = 'call'").collect()}
    use = lambda *names: {("shop.Use", n) for n in names}
    # Through receivers, parameters, literals, declarations, results, assertions, promotion, fields and package variables.
    assert use("shop.*base.Close", "shop.Reader.Read", "shop.base.Code", "store.*Buffer.Flush", "shop.File.Read", "shop.NewFile", "store.Size", "shop.helper", "shop.pick", "shop.run", "shop.table", "shop.Amount") <= got
    assert ("shop_test.TestUse", "shop.NewFile") in got and ("shop.Half", "shop.helper") in got
    lits = {(f, t) for f, t in got if "init$var" in f or "$lit@" in f}
    assert {(f.split("@")[0], t) for f, t in lits} == {("shop.init$var:shared", "store.New"), ("shop.init$var:shared", "shop.helper"), ("shop.shared$lit", "shop.helper")}
    assert any(f.startswith("shop.shared$lit@shop.go:") for f, _ in lits)


def test_unresolved_calls_say_what_they_call(index):
    got = {r.expr for r in index.unresolved_calls.where("endswith(from_fqname, '.Use')").collect()}
    assert got == {"return-value-of(pick)", "unknown.Call"}


def test_values_passed_on(index):
    got = {(short(r.from_fqname), short(r.to_fqname)) for r in index.calls.where("kind = 'ref'").collect()}
    assert got == {("shop.Use", "shop.helper"), ("shop.pick", "shop.helper")}


def test_type_references(index):
    got = {(short(r.from_fqname), short(r.to_fqname), r.ref_kind) for r in index.type_refs.collect()}
    use = lambda kind, *names: {("shop.Use", n, kind) for n in names}
    assert use("type_switch", "shop.File", "store.Buffer", "shop.Reader") | use("conversion", "shop.Amount") | use("type_assert", "store.Buffer") | use("composite_lit", "shop.File", "store.Buffer") <= got
    assert {(f, t) for f, t, k in got if k == "field_access"} == {("shop.Use", "shop.File"), ("shop.*base.Close", "shop.base"), ("shop.base.Code", "shop.base"), ("shop.*Box.Get", "shop.Box")}
    assert {(f, t) for f, t, k in got if k == "embed"} == {("shop.File", "shop.base"), ("shop.File", "store.Buffer"), ("shop.Oops", "shop.base")}
    places = {(r.expr, r.line) for r in index.type_refs.where("ref_kind = 'field_access' AND endswith(from_fqname, '.Use')").collect()}
    at = [k for k, x in enumerate(SHOP.split("\n"), 1) if "f.name" in x]
    assert {("name", k) for k in at} <= places and ("base", SHOP[: SHOP.index("x.base")].count("\n") + 1) in places


def test_satisfaction(index):
    got = {(short(r.iface_fqname), short(r.impl_fqname), r.is_pointer) for r in index.implements.collect()}
    # By signature, closed over embedding on both sides, pointers only where needed, type parameters by place.
    assert got == {
        ("shop.Reader", "shop.File", False), ("shop.Closer", "shop.File", True), ("shop.ReadCloser", "shop.File", True), ("shop.Closer", "shop.base", True), ("shop.Closer", "shop.Wrong", False),
        ("shop.Closer", "shop.Oops", True), ("shop.Failing", "shop.Oops", False), ("shop.Getter", "shop.Box", True),
    }
    methods = {(short(r.iface_fqname), r.method_name) for r in index.iface_methods.collect()}
    assert {("shop.ReadCloser", "Read"), ("shop.ReadCloser", "Close"), ("shop.Failing", "Error"), ("shop.Failing", "Code"), ("shop.Outside", "Close")} <= methods
    assert {short(r.impl_fqname) for r in index.impl_methods.collect()} == {"shop.File.Read", "shop.*base.Close", "shop.Wrong.Close", "shop.base.Code", "shop.Oops.Error", "shop.*Box.Get"}
    assert [short(r.impl_fqname) for r in satisfy.implementors(index, iface=f"{P}.ReadCloser").collect()] == ["shop.File"]


def test_dead(index):
    dead = {short(r.fqname) for r in graph.dead_symbols(index, include_exported=True).collect()}
    assert "shop.Wrong.Read" in dead and "shop.IntBox.Get" in dead
    assert not dead & {"shop.*base.Close", "shop.base.Code", "shop.File.Read", "shop.helper", "shop.pick", "store.*Buffer.Flush"}


def test_canonical_signatures():
    rows = gosource.parse("a.go", "package a\nimport b \"x/y\"\nfunc f(p, q int, r ...b.T) (s string, err error) {}\nfunc g(int, int, ...b.T) (string, error) {}\nfunc h[K comparable, V any](m map[K][]V, f func(x byte) any) chan<- V {}\nfunc (l *L[E]) i(E, [3]E, List[E]) {}\n", "a")
    got = {f[3]: f[11] for f in rows if f[0] == "symbol"}
    assert got == {"f": "(int,int,...x/y.T)(string,error)", "g": "(int,int,...x/y.T)(string,error)", "h": "(map[$0][]$1,func(uint8)(interface{}))(chan<-$1)", "i": "($0,[3]$0,a.List[$0])()"}


def test_deeply_nested_calls():
    n = 2_000
    rows = gosource.parse("a.go", "package p\nfunc f() { x := " + "g(" * n + ")" * n + "\n}\nfunc h() {" + "{" * n + "}" * n + "}\n", "p")
    assert sum(f[0] == "call" for f in rows) == n and {f[3] for f in rows if f[0] == "symbol"} == {"f", "h"}


def test_warnings(spark):
    rows = gosource.parse("a.go", "func f() { g(")
    assert {f[3] for f in rows if f[0] == "error"} == {"no package clause", "a bracket isn't closed"} and ("call", "g") in {(f[0], f[3]) for f in rows}
    for text in ("", "package p; func", "package p\nvar (", "package p\ntype T struct {", "package p\nfunc (r", "package p\nfunc f() { x := ", "package p\ntype I interface { A | B }\ntype", "}}}]])", "package p\nfunc f[T", "package p\nvar x = func(", 'package p\nimport "'):
        assert gosource.parse("b.go", text, "p") is not None
