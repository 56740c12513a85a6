"""Extraction: names, scopes, lines, kinds, call texts and their order."""

import pytest

from lodestone.sources import extract as ex
from lodestone.sources.extract import c, extract_file, go, rust


def calls(found, k=0):
    return [x.raw for x in found.functions[k].calls]


def test_go_functions_methods_and_types():
    text = """package net

type Pool struct {
\tsize int
}
type (
\tSource interface{ Next() int }
\tCode int
\tSame = int
)

func init() { boot() }

func (p *Pool) Take(n int) (int, error) {
\treturn p.size, nil
}

func free(p Pool) {}

func (s Set[K]) Has() bool { return true }
"""
    f = extract_file(text, "./internal/net/pool.go", "go")
    assert [(x.qualified_name, x.receiver, x.scope, x.line_start, x.line_end) for x in f.functions] == [
        ("internal/net.init@pool", None, "internal", 12, 12),
        ("internal/net.Pool.Take", "Pool", "public", 14, 16),
        ("internal/net.free", None, "internal", 18, 18),
        ("internal/net.Set[K].Has", "Set[K]", "public", 20, 20),
    ]
    assert f.functions[1].signature == "func Take(n int) (int, error)"
    assert [(x.name, x.kind, x.line_start, x.line_end) for x in f.types] == [("Pool", "struct", 3, 5), ("Source", "interface", 7, 7), ("Code", "typedef", 8, 8)]
    assert f.variables == []


def test_go_calls_in_order():
    text = """package a
func F() {
\tdefer func() { c.close() }()
\tx := []byte(str(b))
\ta.b(c.d).e(f(1))
\tfor i := range g() { h[i](fmt.Sprintf("q(%d)", i)) }
\treturn P{q: r()}.Run(), x.(T).M(), make([]int, 2)
}
"""
    f = extract_file(text, "a.go", "go")
    assert calls(f) == ["func() { c.close() }", "c.close", "str", "a.b(c.d).e", "a.b", "f", "g", "h[i]", "fmt.Sprintf", "P{q: r()}.Run", "r", "x.(T).M", "make"]
    assert [x.line for x in f.functions[0].calls][:3] == [3, 3, 4]


def test_go_prefixes():
    assert go.path_prefix("./main.go") == "main"
    assert go.path_prefix("./cmd/x/main.go") == "cmd/x"
    assert extract_file("package main\nfunc main() {}", "./main.go", "go").functions[0].qualified_name == "main.main"


def test_rust_items():
    text = """
/// A pool.
#[derive(Debug)]
pub struct Pool<T> { a: T }
enum Mode { On, Off(i32) }
pub trait Shape { fn area(&self) -> f64 { self.base() } }
impl<T: Fn(i32) -> i32> Pool<T> where T: Clone {
    pub fn new(x: &'static str) -> Result<Self, Error> where T: Send {
        Self { a: make(x)? }
    }
    fn hidden(&self) {}
}
impl Shape for &mut Pool<u8> { fn area(&self) -> f64 { self.w.mul(2.0) } }
mod inner { pub(crate) fn deep() {} }
mod other;
"""
    f = extract_file(text, "./src/geo/mod.rs", "rust")
    assert [(x.qualified_name, x.receiver, x.scope) for x in f.functions] == [
        ("geo::Pool<T>::new", "Pool<T>", "public"),
        ("geo::Pool<T>::hidden", "Pool<T>", "internal"),
        ("geo::Pool<u8>::area", "Pool<u8>", "internal"),
        ("geo::inner::deep", None, "public"),
    ]
    assert f.functions[0].signature == "fn new(x: &'static str) -> Result<Self, Error>"
    assert [(x.name, x.kind) for x in f.types] == [("Pool", "struct"), ("Mode", "enum"), ("Shape", "interface")]
    assert f.types[0].line_start == 4


def test_rust_calls_leave_out_macros_and_patterns():
    text = """
fn f() {
    println!("{}", gone());
    let Some(y) = get(x) else { return fail() };
    match look(y)? {
        Some(z) if ok(z) => Ok(wrap(z)),
        Kind::A(q) => { go(q); }
        _ => v.iter().map(|c| conv(c)).collect::<Vec<_>>(),
    }
    /* a /* nested( */ comment( */
    let s = r#"raw(")"#; let c = '('; run::<u8>(s)
}
"""
    f = extract_file(text, "src/lib.rs", "rust")
    assert f.functions[0].qualified_name == "f"
    assert calls(f) == ["get", "fail", "look", "ok", "Ok", "wrap", "go", "v.iter().map(|c| conv(c)).collect::<Vec<_>>", "v.iter().map", "v.iter", "conv", "run::<u8>"]


@pytest.mark.parametrize(
    ("path", "module"), [("src/lib.rs", ""), ("./src/main.rs", ""), ("src/a/b.rs", "a::b"), ("src/a/mod.rs", "a"), ("x/y.rs", "x::y"), ("./src/z.rs", "z")]
)
def test_rust_modules(path, module):
    assert rust.module_path(path) == module


def test_c_definitions():
    text = """#include <x.h>
#ifndef GUARD
#define CALL(x) gone(x)
struct node {
  int v;
};
#endif
static int table[10] = {1};
unsigned int skipped;
int a = 1, b = 2;
static const struct ops *o;
extern int nope;
int proto(int x);
typedef A B;
typedef struct node node_t;
typedef int *ip;
enum color { RED };
static inline int add(int a, const char *b)
{
  return a;
}
char *name_of(struct node *n) { return n->name; }
extern "C" { int inside(void) { return 1; } }
"""
    f = extract_file(text, "./lib/x.c", "c")
    assert [(x.qualified_name, x.signature, x.scope, x.line_start, x.line_end) for x in f.functions] == [
        ("lib/x.add", "int add(int a, const char *b)", "internal", 18, 21),
        ("lib/x.name_of", "char *name_of(struct node *n)", "public", 22, 22),
    ]
    assert [(x.name, x.kind, x.line_start, x.line_end) for x in f.types] == [("node", "struct", 4, 6), ("A", "typedef", 14, 14), ("node_t", "typedef", 15, 15), ("color", "enum", 17, 17)]
    assert [(x.name, x.type_name, x.scope) for x in f.variables] == [("table", "int", "static"), ("b", "int", "public"), ("o", "const struct ops", "static")]


def test_c_calls():
    text = """void f(void) {
  if (ok(a)) return sizeof(int) + (int)calc(b);
  p->f(x); (*fp)(y); obj.m(g(1), h(2));
  for (i = 0; i < n(); i++) { pr_err("x(%d)", z()); } // gone()
}"""
    assert calls(extract_file(text, "x.c", "c")) == ["ok", "calc", "p->f", "(*fp)", "obj.m", "g", "h", "n", "pr_err", "z"]
    assert c.path_prefix("./a/b.h") == c.path_prefix("a/b.c") == "a/b"


@pytest.mark.parametrize("lang", ["go", "rust", "c"])
@pytest.mark.parametrize("text", ["", "\n", "}{)(", "func (", "fn x", "int f(", "struct {", '"', "/*", "impl", "type (", "a(b(c(d", "fn f() { match x { A("])
def test_broken_files_give_what_they_have(lang, text):
    extract_file(text, "a." + lang, lang)


def test_relations(spark):
    rows = [("./a.go", "go", "package a\nfunc F() { g(); g() }\ntype T int\n"), ("./b.c", "c", "int x;\n"), ("./c.zz", "zz", "?")]
    found = ex.extract(spark.createDataFrame(rows, "path string, lang string, text string"))
    assert [(r.caller, r.ordinal, r.raw, r.line, r.target) for r in ex.call_sites(found).orderBy("ordinal").collect()] == [
        ("a.F", 0, "g", 2, "[unresolved]"),
        ("a.F", 1, "g", 2, "[unresolved]"),
    ]
    assert [r.name for r in ex.types(found).collect()] == ["T"]
    assert [r.qualified_name for r in ex.variables(found).collect()] == ["b.x"]
    assert [r.path for r in ex.rejects(found).collect()] == ["./c.zz"]
