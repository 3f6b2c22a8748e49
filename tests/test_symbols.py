"""Needles, definitions and types on small files."""

import random

import pytest
from pyspark.sql import functions as F

from archlens.operators import blocks, needles, symbols

RUST = """use crate::other;
/// doc
#[derive(Debug, Clone)]
pub struct Thing<'a> {
    pub name: String,
    map: HashMap<K, V>, // not: this
    #[serde(skip)]
    pub(crate) n: u8,
}
enum Kind { A, B(u8) }
impl Thing { fn go(&mut self, x: u8) -> u8 { if x > 1 && self.n > 2 { self.stop(x); } self.name.len(); Other::make(x) }
    fn stop(&self) { helper(self.n) }
    fn make() -> Self { x }
}
impl<T> Show for Gen<T> { fn a(&self) { } }
impl Show for Kind { fn b(self) { match self { A => 1, } } }
const MAX: u8 = 3;
static mut COUNT: u8 = 0;
type Id = u8;
pub const fn five() -> u8 { 5 }
mod tests;
"""


def files_of(spark):
    rows = [("src/a.rs", RUST), ("src/lib.rs", "mod other;"), ("src/c.py", "class A:\n    def f(self): pass\n"), ("src/n.rs", None), ("src/e.rs", ""), ("src/w.ts", "export class W { }\nfunction go() { }")]
    return spark.createDataFrame(rows, "path string, content string")


def test_definitions(spark):
    found = sorted((r["path"], r["row"], r["name"], r["kind"]) for r in symbols.definitions(files_of(spark)).collect())
    own = [(4, "Thing", "struct"), (10, "Kind", "enum"), (11, "Thing", "impl"), (11, "go", "function"), (12, "stop", "function"), (13, "make", "function"), (15, "a", "function"), (16, "Kind", "impl"), (16, "b", "function"), (17, "MAX", "constant"), (18, "COUNT", "constant"), (19, "Id", "type"), (20, "five", "function"), (21, "tests", "module")]
    assert found == sorted([("src/a.rs", *x) for x in own] + [("src/c.py", 1, "A", "class"), ("src/c.py", 2, "f", "function"), ("src/lib.rs", 1, "other", "module"), ("src/w.ts", 1, "W", "class"), ("src/w.ts", 2, "go", "function")])
    edges = symbols.symbol_graph(files_of(spark)).collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in edges] == [("src/a.rs", "src/lib.rs", 1)]


def test_types(spark):
    scopes, fields, methods = symbols.types(files_of(spark))
    assert sorted((r["scope"], r["row"], r["is_enum"], r["derives"]) for r in scopes.collect()) == [("Kind", 10, True, []), ("Thing", 4, False, ["Debug", "Clone"])]
    assert sorted((r["scope"], r["name"], r["is_public"]) for r in fields.collect()) == [("Thing", "map", False), ("Thing", "n", True), ("Thing", "name", True)]
    told = {(r["scope"], r["name"]): (sorted(r["field_access"]), sorted(r["internal_calls"]), sorted(r["external_calls"]), r["cognitive"], r["is_mutable"]) for r in methods.collect()}
    assert told == {("Thing", "go"): (["n", "name", "stop"], ["name.len", "stop"], ["Other::make"], 2, True), ("Thing", "stop"): (["n"], [], ["helper"], 0, False), ("Kind", "b"): ([], [], [], 2, False)}


def test_needles_against_one_by_one(spark):
    rng = random.Random(2)
    words = ["ab", "abc", "bc", "b", "ca", "é", "xyz", "a b"]
    texts = ["".join(rng.choices("abcxyzé \n", k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "\n\nABC"]
    df = spark.createDataFrame([(f"f{k}.rs", t) for k, t in enumerate(texts)], "path string, content string")
    got = {(r["path"], r["row"], r["needle"]) for r in needles.needle_lines(df, words).collect()}
    assert got == {(f"f{k}.rs", i + 1, w) for k, t in enumerate(texts) for i, line in enumerate((t or "").lower().split("\n")) for w in words if w in line}


@pytest.mark.parametrize("bad", [["a", "a"], [""], ["a\nb"]])
def test_needles_that_are_refused(spark, bad):
    with pytest.raises(ValueError):
        needles.needle_lines(spark.createDataFrame([("a", "b")], "path string, content string"), bad)


def test_no_needles(spark):
    df = spark.createDataFrame([("a", "b")], "path string, content string")
    assert needles.hits(df, F.col("content"), []).first()["hits"] == []


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_duplicate_arms(spark):
    same = "fn f() {\n let x = 1;\n match k { A => go(1, [2, 3]), B => go(1, [2, 3]), C => { x } D => { x } _ => _ }\n}"
    parted = "fn f() { match k { A(x) => go(x), B(y) => go(x), } }"
    slots = "fn f() { match k { (A(x), B(y)) => go(x), (A(x), C(y)) => go(x), } }"
    mixed = "fn f() { match k { A(x) => go(x), A(y) => go(x), C(z) => go(x) } }"
    inner = "fn f() { match k { A => match n { 1 => 2, _ => 2 }, B => { match n { 1 => 3 } } } }"
    df = spark.createDataFrame([(f"{k}.rs", t) for k, t in enumerate((same, parted, slots, mixed, inner, None, "match"))], "path string, content string")
    assert rows_of(blocks.duplicate_arms(df), "path", "row") == [("0.rs", 3), ("0.rs", 3), ("3.rs", 1), ("4.rs", 1)]


def test_unchecked_commands(spark):
    texts = [
        "fn f(bash: &str) {\n Command::new(bash);\n}", "fn f(p: &str) { std::process::Command::new(p); }", "fn f(my_git: &str) { Command::new(my_git); Command::new(\"ls\"); }",
        "const P: &str = x;\nfn f() { Command::new(P); }", "fn read_it(p: &str) { Command::new(p); }", "fn f(p: &str) { match p { \"a\" => Command::new(p), _ => stop() } }", "Command::new(p);",
    ]
    found = blocks.unchecked_commands(spark.createDataFrame([(f"{k}.rs", t) for k, t in enumerate(texts)], "path string, content string"))
    assert rows_of(found, "path", "row", "confidence") == [("0.rs", 2, "High"), ("1.rs", 1, "Medium"), ("6.rs", 1, "Medium")]
