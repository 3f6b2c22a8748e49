"""Blocks, containment and cycles on small inputs with known answers."""

import random

import pytest

from archlens.operators import blocks, cycles
from archlens.operators.ranges import within


def files_of(spark, *texts, end=".rs"):
    return spark.createDataFrame([(f"src/f{k}{end}", t) for k, t in enumerate(texts)], "path string, content string")


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_cognitive_goldens(spark):
    bodies = ["", "if a { }", "if a { if b { } }", "if a { } else if b { }", "if a && b { }"]
    found = blocks.measured(files_of(spark, *[f"fn f() {{ {b} }}" for b in bodies]))
    assert rows_of(found, "path", "cognitive") == [(f"src/f{k}.rs", n) for k, n in enumerate((0, 1, 3, 2, 2))]


def test_signs_in_strings_and_comments_are_none(spark):
    text = 'fn f<\'a>(x: &\'a str) {\n  let s = "{ if \\" { }}";\n  // } for\n  /* } \n while { */ let c = \'{\'; let r = r#"} "{"#;\n  loop { }\n}\nfn g() { }'
    found = blocks.measured(files_of(spark, text))
    assert rows_of(found, "name", "row", "end_row", "depth", "deepest_row", "cognitive") == [("f", 1, 7, 1, 6, 1), ("g", 8, 8, 0, 8, 0)]


def test_closures_and_inner_functions_start_anew_but_count_for_the_outer(spark):
    text = "fn f() {\n if a {\n  xs.each(|x| { if x { } });\n  fn g() { if b { } }\n }\n}"
    found = blocks.measured(files_of(spark, text))
    assert rows_of(found, "name", "depth", "deepest_row", "cognitive") == [("f", 2, 3, 3), ("g", 1, 4, 1)]


def test_odd_files(spark):
    texts = ["", None, "}}} fn f() { if a {", "fn f() { } }", "{" * 3000 + "}" * 3000, "fn f() {" + "if a { b; } " * 3000 + "}"]
    found = blocks.measured(files_of(spark, *texts))
    assert rows_of(found, "path", "depth", "cognitive") == [("src/f3.rs", 0, 0), ("src/f5.rs", 1, 3000)]
    assert rows_of(blocks.skeletons(files_of(spark, *texts)), "path")[0] == ("src/f0.rs",)
    assert blocks.measured(files_of(spark)).count() == 0
    assert blocks.measured(files_of(spark, "def f():\n    if a: pass", end=".py")).count() == 0


def test_conversions_know_each_loop_variable(spark):
    text = "fn f() {\n for x in xs {\n  x.to_string();\n  y.to_owned();\n  for y in x.ys {\n   y.to_string();\n  }\n }\n z.to_string();\n}"
    found = blocks.loop_conversions(files_of(spark, text))
    assert rows_of(found, "row") == [(4,), (6,)]  # y of row 6 is the inner loop's own, but converted within the outer one too
    assert rows_of(blocks.nested_loops(files_of(spark, text)), "row", "confidence") == [(5, "Medium")]


def test_writers(spark):
    kept = ["fn f() { let w = BufWriter::new(x); w.flush(); }", "fn f() -> BufWriter<File> { BufWriter::new(x) }", "fn f() { std::io::BufWriter::new(x); }", "let w = BufWriter::new(x);"]
    lost = ["fn f() {\n let w = BufWriter::new(x);\n}", "fn f() { w.flush(); fn g() { BufWriter::new(x); } }"]
    found = blocks.unflushed_writers(files_of(spark, *kept, *lost))
    assert rows_of(found, "path", "row") == [("src/f4.rs", 2), ("src/f5.rs", 1)]


def test_skeletons(spark):
    texts = ["use a;\nfn f() {\n  fn g() { }\n}\nstruct S { x: u8 }\nfn h() {}\n// end", "no functions {", None]
    found = dict(rows_of(blocks.skeletons(files_of(spark, *texts)).where("skeleton IS NOT NULL"), "path", "skeleton"))
    assert found == {"src/f0.rs": "use a;\nfn f() { ... }\nstruct S { x: u8 }\nfn h() { ... }\n// end", "src/f1.rs": texts[1]}


@pytest.mark.parametrize("size", [10, 3000, 10**6])
def test_within_against_all_pairs(spark, size):
    rng = random.Random(size)
    points = [(rng.choice("ab"), k, rng.randrange(size)) for k in range(150)] + [("a", 999, None), (None, 998, 3)]
    ranges = [("a", k, low, low + rng.randrange(-2, size)) for k in range(60) for low in [rng.randrange(size)]] + [("b", 99, 0, size), ("b", 98, None, 5)]
    found = within(spark.createDataFrame(points, "path string, point int, at long"), spark.createDataFrame(ranges, "path string, span int, low long, high long"))
    wanted = {(p, r) for path, p, at in points for key, r, low, high in ranges if path and path == key and None not in (at, low, high) and low < at < high}
    got = [(r["point"], r["span"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_within_joins_by_equality(spark):
    found = within(spark.createDataFrame([("a", 1)], "path string, at long"), spark.createDataFrame([("a", 0, 2)], "path string, low long, high long"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


GRAPHS = {
    "chain": "ab bc", "pair": "ab ba", "diamond": "ab ac bd cd", "self": "aa", "ring": "ab bc ca", "two": "ab ba cd dc", "eight": "ab ba ac ca", "five": "ab bc cd de ea", "one": "ab",
    "chord": "ab bc cd da db", "tail": "xa ab ba by aa",
}
CYCLES = {"chain": 0, "pair": 1, "diamond": 0, "self": 1, "ring": 1, "two": 2, "eight": 2, "five": 1, "one": 0, "chord": 2, "tail": 2}


def test_cycle_goldens(spark):
    edges = [(f"{name}/{e[0]}", f"{name}/{e[1]}") for name, text in GRAPHS.items() for e in text.split()] + [(None, "pair/a"), ("pair/a", None), ("pair/a", "pair/b")]
    found = cycles.dependency_cycles(spark.createDataFrame(edges, "src string, dst string")).collect()
    counts = dict.fromkeys(GRAPHS, 0)
    for r in found:
        counts[r["component"].split("/")[0]] += r["n_cycles"]
    assert counts == CYCLES
    told = {r["component"]: "".join(x[-1] for x in r["witness"]) for r in found}
    assert told == {"pair/a": "aba", "self/a": "aa", "ring/a": "abca", "two/a": "aba", "two/c": "cdc", "eight/a": "aba", "five/a": "abcdea", "chord/a": "abcda", "tail/a": "aa"}


def test_no_edges_no_cycles(spark):
    assert cycles.dependency_cycles(spark.createDataFrame([], "src string, dst string")).count() == 0
