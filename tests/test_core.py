"""Goldens of the core operators, and every query against its SQL on the smallest tables."""

import json
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from archlens import config, registry
from archlens.functions import docs
from archlens.functions import tables as T
from archlens.functions import text as X
from archlens.operators import cohesion, graph, imports, locality, report, rules, taxonomy
from archlens.sources import corpus
from archlens.streaming import events

SMALL = "/root/testdata/sf0.001"


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_coupling_and_identity(spark):
    rows = {r.path: r for r in locality.coupling(edges(spark, [(a, "hub.rs") for a in "abc"] + [("hub.rs", "types.rs")])).collect()}
    assert (rows["hub.rs"].ca, rows["hub.rs"].ce) == (3, 1) and rows["hub.rs"].skew > 0 > rows["a"].skew and rows["a"].instability == 1
    kinds = spark.createDataFrame([(50, 2), (1, 12), (25, 25), (0, 1), (2, 2)], "ca int, ce int").select(locality.identity(F.col("ca"), F.col("ce"))).collect()
    assert [r[0] for r in kinds] == ["StableHub", "VolatileLeaf", "GodModule", "IsolatedDeadwood", "Standard"]


def test_distance(spark):
    pairs = [("src/apply/parser.rs", "src/apply/types.rs"), ("src/tui/view.rs", "src/apply/parser.rs"), ("src/tui/dashboard/widgets/sidebar.rs", "src/apply/patch/v1/context.rs"), ("a", "a")]
    got = edges(spark, pairs).select(locality.distance(F.col("src"), F.col("dst")), locality.common_ancestor(F.col("src"), F.col("dst"))).collect()
    assert [tuple(r) for r in got] == [(2, "src/apply"), (4, "src"), (8, "src"), (0, "a")]


def test_verdicts(spark):
    pairs = [("src/tui/view.rs", "src/apply/types.rs"), ("src/a/deep/one.rs", "src/b/deep/two.rs"), ("src/main.rs", "src/b/deep/far/x.rs"), ("src/b/mod.rs", "src/b/deep/y.rs"), ("src/c/d/e.rs", "src/util.rs")]
    got = {(r.src, r.dst): r.reason for r in locality.judged(edges(spark, pairs)).collect()}
    assert list(got.values()).count(None) == 1 and got[pairs[0]] == "WithinDistance" and got[pairs[1]] is None and got[pairs[2]] == got[pairs[3]] == got[pairs[4]] == "Exempted"
    hub = [(f"src/m{i}/deep/a.rs", "src/shared/deep/x.rs") for i in range(5)]
    assert locality.judged(edges(spark, hub)).where("NOT passed").count() == 0
    layer = spark.createDataFrame([("p/a.rs", 0), ("q/b.rs", 2)], "path string, layer int")
    failed = locality.judged(edges(spark, [("p/a.rs", "q/b.rs")]), config.LocalityConfig(max_distance=2, l1_threshold=1)).where("NOT passed")
    assert locality.categorised(failed, layer).first().category == "UPWARD_DEP"


@pytest.mark.parametrize("pairs, cyclic", [
    ([("a", "b"), ("b", "c")], 0), ([("a", "b"), ("b", "a")], 2), ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], 0), ([("a", "a")], 1),
    ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], 3), ([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], 4), ([], 0),
])
def test_cycles(spark, pairs, cyclic):
    assert graph.cyclic_core(edges(spark, pairs)).count() == cyclic


def test_layers(spark):
    got = {r.path: r.layer for r in graph.layers(edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "c"), ("x", "y"), ("y", "x")])).collect()}
    assert (got["c"], got["b"], got["a"]) == (0, 1, 2) and got["x"] == got["y"] > 2


def test_layers_leave_no_tables_of_past_rounds(spark, monkeypatch):
    chain = edges(spark, [(f"n{k}", f"n{k + 1}") for k in range(6)])
    graph.checkpointed(chain)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    kept = lambda: {x for place in (folder, folder / "tables") if place.exists() for x in place.iterdir() if x.name != "tables"}
    before = kept()
    got = {r.path: r.layer for r in graph.layers(chain).collect()}
    assert got == {f"n{k}": 6 - k for k in range(7)} and len(kept() - before) <= 7 + 3  # a table of each layer, names, and the last round's
    monkeypatch.setattr(graph, "_numbers", lambda names: F.col)  # where two paths share a hash
    assert {r.path: r.layer for r in graph.layers(chain).collect()} == got


def test_pagerank(spark):
    rank = lambda pairs, anchor=None: {r.path: r["rank"] for r in graph.pagerank(edges(spark, pairs).withColumn("weight", F.lit(1)), anchor).collect()}
    two = rank([("a", "b")])
    assert two["b"] > two["a"] and sum(two.values()) == pytest.approx(1)
    assert all(v == pytest.approx(1 / 3, abs=1e-3) for v in rank([("a", "b"), ("b", "c"), ("c", "a")]).values())
    assert rank([("a", "b")], "a")["a"] > 0.3


def test_symbol_edges_and_neighbours(spark):
    defs = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "g")], "path string, name string")
    refs = spark.createDataFrame([("c", "x::f"), ("c", "g"), ("a", "g"), ("c", "g")], "path string, name string")
    found = graph.symbol_edges(defs, refs)
    assert {(r.src, r.dst): r.weight for r in found.collect()} == {("c", "a"): 2, ("c", "b"): 1, ("a", "b"): 1}
    assert {r.path for r in graph.neighbours(found, "a").collect()} == {"b", "c"} and [r.path for r in graph.hubs(found, 2).collect()] == ["b"]


def test_identifiers(spark):
    names = ["parseHTTPResponseBody", "render_user_profile_card", "XMLHttpRequest", "aB", "ABc", "x", "", "getURL2Path"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(X.split_identifier(F.col("name")), X.expand_identifier(F.col("name"))).collect()
    assert [r[0] for r in rows] == [["parse", "http", "response", "body"], ["render", "user", "profile", "card"], ["xml", "http", "request"], ["a", "b"], ["a", "bc"], ["x"], [], ["get", "url2path"]]
    assert rows[0][1] == "Parses http response body." and rows[1][1] == "Formats user profile card for output."


def test_file_kinds(spark):
    names = ["main.rs", "index.html", "package.json", "a.toml", "app.min.js", "README.md", "Cargo.lock", ".env", "x/y.bundle.ts"]
    got = spark.createDataFrame([(n,) for n in names], "path string").select(corpus.file_kind(F.col("path"))).collect()
    assert [r[0] for r in got] == ["SourceCode", "Asset", "Config", "Config", "Asset", "Other", "Other", "Other", "Asset"]


def test_discovery(spark, tmp_path):
    for name, data in {"src/a.rs": b"fn a() {}", "node_modules/b.js": b"x", "run": b"#!/bin/sh", "note": b"hello", "k.pem": b"x", "bad.py": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = corpus.discover(corpus.read_files(spark, str(tmp_path)))
    assert {(r.path, r.content is None) for r in found.collect()} == {("src/a.rs", False), ("run", False), ("bad.py", True)}
    assert corpus.project_type(files(spark, [("go.mod", ""), ("package.json", "")])).first()[0] == "node"


def test_config():
    got = config.parse_config("[rules]\nmax_cbo = 3\nmax_cyclomatic_complexity = 7\n[rules.locality]\nmax_distance = 9\n", "# c\n^x/\n[bad\n")
    assert (got.rules.max_cbo, got.rules.max_cognitive_complexity, got.locality.max_distance, got.exclude) == (3, 7, 9, ("^x/",))
    assert config.parse_config("not toml [").rules == config.RuleConfig()
    assert corpus.tsconfig_paths('{ // c\n "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*"]} /* d */ } }') == ("src", {"@/*": ["./*"]})


def test_length_boundary(spark):
    rows = [("rust", "idx <= values.len()"), ("rust", "idx >= values.len()"), ("rust", "values.len() >= i"), ("python", "5 <= len(x)"), ("rust", "a < b.len()"), ("go", "k <= len(xs)"), (None, "i <= x.len()")]
    got = spark.createDataFrame(rows, "lang string, line string").select(X.length_boundary(F.col("lang"), F.col("line"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, True, False]


def test_rules(spark):
    source = "async fn f() {\n let g = m.lock().unwrap();\n go().await;\n drop(g);\n go().await;\n}\n// SAFETY: fine\nunsafe { a() }\nunsafe { b() }\nstatic mut X: u8 = 0;\nlet token = \"abcdef\";\nfn is_ok() -> u8 {}"
    got = {(r.law, r.row) for r in rules.check(files(spark, [("src/a.rs", source), ("src/a.toml", source)])).collect()}
    assert got == {("C03", 3), ("LAW OF PARANOIA", 9), ("S01", 9), ("X03", 11), ("M04", 12)}
    assert rules.atomicity(files(spark, [("a.py", "x " * 2001), ("b.py", "x " * 2000), ("c.rs", "#![no_std] " + "x " * 2001)])).select("path").collect() == [("a.py",)]
    assert rules.scan(files(spark, [])).count() == 0 and rules.scan(files(spark, [(None, None), ("a.rs", None), ("b.rs", "")])).count() == 0


def test_imports(spark):
    rows = [("src/a.rs", "use crate::config::{x, Y};\nuse crate::{alpha, Beta, gamma::z};\nmod tests;\nuse super::up;"), ("p/b.py", "from .c import d\nimport os"), ("p/c.py", ""), ("w/x.ts", "import a from './y'\nrequire(\"node:fs\")"), ("w/y.tsx", ""), ("src/config.rs", "")]
    found = imports.imports(files(spark, rows))
    assert {r["import"] for r in found.where("path = 'src/a.rs'").collect()} == {"alpha", "config", "gamma", "tests", "up"}
    assert {(r.src, r.dst) for r in imports.resolved(found, files(spark, rows)).collect()} == {("src/a.rs", "src/config.rs"), ("p/b.py", "p/c.py"), ("w/x.ts", "w/y.tsx")}


def test_cohesion(spark):
    scopes = spark.createDataFrame([("a.rs", "C", 1, False, ["Debug"])], "path string, scope string, row int, is_enum boolean, derives array<string>")
    fields = spark.createDataFrame([("a.rs", "C", f, f in "abc") for f in "abcd"], "path string, scope string, name string, is_public boolean")
    spec = [("m1", ["a"], []), ("m2", ["b"], []), ("m3", ["c"], ["m1"]), ("m4", ["d"], []), ("m5", ["d"], ["nothing"])]
    rows = [("a.rs", "C", n, u, calls, [f"x{k}" for k in range(8)], 1, False) for n, u, calls in spec]
    methods = spark.createDataFrame(rows, "path string, scope string, name string, field_access array<string>, internal_calls array<string>, external_calls array<string>, cognitive int, is_mutable boolean")
    metrics = cohesion.inspected(scopes, fields, methods)
    assert (metrics.first().lcom4, metrics.first().cbo, metrics.first().sfout, metrics.first().ahf) == (3, 8, 8, 25.0)
    assert {r.law for r in cohesion.violations(metrics).collect()} == {"LCOM4", "AHF", "SFOUT"}


def test_cohesion_of_ties_and_unknown_names(spark):
    """Shares halfway between two decimals go to the even one, as in the SQL; unknown fields and names link nothing."""
    told = spark.range(17).select("id", X.one_decimal(F.col("id") / 16 * 100).alias("said"))
    assert {r.id: r.said for r in told.collect()} == {k: "%.1f" % (k / 16 * 100) for k in range(17)}
    spec = [("m1", ["a"]), ("m2", [None, "a"]), ("m3", [None]), (None, ["b"]), ("m5", ["b"])]
    rows = [("a.rs", "C", n, u, ["m1", None], ["x", None], 1, False) for n, u in spec[:1]] + [("a.rs", "C", n, u, [None], ["x", None], 1, False) for n, u in spec[1:]]
    methods = spark.createDataFrame(rows, "path string, scope string, name string, field_access array<string>, internal_calls array<string>, external_calls array<string>, cognitive int, is_mutable boolean")
    got = cohesion.by_scope(methods).first()
    assert (got.lcom4, got.n_methods, got.cbo, got.sfout) == (3, 5, 1, 1)


def test_taxonomy_and_mutations(spark):
    schema = "path string, imports array<string>, annotations array<string>, param_types array<string>, strings array<string>, exports array<string>"
    row = taxonomy.badges(spark.createDataFrame([("a", ["std::fs", "database/sql"], [], [], ["https://api.github.com/x"], ["RegisterPlugin"])], schema)).first()
    assert (row.role, row.domain, row.mechanisms) == ("Registers", "GitHub releases", ["SQL", "file I/O"])
    lines = spark.createDataFrame([("a", 1, "if a == b && c < d or True: x += 1; foo")], "path string, row int, line string")
    assert [(r.col, r.original, r.mutated, r.kind) for r in taxonomy.mutation_points(lines).orderBy("col").collect()] == [(6, "==", "!=", "CMP"), (11, "&&", "||", "LOG"), (16, "<", ">=", "CMP"), (20, "or", "and", "LOG"), (23, "True", "False", "BOOL")]
    empty = taxonomy.mutation_summary(spark.createDataFrame([], "survived boolean")).first()
    assert (empty.total, empty.score) == (0, 100.0)


def test_reports(spark):
    schema = "path string, row int, law string, message string, confidence string"
    found = spark.createDataFrame([("a", 1, "X01", "m", "High"), ("a", 2, "X01", "m", "High"), ("b", 1, "P06", "n", "Medium")], schema)
    own = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "path string, token_count int")
    total = report.totals(own, found)
    row = total.first()
    assert (row.n_files, row.n_tokens, row.n_violations, row.n_high, row.n_medium, row.n_clean_files, row.passed) == (3, 18, 3, 2, 1, 1, False)
    assert [(r.path, r.row, r.k, r.n) for r in report.numbered(found).orderBy("law", "k").collect()] == [("b", 1, 1, 1), ("a", 1, 1, 2), ("a", 2, 2, 2)]
    assert report.one_line(found).orderBy("text").first().text == "a:1: error: [X01] m"
    assert report.file_reports(own, found).where("path = 'c'").first().report == '{"path":"c","token_count":7,"violations":[]}'
    outputs = spark.createDataFrame([("c", "error: x\nwarning: y", "error")], "command string, stdout string, stderr string")
    assert tuple(report.output_counts(outputs).first())[1:] == (2, 1)


def test_event_stream(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").write.parquet(f"{tmp_path}/log")
    stream = events.windowed_counts(events.read_log(spark, f"{tmp_path}/log"))
    running = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    running.processAllAvailable()
    running.stop()
    batch = events.windowed_counts(spark.read.parquet(f"{SMALL}/events.parquet"))
    assert spark.table("counts").count() == batch.count() > 0


def cell(x):
    return float(f"{x:.8g}") if isinstance(x, float) else float(x) if isinstance(x, int) and not isinstance(x, bool) else str(x)


def test_mutation_points_equal_a_scan_by_hand(spark):
    token = re.compile(r"==|!=|<=|>=|&&|\|\||(?<![A-Za-z0-9_])(?:and|or|true|false|True|False)(?![A-Za-z0-9_])|(?<=\s)[<>+\-*/](?=\s)")
    lines = ["if a == b && !c {", "x = y <= 3 or True", "orbit and android", "a -> b - c", "  * p", "true||false", "", "a<b > c", "é == ü"] * 2
    rows = [("f.rs", k, line) for k, line in enumerate(lines, 1)]
    want = {(k, m.start() + 1, m[0], T.MUTATIONS[m[0]][0]) for _, k, line in rows for m in token.finditer(line)}
    got = taxonomy.mutation_points(spark.createDataFrame(rows, "path string, row int, line string")).collect()
    assert {(r.row, r.col, r.original, r.mutated) for r in got} == want and len(got) == len(want)
    shown = report.survivors(spark.createDataFrame([("f", 1, 2, "==", "!=", "CMP", True), ("f", 2, 2, "==", "!=", "CMP", False)], "path string, row int, col int, original string, mutated string, kind string, survived boolean"))
    assert [json.loads(r.mutant) for r in shown.collect()] == [{"path": "f", "row": 1, "col": 2, "original": "==", "mutated": "!=", "kind": "CMP"}]


def test_line_rules_in_odd_dress(spark):
    rows = [("src/a.rs", "let a = v[0];\nself.p[0] = 1;\nself.p[0] = 2;\n"), ("src/b.rs", "if v.is_empty() {}\nlet a = v[0];"), ("src/c.rs", "for x in v.chunks_exact(2) { x[0] }"), ("src/my_test.rs", "x.unwrap()"), ("src/d.py", "x.unwrap()"),
            ("src/e.rs", "impl From<A> for B {\n fn from(a: A) -> B { B(a) }\n}"), ("src/f.rs", "impl From<A> for B {\n // err\n}"), ("src/g.rs", "fn get_x<'a>(&'a mut self) {}\nfn get_y(&mut self) {}\nfn get_z(&self) {}")]
    found = lambda *names: sorted((r.path, r.row, r.law) for r in rules.check(files(spark, rows), *names).collect())
    assert found("index_zero") == [("src/a.rs", 1, "L03"), ("src/a.rs", 2, "L03")]
    assert found("unwraps") == [] and found("manual_conversions") == [("src/e.rs", 1, "I01")]
    assert found("mutating_getters") == [("src/g.rs", 1, "M03"), ("src/g.rs", 2, "M03")]


def test_contexts_docs_and_builds(spark):
    rows = [("src/a.rs", "#[cfg(test)]", True), ("tests/a.rs", "", True), ("x/test_a.py", "", True), ("x/a.py", "import pytest", True), ("a.spec.ts", "", True), ("a.go", "func TestX(t *testing.T)", True), ("src/a.rs", "fn x() {}", False), ("a.txt", "test(", False)]
    got = files(spark, [r[:2] for r in rows]).select(X.is_test_context(X.language(F.col("path")), F.col("path"), F.col("content"), F.array()).alias("t")).collect()
    assert [r.t for r in got] == [r[2] for r in rows]
    said = [("Parses things quickly now", True), ("Layout of the parser. More.", False), ("Value is odd here", True), ("This is a module of x", False), ("A parser of things", True), ("Copyright me and you", True), ("Two words", True), ("Applies all of it", True), ("Notes on e.g", True), ("Rules of the callback kind", True)]
    got = spark.createDataFrame([(t,) for t, _ in said], "t string").select(docs.looks_like_item_doc(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [x for _, x in said]
    texts = [("a.rs", "// c\n\n//! # Title\n//! Body here. Rest\nfn x() {}", "Title Body here."), ("a.rs", "use b;\n//// no\n/// Layout of all parts\n//// skip\n/// and more\nfn x() {}", "Layout of all parts and more."), ("a.rs", "fn x() {}", None),
             ("a.py", "#!x\n\n'''One thing.\nTwo'''", "One thing."), ("a.py", "import a\n'''no'''", None), ("a.ts", "// x\n/* y */\n/**\n * Shows it. All\n * @a b\n */", "Shows it."), ("a.go", "// Package x holds parts of it\npackage x", "Package x holds parts of it.")]
    got = files(spark, [t[:2] for t in texts]).select(docs.module_doc(F.col("path"), F.col("content")).alias("d")).collect()
    assert [r.d for r in got] == [t[2] for t in texts]
    assert [r.build_system for r in corpus.build_systems(files(spark, [("a/go.mod", ""), ("b/x.CMAKE", ""), ("Go.mod", "")])).orderBy("build_system").collect()] == ["CMake", "Go"]
    assert corpus.to_mutate(files(spark, [("src\\a\\b.rs", ""), ("src/c.rs", "")]), "a/").count() == 1 and corpus.to_mutate(files(spark, [("x", "")]), None).count() == 1


def test_aliases_go_and_taxonomy(spark, tmp_path):
    known = [("src/app/x.ts", 'import a from "@lib/y"\nimport b from "~"\nimport c from "deep/z"'), ("src/lib/y/index.tsx", ""), ("home.ts", ""), ("base/deep/z.js", ""), ("lib/w.ts", "")]
    own = files(spark, known)
    got = imports.resolved(imports.imports(own), own, imports.aliased(imports.imports(own), {"@lib/*": ["lib/*", "./src/lib/*"], "~": ["home"]}, "base")).collect()
    assert {(r["import"], r.dst) for r in got} == {("@lib/y", "src/lib/y/index.tsx"), ("~", "home.ts"), ("deep/z", "base/deep/z.js")}
    go = files(spark, [("a/x.go", 'package a\nimport (\n"m.org/p/b"\n)'), ("b/y.go", "package b"), ("b/y_test.go", "package b"), ("a/x_test.go", 'package a_test\nimport "m.org/p/b"')])
    assert {(r.src, r.dst) for r in imports.go_edges(imports.imports(go), go, "m.org/p").collect()} == {("a/x.go", "b/y.go"), ("a/x_test.go", "b/y.go"), ("a/x_test.go", "b/y_test.go")}
    assert taxonomy.taxonomy_of("role: [") == taxonomy.taxonomy_of("") == taxonomy.Taxonomy()
    mine = taxonomy.taxonomy_of('{"mechanism": [{"badge": "A", "import_prefix": "a"}, {"badge": "B", "import_prefix": "b"}], "domain": [{"badge": "bad", "string_pattern": "("}]}')
    assert [m[0] for m in mine.mechanisms[:2]] == ["B", "A"] and mine.domains == taxonomy.T.DOMAINS
    report.append_log(spark.createDataFrame([(1, "x")], "a int, b string"), f"{tmp_path}/log")
    report.append_log(spark.createDataFrame([(2, None)], "a int, b string"), f"{tmp_path}/log")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/log").collect()) == ['{"a":1,"b":"x"}', '{"a":2}']
    kept = report.maximal(spark.createDataFrame([("p", 0, 9), ("p", 0, 9), ("p", 2, 5), ("p", 3, 12), ("q", 2, 5)], "path string, low int, high int")).collect()
    assert sorted(tuple(r) for r in kept) == [("p", 0, 9), ("p", 3, 12), ("q", 2, 5)]


def test_graph_inputs_hold_all_rows(spark):
    from archlens.plans import inputs

    con = duckdb.connect()
    one = lambda text: con.execute(text.replace("lineitem", f"'{SMALL}/lineitem.parquet'").replace("orders", f"'{SMALL}/orders.parquet'")).fetchone()[0]
    trade, n = inputs.derived(spark, SMALL, inputs.TRADE), one("SELECT count(*) FROM lineitem")
    assert trade.where("src LIKE 'c%'").agg(F.sum("weight")).first()[0] == n
    assert trade.where("src LIKE 'c%'").select("src").distinct().count() == one("SELECT count(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    pairs = one("SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
    assert inputs.derived(spark, SMALL, inputs.EDGES).where("src LIKE 'src/part/%'").count() == inputs.derived(spark, SMALL, inputs.DEFS).count() == pairs
    assert inputs.derived(spark, SMALL, inputs.REFS).count() == n
    core = graph.cyclic_core(trade)
    assert 0 < core.count() < trade.count() and core.where("dst LIKE 'nation%'").isEmpty()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    table = lambda df: sorted([tuple(cell(x) for x in row) for row in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)], key=repr)
    assert table(got) == table(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
