"""Inputs that Spark derives from the given tables: corpora of code-like files, dependency edges and type tables.

Each is one SQL text in the common part of both dialects, so that a query and its oracle start from the same rows; {t}
stands for the table t.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

NL = " || chr(10) || "

_NAME = "replace(p_name, ' ', '_')"
_ID = "CAST(p_partkey AS STRING)"
_CODE = [
    (".rs", ["'use crate::config::{Rules, loader};'", f"'use super::' || {_NAME} || ';'", "'mod ' || lower(p_type) || ';'", f"'pub fn get_' || {_NAME} || '(i: usize) -> u32 {{'", "'    if i <= items.len() {{ items[0] }}'", "'    first.first().unwrap()'", "'}}'"]),
    (".py", ["'from .' || lower(p_type) || ' import helper'", "'import os'", "'def compute_the_total_of_all_the_items_in_one_big_list(x):'", "'for x in items:'", "'    if x in other:'", "'        total = total + 1'", "'while idx <= len(items) and True:'", "'    pass'"]),
    (".ts", [f"'import a from \"./' || {_NAME} || '_' || CAST(p_partkey AS STRING) || '\"'", "'const b = require(\"node:fs\")'", "'for (const x of xs) {{'", "'  if (ys.includes(x)) {{ n += 1 }}'", "'  if (i <= xs.length && true) {{ }}'", "'}}'"]),
    (".rs", [f"'let api_key = \"sk-' || {_ID} || '\";'", f"'let q = format!(\"SELECT * FROM t WHERE id = {{}}\", ' || {_NAME} || ');'", "'// SAFETY: checked'", "'unsafe {{ read(p) }}'", "'let n = 1;'", "'unsafe {{ transmute(p) }}'", f"'pub static counter_{_ID} : u32 = 0;'".replace(_ID, f"' || {_ID} || '")]),
    (".rs", ["'async fn run() {{'", "'    let g = state.lock().unwrap();'", "'    fetch(1).await;'", "'    drop(g);'", "'    fetch(2).await;'", "'}}'", "'    cache: Mutex<Vec<u8>>,'", "'    // guards the map'", "'    map: RwLock<Map>,'", "'static mut N: u32 = 0;'", "'fn is_ready(x: u8) -> u32 {{'"]),
    (".go", ["'package main'", "'import ('", "'  \"net/http\"'", "'  \"os/exec\"'", "')'", "'func main() {{ for i := range xs {{ }} }}'"]),
    (".js", ["'const y = xs.shift();'"]),
    (".toml", ["'[rules]'", "'max = ' || " + _ID]),
]


def _case(values: list[str]) -> str:
    return "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


#: files(path, content)
CODE = (
    f"SELECT 'src/' || lower(p_type) || '/' || {_NAME} || '_' || {_ID} || " + _case([f"'{ext}'" for ext, _ in _CODE])
    + " AS path, " + _case([NL.join(lines) for _, lines in _CODE]).replace("{{", "{").replace("}}", "}") + " AS content FROM {part}"
)

#: Lines of which rules find some, clear others, and meet some in unusual dress; no quotes and backslashes, which the dialects read differently.
_POOL = [
    "let a = items.first().unwrap();", "let b = map.get(k).expect(msg);", "// a.unwrap() in a comment", "let c = x.unwrap_or(0);", "let d = rows[0];", "let e = self.parts[0];", "let f = self.parts[0].len;",
    "let g = v[10];", "let h = y.expected();", "impl From<u8> for Id {", "impl From<ParseError> for Fault {", "impl  From<u16> for Wide {", "impl Into<u8> for Id {", "lazy_static! {", "static ref A: Mutex<Vec<u8>> = make();",
    "static ref B: RwLock<HashMap<u8, u8>> = make();", "static ref C: Mutex<u8> = make();", "}", "fn get_name(&mut self) -> u8 {", "fn get_size(&self) -> u8 {", "fn is_open(mut self) -> bool {", "fn compute_sum(&mut self) {",
    "fn count_all(&self) -> u8 {", "fn sum_up<T>(&mut self, t: T) {", "fn target_get_it(&mut self) {", "fn forget_it(&mut self) {", "let n = items.len();", "for x in v.chunks_exact(4) {", "static mut COUNT: u8 = 0;", "pub static NAME: u8 = 0;",
    "pub static name_of: u8 = 0;", "unsafe { go(p) }", "// SAFETY: p is ours", "fn is_ready(&self) -> u8 {", "fn has_all(&self) -> bool {", "if i <= items.len() {", "while i < items.len() {", "if v.is_empty() { stop(); }", "cache: Mutex<Map>,",
    "// guards the cache", "let z = cache.lock().unwrap();", "work().await;", "drop(z);",
]
_PICK = lambda k: f"split_part({' || chr(10) || '.join(repr(x) for x in _POOL)}, chr(10), CAST((p_partkey * {2 * k + 3} + {k * k * 5}) % {len(_POOL)} + 1 AS INT))"
#: files(path, content) whose lines differ from file to file; some are tests.
MIXED = (
    "SELECT 'src/' || CASE p_partkey % 9 WHEN 4 THEN 'spec_' WHEN 5 THEN 'tests/x' ELSE 'm' END || CAST(p_partkey AS STRING) || CASE p_partkey % 11 WHEN 7 THEN '.py' ELSE '.rs' END AS path, "
    + NL.join(_PICK(k) for k in range(8)) + " AS content FROM {part}"
)

#: Functions of several shapes: blocks within blocks, chains of else-if, closures, loops, arms, and braces in strings and comments.
_RUST = [
    "pub fn flat_@(x: u8) -> u8 {\n    // no { here\n    x + 1\n}",
    "fn once_@(a: bool, b: bool) -> u8 {\n    if a && b || a {\n        return 1;\n    }\n    0\n}",
    "fn chain_@(x: u8) -> u8 {\n    if x > 1 {\n        1\n    } else if x > 2 {\n        2\n    } else if x > 3 {\n        if x > 9 { 3 } else { 4 }\n    } else {\n        for y in 0..x { go(y); }\n        5\n    }\n}",
    "fn deep_@(xs: &[u8]) {\n    for x in xs {\n        while ready(x) {\n            loop {\n                if *x == 0 { break; }\n                match x { 1 => go(1), 2 => { go(2) } _ => stop() }\n            }\n        }\n    }\n}",
    "fn names_@(items: &[Item], label: &str) -> Vec<String> {\n    let mut out = vec![];\n    for item in items {\n        out.push(item.name.to_string());\n        out.push(label.to_string());\n    }\n    out\n}",
    "fn pairs_@(m: &Map, label: &str) {\n    for (k, v) in m {\n        put(k.to_owned());\n        for w in v { put(w.to_string()); put(label.to_owned()); }\n    }\n    put(label.to_string());\n}",
    "fn quoted_@() -> &'static str {\n    let a = " + '"' + "{ if for while" + '"' + ";\n    /* { { \n } */\n    let c = '{';\n    if a == c { a } else { c }\n}",
    "impl<'a> Thing<'a> for Other_@ {\n    fn inner_@<F: for<'b> Fn(&'b u8)>(&self, f: F) {\n        self.xs.iter().for_each(|x| {\n            if x > 1 { if x > 2 { f(x); } }\n        });\n    }\n    fn later_@(&self);\n}",
    "fn outer_@(x: u8) {\n    if x > 0 {\n        fn within_@(y: u8) { while y > 1 { if y > 2 { go(y); } } }\n        within_@(x);\n    }\n}",
    "fn arms_@(k: Kind, n: u8) -> u8 {\n    match k {\n        Kind::A => 1,\n        Kind::B if n > 1 => 2,\n        Kind::C => match n { 0 => 0, _ => 1 },\n        _ => { if n > 3 && n < 9 { 3 } else { 4 } }\n    }\n}",
    "fn write_@(f: File) -> Result<()> {\n    let mut w = BufWriter::new(f);\n    let open = || { BufWriter::new(f) };\n    w.write_all(b)?;\n    Ok(())\n}",
    "fn flush_@(f: File) {\n    let mut w = BufWriter::new(f);\n    fn lost_@(g: File) { let v = BufWriter::new(g); let u = io::BufWriter::new(g); }\n    w.flush();\n}",
    "fn same_@(k: Kind, v: (u8, u8)) -> u8 {\n    match k {\n        Kind::A => go(1, 2),\n        Kind::B => go(1, 2),\n        Kind::C(x) => { stop(x) }\n        Kind::D(y) => { stop(x) }\n        Kind::E { z } if z > 1 => [1, 2][0],\n        Kind::F => match v { (1, _) => 3, (_, 2) => 3, _ => 4 },\n        _ => go(1, 2)\n    }\n}",
    "fn run_@(tool_path: &str, bash: &str, my_git: &str) {\n    Command::new(tool_path).arg(x);\n    std::process::Command::new(bash);\n    Command::new(my_git);\n    Command::new(" + '"ls"' + ");\n}",
    "fn load_@(p: &str) { if a { Command::new(p); } }",
    "fn pick_@(p: &str, zsh: &str) {\n    match p { " + '"a"' + " => Command::new(p), _ => stop() };\n    match n { 1 => Command::new(p), _ => Command::new(zsh) }\n}",
    "fn wait_@(mut n: u64) -> String {\n    let mut s = String::new();\n    while n > 0 { s = n.to_string(); n -= 1; loop { s.to_owned(); break; } }\n    s\n}",
]
_SCRIPT = [
    "function walk_@(xs) {\n  for (let i = 0; i < xs.length; i++) {\n    if (xs[i] && !done) { try { go(`${i} {`); } catch (e) { stop(e); } }\n  }\n}",
    "export function pick_@(x) {\n  switch (x) { case 1: if (x || y) { return '}'; } default: return 0 }\n}",
]
_GO = ["func Run_@(xs []int) int {\n\tfor i := 0; i < 3; i++ {\n\t\tif xs[i] > 0 { for _, x := range xs { go1(x) } } else if i > 2 { return 1 }\n\t}\n\treturn 0\n}", "func (s *Set) Add_@(x int) {\n\tif x > 0 && x < 5 || x == 9 { s.n++ }\n}"]


def _code(text: str, number: str) -> str:
    """A text as an SQL string; @ is the number."""
    parts = [" || chr(10) || ".join("'" + line.replace("'", "''").replace("\t", "  ") + "'" for line in piece.split("\n")) for piece in text.split("@")]
    return f" || {number} || ".join(parts)


def _picked(pool: list[str], key: str, number: str) -> str:
    return f"CASE {key} % {len(pool)} " + " ".join(f"WHEN {k} THEN {_code(x, number)}" for k, x in enumerate(pool)) + " END"


_PART = "CAST(p_partkey AS STRING)"
#: files(path, content) with functions of several shapes, each file another choice.
NESTED = (
    f"SELECT 'src/b' || {_PART} || CASE p_partkey % 7 WHEN 5 THEN '.ts' WHEN 6 THEN '.go' ELSE '.rs' END AS path, CASE p_partkey % 7 WHEN 5 THEN {_picked(_SCRIPT, 'p_partkey', _PART)} "
    f"WHEN 6 THEN {_picked(_GO, 'p_partkey', _PART)} || chr(10) || {_picked(_GO, '(p_partkey + 1)', _PART)} ELSE "
    + NL.join(_picked(_RUST, f"(p_partkey * {a} + {b})", f"{_PART} || '_{k}'") for k, (a, b) in enumerate(((1, 0), (3, 2), (7, 5)))) + " END AS content FROM {part}"
)

#: files(path, content): scripts that import one another, by relative paths and by an alias; some targets don't exist.
_SCRIPT_PATH = lambda key: f"'src/m' || CAST(({key}) % 40 AS STRING) || '/p' || CAST({key} AS STRING) || '.ts'"
_Q = "'\"'"
SCRIPTS = (
    f"SELECT {_SCRIPT_PATH('p_partkey')} AS path, 'import a from ' || {_Q} || '../m' || CAST((p_partkey + 27) % 40 AS STRING) || '/p' || CAST(p_partkey - 13 AS STRING) || {_Q} || chr(10) || "
    f"'import b from ' || {_Q} || '@app/m' || CAST((p_partkey + 5) % 40 AS STRING) || '/p' || CAST(p_partkey + 5 AS STRING) || {_Q} || chr(10) || 'import c from ' || {_Q} || 'react' || {_Q} AS content FROM {{part}}"
)
#: files(path, content): Go files, eight to a directory, that import the next directory of their module; some are tests.
GO_FILES = (
    "SELECT 'pkg' || CAST(p_partkey - p_partkey % 8 AS STRING) || '/f' || CAST(p_partkey AS STRING) || CASE p_partkey % 5 WHEN 3 THEN '_test.go' ELSE '.go' END AS path, "
    "CASE p_partkey % 5 WHEN 3 THEN 'package pkg_test' ELSE 'package pkg' END || chr(10) || 'import (' || chr(10) || '\"fmt\"' || chr(10) || '\"example.com/mod/pkg' || CAST(p_partkey - p_partkey % 8 + 8 AS STRING) || '\"' || chr(10) || ')' AS content FROM {part}"
)
_BUILD = ["Cargo.toml", "package.json", "requirements.txt", "x.cmake", "CMakeLists.txt", "conanfile.py", "cargo.toml", "a.toml", "Pipfile"]
#: files(path): names of which some belong to build systems.
BUILDS = "SELECT 'd' || CAST(s_suppkey AS STRING) || '/' || CASE s_suppkey % 9 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_BUILD)) + " END AS path FROM {supplier}"

_SAID = "replace(replace(replace(text, chr(10), ' '), '*', ' '), '\"', ' ')"
_OPENINGS = ["Parser of ", "Returns the value of ", "Whether ", "A small ", "The number of ", "Applies ", "This is ", "Rules. More of "]
_DOC = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_OPENINGS)) + f" END || {_SAID}"
#: files(path, content): Rust, Python, script and Go files with a comment on top; said is the comment's text.
DOCS = (
    f"SELECT doc_id, {_DOC} AS said, 'src/d' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.rs' WHEN 2 THEN '.py' WHEN 3 THEN '.ts' ELSE '.go' END AS path, CASE doc_id % 5 "
    f"WHEN 0 THEN '// x' || chr(10) || '//! # ' || {_DOC} || chr(10) || '//! end' || chr(10) || 'fn main() {{}}' WHEN 1 THEN 'use a;' || chr(10) || '/// ' || {_DOC} || chr(10) || 'fn f() {{}}' "
    f"WHEN 2 THEN '# x' || chr(10) || '\"\"\"' || {_DOC} || '\"\"\"' || chr(10) || 'import os' WHEN 3 THEN '/** ' || {_DOC} || ' */' ELSE '// ' || {_DOC} || chr(10) || 'package main' END AS content FROM {{documents}}"
)
#: files(path, content): C++ headers and sources.
CPP = (
    "SELECT 'src/c' || CAST(s_suppkey AS STRING) || CASE s_suppkey % 2 WHEN 0 THEN '.h' ELSE '.cpp' END AS path, 'class K' || CAST(s_suppkey AS STRING) || ' {' || chr(10) || 'void inner();' || chr(10) || '};' || chr(10) || "
    "'int declared_' || CAST(s_nationkey AS STRING) || '(int x);' || chr(10) || 'static int hidden(int x) {' || chr(10) || '}' || chr(10) || 'void made' || CAST(s_nationkey AS STRING) || '() {' || chr(10) || 'if (x) { go(); }' || chr(10) || '}' || chr(10) || "
    "'void K::method() {' || chr(10) || '}' || chr(10) || 'void OnClick() {' || chr(10) || '}' AS content FROM {supplier}"
)
#: spans(path, low, high): a supplier's lines as ranges, some within others.
SPANS = "SELECT 's' || CAST(l_suppkey AS STRING) AS path, l_partkey % 1000 AS low, l_partkey % 1000 + CAST(l_quantity AS INT) * 3 AS high FROM {lineitem}"

_ENDS = [".rs", ".py", ".bundle.js", ".ts", ".toml", ".json", ".html", ".min.css", ".md", ".png", ".lock", ".sh", "", ".pem"]
_DIRS = ["src/core", "src/core/tests", "node_modules/a", "docs", "src/ui/view", "target/debug", "vendor", "src"]
#: files(path, content): documents under made-up names of many kinds.
PATHS = (
    "SELECT CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(_DIRS)) + " END || '/' || source || '_' || CAST(doc_id AS STRING) || CASE doc_id % 14 "
    + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDS)) + " END AS path, CASE WHEN doc_id % 28 = 12 THEN '#!' || text ELSE text END AS content FROM {documents}"
)

#: files(path, content): every document as a source file.
SOURCES = "SELECT 'src/' || lang || '/' || source || '/doc_' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '.rs' ELSE '.py' END AS path, text AS content FROM {documents}"

_CUSTOMER = "'src/customer/n' || CAST(c_nationkey AS STRING) || '/c' || CAST(c_custkey AS STRING) || '.rs'"
#: edges(src, dst), a bag without cycles: customer -> order -> part -> supplier -> nation -> region.
EDGES = f"""
SELECT {_CUSTOMER} AS src, 'src/orders/' || o_orderstatus || '/o' || CAST(o_orderkey AS STRING) || '.rs' AS dst FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
UNION ALL SELECT 'src/orders/' || o_orderstatus || '/o' || CAST(o_orderkey AS STRING) || '.rs', 'src/part/p' || CAST(l_partkey AS STRING) || '.rs' FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'src/part/p' || CAST(l_partkey AS STRING) || '.rs', 'src/supplier/deep/s' || CAST(l_suppkey AS STRING) || '.rs' FROM {{lineitem}}
UNION ALL SELECT 'src/supplier/deep/s' || CAST(s_suppkey AS STRING) || '.rs', 'src/nation/n' || CAST(s_nationkey AS STRING) || '.rs' FROM {{supplier}}
UNION ALL SELECT 'src/nation/n' || CAST(n_nationkey AS STRING) || '.rs', 'src/region/r' || CAST(n_regionkey AS STRING) || '/mod.rs' FROM {{nation}}"""

#: edges(src, dst, weight): a customer needs the suppliers (n) of its lines, a supplier the customers whose lines came back, and its nation, and that its region; has cycles and dead ends.
TRADE = """
SELECT src, dst, count(*) AS weight FROM (
SELECT 'c' || CAST(o_custkey AS STRING) AS src, 'n' || CAST(l_suppkey AS STRING) AS dst FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
UNION ALL SELECT 'n' || CAST(l_suppkey AS STRING), 'c' || CAST(o_custkey AS STRING) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
UNION ALL SELECT 'n' || CAST(s_suppkey AS STRING), 'nation' || CAST(s_nationkey AS STRING) FROM {supplier}
UNION ALL SELECT 'nation' || CAST(n_nationkey AS STRING), 'region' || CAST(n_regionkey AS STRING) FROM {nation}) AS t
GROUP BY src, dst"""

_RING = "'src/r' || CAST(c_custkey - c_custkey % 6 + {more} AS STRING) || '/n' || CAST({node} AS STRING) || '.rs'"
_ring = lambda node, more=0: _RING.format(node=node, more=more)
#: edges(src, dst): rings of six modules, some broken, some with chords, edges to themselves or back edges; eight rings depend on one another in a row.
RINGS = f"""
SELECT {_ring('c_custkey % 6')} AS src, {_ring('(c_custkey + 1) % 6')} AS dst FROM {{customer}} WHERE NOT ((c_custkey - c_custkey % 6) % 18 = 0 AND c_custkey % 6 = 5)
UNION ALL SELECT {_ring(4)}, {_ring(1)} FROM {{customer}} WHERE (c_custkey - c_custkey % 6) % 24 = 6 AND c_custkey % 6 = 4
UNION ALL SELECT {_ring(2)}, {_ring(2)} FROM {{customer}} WHERE (c_custkey - c_custkey % 6) % 30 = 12 AND c_custkey % 6 = 2
UNION ALL SELECT {_ring(1)}, {_ring(0)} FROM {{customer}} WHERE (c_custkey - c_custkey % 6) % 42 = 0 AND c_custkey % 6 = 1
UNION ALL SELECT {_ring(0)}, {_ring(0, 6)} FROM {{customer}} WHERE (c_custkey - c_custkey % 6) % 48 <> 42 AND c_custkey % 6 = 0"""

_KEY = "CAST(c_custkey AS STRING)"
_many = " || ".join(f"' a{j}(x);'" for j in range(10))
_method = lambda i: (
    f"'    fn m{i}(' || CASE WHEN (c_custkey + {i}) % 4 = 0 THEN '&mut self' ELSE '&self' END || ', x: u8) {{' || chr(10) || '        if self.f' || CAST((c_custkey * {i + 1}) % 4 AS STRING) || ' > 0 {{ helper_{i}(x); }}' || "
    f"CASE WHEN (c_custkey + {i}) % 5 = 0 THEN ' self.m{(i + 1) % 4}();' ELSE '' END || CASE WHEN c_custkey % 6 = {i} THEN {_many} ELSE '' END || chr(10) || '    }}'"
)
_field = lambda i: f"CASE WHEN (c_custkey + {i}) % 3 = 0 THEN '    pub ' ELSE '    ' END || 'f{i}: u8,'"
#: files(path, content): a type each, with fields, and methods that use them, call one another and call out.
TYPED = (
    f"SELECT 'src/t' || {_KEY} || '.rs' AS path, 'use crate::t' || CAST(c_custkey + 1 AS STRING) || '::T;' || chr(10) || 'mod t' || {_KEY} || ';' || chr(10) || "
    f"CASE WHEN c_custkey % 7 = 0 THEN '#[derive(Debug, Serialize)]' || chr(10) ELSE '' END || 'pub struct T' || {_KEY} || ' {{' || chr(10) || "
    + NL.join(map(_field, range(4))) + f" || chr(10) || '}}' || chr(10) || 'impl T' || {_KEY} || ' {{' || chr(10) || " + NL.join(map(_method, range(4)))
    + f" || chr(10) || '}}' || chr(10) || 'const LIMIT_' || {_KEY} || ': u8 = 1;' AS content FROM {{customer}}"
).replace("{{customer}}", "@").replace("{{", "{").replace("}}", "}").replace("@", "{customer}")

#: defs(path, name) and refs(path, name): a supplier defines the parts that it ships, its nation refers to them.
DEFS = "SELECT DISTINCT 'src/supplier/s' || CAST(l_suppkey AS STRING) || '.rs' AS path, 'part_' || CAST(l_partkey AS STRING) AS name FROM {lineitem}"
REFS = "SELECT 'src/nation/n' || CAST(s_nationkey AS STRING) || '.rs' AS path, 'crate::parts::part_' || CAST(l_partkey AS STRING) AS name FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey"

#: Types: an order is one, its lines are methods, parts and suppliers what they use and call.
SCOPES = """SELECT 'src/c' || CAST(o_custkey AS STRING) || '.rs' AS path, 'Order' || CAST(o_orderkey AS STRING) AS scope, CAST(o_orderkey % 500 AS INT) AS row, o_orderstatus = 'P' AS is_enum,
CASE WHEN o_orderkey % 9 = 0 THEN array('Serialize', 'Debug') ELSE array('Debug') END AS derives FROM {orders}"""
FIELDS = """SELECT 'src/c' || CAST(o_custkey AS STRING) || '.rs' AS path, 'Order' || CAST(o_orderkey AS STRING) AS scope, 'f' || CAST(l_linenumber AS STRING) AS name, l_quantity > 25 AS is_public
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
METHODS = """SELECT 'src/c' || CAST(o_custkey AS STRING) || '.rs' AS path, 'Order' || CAST(o_orderkey AS STRING) AS scope, 'm' || CAST(l_linenumber AS STRING) AS name,
array('g' || CAST(l_partkey % 5 AS STRING)) AS field_access,
CASE WHEN l_suppkey % 3 = 0 THEN array('m' || CAST(l_linenumber + 1 AS STRING)) ELSE array('zz') END AS internal_calls,
array('p' || CAST(l_partkey AS STRING), 's' || CAST(l_suppkey AS STRING)) AS external_calls,
CAST(l_quantity AS INT) % 4 AS cognitive, l_returnflag = 'R' AS is_mutable FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

#: fingerprints(path, imports, annotations, param_types, strings, exports)
FINGERPRINTS = """SELECT 'f' || CAST(c_custkey AS STRING) AS path,
CASE c_custkey % 5 WHEN 0 THEN array('net/http', 'encoding/json', 'database/sql') WHEN 1 THEN array('std::fs') WHEN 2 THEN array('os/exec/x') ELSE array(c_mktsegment) END AS imports,
CASE c_custkey % 4 WHEN 0 THEN array('serde(rename)') ELSE array(lower(c_mktsegment)) END AS annotations,
CASE c_custkey % 6 WHEN 0 THEN array('http.ResponseWriter') ELSE array('u32') END AS param_types,
CASE c_custkey % 7 WHEN 0 THEN array('https://api.github.com/x') WHEN 1 THEN array('Library/LaunchAgents/a') ELSE array(c_name) END AS strings,
CASE c_custkey % 3 WHEN 0 THEN array('InstallApp', 'UninstallApp') WHEN 1 THEN array('FetchAll', 'RegisterPlugin') ELSE array('Run') END AS exports FROM {customer}"""

#: names(id, name): identifiers in several styles.
NAMES = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'get_' || replace(p_name, ' ', '_') WHEN 1 THEN 'parseHTTP' || p_type || 'Body' WHEN 2 THEN 'Is' || upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '')
WHEN 3 THEN lower(p_type) ELSE 'render' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || 'XMLView' END AS name FROM {part}"""


def for_duckdb(text: str) -> str:
    text = re.sub(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents|pages|conversations)\}", r"\1", text)
    return text.replace("array(", "list_value(")


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a text; its views are gone when this returns."""
    own, views = uuid.uuid4().hex, []
    try:
        for name in set(re.findall(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents|pages|conversations)\}", text)):
            views.append(f"v{own}_{name}")
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(views[-1])
            text = text.replace(f"{{{name}}}", views[-1])
        return spark.sql(text)
    finally:
        for view in views:
            spark.catalog.dropTempView(view)
