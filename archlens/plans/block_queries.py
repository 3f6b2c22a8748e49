"""Queries on blocks of code and on cycles, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from archlens.config import RuleConfig
from archlens.functions import tables as T
from archlens.operators import blocks, cycles, fingerprints, graph, imports, needles, report, rules, symbols, taxonomy
from archlens.operators.graph import shared_folder
from archlens.plans import inputs as I
from archlens.plans.oracles import CODE, GUIDANCE, KIND, LANG, ORACLE_SQL as KNOWN, SCAN, has, listed, quoted, source
from archlens.streaming import rescan

#: A limit that some of the derived files break.
STRICT = RuleConfig(max_cognitive_complexity=8, max_nesting_depth=2)


def _nested(spark, sf):
    return I.derived(spark, sf, I.NESTED)


def function_metrics(spark, sf):
    return blocks.measured(_nested(spark, sf)).drop("low")


def rule_nesting(spark, sf):
    return blocks.nesting(blocks.measured(_nested(spark, sf)), STRICT)


def rule_cognitive(spark, sf):
    return blocks.cognitive(blocks.measured(_nested(spark, sf)), STRICT)


def rule_nested_loops(spark, sf):
    return blocks.nested_loops(_nested(spark, sf))


def rule_loop_conversions(spark, sf):
    return blocks.loop_conversions(_nested(spark, sf))


def rule_unflushed_writers(spark, sf):
    return blocks.unflushed_writers(_nested(spark, sf))


def rule_duplicate_arms(spark, sf):
    return blocks.duplicate_arms(_nested(spark, sf))


def rule_unchecked_commands(spark, sf):
    return blocks.unchecked_commands(_nested(spark, sf))


def block_findings(spark, sf):
    return report.by_law(blocks.check(_nested(spark, sf)))


def skeletons(spark, sf):
    return blocks.skeletons(_nested(spark, sf))


def dependency_cycles(spark, sf):
    return cycles.dependency_cycles(I.derived(spark, sf, I.RINGS)).withColumn("witness", F.array_join("witness", " -> "))


def strong_components(spark, sf):
    return cycles.strong_components(I.derived(spark, sf, I.TRADE))


NEEDLES = tuple(sorted({n for of in T.NEEDLES.values() for found in of.values() for n in found}))


def needle_hits(spark, sf):
    return needles.needle_lines(I.derived(spark, sf, I.CODE), NEEDLES)


def concepts_at_once(spark, sf):
    return needles.concepts(I.derived(spark, sf, I.CODE))


def _typed(spark, sf):
    return I.derived(spark, sf, I.TYPED)


def definitions_from_text(spark, sf):
    return symbols.definitions(_typed(spark, sf))


def symbol_graph(spark, sf):
    return symbols.symbol_graph(_typed(spark, sf))


def methods_from_text(spark, sf):
    joined = {n: F.array_join(F.sort_array(n), ",") for n in ("field_access", "internal_calls", "external_calls")}
    return symbols.types(_typed(spark, sf))[2].withColumns(joined)


def types_from_text(spark, sf):
    scopes, fields, _ = symbols.types(_typed(spark, sf))
    counted = fields.groupBy("path", "scope").agg(F.count("*").alias("n_fields"), F.count_if("is_public").alias("n_public"))
    return scopes.withColumn("derives", F.array_join("derives", ",")).join(counted, ["path", "scope"])


def type_findings(spark, sf):
    return symbols.type_violations(_typed(spark, sf))


#: Files of the second batch: as they were, but for some that got a line more.
_AGED = f"SELECT path, CASE WHEN length(path) % 3 = 0 THEN content || chr(10) || 'let api_token = \"abcdefgh\";' ELSE content END AS content FROM ({I.CODE}) AS c"


def rescanned_findings(spark, sf):
    """Two batches of files through the ledger; the second judges only what changed."""
    folder, judge = shared_folder(spark), lambda files: rules.check(files, "hardcoded_secrets")
    for k, text in enumerate((I.CODE, _AGED)):
        rescan.judge_batch(I.derived(spark, sf, text).withColumn("ord", F.lit(k)), k, folder, judge)
    return rescan.findings(spark, folder)


def badges_from_text(spark, sf):
    """Fingerprints written out as files, read back, and judged."""
    made = I.derived(spark, sf, I.FINGERPRINTS)
    each = lambda name, before, after: F.transform(name, lambda x: F.concat(F.lit(before), x, F.lit(after)))
    lines = F.concat(each("imports", "use ", ";"), each("annotations", "#[", "]"), each("param_types", "fn go(x: ", ") { }"), each("strings", 'let s = "', '";'), each("exports", "pub fn ", "() { }"))
    files = made.select(F.concat("path", F.lit(".rs")).alias("path"), F.array_join(lines, "\n").alias("content"))
    found = taxonomy.badges(fingerprints.fingerprints(files))
    return found.withColumns({"path": F.regexp_replace("path", r"\.rs$", ""), "mechanisms": F.array_join("mechanisms", "|")})


def ranked_files(spark, sf):
    ranks = graph.pagerank(I.derived(spark, sf, I.TRADE)).withColumn("rank", F.round("rank", 9))
    return graph.ranked(ranks)


def grouped_report(spark, sf):
    files = I.derived(spark, sf, I.CODE)
    return report.grouped(rules.scan(files), rules.lines_of(files)).select("law", "k", "n", "path", "row", "message", "before", "line", "after", "why", "fix")


#: What the files of SCRIPTS are configured by.
TSCONFIG = '{"compilerOptions": {"paths": {"@app/*": ["src/*"], /* a comment */ "react": ["vendor/react"]}}} // end'


def configured_imports(spark, sf):
    files = I.derived(spark, sf, I.SCRIPTS).unionByName(I.derived(spark, sf, f"SELECT 'tsconfig.json' AS path, '{TSCONFIG}' AS content"))
    found = imports.imports(files)
    return imports.resolved(found, files, imports.configured(found, files)).select("src", "dst")


QUERIES = {f.__name__: f for f in (function_metrics, rule_nesting, rule_cognitive, rule_nested_loops, rule_loop_conversions, rule_unflushed_writers, rule_duplicate_arms, rule_unchecked_commands, block_findings, skeletons, dependency_cycles, strong_components, needle_hits, concepts_at_once, definitions_from_text, symbol_graph, methods_from_text, types_from_text, type_findings, rescanned_findings, badges_from_text, ranked_files, grouped_report, configured_imports)}

# The SQL follows the definitions by containment: a block's ancestors are the blocks whose ranges hold it.
_QUOTED = r'"(?:[^"\\]|\\.)*"'
_ALL = r"|\|[^|{};\n]*\|\s*(?:->[^{};|\n]*)?\{|\.\s*(?:to_string|to_owned)\s*\(|BufWriter::new\s*\(|Command::new\s*\(\s*[A-Za-z_]\w*\s*\)|[\w$]+|=>|&&|\|\||."
_TOKENS = {
    "rust": r'(?s)//[^\n]*|/\*.*?\*/|r"[^"]*"|' + _QUOTED + r"|'(?:[^'\\\n]|\\[^\n])'|fn\s+[A-Za-z_]\w*" + _ALL,
    "other": r"(?s)//[^\n]*|/\*.*?\*/|" + _QUOTED + r"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|function\s+[A-Za-z_$][\w$]*|func\s+(?:\([^)\n]*\)\s*)?[A-Za-z_]\w*|for\b[^{};\n]*;[^{};\n]*;" + _ALL,
}
_WORDS = ("if", "else", "for", "while", "loop", "match", "switch", "try", "catch", "do", "impl", "struct", "enum", "union", "trait", "mod", "class", "interface", "fn", "func", "function")
BLOCKS = f"""{source('code', I.NESTED)},
g AS (SELECT path, content, {LANG} AS lang FROM code WHERE {KIND} = 'SourceCode'),
raw AS (SELECT path, lang, CASE WHEN lang = 'rust' THEN regexp_extract_all(content, {quoted(_TOKENS['rust'])}) ELSE regexp_extract_all(content, {quoted(_TOKENS['other'])}) END AS ts FROM g WHERE lang <> 'python'),
tok AS (SELECT path, lang, unnest(range(len(ts))) AS i, unnest(ts) AS t FROM raw),
pos AS (SELECT *, 1 + coalesce(sum(length(t) - length(replace(t, chr(10), ''))) OVER b, 0) AS row, 1 + coalesce(sum(length(t)) OVER b, 0) AS first,
  left(t, 1) NOT IN ('"', '''', '`') AND left(t, 2) NOT IN ('//', '/*', 'r"') AS plain FROM tok WINDOW b AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, plain AND ends_with(t, '{{') AS o, plain AND t = '}}' AS c, plain AND (ends_with(t, '{{') OR t IN ('}}', ';', '=>')) AS b, plain AND regexp_extract(t, '^[\\w$]+') IN {listed(_WORDS)} AS k FROM pos),
d AS (SELECT *, sum(o::INT - c::INT) OVER (PARTITION BY path ORDER BY i) + c::INT AS depth, max(CASE WHEN b THEN i END) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS border FROM s),
br AS (SELECT *, lead(i) OVER w AS e, lead(row) OVER w AS e_row, lead(first) OVER w + 1 AS e_end FROM d WHERE o OR c WINDOW w AS (PARTITION BY path, depth ORDER BY i)),
hd AS (SELECT x.path, x.i, list(struct_pack(t := k.t, row := k.row, first := k.first) ORDER BY k.i) AS ks FROM br x JOIN d k ON k.path = x.path AND k.k AND k.i < x.i AND k.i > coalesce(x.border, -1) WHERE x.o GROUP BY x.path, x.i),
bl AS (SELECT br.path, lang, br.i, e, e_row, e_end, br.first, depth, ks[1].t AS head, ks[1].row AS hrow, ks[1].first AS hfirst, CASE WHEN br.t LIKE '|%' THEN 'closure' WHEN ks IS NULL THEN 'other'
  WHEN regexp_matches(ks[1].t, '^(fn|func|function)\\b') THEN 'fn' WHEN ks[1].t = 'else' AND ks[2].t = 'if' THEN 'else_if' ELSE regexp_extract(ks[1].t, '^[a-z]+') END AS kind FROM br LEFT JOIN hd ON hd.path = br.path AND hd.i = br.i WHERE br.o),
fi AS (SELECT y.path, y.i, max(z.i) AS f FROM bl y JOIN bl z ON z.path = y.path AND z.depth = y.depth AND z.kind = 'if' AND z.i <= y.i WHERE y.kind IN ('else_if', 'else') GROUP BY y.path, y.i),
ch AS (SELECT fi.path, fi.i, count(z.i) AS links FROM fi LEFT JOIN bl y ON y.path = fi.path AND y.i = fi.i LEFT JOIN bl z ON z.path = y.path AND z.depth = y.depth AND z.kind = 'else_if' AND z.i > fi.f AND z.i <= y.i GROUP BY fi.path, fi.i),
bw AS (SELECT bl.*, CASE WHEN kind IN {listed((*blocks.NESTING, 'else'))} THEN 1 + coalesce(links, 0) ELSE 0 END AS adds FROM bl LEFT JOIN ch USING (path, i)),
fn AS (SELECT path, lang, i, e, e_row, e_end, first, regexp_extract(head, '([\\w$]+)$', 1) AS name, hrow, hfirst FROM bw WHERE kind = 'fn' AND e IS NOT NULL),
ne AS (SELECT f.path, f.i AS f, x.i, any_value(x.hrow) AS hrow, sum(a.adds) AS nest FROM fn f JOIN bw x ON x.path = f.path AND x.i > f.i AND x.i < f.e AND x.kind IN {listed(blocks.NESTING)} JOIN bw a ON a.path = x.path AND a.i > f.i AND a.i <= x.i AND a.e >= x.e GROUP BY f.path, f.i, x.i),
nd AS (SELECT path, f, max(nest) AS depth FROM ne GROUP BY path, f),
dp AS (SELECT ne.path, ne.f, any_value(depth) AS depth, arg_min(hrow, i) AS hrow FROM ne JOIN nd ON nd.path = ne.path AND nd.f = ne.f AND nest = depth GROUP BY ne.path, ne.f),
re AS (SELECT x.path, x.i, coalesce(max(r.i), -1) AS r FROM bw x LEFT JOIN bw r ON r.path = x.path AND r.i < x.i AND r.e > x.e AND r.kind IN ('fn', 'closure') WHERE x.lang = 'rust' AND x.kind IN ('if', 'for', 'while', 'loop', 'match') GROUP BY x.path, x.i),
co AS (SELECT re.path, re.i, 1 + count(a.i) AS score FROM re JOIN bw x ON x.path = re.path AND x.i = re.i LEFT JOIN bw a ON a.path = re.path AND a.i > re.r AND a.i < re.i AND a.e > x.e AND a.kind IN ('if', 'else_if', 'else', 'for', 'while', 'loop', 'match') GROUP BY re.path, re.i
  UNION ALL SELECT path, i, 1 FROM bw WHERE lang = 'rust' AND kind = 'else_if' UNION ALL SELECT path, i, 1 FROM d WHERE plain AND t IN ('&&', '||')
  UNION ALL SELECT d.path, d.i, 1 FROM d JOIN bw x ON x.path = d.path AND x.i < d.i AND x.e > d.i AND x.depth = d.depth WHERE d.lang = 'rust' AND d.plain AND d.t = '=>' AND x.kind = 'match'),
cs AS (SELECT f.path, f.i AS f, sum(score) AS cognitive FROM fn f JOIN co ON co.path = f.path AND co.i > f.i AND co.i < f.e GROUP BY f.path, f.i),
me AS (SELECT fn.path, lang, name, fn.hrow::INT AS row, e_row::INT AS end_row, coalesce(depth, 0)::INT AS depth, coalesce(dp.hrow, fn.hrow)::INT AS deepest_row, coalesce(cognitive, 0)::INT AS cognitive
  FROM fn LEFT JOIN dp ON dp.path = fn.path AND dp.f = fn.i LEFT JOIN cs ON cs.path = fn.path AND cs.f = fn.i)"""
_LOOPS = f"lo AS (SELECT *, regexp_extract(substr(g.content, hfirst::BIGINT, (first - hfirst)::BIGINT), '^for\\s+(?:mut\\s+)?([^,(]*?)\\s*(?:[,(]|\\bin\\b)', 1) AS var FROM bw JOIN g USING (path) WHERE bw.lang = 'rust' AND kind IN {listed(blocks.LOOPS)})"


def _told(rule: str, body: str, message: str = "") -> str:
    law, text, confidence = T.BLOCK_LAWS[rule]
    return f"SELECT path, row::INT AS row, '{law}' AS law, {message or quoted(text)} AS message, '{confidence}' AS confidence FROM {body}"


def _components(text: str) -> str:
    """Nodes that reach each other, by all ways."""
    return f"""{source('bag', text)}, e AS (SELECT DISTINCT src, dst FROM bag), w AS (SELECT src AS a, dst AS b FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON e.src = w.b),
m AS (SELECT x.a AS path, min(x.b) AS component FROM w x JOIN w y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"""


# What the files of TYPED hold, told from the keys that they are made of.
_T, _NAME = "customer", "'T' || c_custkey"
_AT = "3 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END"
_of = lambda test, text: f"CASE WHEN {test} THEN [{text}] ELSE [] END"
_METHODS = " UNION ALL ".join(
    f"""SELECT 'src/t' || c_custkey || '.rs' AS path, {_NAME} AS scope, 'm{i}' AS name, list_concat(['f' || ((c_custkey * {i + 1}) % 4)], {_of(f'(c_custkey + {i}) % 5 = 0', f"'m{(i + 1) % 4}'")}) AS field_access,
    {_of(f'(c_custkey + {i}) % 5 = 0', f"'m{(i + 1) % 4}'")} AS internal_calls, list_concat(['helper_{i}'], {_of(f'c_custkey % 6 = {i}', ', '.join(f"'a{j}'" for j in range(10)))}) AS external_calls, 1 AS cognitive, (c_custkey + {i}) % 4 = 0 AS is_mutable FROM {_T}"""
    for i in range(4)
)
_SCOPES = f"SELECT 'src/t' || c_custkey || '.rs' AS path, {_NAME} AS scope, ({_AT})::INT AS row, false AS is_enum, CASE WHEN c_custkey % 7 = 0 THEN ['Debug', 'Serialize'] ELSE []::VARCHAR[] END AS derives FROM {_T}"
_FIELDS = " UNION ALL ".join(f"SELECT 'src/t' || c_custkey || '.rs' AS path, {_NAME} AS scope, 'f{i}' AS name, (c_custkey + {i}) % 3 = 0 AS is_public FROM {_T}" for i in range(4))
_defined = lambda name, kind, row, text: f"SELECT 'src/t' || c_custkey || '.rs' AS path, {name} AS name, '{kind}' AS kind, ({row})::INT AS row, {text} AS signature FROM {_T}"
_DEFINED = " UNION ALL ".join([
    _defined("'t' || c_custkey", "module", "2", "'mod t' || c_custkey || ';'"), _defined(_NAME, "struct", _AT, "'pub struct T' || c_custkey || ' {'"), _defined(_NAME, "impl", f"6 + {_AT}", "'impl T' || c_custkey || ' {'"),
    *[_defined(f"'m{i}'", "function", f"{7 + 3 * i} + {_AT}", f"'fn m{i}(' || CASE WHEN (c_custkey + {i}) % 4 = 0 THEN '&mut self' ELSE '&self' END || ', x: u8) {{'") for i in range(4)],
    _defined("'LIMIT_' || c_custkey", "constant", f"20 + {_AT}", "'const LIMIT_' || c_custkey || ': u8 = 1;'"),
])
_joined = lambda x: f"array_to_string(list_sort({x}), ',') AS {x}"


def _from_text(sql: str) -> str:
    """A query on prepared tables of types, over those that the text holds."""
    for text, made in ((I.SCOPES, _SCOPES), (I.FIELDS, _FIELDS), (I.METHODS, _METHODS)):
        assert I.for_duckdb(text) in sql
        sql = sql.replace(I.for_duckdb(text), made)
    return sql


ORACLE_SQL = {
    "rule_duplicate_arms": f"""WITH {BLOCKS}, nt AS (SELECT path, i, t, first, sum(length(t) - length(translate(t, '([{{', '')) - length(t) + length(translate(t, ')]}}', ''))) OVER (PARTITION BY path ORDER BY i) AS net FROM d WHERE plain),
    ar AS (SELECT a.path, a.i, a.net, a.first, x.i AS m, x.hrow, x.first + 1 AS begin, (SELECT arg_min(n.t, n.i) FROM nt n WHERE n.path = a.path AND n.i > a.i AND trim(n.t, chr(10) || ' ') <> '') = '{{' AS block FROM nt a JOIN bw x ON x.path = a.path AND x.i < a.i AND x.e > a.i JOIN d ON d.path = a.path AND d.i = a.i AND d.depth = x.depth WHERE a.t = '=>' AND x.kind = 'match'),
    en AS (SELECT ar.path, ar.i, min(n.i) AS j FROM ar JOIN nt n ON n.path = ar.path AND n.i > ar.i AND ((n.t = ',' AND n.net = ar.net) OR (n.t = '}}' AND n.net = ar.net - 1) OR (n.t = '}}' AND n.net = ar.net AND block)) GROUP BY ar.path, ar.i),
    am AS (SELECT ar.*, n.first + CASE WHEN n.t = '}}' AND n.net = ar.net THEN 1 ELSE 0 END AS until FROM ar JOIN en ON en.path = ar.path AND en.i = ar.i JOIN nt n ON n.path = en.path AND n.i = en.j),
    pt AS (SELECT *, coalesce(lag(until) OVER (PARTITION BY path, m ORDER BY i), begin) AS start FROM am),
    tx AS (SELECT pt.path, m, hrow, regexp_replace(substr(content, start::BIGINT, (pt.first - start)::BIGINT), '^[,\\s]+|\\s+$', '', 'g') AS pat, regexp_replace(substr(content, (pt.first + 2)::BIGINT, (until - pt.first - 2)::BIGINT), '^\\s+|\\s+$', '', 'g') AS body FROM pt JOIN g USING (path)),
    vr AS (SELECT *, CASE WHEN pat LIKE '(%' THEN regexp_extract_all(pat, '{blocks.VARIANT}', 1) ELSE regexp_extract_all(pat, '{blocks.VARIANT}', 1)[1:1] END AS vs FROM tx WHERE body NOT IN ('', '_')),
    gr AS (SELECT path, hrow AS row, count(*) AS n, list(vs) AS l FROM vr GROUP BY path, m, hrow, body) """
    + _told("duplicate_arms", "gr WHERE n > 1 AND NOT (len(list_filter(l, lambda v: len(v) = len(l[1]) AND len(v) > 0)) = n AND len(list_filter(range(1, len(l[1]) + 1), lambda k: len(list_distinct(list_transform(l, lambda v: v[k]))) = n)) > 0)"),
    "rule_unchecked_commands": f"""WITH {BLOCKS}, mk AS (SELECT path, i, row, regexp_extract(t, '\\(\\s*(\\w+)', 1) AS name FROM d WHERE plain AND t LIKE 'Command::new%'),
    ex AS (SELECT mk.path, mk.i FROM mk JOIN bw ON bw.path = mk.path AND bw.i < mk.i AND bw.e > mk.i JOIN g ON g.path = mk.path WHERE (kind = 'fn' AND regexp_matches(regexp_extract(head, '(\\w+)$', 1), '{'|'.join(T.CONFIG_FUNCTIONS)}')) OR (kind = 'match' AND contains(substr(content, hfirst::BIGINT, (e_end - hfirst)::BIGINT), '"'))),
    ok AS (SELECT mk.*, lower(name) IN {listed(T.SHELLS)} AS shell FROM mk JOIN g USING (path) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.path = mk.path AND ex.i = mk.i) AND NOT contains(content, 'const ' || name) AND NOT contains(content, 'static ' || name) AND NOT list_bool_or(list_transform([{', '.join(map(quoted, T.TRUSTED_COMMANDS))}], lambda x: lower(name) = x OR ends_with(lower(name), '_' || x)))) """
    + _told("shell_commands", "ok WHERE shell") + " UNION ALL " + _told("command_sources", "ok WHERE NOT shell", f"printf({quoted(T.BLOCK_LAWS['command_sources'][1])}, name)"),
    "ranked_files": f"SELECT row_number() OVER (ORDER BY rank DESC, path) AS place, path, rank FROM ({KNOWN['pagerank']})",
    "grouped_report": f"""WITH {SCAN}, {CODE}, al AS (SELECT path, unnest(range(1, len(ls) + 1)) AS row, unnest(ls) AS line FROM (SELECT path, string_split(content, chr(10)) AS ls FROM code)), ad AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM al WINDOW w AS (PARTITION BY path ORDER BY row)),
    nu AS (SELECT *, row_number() OVER (PARTITION BY law ORDER BY path, row, message) AS k, count(*) OVER (PARTITION BY law) AS n FROM v)
    SELECT nu.law, k, n, nu.path, nu.row, message, before, line, after, why, fix FROM nu LEFT JOIN ad ON ad.path = nu.path AND ad.row = nu.row LEFT JOIN {GUIDANCE} ON gd.law = nu.law""",
    "configured_imports": KNOWN["aliased_imports"],
    "badges_from_text": KNOWN["taxonomy_badges"],
    "rescanned_findings": KNOWN["rule_hardcoded_secrets"].replace(I.for_duckdb(I.CODE), I.for_duckdb(_AGED)),
    "needle_hits": f"WITH {CODE}, l AS (SELECT path, unnest(range(1, len(ls) + 1))::INT AS row, unnest(ls) AS line FROM (SELECT path, string_split(lower(content), chr(10)) AS ls FROM code)), n AS (SELECT unnest([{', '.join(map(quoted, NEEDLES))}]) AS needle) SELECT path, row, needle FROM l JOIN n ON contains(line, needle)",
    "concepts_at_once": f"WITH {CODE} SELECT path, " + ", ".join(f"{has(LANG, n, 'content')} AS {n}" for n in T.NEEDLES) + " FROM code",
    "definitions_from_text": _DEFINED,
    "symbol_graph": f"WITH d AS (SELECT DISTINCT path, name FROM ({_DEFINED})), r AS (SELECT 'src/t' || c_custkey || '.rs' AS path, unnest(['t' || (c_custkey + 1), 't' || c_custkey]) AS name FROM {_T}) SELECT r.path AS src, d.path AS dst, count(*) AS weight FROM r JOIN d USING (name) WHERE r.path <> d.path GROUP BY ALL",
    "methods_from_text": f"SELECT path, scope, name, {_joined('field_access')}, {_joined('internal_calls')}, {_joined('external_calls')}, cognitive, is_mutable FROM ({_METHODS})",
    "types_from_text": f"SELECT path, scope, row, is_enum, array_to_string(derives, ',') AS derives, n_fields, n_public FROM ({_SCOPES}) JOIN (SELECT path, scope, count(*) AS n_fields, count(*) FILTER (is_public) AS n_public FROM ({_FIELDS}) GROUP BY ALL) USING (path, scope)",
    "type_findings": _from_text(KNOWN["cohesion_violations"]),
    "function_metrics": f"WITH {BLOCKS} SELECT * FROM me",
    "rule_nesting": f"WITH {BLOCKS} " + _told("nesting", "me WHERE depth > 2", f"printf({quoted(T.BLOCK_LAWS['nesting'][1])}, name, depth, 2)"),
    "rule_cognitive": f"WITH {BLOCKS} " + _told("cognitive", "me WHERE cognitive > 8", f"printf({quoted(T.BLOCK_LAWS['cognitive'][1])}, name, cognitive, 8)"),
    "rule_nested_loops": f"WITH {BLOCKS}, {_LOOPS} " + _told("nested_loops", "(SELECT path, hrow AS row FROM lo a WHERE EXISTS (SELECT 1 FROM lo b WHERE b.path = a.path AND b.i < a.i AND b.e > a.e))"),
    "rule_loop_conversions": f"""WITH {BLOCKS}, {_LOOPS}, ca AS (SELECT d.path, i, row, regexp_extract(substr(content, 1, (first - 1)::BIGINT), '([\\w.:&*?()\\[\\]]*)$', 1) AS rc FROM d JOIN g USING (path) WHERE d.lang = 'rust' AND plain AND regexp_matches(t, '^\\.\\s*to_')) """
    + _told("loop_conversions", "(SELECT ca.path, ca.row FROM ca JOIN lo ON lo.path = ca.path AND lo.i < ca.i AND lo.e > ca.i WHERE NOT (kind = 'for' AND (rc = var OR contains(rc, var || '.'))))"),
    "rule_unflushed_writers": f"""WITH {BLOCKS}, mk AS (SELECT d.path, d.i, row FROM d JOIN g USING (path) WHERE plain AND t LIKE 'BufWriter::new%' AND substr(content, (first - 2)::BIGINT, 2) <> '::'),
    ar AS (SELECT mk.path, mk.i, mk.row, max(fn.i) AS f FROM mk JOIN fn ON fn.path = mk.path AND fn.i < mk.i AND fn.e > mk.i GROUP BY mk.path, mk.i, mk.row),
    tx AS (SELECT ar.path, ar.row, substr(content, hfirst::BIGINT, (e_end - hfirst)::BIGINT) AS x FROM ar JOIN fn ON fn.path = ar.path AND fn.i = ar.f JOIN g ON g.path = ar.path) """
    + _told("unflushed_writers", "tx WHERE " + " AND ".join(f"NOT contains(x, {quoted(n)})" for n in T.FLUSH_SIGNS)),
    "skeletons": f"""WITH {BLOCKS}, ou AS (SELECT * FROM fn a WHERE lang IN {listed(T.SKELETON_LANGUAGES)} AND NOT EXISTS (SELECT 1 FROM fn b WHERE b.path = a.path AND b.i < a.i AND b.e > a.e)),
    pc AS (SELECT path, string_agg(t, '' ORDER BY i) AS skeleton FROM (SELECT tok.path, tok.i, CASE WHEN tok.i = ou.i THEN '{{ ... }}' WHEN ou.i IS NULL THEN t ELSE '' END AS t FROM tok LEFT JOIN ou ON ou.path = tok.path AND tok.i BETWEEN ou.i AND ou.e) GROUP BY path)
    SELECT path, coalesce(skeleton, content) AS skeleton FROM code LEFT JOIN pc USING (path)""",
    "strong_components": f"WITH RECURSIVE {_components(I.TRADE)} SELECT * FROM m",
    "dependency_cycles": f"""WITH RECURSIVE {_components(I.RINGS)}, i AS (SELECT a.component, src, dst FROM e JOIN m a ON a.path = src JOIN m b ON b.path = dst WHERE a.component = b.component),
    p AS (SELECT DISTINCT component, component AS at, [component] AS trail FROM i UNION ALL SELECT p.component, dst, list_append(trail, dst) FROM p JOIN i ON i.component = p.component AND i.src = p.at WHERE NOT list_contains(trail, dst)),
    c AS (SELECT p.component, list_append(trail, p.component) AS trail FROM p JOIN i ON i.component = p.component AND i.src = p.at AND i.dst = p.component),
    f AS (SELECT component, array_to_string(trail, ' -> ') AS witness, row_number() OVER (PARTITION BY component ORDER BY len(trail), trail) AS k FROM c)
    SELECT component, n_nodes, n_edges, n_edges - n_nodes + 1 AS n_cycles, witness FROM f JOIN (SELECT component, count(*) AS n_nodes FROM m GROUP BY component) USING (component) JOIN (SELECT component, count(*) AS n_edges FROM i GROUP BY component) USING (component) WHERE k = 1""",
}
ORACLE_SQL["block_findings"] = "SELECT law, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT * FROM ({sql})" for sql in (
        f"WITH {BLOCKS} " + _told("nesting", f"me WHERE depth > {RuleConfig().max_nesting_depth}"), f"WITH {BLOCKS} " + _told("cognitive", f"me WHERE cognitive > {RuleConfig().max_cognitive_complexity}"),
        *[ORACLE_SQL[f"rule_{n}"] for n in ("nested_loops", "loop_conversions", "unflushed_writers", "duplicate_arms", "unchecked_commands")],
    )
) + ") GROUP BY law"
