"""The same results from plain SQL, written for DuckDB."""

from __future__ import annotations

from archlens.functions import tables as T
from archlens.plans import inputs as I
from archlens.plans.queries import STOP_WORDS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(xs) -> str:
    return "(" + ", ".join(quoted(x) for x in xs) + ")"


def source(name: str, text: str) -> str:
    return f"{name} AS ({I.for_duckdb(text)})"


NAME = "regexp_extract(path, '([^/]*)$', 1)"
EXT = f"lower(regexp_extract({NAME}, '^.+\\.([^.]*)$', 1))"
LANG = f"CASE {EXT} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in T.LANGUAGES.items()) + " END"
PRUNED = listed([*T.PRUNED_DIRECTORIES, *T.PRUNED_FILES, *T.SKIPPED_DIRECTORIES])
KIND = f"""CASE WHEN contains(lower({NAME}), '.min.') OR regexp_matches(lower({NAME}), '(\\.min|\\.bundle\\.js|\\.bundle\\.ts|-bundle\\.js)$') THEN 'Asset'
WHEN {EXT} IN {listed(T.SOURCE_EXTENSIONS)} THEN 'SourceCode' WHEN {EXT} IN {listed(T.CONFIG_EXTENSIONS)} THEN 'Config' WHEN {EXT} IN {listed(T.ASSET_EXTENSIONS)} THEN 'Asset' ELSE 'Other' END"""
TOKENS = "len(regexp_extract_all(content, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]'))"
CODE = source("code", I.CODE)
GOVERNED = f"{CODE}, g AS (SELECT path, content, {LANG} AS lang FROM code WHERE {KIND} = 'SourceCode')"
LINES = f"{GOVERNED}, l AS (SELECT path, lang, unnest(range(1, len(ls) + 1)) AS row, unnest(ls) AS line FROM (SELECT path, lang, string_split(content, chr(10)) AS ls FROM g))"


def has(lang: str, concept: str, text: str) -> str:
    return "CASE " + lang + " " + " ".join(f"WHEN {quoted(k)} THEN (" + " OR ".join(f"contains(lower({text}), {quoted(n)})" for n in needles) + ")" for k, needles in T.NEEDLES[concept].items()) + " ELSE false END"


def found(body: str, law: str, message: str, confidence: str = "'High'", row: str = "row") -> str:
    return f"SELECT path, CAST({row} AS INT) AS row, '{law}' AS law, {message} AS message, {confidence} AS confidence FROM {body}"


PERF_EXEMPT = "(" + " OR ".join([*(f"contains(path, {quoted(x)})" for x in T.PERF_EXEMPT), f"ends_with(path, {quoted(T.PERF_EXEMPT_END)})"]) + ")"
SYSTEMS = " + ".join(f"CASE WHEN {' OR '.join(f'contains(content, {quoted(n)})' for n in needles)} THEN {w} ELSE 0 END" for w, needles in T.SYSTEMS_SIGNS)
WORDS = "list_transform(list_filter(CASE WHEN contains(name, '_') THEN string_split(name, '_') ELSE string_split(regexp_replace(regexp_replace(name, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g'), '(^| )(\\p{Lu}+)(\\p{Lu}\\p{Ll})', '\\1\\2 \\3', 'g'), ' ') END, lambda w: w <> ''), lambda w: lower(w))"


def sentence(verb: str, rest: str) -> str:
    return f"CASE WHEN {rest} = '' THEN 'Implements ' || {verb} || ' functionality.' " + " ".join(f"WHEN {verb} IN {listed(v)} THEN {quoted(a)} || {rest} || {quoted(b)}" for v, a, b in T.VERB_SENTENCES) + f" ELSE 'Implements ' || {verb} || ' ' || {rest} || '.' END"


PRIORITY = "CASE " + " ".join(f"WHEN verb IN {listed(v)} THEN {k}" for k, v in enumerate(T.VERB_PRIORITY)) + f" ELSE {len(T.VERB_PRIORITY)} END"


def garbled(t: str) -> str:
    return f"(trim({t}) = '' OR (regexp_full_match(trim({t}), '[a-z]{{1,2}}') AND trim({t}) NOT IN {listed(T.SHORT_THEMES)}))"


_BARE = lambda x: f"lower(regexp_replace(regexp_replace(regexp_replace(trim({x}), '^\\(+', ''), '\\)+$', ''), ':+$', ''))"
_INDEX = lambda x: f"({_BARE(x)} <> '' AND NOT regexp_full_match({_BARE(x)}, '[0-9]+') AND (" + " OR ".join(f"contains({_BARE(x)}, '{n}')" for n in T.INDEX_NAMES) + f" OR (regexp_full_match({_BARE(x)}, '[a-z0-9_.\\[\\]]*') AND NOT regexp_matches({_BARE(x)}, 'len|size|empty'))))"



def _mutating(verbs: str, law: str, kind: str) -> str:
    pattern = "\\bfn\\s+((?:" + verbs + ")_[A-Za-z0-9_]*)\\s*(?:<[^>]*>)?\\(\\s*&?\\s*(?:mut\\s+self|''[a-z]+\\s+mut\\s+self)"
    return f"WITH {LINES}, y AS (SELECT *, regexp_extract(line, '{pattern}', 1) AS name FROM l WHERE lang = 'rust') " + found("y WHERE name <> ''", law, f"'{kind} ''' || name || ''' takes its object to change it'")


RULES = {
    "rule_naming": f"WITH {LINES}, n AS (SELECT *, {WORDS} AS w FROM (SELECT path, row, regexp_extract(line, '\\b(?:fn|def|function)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM l) WHERE name <> '') "
    + found("n WHERE len(w) > 10", "LAW OF COMPLEXITY", "'Function ''' || name || ''' has ' || len(w) || ' words; try ''' || list_aggregate(w[1:3], 'string_agg', '_') || ''''"),
    "rule_length_bounds": f"""WITH {LINES}, s AS (SELECT *, CASE WHEN contains(t, '<=') THEN '<=' WHEN contains(t, '>=') THEN '>=' END AS op FROM (SELECT *, trim(line) AS t FROM l)),
    p AS (SELECT *, trim(substr(t, 1, instr(t, op) - 1)) AS a, trim(substr(t, instr(t, op) + 2)) AS b FROM s WHERE op IS NOT NULL),
    q AS (SELECT *, {has('lang', 'length', 'a')} AS al, {has('lang', 'length', 'b')} AS bl FROM p) """
    + found(f"q WHERE al <> bl AND ((bl AND op = '<=' AND {_INDEX('a')}) OR (al AND op = '>=' AND {_INDEX('b')}))", "L02", "'Inclusive bound: ' || trim(line)"),
    "rule_looped_lookups": f"WITH {LINES}, w AS (SELECT path FROM g WHERE NOT regexp_matches(lower(path), '(^|/)tests?/|_test\\.|\\.test\\.|\\.spec\\.') AND NOT {PERF_EXEMPT} AND {has('lang', 'loop', 'content')} AND {has('lang', 'lookup', 'content')}), f AS (SELECT path, min(row) AS row FROM l WHERE path IN (SELECT path FROM w) AND {has('lang', 'lookup', 'line')} GROUP BY path) "
    + found("f", "P06", "'Linear lookup in a loop'", "'Medium'"),
    "rule_front_accesses": f"WITH {LINES}, w AS (SELECT path FROM g WHERE NOT {has('lang', 'collection_guard', 'content')}) " + found(f"l WHERE path IN (SELECT path FROM w) AND {has('lang', 'front_access', 'line')}", "L03", "'Element taken without a check for emptiness'"),
    "rule_formatted_sql": f"WITH {LINES} " + found("l WHERE contains(line, 'format!(') AND regexp_matches(upper(line), 'SELECT |INSERT INTO|UPDATE |DELETE FROM') AND (contains(line, '{}') OR contains(line, '{:'))", "X01", "'SQL built by formatting'"),
    "rule_hardcoded_secrets": f"""WITH {LINES}, n AS (SELECT *, regexp_extract(line, '\\b(?:let|const|static)\\s+(?:mut\\s+)?([A-Za-z_][A-Za-z0-9_]*)', 1) AS name, regexp_extract(line, '=\\s*("(?:[^"\\\\]|\\\\.)*")', 1) AS lit FROM l) """
    + found("n WHERE regexp_matches(name, '(?i)(key|secret|token|password|auth)') AND strlen(lit) >= 5 AND NOT regexp_matches(lit, '(?i)(example|placeholder|test|dummy|xxx|your_)')", "X03", "'Hardcoded secret in ''' || name || ''''"),
    "rule_locks_across_await": f"""WITH {LINES}, e AS (SELECT *, regexp_matches(line, '\\blet\\b.*\\.(lock|read|write)\\(\\)') AS takes, regexp_matches(trim(line), '^\\}}') OR contains(line, 'drop(') AS frees FROM l WHERE path IN (SELECT path FROM g WHERE contains(content, '.await') AND contains(content, 'async fn'))),
    h AS (SELECT *, last_value(CASE WHEN takes THEN 1 WHEN frees THEN 0 END IGNORE NULLS) OVER w AS held, last_value(CASE WHEN takes THEN CASE WHEN {has("'rust'", 'async_locking', 'line')} THEN 'async' ELSE 'sync' END END IGNORE NULLS) OVER w AS kind
          FROM e WINDOW w AS (PARTITION BY path ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) """
    + found("h WHERE held = 1 AND contains(line, '.await') AND NOT takes", "C03", "'Lock guard held across an await'", "CASE WHEN kind = 'sync' THEN 'High' ELSE 'Medium' END"),
    "rule_undocumented_locks": f"WITH {LINES}, b AS (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY row) AS before FROM l) "
    + found("b WHERE regexp_matches(line, '^\\s*(?:pub(?:\\([a-z]+\\))?\\s+)?[a-z_][a-z0-9_]*\\s*:\\s*[A-Za-z0-9_:<]*(?:Mutex|RwLock)<') AND NOT coalesce(regexp_matches(trim(before), '^//'), false)", "C04", "'Lock without a comment on what it protects'", "'Medium'", "row - 1"),
    "rule_unsafe_blocks": f"WITH {LINES}, b AS (SELECT *, " + ", ".join(f"coalesce(trim(lag(line, {k}) OVER (PARTITION BY path ORDER BY row)), '') AS b{k}" for k in (1, 2, 3)) + " FROM l) "
    + found("b WHERE regexp_matches(line, '\\bunsafe\\s*\\{') AND NOT (b1 LIKE '//%' AND (contains(b1, 'SAFETY:') OR (b2 LIKE '//%' AND (contains(b2, 'SAFETY:') OR (b3 LIKE '//%' AND contains(b3, 'SAFETY:'))))))", "LAW OF PARANOIA", "'Unsafe block without a SAFETY comment'"),
    "rule_global_state": f"WITH {LINES}, n AS (SELECT *, regexp_extract(line, '\\bpub\\s+static\\s+(?:mut\\s+)?([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM l) "
    + found("n WHERE regexp_matches(line, '\\bstatic\\s+mut\\s')", "S01", "'Mutable static'", "'Medium'", "row - 1") + " UNION ALL " + found("n WHERE name <> '' AND NOT regexp_full_match(name, '[A-Z_]+')", "S02", "'Public static ''' || name || ''''", "'Medium'", "row - 1"),
    "rule_predicates": f"WITH {LINES}, n AS (SELECT *, regexp_extract(line, '\\bfn\\s+((?:is|has|can|should)_[A-Za-z0-9_]*)', 1) AS name, regexp_extract(line, '->\\s*([^{{;]+?)\\s*(?:\\{{|;|$)', 1) AS returns FROM l) "
    + found("n WHERE name <> '' AND returns <> '' AND returns <> 'bool'", "M04", "'''' || name || ''' returns ' || returns"),
    "rule_unwraps": f"WITH {LINES} " + found(f"l WHERE lang = 'rust' AND NOT regexp_matches(lower({NAME}), 'test|spec') AND regexp_matches(line, '\\.(?:unwrap\\(\\)|expect\\()')", "LAW OF PARANOIA", "'Unchecked ' || regexp_extract(line, '\\.(unwrap|expect)\\(', 1)"),
    "rule_index_zero": f"""WITH {LINES}, w AS (SELECT path FROM g WHERE {has('lang', 'collection_guard', 'content')} OR contains(content, 'chunks_exact(') OR contains(content, 'array_chunks(')), z AS (SELECT *, regexp_extract(line, '(self\\.[A-Za-z0-9_.]+)\\[0\\]', 1) AS f FROM l WHERE lang = 'rust'),
    y AS (SELECT *, min(row) OVER (PARTITION BY path, f) AS lead_row FROM z) """
    + found("y WHERE contains(line, '[0]') AND path NOT IN (SELECT path FROM w) AND (f = '' OR row = lead_row)", "L03", "'Index 0 taken without a check of bounds'", "CASE WHEN f <> '' THEN 'Medium' ELSE 'High' END"),
    "rule_global_containers": f"""WITH {LINES}, y AS (SELECT *, last_value(CASE WHEN contains(line, 'lazy_static!') THEN 1 WHEN trim(line) = '}}' THEN 0 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY row) AS lazy FROM l) """
    + found("y WHERE lang = 'rust' AND lazy = 1 AND (" + " OR ".join(f"contains(line, '{c}')" for c in T.GLOBAL_CONTAINERS) + ")", "S03", "'Container in a lazy static'", "'Medium'", "row - 1"),
    "rule_mutating_getters": _mutating("get|is|has", "M03", "Getter"),
    "rule_mutating_calculators": _mutating("calculate|compute|count|sum", "M05", "Calculation"),
    "rule_manual_conversions": f"WITH {LINES}, y AS (SELECT *, concat_ws(' ', line, " + ", ".join(f"lead(line, {k}) OVER (PARTITION BY path ORDER BY row)" for k in range(1, 6)) + ") AS body FROM l) "
    + found("y WHERE lang = 'rust' AND regexp_matches(trim(line), '^impl\\s*From[< ]') AND NOT contains(lower(body), 'err')", "I01", "'Hand-written From'", "'Info'"),
}

ATOMICITY = f"""WITH code AS ({I.for_duckdb("@")}), g AS (SELECT path, content, {LANG} AS lang FROM code WHERE {KIND} = 'SourceCode'),
c AS (SELECT path, 1 AS row, {TOKENS} AS n, CASE WHEN {SYSTEMS} >= 3 THEN 10000 ELSE 2000 END AS lim FROM g) """ + found("c WHERE n > lim", "LAW OF ATOMICITY", "'File has ' || n || ' tokens (limit ' || lim || ')'")


def _scan() -> str:
    parts = [f"SELECT * FROM ({sql})" for sql in [*(sql for name, sql in RULES.items() if name != "rule_unwraps"), ATOMICITY.replace("@", I.for_duckdb(I.CODE))]]
    return "v AS (" + " UNION ALL ".join(parts) + ")"


SCAN = _scan()
EDGES, TRADE = source("e", I.EDGES), source("e", I.TRADE)
COUPLING = f"{EDGES}, k AS (SELECT path, CAST(sum(a) AS BIGINT) AS ca, CAST(sum(b) AS BIGINT) AS ce FROM (SELECT src AS path, 0 AS a, 1 AS b FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY path)"
IDENTITY = "CASE WHEN ca > 20 AND ce > 20 THEN 'GodModule' WHEN ca + ce < 2 THEN 'IsolatedDeadwood' WHEN ca >= 3 THEN 'StableHub' WHEN ln((ca + 1.0) / (ce + 1.0)) < 0 AND ce >= 5 THEN 'VolatileLeaf' ELSE 'Standard' END"
SHARED = "len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i]))"
TOP = lambda c: f"CASE WHEN list_position(string_split({c}, '/'), 'src') > 0 THEN string_split({c}, '/')[list_position(string_split({c}, '/'), 'src') + 1] END"
JUDGED = f"""{COUPLING}, d AS (SELECT e.*, ca, ce, {IDENTITY} AS identity, string_split(src, '/') AS x, string_split(dst, '/') AS y FROM e JOIN k ON path = dst),
f AS (SELECT *, CAST(len(x) + len(y) - 2 * {SHARED} AS INT) AS distance FROM d),
j AS (SELECT *, CASE WHEN x[-1] IN ('lib.rs', 'main.rs') OR (x[-1] = 'mod.rs' AND starts_with(dst, src[:-7])) OR (y[-1] = 'mod.rs' AND starts_with(src, dst[:-7])) OR {TOP('src')} = {TOP('dst')}
  OR (list_position(y, 'src') > 0 AND len(y) - list_position(y, 'src') = 1) THEN 'Exempted' WHEN distance <= 2 THEN 'L1Cache' WHEN distance <= 4 THEN 'WithinDistance' WHEN identity = 'StableHub' THEN 'VerticalRouting' END AS reason FROM f)"""


def ranks(anchor: str | None) -> str:
    restart = "1.0 / n" if anchor is None else f"CASE WHEN path = '{anchor}' THEN 1.0 ELSE 1.0 / n END"
    steps = [f"WITH {TRADE}, s AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e), v AS (SELECT path, count(*) OVER () AS n FROM (SELECT src AS path FROM e UNION SELECT dst FROM e)), r0 AS MATERIALIZED (SELECT path, 1.0 / n AS rank FROM v)"]
    for k in range(1, 21):
        steps.append(f"i{k} AS (SELECT dst, sum(rank * share) AS w FROM s JOIN r{k - 1} ON path = src GROUP BY dst), t{k} AS (SELECT v.path, 0.15 * {restart.replace('path', 'v.path')} + 0.85 * coalesce(w, 0) AS raw FROM v LEFT JOIN i{k} ON v.path = dst), r{k} AS MATERIALIZED (SELECT path, raw / sum(raw) OVER () AS rank FROM t{k})")
    return ", ".join(steps) + " SELECT path, round(CAST(rank AS DOUBLE), 9) AS rank FROM r20"


SCOPES, FIELDS, METHODS = source("sc", I.SCOPES), source("fi", I.FIELDS), source("me", I.METHODS)
COMPONENTS = f"""{METHODS}, links AS (SELECT DISTINCT a.path, a.scope, a.name AS x, b.name AS y FROM me a JOIN me b ON a.path = b.path AND a.scope = b.scope AND a.name <> b.name
  AND (list_has_any(a.field_access, b.field_access) OR list_contains(a.internal_calls, b.name) OR list_contains(b.internal_calls, a.name))),
reach(path, scope, x, y) AS (SELECT path, scope, name, name FROM me UNION SELECT r.path, r.scope, r.x, k.y FROM reach r JOIN links k ON r.path = k.path AND r.scope = k.scope AND r.y = k.x),
lc AS (SELECT path, scope, count(DISTINCT low) AS lcom4, count(*) AS n_methods FROM (SELECT path, scope, x, min(y) AS low FROM reach GROUP BY ALL) GROUP BY path, scope)"""
CALLS = "cb AS (SELECT path, scope, count(DISTINCT call) AS cbo FROM (SELECT path, scope, unnest(external_calls) AS call FROM me) GROUP BY path, scope), sf AS (SELECT path, scope, max(len(list_distinct(external_calls))) AS sfout FROM me GROUP BY path, scope)"
HIDING = "ah AS (SELECT sc.path, sc.scope, coalesce(n, 0) AS n_fields, coalesce(p, 0) AS n_private, CASE WHEN coalesce(n, 0) = 0 THEN 100.0 ELSE p / n * 100 END AS ahf FROM sc LEFT JOIN (SELECT path, scope, count(*) AS n, count(*) FILTER (NOT is_public) AS p FROM fi GROUP BY path, scope) c ON sc.path = c.path AND sc.scope = c.scope)"
_IMPORT = {
    "rust": "list_concat(list_concat(regexp_extract_all(content, 'mod\\s+([A-Za-z0-9_]+);', 1), regexp_extract_all(content, 'use\\s+(?:crate|super|self)::([A-Za-z0-9_]+)', 1)), list_filter(flatten(list_transform(regexp_extract_all(content, 'use\\s+crate::\\{([^}]+)\\}', 1), lambda g: list_transform(string_split(g, ','), lambda s: trim(string_split(trim(s), '::')[1])))), lambda h: regexp_matches(h, '^[a-z]')))",
    "python": "list_concat(regexp_extract_all(content, '(?m)^\\s*from\\s+([.A-Za-z0-9_]+)\\s+import', 1), regexp_extract_all(content, '(?m)^\\s*import\\s+([.A-Za-z0-9_]+)', 1))",
    "typescript": "list_filter(regexp_extract_all(content, '(?:from\\s+|require\\(\\s*|import\\(\\s*|import\\s+)[\"'']([^\"''\\n]+)[\"'']', 1), lambda s: NOT starts_with(s, 'node:'))",
    "javascript": "list_filter(regexp_extract_all(content, '(?:from\\s+|require\\(\\s*|import\\(\\s*|import\\s+)[\"'']([^\"''\\n]+)[\"'']', 1), lambda s: NOT starts_with(s, 'node:'))",
    "go": "regexp_extract_all(coalesce(list_aggregate(regexp_extract_all(content, '(?s)import\\s*\\(([^)]*)\\)', 1), 'string_agg', chr(10)), ''), '\"([^\"\\n]+)\"', 1)",
}
IMPORTS = f"{CODE}, im AS (SELECT DISTINCT path, unnest(CASE {LANG} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _IMPORT.items()) + " END) AS import FROM code)"
HERE = "regexp_replace(path, '/?[^/]*$', '')"
_TOKEN = "==|!=|<=|>=|&&|\\|\\||\\band\\b|\\bor\\b|\\btrue\\b|\\bfalse\\b|\\bTrue\\b|\\bFalse\\b"

ON_MIXED = ("rule_unwraps", "rule_index_zero", "rule_global_containers", "rule_mutating_getters", "rule_mutating_calculators", "rule_manual_conversions")
MIXED = {name: sql.replace(CODE, source("code", I.MIXED)) for name, sql in RULES.items()}


def _any(text: str, needles) -> str:
    return "(" + (" OR ".join(f"contains(lower({text}), {quoted(n)})" for n in needles) or "false") + ")"


IS_TEST = f"CASE {LANG} " + " ".join(f"WHEN '{lang}' THEN {_any('path', paths)} OR {_any('content', needles)}" for lang, (paths, needles, _) in T.TEST_SIGNS.items()) + " ELSE false END"
_HEAD = lambda x: f"split_part(trim({x}), '. ', 1)"
SENTENCE = lambda x: f"CASE WHEN ends_with({_HEAD(x)}, '.') THEN {_HEAD(x)} ELSE {_HEAD(x)} || '.' END"


def of_item(x: str) -> str:
    t = f"regexp_replace(trim({x}), '\\.+$', '')"
    words = f"list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> '')"
    first, second = f"coalesce({words}[1], '')", f"coalesce({words}[2], '')"
    verb = f"({first} IN {listed(T.DOC_VERBS)} OR CASE WHEN ends_with({first}, 'ies') THEN {first}[:-4] || 'y' IN {listed(T.DOC_VERBS)} WHEN ends_with({first}, 's') THEN {first}[:-2] IN {listed(T.DOC_VERBS)} OR (ends_with({first}, 'es') AND {first}[:-3] IN {listed(T.DOC_VERBS)}) ELSE false END)"
    starts = lambda prefixes: "(" + " OR ".join(f"starts_with(lower({t}), {quoted(q)})" for q in prefixes) + ")"
    return f"({_any(t, T.LICENSE_SIGNS)} OR {verb} OR ({second} IN ('is', 'are', 'was', 'were') AND {first} NOT IN ('this', 'it', 'there', 'here')) OR {starts(T.STATE_PREFIXES)} OR regexp_matches({t}, '^[aA][nN]? \\p{{Ll}}') OR {starts(T.QUANTITY_PREFIXES)} OR {_any(t, T.INTERNAL_TERMS)} OR regexp_matches({t}, '(?::|-|e\\.g)$') OR len({words}) < 3)"


_SCRIPT_FILE = lambda q: f"'src/m' || ({q}) % 40 || '/p' || ({q}) || '.ts'"
_SCRIPT_EDGE = lambda shift: f"SELECT {_SCRIPT_FILE('p_partkey')} AS src, {_SCRIPT_FILE(f'p_partkey + {shift}')} AS dst FROM part WHERE p_partkey + {shift} IN (SELECT p_partkey FROM part)"
GUIDANCE = "(VALUES " + ", ".join(f"({quoted(law)}, {quoted(why)}, {quoted(fix)})" for law, (why, fix) in T.GUIDANCE.items()) + ") AS gd(law, why, fix)"
MARKERS = "(VALUES " + ", ".join(f"({quoted(name)}, {k}, {quoted(kind)})" for k, (name, kind) in enumerate(T.PROJECT_MARKERS)) + ") AS mk(name, k, kind)"
CATEGORY = "CASE WHEN y[-1] <> 'mod.rs' AND len(y) > 2 THEN 'ENCAPSULATION_BREACH' WHEN ca >= 3 AND identity <> 'StableHub' THEN 'MISSING_HUB' ELSE 'SIDEWAYS_DEP' END"
ORACLE_SQL = {
    "file_kind": f"WITH {source('p', I.PATHS)} SELECT path, {KIND} AS kind, {EXT} AS ext, {LANG} AS lang FROM p",
    "discovered_files": f"WITH {source('p', I.PATHS)} SELECT path FROM p WHERE NOT list_has_any(string_split(path, '/'), {PRUNED.replace('(', '[').replace(')', ']')}) AND NOT regexp_matches(path, 'core/tests') AND CASE WHEN regexp_matches({NAME}, {quoted(T.BINARY_FILE)}) OR regexp_matches({NAME}, {quoted(T.SECRET_FILE)}) THEN false WHEN regexp_matches({NAME}, {quoted(T.CODE_FILE)}) OR regexp_matches({NAME}, {quoted(T.CODE_NAME)}) THEN true ELSE starts_with(content, '#!') END",
    "files_by_directory": f"WITH {source('p', I.PATHS)} SELECT {HERE} AS directory, count(*) AS n_files, min(path) AS first_path, max(path) AS last_path FROM p GROUP BY 1",
    "production_sources": f"WITH {source('p', I.PATHS)} SELECT count(*) AS n_sources, count(*) >= 10 AS deep FROM p WHERE contains(path, 'src/') AND NOT contains(lower(path), 'test')",
    "systems_score": f"WITH {CODE} SELECT path, {SYSTEMS} AS score FROM code",
    "token_totals": f"WITH {source('p', I.SOURCES)} SELECT {EXT} AS ext, count(*) AS n_files, CAST(sum({TOKENS}) AS BIGINT) AS n_tokens, max({TOKENS}) AS most FROM p GROUP BY 1",
    "sha256_normalised": "SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS sha256 FROM documents",
    "split_identifiers": f"WITH {source('p', I.NAMES)} SELECT id, name, list_aggregate({WORDS}, 'string_agg', ' ') AS words, len({WORDS}) AS n_words FROM p",
    "expanded_identifiers": f"WITH {source('p', I.NAMES)}, w AS (SELECT id, {WORDS} AS w FROM p) SELECT id, {sentence('w[1]', 'coalesce(list_aggregate(w[2:], ' + quoted('string_agg') + ', ' + quoted(' ') + '), ' + quoted('') + ')')} AS sentence FROM w",
    "export_summaries": f"""WITH {source('p', I.NAMES)}, w AS (SELECT CAST(id % 50 AS VARCHAR) AS path, id, name, {WORDS} AS w FROM p), t AS (SELECT *, w[1] AS verb, coalesce(list_aggregate(w[2:], 'string_agg', ' '), '') AS theme FROM w),
    b AS (SELECT path, verb, count(*) AS n, arg_max(theme, (strlen(theme), id)) AS best FROM t GROUP BY path, verb), top AS (SELECT path, verb, best FROM b QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, {PRIORITY}, verb DESC) = 1),
    f AS (SELECT path, arg_min(w, id) AS fw, arg_min(name, id) AS first, count(*) AS n FROM t GROUP BY path), z AS (SELECT *, coalesce(list_aggregate(fw[2:], 'string_agg', ' '), '') AS rest FROM f JOIN top USING (path))
    SELECT path, CASE WHEN n = 1 OR strlen(best) < 3 OR {garbled('best')} THEN CASE WHEN strlen(rest) < 3 AND {garbled('rest')} THEN 'Implements ' || first || ' functionality.' ELSE {sentence('fw[1]', 'rest')} END ELSE {sentence('verb', 'best')} END AS summary FROM z""",
    "comment_nouns": f"WITH w AS (SELECT source AS path, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM documents), c AS (SELECT path, word, count(*) AS n FROM w WHERE length(word) > 2 AND word NOT IN {listed(STOP_WORDS)} AND NOT regexp_matches(word, '(ing|ed)$') GROUP BY ALL) SELECT path, word, n, row_number() OVER (PARTITION BY path ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 5",
    "concepts": f"WITH {CODE} SELECT path, " + ", ".join(f"{has(LANG, n, 'content')} AS {n}" for n in T.NEEDLES) + " FROM code",
    **RULES,
    **{name: MIXED[name] for name in ON_MIXED},
    "mixed_findings": "SELECT law, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM ({MIXED[name]})" for name in (*ON_MIXED, "rule_unsafe_blocks", "rule_global_state", "rule_predicates", "rule_undocumented_locks")) + ") AS v GROUP BY law",
    "test_contexts": f"WITH {source('p', I.SOURCES)} SELECT path, {IS_TEST} AS is_test, regexp_matches(content, '#\\s*\\[\\s*(?:cfg\\s*\\(\\s*test\\s*\\)|test)\\s*\\]') AS inline_tests, {PERF_EXEMPT} AS perf_exempt FROM p",
    "build_systems": f"WITH {source('p', I.BUILDS)} SELECT DISTINCT build_system FROM (SELECT CASE WHEN {EXT} = 'cmake' THEN 'CMake' ELSE CASE {NAME} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in T.BUILD_FILES.items()) + " END END AS build_system FROM p) AS b WHERE build_system IS NOT NULL",
    "project_types": f"WITH {source('p', I.BUILDS)} SELECT coalesce(arg_min(kind, k), 'unknown') AS project_type FROM p JOIN {MARKERS} ON {NAME} = name",
    "files_to_mutate": f"WITH {source('p', I.PATHS)} SELECT path FROM p WHERE contains(path, 'core/')",
    "item_docs": f"WITH {source('p', I.DOCS)} SELECT path, {of_item('said')} AS of_item FROM p",
    "module_docs": f"WITH {source('p', I.DOCS)} SELECT path, CASE WHEN doc_id % 5 = 0 THEN {SENTENCE("trim(said) || ' end'")} WHEN doc_id % 5 IN (1, 4) THEN CASE WHEN NOT {of_item(SENTENCE('said'))} THEN {SENTENCE('said')} END ELSE {SENTENCE('said')} END AS doc FROM p",
    "cpp_exports": f"WITH {source('p', I.CPP)}, t AS (SELECT *, ends_with(path, '.h') AS header FROM p) SELECT path, 'K' || regexp_extract(path, 'c(\\d+)\\.', 1) || CASE WHEN header THEN ',' || regexp_extract(content, 'declared_\\d+') ELSE '' END || ',' || regexp_extract(content, 'made\\d+') AS names FROM t",
    "aliased_imports": _SCRIPT_EDGE(5),
    "go_imports": f"WITH {source('p', I.GO_FILES)}, d AS (SELECT path, CAST(regexp_extract(path, '^pkg(\\d+)/', 1) AS BIGINT) AS d, ends_with(path, '_test.go') AS t FROM p) SELECT x.path AS src, y.path AS dst FROM d x JOIN d y ON y.d = x.d + 8 WHERE x.t OR NOT y.t",
    "import_verdicts": "WITH " + JUDGED.replace(EDGES, f"e AS ({_SCRIPT_EDGE(-13)} UNION ALL {_SCRIPT_EDGE(5)})") + " SELECT identity, distance, reason, reason IS NOT NULL AS passed, count(*) AS n FROM j GROUP BY ALL",
    "layered_categories": f"WITH RECURSIVE {JUDGED}, d2 AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), n2 AS (SELECT src AS path FROM d2 UNION SELECT dst FROM d2), r2(path, layer) AS (SELECT path, 0 FROM n2 WHERE path NOT IN (SELECT src FROM d2) UNION SELECT src, layer + 1 FROM d2 JOIN r2 ON dst = path), m2 AS (SELECT path, max(layer) AS layer FROM r2 GROUP BY path), "
    f"c2 AS (SELECT {CATEGORY} AS category, a.layer < b.layer AS up FROM j LEFT JOIN m2 a ON a.path = src LEFT JOIN m2 b ON b.path = dst WHERE reason IS NULL) SELECT CASE WHEN category = 'SIDEWAYS_DEP' AND up THEN 'UPWARD_DEP' ELSE category END AS category, count(*) AS n FROM c2 GROUP BY 1",
    "locality_report": f"WITH {JUDGED}, x AS (SELECT *, {CATEGORY} AS category FROM j WHERE reason IS NULL) SELECT 0 AS section, printf('Edges: %d, failed: %d, health: %.1f%%', count(*), count(*) FILTER (reason IS NULL), (1 - count(*) FILTER (reason IS NULL) / count(*)) * 100) AS line FROM j "
    "UNION ALL SELECT 1, category || ': ' || count(*) FROM x GROUP BY category UNION ALL SELECT * FROM (SELECT 2, src || ' fails ' || count(*) || ' times' FROM x GROUP BY src HAVING count(*) >= 3 ORDER BY count(*) DESC, src LIMIT 10)",
    "guided_findings": f"WITH {SCAN} SELECT v.law, why, fix, count(*) AS n FROM v LEFT JOIN {GUIDANCE} ON gd.law = v.law GROUP BY ALL",
    "sorted_files": f"WITH {SCAN} SELECT path, count(*) AS n FROM v GROUP BY path",
    "maximal_spans": f"WITH {source('s', I.SPANS)}, b AS (SELECT DISTINCT * FROM s) SELECT path, low, high FROM b QUALIFY coalesce(high > max(high) OVER (PARTITION BY path ORDER BY low, high DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)",
    "text_report": f"WITH {SCAN}, {CODE} SELECT 0 AS section, printf('Files: %d, tokens: %d, findings: %d, clean files: %d', (SELECT count(*) FROM code), (SELECT CAST(sum({TOKENS}) AS BIGINT) FROM code), count(*), (SELECT count(*) FROM code) - count(DISTINCT path)) AS line FROM v "
    "UNION ALL SELECT 1, printf('[%s] %d', law, count(*)) FROM v GROUP BY law UNION ALL SELECT 2, printf('%s: %d runs, %d failed', event_type, count(*), count(*) FILTER (NOT value > 50)) FROM events GROUP BY event_type",
    "file_reports": f"""WITH {CODE}, r AS ({RULES['rule_hardcoded_secrets']}), b AS (SELECT path, string_agg('{{"row":' || row || ',"law":"' || law || '","message":"' || message || '","confidence":"' || confidence || '"}}', ',' ORDER BY row, law, message) AS found FROM r GROUP BY path)
    SELECT code.path, '{{"path":"' || code.path || '","token_count":' || {TOKENS} || ',"violations":[' || coalesce(found, '') || ']}}' AS report FROM code LEFT JOIN b ON b.path = code.path""",
    "output_counts": "WITH o AS (SELECT doc_id AS command, string_split(concat_ws(chr(10), text, CASE WHEN doc_id % 3 = 0 THEN 'error: x' || chr(10) || 'warning: y' || chr(10) || 'an error' END), chr(10)) AS ls FROM documents) SELECT command, CAST(len(list_filter(ls, lambda x: contains(x, 'error'))) AS INT) AS n_errors, CAST(len(list_filter(ls, lambda x: contains(x, 'warning'))) AS INT) AS n_warnings FROM o",
    "event_log": """SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS value FROM events""",
    "rule_atomicity": ATOMICITY.replace("@", I.for_duckdb(I.SOURCES)),
    "count_by_law": f"WITH {SCAN} SELECT law, count(*) AS n FROM v GROUP BY law",
    "report_totals": f"WITH {SCAN}, {CODE} SELECT (SELECT count(*) FROM code) AS n_files, (SELECT CAST(sum({TOKENS}) AS BIGINT) FROM code) AS n_tokens, count(*) AS n_violations, count(*) FILTER (confidence = 'Info') AS n_info, count(*) FILTER (confidence = 'Medium') AS n_medium, count(*) FILTER (confidence = 'High') AS n_high, (SELECT count(*) FROM code) - count(DISTINCT path) AS n_clean_files, count(*) = 0 AS passed FROM v",
    "gate_verdict": f"WITH {SCAN} SELECT count(*) AS n_commands, count(*) FILTER (event_type = 'error') AS n_failed, count(*) FILTER (event_type = 'error') = 0 AND (SELECT count(*) = 0 FROM v) AS passed FROM events",
    "top_files": f"WITH {SCAN} SELECT path, count(*) AS n FROM v GROUP BY path ORDER BY n DESC, path LIMIT 5",
    "numbered_violations": f"WITH {SCAN} SELECT path, row, law, row_number() OVER (PARTITION BY law ORDER BY path, row, message) AS k, count(*) OVER (PARTITION BY law) AS n FROM v",
    "violation_snippets": f"WITH {CODE}, al AS (SELECT path, unnest(range(1, len(ls) + 1)) AS row, unnest(ls) AS line FROM (SELECT path, string_split(content, chr(10)) AS ls FROM code)), a AS (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY row) AS before, lead(line) OVER (PARTITION BY path ORDER BY row) AS after FROM al), r AS ({RULES['rule_looped_lookups']}) SELECT r.path, r.row, before, line, after FROM r LEFT JOIN a ON r.path = a.path AND r.row = a.row",
    "one_line_findings": f"WITH r AS ({RULES['rule_hardcoded_secrets']}) SELECT path || ':' || row || ': error: [' || law || '] ' || message AS text FROM r",
    "import_strings": f"WITH {IMPORTS} SELECT path, import FROM im",
    "resolved_imports": f"""WITH {IMPORTS}, h AS (SELECT *, {HERE} AS here, {EXT} AS ext FROM im), c AS (
      SELECT path, import, unnest(CASE ext WHEN 'rs' THEN [here || '/' || replace(import, '::', '/') || '.rs', here || '/' || replace(import, '::', '/') || '/mod.rs', 'src/' || replace(import, '::', '/') || '.rs', 'src/' || replace(import, '::', '/') || '/mod.rs']
        WHEN 'py' THEN CASE WHEN starts_with(import, '.') THEN [here || '/' || import[2:] || '.py', here || '/' || import[2:] || '/__init__.py'] ELSE [import || '.py', import || '/__init__.py'] END
        WHEN 'ts' THEN CASE WHEN starts_with(import, './') THEN list_transform(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js'], lambda z: here || '/' || import[3:] || z) END END) AS cand, unnest(range(8)) AS prio FROM h)
    SELECT c.path AS src, arg_min(cand, prio) AS dst, import FROM c WHERE cand IN (SELECT path FROM code) GROUP BY c.path, import""",
    "taxonomy_badges": f"""WITH {source('f', I.FINGERPRINTS)}, b AS (SELECT *, len(list_filter(exports, lambda x: contains(x, 'Install'))) > 0 AND len(list_filter(exports, lambda x: contains(x, 'Uninstall'))) > 0 AS m, len(list_filter(exports, lambda x: contains(x, 'Fetch'))) > 0 AS fe,
      len(list_filter(param_types, lambda x: contains(x, 'http.ResponseWriter'))) > 0 AS ha, len(list_filter(annotations, lambda x: contains(x, 'gorm') OR contains(x, 'db') OR contains(x, 'serde'))) > 0 AS pe, len(list_filter(exports, lambda x: contains(x, 'Register'))) > 0 AS re FROM f)
    SELECT path, CASE WHEN pe THEN 'Persists' WHEN ha THEN 'Handles HTTP requests for' WHEN m THEN 'Manages' WHEN fe THEN 'Fetches' WHEN re THEN 'Registers' END AS role,
      CASE """ + " ".join(f"WHEN len(list_filter(strings, lambda x: regexp_matches(x, {quoted(p)}))) > 0 THEN {quoted(b)}" for b, p in T.DOMAINS) + " END AS domain, coalesce(list_aggregate(list_filter(["
    + ", ".join(f"CASE WHEN len(list_filter(imports, lambda x: starts_with(x, {quoted(p)}))) > 0 THEN {quoted(b)} END" for b, p in T.MECHANISMS) + "], lambda x: x IS NOT NULL)[1:2], 'string_agg', '|'), '') AS mechanisms FROM b",
    "project_badges": f"""WITH {source('f', I.FINGERPRINTS)}, b AS (SELECT *, len(list_filter(exports, lambda x: contains(x, 'Install'))) > 0 AND len(list_filter(exports, lambda x: contains(x, 'Uninstall'))) > 0 AS m, len(list_filter(exports, lambda x: contains(x, 'Fetch'))) > 0 AS fe, len(list_filter(exports, lambda x: contains(x, 'Run'))) > 0 AS ru,
      len(list_filter(param_types, lambda x: contains(x, 'http.ResponseWriter'))) > 0 AS ha, len(list_filter(annotations, lambda x: contains(x, 'gorm') OR contains(x, 'db') OR contains(x, 'serde'))) > 0 AS pe, len(list_filter(exports, lambda x: contains(x, 'Register'))) > 0 AS re FROM f)
    SELECT CASE WHEN pe THEN 'Persists' WHEN ha THEN 'Handles HTTP requests for' WHEN ru THEN 'Runs' WHEN m THEN 'Manages' WHEN fe THEN 'Fetches' WHEN re THEN 'Registers' END AS role, CASE WHEN len(list_filter(strings, lambda x: contains(x, 'Customer#'))) > 0 THEN 'customers' """
    + " ".join(f"WHEN len(list_filter(strings, lambda x: regexp_matches(x, {quoted(p)}))) > 0 THEN {quoted(b)}" for b, p in T.DOMAINS) + " END AS domain, coalesce(list_aggregate(list_filter(["
    + ", ".join(f"CASE WHEN len(list_filter(imports, lambda x: starts_with(x, {quoted(p)}))) > 0 THEN {quoted(b)} END" for b, p in [("files", "std::fs"), *T.MECHANISMS]) + "], lambda x: x IS NOT NULL)[1:2], 'string_agg', '|'), '') AS mechanisms, count(*) AS n FROM b GROUP BY ALL",
    "mutation_summary": "SELECT count(*) AS total, count(*) FILTER (l_returnflag <> 'R') AS killed, count(*) FILTER (l_returnflag = 'R') AS survived, count(*) FILTER (l_returnflag <> 'R') / count(*) * 100 AS score FROM lineitem",
    "coupling": f"WITH {COUPLING} SELECT path, ca, ce, round(ce / (ca + ce), 9) AS instability, round(ln((ca + 1.0) / (ce + 1.0)), 9) AS skew FROM k",
    "path_distance": f"WITH {EDGES}, d AS (SELECT DISTINCT src, dst, string_split(src, '/') AS x, string_split(dst, '/') AS y FROM e), s AS (SELECT *, {SHARED} AS n FROM d) SELECT src, dst, CAST(len(x) + len(y) - 2 * n AS INT) AS distance, coalesce(list_aggregate(x[1:n], 'string_agg', '/'), '') AS ancestor FROM s",
    "node_identity": f"WITH {COUPLING} SELECT {IDENTITY} AS identity, count(*) AS n FROM k GROUP BY 1",
    "edge_verdicts": f"WITH {JUDGED} SELECT identity, distance, reason, reason IS NOT NULL AS passed, count(*) AS n FROM j GROUP BY ALL",
    "edge_categories": f"""WITH {JUDGED} SELECT src, dst, distance, CASE WHEN y[-1] <> 'mod.rs' AND len(y) > 2 THEN 'ENCAPSULATION_BREACH' WHEN ca >= 3 AND identity <> 'StableHub' THEN 'MISSING_HUB' ELSE 'SIDEWAYS_DEP' END AS category,
    CASE WHEN y[-1] <> 'mod.rs' AND len(y) > 2 THEN 'Expose needed API from ''' || list_aggregate(y[1:-2], 'string_agg', '/') || '/mod.rs'' instead of importing ''' || dst || '''' WHEN ca >= 3 AND identity <> 'StableHub' THEN 'Promote ''' || dst || ''' to Hub (fan-in: ' || ca || '). Add to [rules.locality].hubs'
    ELSE 'Route through Hub or move ''' || dst || ''' closer' END AS suggestion FROM j WHERE reason IS NULL""",
    "locality_summary": f"WITH {JUDGED} SELECT count(*) AS total_edges, count(*) FILTER (reason IS NULL) AS failed_edges, round(count(*) FILTER (reason IS NULL) / count(*), 9) AS entropy, round((1 - count(*) FILTER (reason IS NULL) / count(*)) * 100, 6) AS health FROM j",
    "god_modules": f"WITH {JUDGED} SELECT src AS path, count(*) AS outbound_violations, count(DISTINCT dst) AS n_targets FROM j WHERE reason IS NULL GROUP BY src HAVING count(*) >= 3",
    "hub_candidates": f"WITH {JUDGED} SELECT dst AS path, count(*) AS n_importers, max(ca) AS fan_in FROM j WHERE reason IS NULL GROUP BY dst",
    "module_coupling": f"WITH {EDGES}, m AS (SELECT coalesce({TOP('src')}, 'unknown') AS a, coalesce({TOP('dst')}, 'unknown') AS b FROM e) SELECT least(a, b) AS module_a, greatest(a, b) AS module_b, count(*) AS n_edges FROM m WHERE a <> b GROUP BY ALL",
    "layers": f"WITH RECURSIVE {EDGES}, d AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), n AS (SELECT src AS path FROM d UNION SELECT dst FROM d), r(path, layer) AS (SELECT path, 0 FROM n WHERE path NOT IN (SELECT src FROM d) UNION SELECT src, layer + 1 FROM d JOIN r ON dst = path), m AS (SELECT path, max(layer) AS layer FROM r GROUP BY path) SELECT layer, count(*) AS n, min(path) AS first_path FROM m GROUP BY layer",
    "cyclic_core": f"WITH RECURSIVE {TRADE}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src), c AS (SELECT DISTINCT a AS path FROM r WHERE a = b), up AS (SELECT path FROM c UNION SELECT b FROM r JOIN c ON a = path), down AS (SELECT path FROM c UNION SELECT a FROM r JOIN c ON b = path) SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT path FROM up) AND dst IN (SELECT path FROM down)",
    "symbol_edges": f"WITH {source('de', I.DEFS)}, {source('re', I.REFS)}, x AS (SELECT DISTINCT path, string_split(name, '::')[-1] AS name FROM re) SELECT x.path AS src, de.path AS dst, count(*) AS weight FROM x JOIN de USING (name) WHERE x.path <> de.path GROUP BY ALL",
    "pagerank": ranks(None),
    "pagerank_anchored": ranks("n1"),
    "neighbours": f"WITH {TRADE}, o AS (SELECT DISTINCT dst AS path FROM e WHERE src = 'n1'), i AS (SELECT DISTINCT src AS path FROM e WHERE dst = 'n1') SELECT 'dependencies' AS kind, path FROM o UNION ALL SELECT 'dependents', path FROM i UNION ALL SELECT 'neighbours', path FROM (SELECT path FROM o UNION SELECT path FROM i)",
    "graph_hubs": f"WITH {EDGES} SELECT dst AS path, count(DISTINCT src) AS n_dependents FROM e GROUP BY dst HAVING count(DISTINCT src) >= 5",
    "lcom4": f"WITH RECURSIVE {COMPONENTS} SELECT * FROM lc",
    "external_coupling": f"WITH {METHODS}, {CALLS} SELECT cb.path, cb.scope, cbo, sfout FROM cb JOIN sf ON cb.path = sf.path AND cb.scope = sf.scope",
    "attribute_hiding": f"WITH {SCOPES}, {FIELDS}, {HIDING} SELECT path, scope, n_fields, n_private, round(ahf, 6) AS ahf FROM ah",
    "cohesion_violations": f"""WITH RECURSIVE {SCOPES}, {FIELDS}, {COMPONENTS}, {CALLS}, {HIDING}, be AS (SELECT path, scope, bool_or(cognitive > 0 OR is_mutable) AS hb, bool_or(len(field_access) > 0) AS uf, sum(cognitive) AS cx FROM me GROUP BY path, scope),
    z AS (SELECT sc.*, coalesce(lcom4, 0) AS lcom4, coalesce(n_methods, 0) AS n_methods, coalesce(cbo, 0) AS cbo, coalesce(sfout, 0) AS sfout, n_fields, ahf, coalesce(hb, false) AS hb, coalesce(uf, false) AS uf, coalesce(cx, 0) AS cx FROM sc JOIN ah USING (path, scope) LEFT JOIN lc USING (path, scope) LEFT JOIN cb USING (path, scope) LEFT JOIN sf USING (path, scope) LEFT JOIN be USING (path, scope)),
    o AS (SELECT path, row, 'LCOM4' AS law, 'Class ''' || scope || ''' has low cohesion (LCOM4: ' || lcom4 || ')' AS message FROM z WHERE NOT is_enum AND hb AND uf AND n_methods >= 4 AND lcom4 > 1
      UNION ALL SELECT path, row, 'AHF', 'Class ''' || scope || ''' exposes too much state (AHF: ' || printf('%.1f', ahf) || '%)' FROM z WHERE NOT is_enum AND NOT list_has_any(derives, {list(T.DATA_DERIVES)}) AND n_fields > 3 AND cx > 3 AND hb AND ahf < 60
      UNION ALL SELECT path, row, 'CBO', 'Class ''' || scope || ''' is tightly coupled (CBO: ' || cbo || ')' FROM z WHERE cbo > 9 UNION ALL SELECT path, row, 'SFOUT', 'Class ''' || scope || ''' has high fan-out (SFOUT: ' || sfout || ')' FROM z WHERE sfout > 7)
    SELECT *, 'Medium' AS confidence FROM o""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
