"""Imports by pattern, and their resolution against the known paths. imports(path, import)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.functions.tables import SCRIPT_EXTENSIONS
from archlens.functions.text import components, extension, language, parent
from archlens.operators.joins import dealt, met
from archlens.sources.corpus import tsconfig_paths


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def rust_modules(text: Column) -> Column:
    """mod x; use crate|super|self::x; and the lower-case heads of use crate::{...}."""
    heads = F.flatten(F.transform(_all(text, r"use\s+crate::\{([^}]+)\}"), lambda g: F.transform(F.split(g, ","), lambda s: F.trim(F.split(F.trim(s), "::")[0]))))
    return F.concat(_all(text, r"mod\s+([A-Za-z0-9_]+);"), _all(text, r"use\s+(?:crate|super|self)::([A-Za-z0-9_]+)"), F.filter(heads, lambda h: h.rlike("^[a-z]")))


def python_modules(text: Column) -> Column:
    return F.concat(_all(text, r"(?m)^\s*from\s+([.A-Za-z0-9_]+)\s+import"), _all(text, r"(?m)^\s*import\s+([.A-Za-z0-9_]+)"))


def script_specifiers(text: Column) -> Column:
    return F.filter(_all(text, r"""(?:from\s+|require\(\s*|import\(\s*|import\s+)["']([^"'\n]+)["']"""), lambda s: ~F.startswith(s, F.lit("node:")))


def includes(text: Column) -> Column:
    return _all(text, r'(?m)^\s*#\s*include\s*["<]([^">]+)[">]')


def go_imports(text: Column) -> Column:
    block = F.array_join(_all(text, r"(?s)import\s*\(([^)]*)\)"), "\n")
    return F.concat(_all(block, r'"([^"\n]+)"'), _all(text, r'(?m)^\s*import\s+(?:[A-Za-z0-9_.]+\s+)?"([^"\n]+)"'))


def imports(files: DataFrame) -> DataFrame:
    lang, text = language(F.col("path")), F.col("content")
    found = (
        F.when(lang == "rust", rust_modules(text)).when(lang == "python", python_modules(text)).when(lang.isin("javascript", "typescript"), script_specifiers(text))
        .when(lang == "cpp", includes(text)).when(lang == "go", go_imports(text))
    )
    return dealt(files.select("path", "content")).select("path", F.explode(F.array_sort(F.array_distinct(found))).alias("import"))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.when(p != "", p) for p in parts])


def _up(directory: Column, levels: Column) -> Column:
    parts = components(directory)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(0))), "/")


def candidates(found: DataFrame) -> DataFrame:
    """path, import, candidate, priority: where the imported file may be, likeliest first."""
    path, name, ext = F.col("path"), F.col("import"), extension(F.col("path"))
    here, bare = parent(path), F.regexp_replace(F.col("import"), "::", "/")
    rust = F.array(F.concat(_joined(here, bare), F.lit(".rs")), F.concat(_joined(here, bare), F.lit("/mod.rs")), F.concat(F.lit("src/"), bare, F.lit(".rs")), F.concat(F.lit("src/"), bare, F.lit("/mod.rs")))
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    module = F.regexp_replace(F.regexp_replace(name, r"^\.+", ""), r"\.", "/")
    base = F.when(dots > 0, _joined(_up(here, dots - 1), module)).otherwise(module)
    python = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    ups = F.size(F.regexp_extract_all(name, F.lit(r"(\.\./)"), F.lit(1)))
    target = _joined(_up(here, ups), F.regexp_replace(name, r"^(\./|\.\./)+", ""))
    script = F.when(name.rlike(r"^\.\.?/"), F.array(*[F.concat(target, F.lit(e)) for e in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")]))
    where = F.when(ext == "rs", rust).when(ext == "py", python).when(ext.isin("ts", "tsx", "js", "jsx"), script).when(ext.isin("c", "cpp", "h", "hpp"), F.array(_joined(here, name), name))
    return found.select("path", "import", F.posexplode(where).alias("priority", "candidate"))


def aliased(found: DataFrame, aliases: dict[str, list[str]], base_url: str | None = None) -> DataFrame:
    """path, import, candidate, priority by the aliases of a tsconfig, in their order, then by its base. A pattern may end in *, whose match takes the place of * in a target."""
    name, targets = F.col("import"), []
    for pattern, to in aliases.items():
        head = pattern.removesuffix("*")
        hit = F.startswith(name, F.lit(head)) if pattern.endswith("*") else name == pattern
        rest = F.substring(name, F.lit(len(head) + 1), F.length(name)) if pattern.endswith("*") else F.lit("")
        for t in to:
            before, star, after = t.partition("*")
            targets.append(F.when(hit, F.concat(F.lit(before), rest, F.lit(after)) if star else F.lit(t)))
    if base_url is not None:
        targets.append(_joined(F.lit(base_url.strip("/")), name))
    ends = F.array(*[F.lit(e) for e in ("", *(f".{e}" for e in SCRIPT_EXTENSIONS), *(f"/index.{e}" for e in SCRIPT_EXTENSIONS[:4]))])
    tried = F.flatten(F.transform(F.filter(F.array(*targets), lambda t: t.isNotNull()), lambda t: F.transform(ends, lambda e: F.concat(F.regexp_replace(t, r"^\./", ""), e))))
    return found.where(extension(F.col("path")).isin("ts", "tsx", "js", "jsx") & ~name.rlike(r"^\.")).select("path", "import", F.posexplode(tried).alias("priority", "candidate"))


def configured(found: DataFrame, files: DataFrame) -> DataFrame:
    """aliased by the tsconfig.json (or jsconfig.json) at the root of files; empty where there is none. One small file is read."""
    own = files.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).orderBy(F.desc("path")).select("content").first()
    base, aliases = tsconfig_paths(own["content"] or "") if own else ("", {})
    return aliased(found, aliases, base or None) if aliases or base else found.select("path", "import", F.lit(0).alias("priority"), F.lit(None).cast("string").alias("candidate")).limit(0)


def go_edges(found: DataFrame, files: DataFrame, module: str) -> DataFrame:
    """src, dst, import of Go files: every known file of a directory of the module that is imported; tests only for tests."""
    of_go = found.where((extension(F.col("path")) == "go") & (F.startswith("import", F.lit(f"{module}/")) | (F.col("import") == module)))
    wanted = of_go.withColumn("directory", F.regexp_replace(F.substring("import", F.lit(len(module) + 2), F.length("import")), "/$", ""))
    tests = files.select("path", (F.contains("content", F.lit("_test.go")) | F.col("content").rlike(r"(?m)^\s*package [^\n]*_test")).alias("tests"))
    known = files.where(extension(F.col("path")) == "go").select(F.col("path").alias("dst"), parent(F.col("path")).alias("directory"))
    pairs = met(met(wanted, tests, "path"), known, "directory").where("tests OR NOT dst LIKE '%\\_test.go'")
    return pairs.select(F.col("path").alias("src"), "dst", "import")


def resolved(found: DataFrame, files: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """src, dst, import: the likeliest candidate that is a known path; tried: candidates other than the usual ones."""
    known = files.select(F.col("path").alias("candidate")).distinct()
    hit = met(candidates(found) if tried is None else tried, known, "candidate")
    best = hit.groupBy("path", "import").agg(F.min_by("candidate", "priority").alias("dst"))
    return best.select(F.col("path").alias("src"), "dst", "import")
