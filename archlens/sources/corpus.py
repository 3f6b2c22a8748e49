"""Corpora of source files: files(path string, content string)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions import tables as T
from archlens.functions.text import any_of, components, extension, file_name, has_any, parent


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below root as text; those that aren't UTF-8 have a null content. Pruned names aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), rf"^.*?{re.escape(root.rstrip('/').rsplit('/', 1)[-1])}/", "")
    content = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select(path.alias("path"), content.alias("content")).where(~is_pruned(F.col("path")))


def is_pruned(path: Column) -> Column:
    names = [*T.PRUNED_DIRECTORIES, *T.PRUNED_FILES, *T.SKIPPED_DIRECTORIES]
    return F.arrays_overlap(components(path), F.array(*map(F.lit, names)))


def is_code_like(path: Column, content: Column) -> Column:
    """By name first; the content is only looked at for a #! where the name doesn't tell."""
    name = file_name(path)
    return (
        F.when(name.rlike(T.BINARY_FILE) | name.rlike(T.SECRET_FILE), F.lit(False))
        .when(name.rlike(T.CODE_FILE) | name.rlike(T.CODE_NAME), F.lit(True))
        .otherwise(F.coalesce(F.startswith(content, F.lit("#!")), F.lit(False)))
    )


def passes_patterns(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    slashed = F.regexp_replace(path, r"\\", "/")
    wanted = any_of([slashed.rlike(p) for p in include]) if include else F.lit(True)
    return wanted & ~any_of([slashed.rlike(p) for p in exclude])


def discover(files: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    path = F.col("path")
    return files.where(~is_pruned(path) & passes_patterns(path, include, exclude) & is_code_like(path, F.col("content")))


def file_kind(path: Column) -> Column:
    name, ext = F.lower(file_name(path)), extension(path)
    minified = F.contains(name, F.lit(".min.")) | name.rlike(r"(\.min|\.bundle\.js|\.bundle\.ts|-bundle\.js)$")
    return (
        F.when(minified, "Asset").when(ext.isin(*T.SOURCE_EXTENSIONS), "SourceCode").when(ext.isin(*T.CONFIG_EXTENSIONS), "Config")
        .when(ext.isin(*T.ASSET_EXTENSIONS), "Asset").otherwise("Other")
    )


def is_production_source(path: Column) -> Column:
    return F.contains(path, F.lit("src/")) & ~F.lower(path).rlike("test")


def systems_score(content: Column) -> Column:
    signs = [F.when(any_of([F.contains(content, F.lit(n)) for n in needles]), weight).otherwise(0) for weight, needles in T.SYSTEMS_SIGNS]
    return sum(signs[1:], signs[0])


def perf_exempt(path: Column) -> Column:
    return has_any(path, T.PERF_EXEMPT) | F.endswith(path, F.lit(T.PERF_EXEMPT_END))


def to_mutate(files: DataFrame, part: str | None) -> DataFrame:
    """Files whose path holds the part, slashes of either kind; all without one."""
    return files if part is None else files.where(F.contains(F.regexp_replace("path", r"\\", "/"), F.lit(part.replace("\\", "/"))))


def build_systems(files: DataFrame) -> DataFrame:
    """build_system: those that the files' names tell of, each once."""
    name = file_name(F.col("path"))
    known = F.create_map(*[F.lit(x) for item in T.BUILD_FILES.items() for x in item])
    system = F.when(extension(F.col("path")) == "cmake", "CMake").otherwise(F.element_at(known, name))
    return files.select(system.alias("build_system")).where("build_system IS NOT NULL").distinct()


def by_directory(files: DataFrame) -> DataFrame:
    """Number of files of each directory, and their names in order."""
    return files.groupBy(parent(F.col("path")).alias("directory")).agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def project_type(files: DataFrame) -> DataFrame:
    """One row: the type whose marker file stands highest in the list of priorities."""
    markers = F.create_map(*[x for k, (name, _) in enumerate(T.PROJECT_MARKERS) for x in (F.lit(name), F.lit(k))])
    first = files.agg(F.min(F.element_at(markers, F.col("path"))).alias("k"))
    kinds = F.array(*[F.lit(kind) for _, kind in T.PROJECT_MARKERS])
    return first.select(F.coalesce(F.get(kinds, F.col("k")), F.lit("unknown")).alias("project_type"))


def tsconfig_paths(text: str) -> tuple[str, dict[str, list[str]]]:
    """(baseUrl, aliases) of a tsconfig.json with comments; empty where it doesn't parse."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        options = json.loads(bare).get("compilerOptions", {})
    except (json.JSONDecodeError, AttributeError):
        return "", {}
    return options.get("baseUrl", ""), options.get("paths", {})
