"""Badges of fingerprints(path, imports, annotations, param_types, strings, exports), mutation points and verb summaries."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlens.functions import tables as T
from archlens.functions.text import any_of, expand_identifier, expand_verb, looks_garbled, split_identifier, verb_priority


def _has(column: str, needle: str) -> Column:
    return F.exists(column, lambda x: F.contains(x, F.lit(needle)))


def _best(rules: list[tuple[int, int, str, Column]]) -> Column:
    """Highest score, then first order."""
    hits = F.filter(F.array(*[F.when(test, F.struct(F.lit(-score).alias("score"), F.lit(order).alias("order"), F.lit(badge).alias("badge"))) for score, order, badge, test in rules]), lambda x: x.isNotNull())
    return F.array_sort(hits)


@dataclass(frozen=True)
class Taxonomy:
    """Rules in the order that decides between equal scores: own ones of a project come before the built-in ones."""

    roles: tuple = T.ROLES
    domains: tuple = T.DOMAINS
    mechanisms: tuple = T.MECHANISMS


def taxonomy_of(text: str) -> Taxonomy:
    """A project's rules, as YAML with lists role, domain and mechanism, before the built-in ones; these alone where it doesn't parse. Domains of bad patterns are left out."""
    try:
        import yaml

        parse, broken = yaml.safe_load, yaml.YAMLError
    except ImportError:  # JSON is YAML too
        parse, broken = json.loads, json.JSONDecodeError
    try:
        own = parse(text) or {}
        part = lambda name: list(reversed(own.get(name) or []))  # noqa: E731  each goes before those read so far
        names = lambda rule, key: tuple(rule.get(key) or ())
        roles = [(r["badge"], names(r, "exports_contain"), names(r, "param_type_contains"), names(r, "annotation_contains")) for r in part("role")]
        domains = [(r["badge"], r["string_pattern"]) for r in part("domain") if _compiles(r["string_pattern"])]
        mechanisms = [(r["badge"], r["import_prefix"]) for r in part("mechanism")]
    except (broken, KeyError, TypeError, AttributeError):
        return Taxonomy()
    return Taxonomy((*roles, *T.ROLES), (*domains, *T.DOMAINS), (*mechanisms, *T.MECHANISMS))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def badges(fingerprints: DataFrame, rules: Taxonomy = Taxonomy()) -> DataFrame:
    """path, role, domain, mechanisms (two at most)."""
    roles = []
    for k, (badge, exports, params, annotations) in enumerate(rules.roles):
        test = F.lit(True)
        for e in exports:
            test = test & _has("exports", e)
        test = test & (any_of([_has("param_types", p) for p in params]) if params else F.lit(True)) & (any_of([_has("annotations", a) for a in annotations]) if annotations else F.lit(True))
        roles.append((bool(exports) + 2 * bool(params) + 3 * bool(annotations), k, badge, test))
    domains = [(3, k, badge, _matches(pattern)) for k, (badge, pattern) in enumerate(rules.domains)]
    mechanisms = [(1, k, badge, _starts(prefix)) for k, (badge, prefix) in enumerate(rules.mechanisms)]
    first = lambda rules: F.get(_best(rules), F.lit(0))["badge"]
    return fingerprints.select("path", first(roles).alias("role"), first(domains).alias("domain"), F.transform(F.slice(_best(mechanisms), 1, 2), lambda x: x["badge"]).alias("mechanisms"))


def _matches(pattern: str) -> Column:
    return F.exists("strings", lambda x: x.rlike(pattern))


def _starts(prefix: str) -> Column:
    return F.exists("imports", lambda x: F.startswith(x, F.lit(prefix)))


def top_nouns(comments: DataFrame, stop_words: tuple[str, ...], k: int = 5) -> DataFrame:
    """comments(path, text) -> each path's k most frequent words of over two letters that are neither stop words nor end in ing or ed."""
    words = comments.select("path", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word") > 2)
    words = words.where(~F.col("word").isin(*stop_words) & ~F.col("word").rlike("(ing|ed)$"))
    counted = words.groupBy("path", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "word"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def summarize_exports(exports: DataFrame) -> DataFrame:
    """exports(path, name, ord) -> path, summary: the most frequent first verb with its longest theme."""
    words = split_identifier(F.col("name"))
    rows = exports.withColumns({"verb": words[0], "theme": F.array_join(F.slice(words, 2, F.size(words)), " ")})
    verbs = rows.groupBy("path", "verb").agg(F.count("*").alias("n"), F.max(F.struct(F.octet_length("theme").alias("size"), F.col("ord").alias("ord"), "theme")).alias("best"))
    top = verbs.groupBy("path").agg(F.max_by(F.struct("verb", "best"), F.struct("n", -verb_priority(F.col("verb")), F.col("verb"))).alias("top"))
    first = exports.groupBy("path").agg(F.min_by("name", "ord").alias("first"), F.count("*").alias("exports"))
    theme = F.col("top.best.theme")
    single = (F.col("exports") == 1) | (F.octet_length(theme) < 3) | looks_garbled(theme)
    return first.join(top, "path").select("path", F.when(single, _single(F.col("first"))).otherwise(expand_verb(F.col("top.verb"), theme)).alias("summary"))


def _single(name: Column) -> Column:
    words = split_identifier(name)
    rest = F.array_join(F.slice(words, 2, F.size(words)), " ")
    return F.when((F.octet_length(rest) < 3) & looks_garbled(rest), F.concat(F.lit("Implements "), name, F.lit(" functionality."))).otherwise(expand_identifier(name))


def mutation_points(lines: DataFrame) -> DataFrame:
    """lines(path, row, line) -> path, row, col (code points from 1), original, mutated, kind for every operator and boolean that stands as a token of its own."""
    operators = F.regexp_extract_all("line", F.lit(r"(==|!=|<=|>=|&&|\|\||(?<![A-Za-z0-9_])(?:and|or|true|false|True|False)(?![A-Za-z0-9_])|(?<=\s)[<>+\-*/](?=\s))"), F.lit(1))
    gaps = F.split("line", r"==|!=|<=|>=|&&|\|\||(?<![A-Za-z0-9_])(?:and|or|true|false|True|False)(?![A-Za-z0-9_])|(?<=\s)[<>+\-*/](?=\s)", -1)
    mutants = F.create_map(*[x for op, (to, kind) in T.MUTATIONS.items() for x in (F.lit(op), F.struct(F.lit(to).alias("mutated"), F.lit(kind).alias("kind")))])
    rows = lines.select("path", "row", "line", gaps.alias("gaps"), operators.alias("ops")).select("path", "row", "gaps", "ops", F.posexplode("ops").alias("k", "original"))
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    col = length(F.slice("gaps", F.lit(1), F.col("k") + 1)) + length(F.slice("ops", F.lit(1), F.col("k"))) + 1
    return rows.select("path", "row", col.alias("col"), "original", F.element_at(mutants, F.col("original")).alias("m")).select("path", "row", "col", "original", "m.*")


def apply_mutation(content: Column, start: Column, end: Column, mutated: Column) -> Column:
    """content with code points start to end (exclusive, from 0) replaced."""
    return F.concat(F.substring(content, F.lit(1), start), mutated, F.substring(content, end + 1, F.length(content)))


def mutation_summary(results: DataFrame) -> DataFrame:
    """results(survived) -> total, killed, survived, score (percent killed; 100 without mutants)."""
    counted = results.agg(F.count("*").alias("total"), F.count_if(~F.col("survived")).alias("killed"), F.count_if("survived").alias("survived"))
    return counted.withColumn("score", F.when(F.col("total") == 0, 100.0).otherwise(F.col("killed") / F.col("total") * 100))
