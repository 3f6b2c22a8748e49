"""Rules over files(path, content), as expressions on lines. No parser: rules that need a syntax tree aren't here (see the README).

All rules on lines read one table of lines with what they need to know of their surroundings: file-level flags, computed
before the lines are exploded, and windows along a file's lines, so one shuffle by path serves them all. A rule is a
condition, and the scan tests all conditions in one pass; a single rule's plan keeps only the columns that it reads.
A rule yields violations(path, row, law, message, confidence).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlens.config import SYSTEMS_LIMITS, SYSTEMS_SCORE, RuleConfig
from archlens.functions.tables import GLOBAL_CONTAINERS, PLACEHOLDERS, SECRET_NAME
from archlens.functions.text import any_of, approx_tokens, file_name, has_any, has_concept, language, length_boundary, split_identifier
from archlens.operators.joins import dealt
from archlens.sources.corpus import file_kind, perf_exempt, systems_score


def lines_of(files: DataFrame) -> DataFrame:
    """files with row (from 1) and line, one for each line."""
    return files.select("*", F.posexplode(F.split("content", "\n")).alias("_at", "line")).withColumn("row", F.col("_at") + 1).drop("_at", "content")


def governed(files: DataFrame) -> DataFrame:
    return files.where(file_kind(F.col("path")) == "SourceCode")


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)tests?/|_test\.|\.test\.|\.spec\.")


def in_context(files: DataFrame) -> DataFrame:
    """Lines of governed files: path, lang, row, line, the three lines before, whether a lock guard is held and of which kind, whether lookups stand in the file's loops and where the first is, and the file's flags."""
    path, text = F.col("path"), F.col("content")
    lang = language(path)
    flags = dealt(governed(files).select("path", "content")).select(
        "path", "content", lang.alias("lang"), has_concept(lang, "collection_guard", text).alias("guarded"),
        (~is_test_file(path) & ~perf_exempt(path) & has_concept(lang, "loop", text) & has_concept(lang, "lookup", text)).alias("looped"),
        F.lower(file_name(path)).rlike("test|spec").alias("tests"), has_any(text, ("chunks_exact(", "array_chunks(")).alias("chunked"),
        (F.contains(text, F.lit(".await")) & F.contains(text, F.lit("async fn"))).alias("awaits"),
    )
    line = F.col("line")
    takes = line.rlike(r"\blet\b.*\.(lock|read|write)\(\)")
    frees = F.trim(line).rlike(r"^\}") | F.contains(line, F.lit("drop("))
    rows = lines_of(flags).withColumns({"takes": takes, "event": F.when(takes, 1).when(frees, 0)})
    rows = rows.withColumn("kind", F.when(takes, F.when(has_concept(F.lit("rust"), "async_locking", line), "async").otherwise("sync")))
    order = Window.partitionBy("path").orderBy("row")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    around = {f"b{k}": F.trim(F.lag("line", k).over(order)) for k in (1, 2, 3)}
    after = {f"a{k}": F.lead("line", k).over(order) for k in range(1, 6)}
    lazy = F.when(F.contains(line, F.lit("lazy_static!")), F.lit(1)).when(F.trim(line) == "}", F.lit(0))
    field = F.regexp_extract(line, r"(self\.[A-Za-z0-9_.]+)\[0\]", 1)
    first_zero = F.min(F.when(field != "", F.col("row"))).over(Window.partitionBy("path", field))
    lookup = F.when(F.col("looped") & has_concept(F.col("lang"), "lookup", line), F.col("row"))
    held = {"held": F.last("event", ignorenulls=True).over(before), "held_kind": F.last("kind", ignorenulls=True).over(before)}
    held["lazy"] = F.last(lazy, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns(around | after | held | {"first_lookup": F.min(lookup).over(Window.partitionBy("path"))})
    return rows.withColumns({"first_zero": first_zero, "zero_field": field})  # last: lines dealt by path are dealt by path and field too


@dataclass(frozen=True)
class Rule:
    """A condition on a line in its context; shift is added to the row (some rules count from 0)."""

    law: str
    condition: Column
    message: Column
    confidence: Column
    shift: int = 0

    @property
    def finding(self) -> Column:
        parts = (F.col("row") + self.shift).cast("int").alias("row"), F.lit(self.law).alias("law"), self.message.alias("message"), self.confidence.alias("confidence")
        return F.when(self.condition, F.struct(*parts))


def _rules(config: RuleConfig = RuleConfig()) -> dict[str, Rule]:
    c, line, lang = F.col, F.col("line"), F.col("lang")
    high, medium = F.lit("High"), F.lit("Medium")
    name_of = lambda pattern: F.regexp_extract(line, pattern, 1)
    function = name_of(r"\b(?:fn|def|function)\s+([A-Za-z_][A-Za-z0-9_]*)")
    words = split_identifier(function)
    allowed = any_of([F.contains(file_name(c("path")), F.lit(t)) for t in config.ignore_naming_on])
    bound, literal = name_of(r"\b(?:let|const|static)\s+(?:mut\s+)?([A-Za-z_][A-Za-z0-9_]*)"), name_of(r'=\s*("(?:[^"\\]|\\.)*")')
    comment = lambda k: F.coalesce(F.startswith(f"b{k}", F.lit("//")), F.lit(False))
    says = lambda k: F.coalesce(F.contains(f"b{k}", F.lit("SAFETY:")), F.lit(False))
    told = comment(1) & (says(1) | (comment(2) & (says(2) | (comment(3) & says(3)))))
    lock_field = line.rlike(r"^\s*(?:pub(?:\([a-z]+\))?\s+)?[a-z_][a-z0-9_]*\s*:\s*[A-Za-z0-9_:<]*(?:Mutex|RwLock)<")
    public = name_of(r"\bpub\s+static\s+(?:mut\s+)?([A-Za-z_][A-Za-z0-9_]*)")
    rust = lang == "rust"
    getter = name_of(r"\bfn\s+((?:get|is|has)_[A-Za-z0-9_]*)\s*(?:<[^>]*>)?\(\s*&?\s*(?:mut\s+self|'[a-z]+\s+mut\s+self)")
    calculator = name_of(r"\bfn\s+((?:calculate|compute|count|sum)_[A-Za-z0-9_]*)\s*(?:<[^>]*>)?\(\s*&?\s*(?:mut\s+self|'[a-z]+\s+mut\s+self)")
    zero = rust & F.contains(line, F.lit("[0]")) & ~c("guarded") & ~c("chunked") & ((c("zero_field") == "") | (c("row") == c("first_zero")))
    body = F.concat_ws(" ", line, *[F.col(f"a{k}") for k in range(1, 6)])
    converts = rust & F.trim(line).rlike(r"^impl\s*From[< ]") & ~F.lower(body).rlike("err")
    contained = rust & (c("lazy") == 1) & has_any(line, GLOBAL_CONTAINERS)
    predicate, returns = name_of(r"\bfn\s+((?:is|has|can|should)_[A-Za-z0-9_]*)"), name_of(r"->\s*([^{;]+?)\s*(?:\{|;|$)")
    sql = F.contains(line, F.lit("format!(")) & F.upper(line).rlike(r"SELECT |INSERT INTO|UPDATE |DELETE FROM") & line.rlike(r"\{\}|\{:")
    long_name = F.concat(F.lit("Function '"), function, F.lit("' has "), F.size(words).cast("string"), F.lit(" words; try '"), F.array_join(F.slice(words, 1, 3), "_"), F.lit("'"))
    return {
        "naming": Rule("LAW OF COMPLEXITY", (function != "") & ~allowed & (F.size(words) > config.max_function_words), long_name, high),
        "length_bounds": Rule("L02", length_boundary(lang, line), F.concat(F.lit("Inclusive bound: "), F.trim(line)), high),
        "looped_lookups": Rule("P06", c("row") == c("first_lookup"), F.lit("Linear lookup in a loop"), medium),
        "front_accesses": Rule("L03", ~c("guarded") & has_concept(lang, "front_access", line), F.lit("Element taken without a check for emptiness"), high),
        "formatted_sql": Rule("X01", sql, F.lit("SQL built by formatting"), high),
        "hardcoded_secrets": Rule("X03", bound.rlike(SECRET_NAME) & (F.octet_length(literal) >= 5) & ~literal.rlike(PLACEHOLDERS), F.concat(F.lit("Hardcoded secret in '"), bound, F.lit("'")), high),
        "locks_across_await": Rule("C03", c("awaits") & (c("held") == 1) & F.contains(line, F.lit(".await")) & ~c("takes"), F.lit("Lock guard held across an await"), F.when(c("held_kind") == "sync", "High").otherwise("Medium")),
        "undocumented_locks": Rule("C04", lock_field & ~comment(1), F.lit("Lock without a comment on what it protects"), medium, -1),
        "unsafe_blocks": Rule("LAW OF PARANOIA", line.rlike(r"\bunsafe\s*\{") & ~told, F.lit("Unsafe block without a SAFETY comment"), high),
        "mutable_statics": Rule("S01", line.rlike(r"\bstatic\s+mut\s"), F.lit("Mutable static"), medium, -1),
        "public_statics": Rule("S02", (public != "") & ~public.rlike("^[A-Z_]+$"), F.concat(F.lit("Public static '"), public, F.lit("'")), medium, -1),
        "unwraps": Rule("LAW OF PARANOIA", rust & ~c("tests") & line.rlike(r"\.(?:unwrap\(\)|expect\()"), F.concat(F.lit("Unchecked "), name_of(r"\.(unwrap|expect)\(")), high),
        "index_zero": Rule("L03", zero, F.lit("Index 0 taken without a check of bounds"), F.when(c("zero_field") != "", "Medium").otherwise("High")),
        "global_containers": Rule("S03", contained, F.lit("Container in a lazy static"), medium, -1),
        "mutating_getters": Rule("M03", rust & (getter != ""), F.concat(F.lit("Getter '"), getter, F.lit("' takes its object to change it")), high),
        "mutating_calculators": Rule("M05", rust & (calculator != ""), F.concat(F.lit("Calculation '"), calculator, F.lit("' takes its object to change it")), high),
        "manual_conversions": Rule("I01", converts, F.lit("Hand-written From"), F.lit("Info")),
        "predicates": Rule("M04", (predicate != "") & ~returns.isin("", "bool"), F.concat(F.lit("'"), predicate, F.lit("' returns "), returns), high),
    }


#: Rules that are only run by name: the tool that this follows documents them, but its scan never reports them.
BY_NAME = ("unwraps",)


def check(files: DataFrame, *names: str, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Violations of the named rules; of all but those of BY_NAME without names."""
    rules = _rules(config)
    findings = [rules[n].finding for n in names or rules if names or n not in BY_NAME]
    rows = in_context(files)
    if len(findings) == 1:
        found = rows.select("path", findings[0].alias("v")).where("v IS NOT NULL")
    else:
        found = rows.select("path", F.explode(F.filter(F.array(*findings), lambda v: v.isNotNull())).alias("v"))
    return found.select("path", "v.*")


def atomicity(files: DataFrame, rules: RuleConfig = RuleConfig(), tokens: Column | None = None) -> DataFrame:
    """Files with more tokens than their limit; systems code has a wider one. tokens: a column of counts, else the estimate."""
    tokens = approx_tokens(F.col("content")) if tokens is None else tokens
    limit = F.when(systems_score(F.col("content")) >= SYSTEMS_SCORE, SYSTEMS_LIMITS["max_file_tokens"]).otherwise(rules.max_file_tokens)
    ignored = any_of([F.contains(F.col("path"), F.lit(p)) for p in rules.ignore_tokens_on])
    counted = governed(files).select("path", tokens.alias("n"), limit.alias("limit"), ignored.alias("ignored")).where("n > limit AND NOT ignored")
    message = F.concat(F.lit("File has "), F.col("n").cast("string"), F.lit(" tokens (limit "), F.col("limit").cast("string"), F.lit(")"))
    return counted.select("path", F.lit(1).alias("row"), F.lit("LAW OF ATOMICITY").alias("law"), message.alias("message"), F.lit("High").alias("confidence"))


def scan(files: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    return atomicity(files, config).unionByName(check(files, config=config))
