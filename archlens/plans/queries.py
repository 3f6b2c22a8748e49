"""Every core query: an operator over inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions import docs
from archlens.functions import text as X
from archlens.operators import cohesion, graph, imports, locality, report, rules, taxonomy
from archlens.plans import inputs as I
from archlens.sources import corpus
from archlens.streaming import events

QUERIES: dict = {}

STOP_WORDS = ("the", "and", "for", "that", "this", "with", "des", "les", "der", "die", "und", "que", "los", "las")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession, sf: str, text: str = I.CODE) -> DataFrame:
    return I.derived(spark, sf, text)


@query
def file_kind(spark, sf):
    p = F.col("path")
    return _files(spark, sf, I.PATHS).select("path", corpus.file_kind(p).alias("kind"), X.extension(p).alias("ext"), X.language(p).alias("lang"))


@query
def discovered_files(spark, sf):
    return corpus.discover(_files(spark, sf, I.PATHS), exclude=("core/tests",)).select("path")


@query
def files_by_directory(spark, sf):
    return corpus.by_directory(_files(spark, sf, I.PATHS))


@query
def production_sources(spark, sf):
    p = F.col("path")
    return _files(spark, sf, I.PATHS).agg(F.count_if(corpus.is_production_source(p)).alias("n_sources"), (F.count_if(corpus.is_production_source(p)) >= 10).alias("deep"))


@query
def systems_score(spark, sf):
    return _files(spark, sf).select("path", corpus.systems_score(F.col("content")).alias("score"))


@query
def token_totals(spark, sf):
    n = X.approx_tokens(F.col("content"))
    return _files(spark, sf, I.SOURCES).select(X.extension(F.col("path")).alias("ext"), n.alias("n")).groupBy("ext").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_tokens"), F.max("n").alias("most"))


@query
def sha256_normalised(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.sha256_normalised(F.col("text")).alias("sha256"))


@query
def split_identifiers(spark, sf):
    words = X.split_identifier(F.col("name"))
    return _files(spark, sf, I.NAMES).select("id", "name", F.array_join(words, " ").alias("words"), F.size(words).alias("n_words"))


@query
def expanded_identifiers(spark, sf):
    return _files(spark, sf, I.NAMES).select("id", X.expand_identifier(F.col("name")).alias("sentence"))


@query
def export_summaries(spark, sf):
    names = _files(spark, sf, I.NAMES).select((F.col("id") % 50).cast("string").alias("path"), "name", F.col("id").alias("ord"))
    return taxonomy.summarize_exports(names)


@query
def comment_nouns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("path"), "text")
    return taxonomy.top_nouns(docs, STOP_WORDS)


@query
def concepts(spark, sf):
    lang, text = X.language(F.col("path")), F.col("content")
    names = ("heap", "lookup", "length", "mutation", "locking", "loop", "exported_api", "collection_access", "front_access", "collection_guard", "async_locking")
    return _files(spark, sf).select("path", *[X.has_concept(lang, n, text).alias(n) for n in names])


def _rule(name, *rules_of):
    def run(spark, sf):
        return rules.check(_files(spark, sf), *rules_of)

    run.__name__ = f"rule_{name}"
    return query(run)


for _name in ("naming", "length_bounds", "looped_lookups", "front_accesses", "formatted_sql", "hardcoded_secrets", "locks_across_await", "undocumented_locks", "unsafe_blocks", "predicates"):
    _rule(_name, _name)
_rule("global_state", "mutable_statics", "public_statics")


@query
def rule_atomicity(spark, sf):
    return rules.atomicity(_files(spark, sf, I.SOURCES))


def _violations(spark, sf):
    return rules.scan(_files(spark, sf))


@query
def count_by_law(spark, sf):
    return report.by_law(_violations(spark, sf))


@query
def report_totals(spark, sf):
    files = _files(spark, sf).select("path", X.approx_tokens(F.col("content")).alias("token_count"))
    return report.totals(files, _violations(spark, sf))


@query
def gate_verdict(spark, sf):
    files = _files(spark, sf).select("path", X.approx_tokens(F.col("content")).alias("token_count"))
    commands = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_type") != "error").alias("passed"))
    return report.gate(report.totals(files, _violations(spark, sf)), commands).select("n_commands", "n_failed", "passed")


@query
def top_files(spark, sf):
    return report.top_files(_violations(spark, sf))


@query
def numbered_violations(spark, sf):
    return report.numbered(_violations(spark, sf)).select("path", "row", "law", "k", "n")


@query
def violation_snippets(spark, sf):
    files = _files(spark, sf)
    return report.snippets(rules.check(files, "looped_lookups"), rules.lines_of(files)).select("path", "row", "before", "line", "after")


@query
def one_line_findings(spark, sf):
    return report.one_line(rules.check(_files(spark, sf), "hardcoded_secrets"))


@query
def import_strings(spark, sf):
    return imports.imports(_files(spark, sf))


@query
def resolved_imports(spark, sf):
    files = _files(spark, sf)
    return imports.resolved(imports.imports(files), files)


@query
def taxonomy_badges(spark, sf):
    found = taxonomy.badges(_files(spark, sf, I.FINGERPRINTS))
    return found.withColumn("mechanisms", F.array_join("mechanisms", "|"))


@query
def mutation_points(spark, sf):
    return taxonomy.mutation_points(rules.lines_of(_files(spark, sf)))


@query
def mutation_summary(spark, sf):
    return taxonomy.mutation_summary(spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_returnflag") == "R").alias("survived")))


def _edges(spark, sf):
    return I.derived(spark, sf, I.EDGES)


@query
def coupling(spark, sf):
    return locality.coupling(_edges(spark, sf)).select("path", "ca", "ce", F.round("instability", 9).alias("instability"), F.round("skew", 9).alias("skew"))


@query
def path_distance(spark, sf):
    a, b = F.col("src"), F.col("dst")
    return _edges(spark, sf).distinct().select("src", "dst", locality.distance(a, b).alias("distance"), locality.common_ancestor(a, b).alias("ancestor"))


@query
def node_identity(spark, sf):
    return locality.coupling(_edges(spark, sf)).groupBy(locality.identity(F.col("ca"), F.col("ce")).alias("identity")).agg(F.count("*").alias("n"))


@query
def edge_verdicts(spark, sf):
    return locality.judged(_edges(spark, sf)).groupBy("identity", "distance", "reason", "passed").agg(F.count("*").alias("n"))


def _failed(spark, sf):
    return locality.judged(_edges(spark, sf)).where("NOT passed")


@query
def edge_categories(spark, sf):
    return locality.categorised(_failed(spark, sf)).select("src", "dst", "distance", "category", "suggestion")


@query
def locality_summary(spark, sf):
    return locality.summary(locality.judged(_edges(spark, sf))).select("total_edges", "failed_edges", F.round("entropy", 9).alias("entropy"), F.round("health", 6).alias("health"))


@query
def god_modules(spark, sf):
    return locality.god_modules(_failed(spark, sf))


@query
def hub_candidates(spark, sf):
    return locality.hub_candidates(_failed(spark, sf), least=1)


@query
def module_coupling(spark, sf):
    return locality.module_coupling(_edges(spark, sf))


@query
def layers(spark, sf):
    return graph.layers(_edges(spark, sf)).groupBy("layer").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query
def cyclic_core(spark, sf):
    return graph.cyclic_core(I.derived(spark, sf, I.TRADE))


@query
def symbol_edges(spark, sf):
    return graph.symbol_edges(I.derived(spark, sf, I.DEFS), I.derived(spark, sf, I.REFS))


@query
def pagerank(spark, sf):
    return graph.pagerank(I.derived(spark, sf, I.TRADE)).select("path", F.round("rank", 9).alias("rank"))


@query
def pagerank_anchored(spark, sf):
    return graph.pagerank(I.derived(spark, sf, I.TRADE), "n1").select("path", F.round("rank", 9).alias("rank"))


@query
def neighbours(spark, sf):
    edges = I.derived(spark, sf, I.TRADE)
    parts = [("dependencies", graph.dependencies(edges, "n1")), ("dependents", graph.dependents(edges, "n1")), ("neighbours", graph.neighbours(edges, "n1"))]
    tagged = [df.select(F.lit(name).alias("kind"), "path") for name, df in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query
def graph_hubs(spark, sf):
    return graph.hubs(_edges(spark, sf), 5)


def _types(spark, sf):
    return tuple(I.derived(spark, sf, t) for t in (I.SCOPES, I.FIELDS, I.METHODS))


@query
def lcom4(spark, sf):
    return cohesion.lcom4(_types(spark, sf)[2])


@query
def external_coupling(spark, sf):
    methods = _types(spark, sf)[2]
    return cohesion.cbo(methods).join(cohesion.sfout(methods), cohesion.KEY)


@query
def attribute_hiding(spark, sf):
    scopes, fields, _ = _types(spark, sf)
    return cohesion.ahf(scopes, fields).select("path", "scope", "n_fields", "n_private", F.round("ahf", 6).alias("ahf"))


@query
def cohesion_violations(spark, sf):
    return cohesion.violations(cohesion.inspected(*_types(spark, sf)))


@query
def event_windows(spark, sf):
    return events.windowed_counts(spark.read.parquet(f"{sf}/events.parquet")).withColumn("total", F.round("total", 4))


for _name in ("unwraps", "index_zero", "global_containers", "mutating_getters", "mutating_calculators", "manual_conversions"):

    def _mixed(spark, sf, name=_name):
        return rules.check(_files(spark, sf, I.MIXED), name)

    _mixed.__name__ = f"rule_{_name}"
    query(_mixed)


@query
def mixed_findings(spark, sf):
    names = ("unwraps", "index_zero", "global_containers", "mutating_getters", "mutating_calculators", "manual_conversions", "unsafe_blocks", "mutable_statics", "public_statics", "predicates", "undocumented_locks")
    return report.by_law(rules.check(_files(spark, sf, I.MIXED), *names))


@query
def test_contexts(spark, sf):
    path, text = F.col("path"), F.col("content")
    exempt = corpus.perf_exempt(path).alias("perf_exempt")
    return _files(spark, sf, I.SOURCES).select("path", X.is_test_context(X.language(path), path, text).alias("is_test"), X.has_inline_tests(text).alias("inline_tests"), exempt)


@query
def build_systems(spark, sf):
    return corpus.build_systems(_files(spark, sf, I.BUILDS))


@query
def project_types(spark, sf):
    files = _files(spark, sf, I.BUILDS).select(F.substring_index("path", "/", -1).alias("path"))
    return corpus.project_type(files)


@query
def files_to_mutate(spark, sf):
    return corpus.to_mutate(_files(spark, sf, I.PATHS), "core\\").select("path")


@query
def module_docs(spark, sf):
    return _files(spark, sf, I.DOCS).select("path", docs.module_doc(F.col("path"), F.col("content")).alias("doc"))


@query
def item_docs(spark, sf):
    return _files(spark, sf, I.DOCS).select("path", docs.looks_like_item_doc(F.col("said")).alias("of_item"))


@query
def cpp_exports(spark, sf):
    return _files(spark, sf, I.CPP).select("path", F.array_join(docs.cpp_exports(F.col("path"), F.col("content")), ",").alias("names"))


ALIASES = {"@app/*": ["src/*"], "react": ["vendor/react"]}


@query
def aliased_imports(spark, sf):
    files = _files(spark, sf, I.SCRIPTS)
    found = imports.imports(files)
    return imports.resolved(found, files, imports.aliased(found, ALIASES)).select("src", "dst")


@query
def go_imports(spark, sf):
    files = _files(spark, sf, I.GO_FILES)
    return imports.go_edges(imports.imports(files), files, "example.com/mod").select("src", "dst")


@query
def import_verdicts(spark, sf):
    """From files through imports and edges to verdicts."""
    files = _files(spark, sf, I.SCRIPTS)
    found = imports.imports(files)
    edges = imports.resolved(found, files).unionByName(imports.resolved(found, files, imports.aliased(found, ALIASES))).select("src", "dst")
    return locality.judged(edges).groupBy("identity", "distance", "reason", "passed").agg(F.count("*").alias("n"))


@query
def layered_categories(spark, sf):
    edges = _edges(spark, sf)
    return locality.categorised(locality.judged(edges).where("NOT passed"), graph.layers(edges)).groupBy("category").agg(F.count("*").alias("n"))


@query
def locality_report(spark, sf):
    judged = graph.written_clean(locality.judged(_edges(spark, sf)).select("src", "dst", "ca", "identity", "passed"))  # asked for sums, categories and modules
    return locality.report_lines(judged, locality.categorised(judged.where("NOT passed"))).select("section", "line")


@query
def guided_findings(spark, sf):
    return report.guided(_violations(spark, sf)).groupBy("law", "why", "fix").agg(F.count("*").alias("n"))


@query
def sorted_files(spark, sf):
    return report.sorted_worst(_violations(spark, sf))


@query
def maximal_spans(spark, sf):
    return report.maximal(I.derived(spark, sf, I.SPANS))


def _commands(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("command"), (F.col("value") > 50).alias("passed"))


@query
def text_report(spark, sf):
    files = _files(spark, sf).select("path", X.approx_tokens(F.col("content")).alias("token_count"))
    found = _violations(spark, sf)
    return report.text_report(report.totals(files, found), report.by_law(found), _commands(spark, sf)).select("section", "line")


@query
def file_reports(spark, sf):
    files = _files(spark, sf).select("path", X.approx_tokens(F.col("content")).alias("token_count"))
    return report.file_reports(files, rules.check(_files(spark, sf), "hardcoded_secrets"))


@query
def output_counts(spark, sf):
    runs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("command"), F.col("text").alias("stdout"), F.when(F.col("doc_id") % 3 == 0, "error: x\nwarning: y\nan error").alias("stderr"))
    return report.output_counts(runs)


@query
def event_log(spark, sf):
    events_table = spark.read.parquet(f"{sf}/events.parquet")
    return report.event_lines(events_table.select("event_id", "user_id", "event_type"))


@query
def surviving_mutants(spark, sf):
    points = taxonomy.mutation_points(rules.lines_of(_files(spark, sf)))
    return report.survivors(points.withColumn("survived", (F.col("row") + F.col("col")) % 3 == 0))


TAXONOMY = """
role: [{badge: Runs, exports_contain: [Run]}]
domain: [{badge: customers, string_pattern: "Customer#"}, {badge: broken, string_pattern: "("}]
mechanism: [{badge: files, import_prefix: "std::fs"}]
"""


@query
def project_badges(spark, sf):
    found = taxonomy.badges(_files(spark, sf, I.FINGERPRINTS), taxonomy.taxonomy_of(TAXONOMY))
    return found.groupBy("role", "domain", F.array_join("mechanisms", "|").alias("mechanisms")).agg(F.count("*").alias("n"))
