"""What findings sum up to: violations(path, row, law, message, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlens.functions.tables import CONFIDENCE_RANK, GUIDANCE
from archlens.operators.graph import checkpointed
from archlens.operators.joins import met


def totals(files: DataFrame, violations: DataFrame) -> DataFrame:
    """files(path, token_count): one row of files, tokens, violations, those of each confidence, clean files, and the verdict."""
    counts = violations.agg(F.count("*").alias("n_violations"), *[F.count_if(F.col("confidence") == c).alias(f"n_{c.lower()}") for c in CONFIDENCE_RANK], F.countDistinct("path").alias("dirty"))
    sums = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("n_tokens"))
    both = sums.crossJoin(counts)  # one row each
    return both.withColumns({"n_clean_files": F.col("n_files") - F.col("dirty"), "passed": F.col("n_violations") == 0}).drop("dirty")


def by_law(violations: DataFrame) -> DataFrame:
    return violations.groupBy("law").agg(F.count("*").alias("n"))


def top_files(violations: DataFrame, k: int = 5) -> DataFrame:
    return violations.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(k)


def numbered(violations: DataFrame) -> DataFrame:
    """violations with k and n: the k-th of n of its law. Sorted ranges are numbered side by side and shifted by the counts of the ranges before (a row for each range and law), so that no law is one task."""
    keys = ["law", "path", "row", "message"]
    ranged = checkpointed(violations.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("law", "_part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("law").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"base": F.coalesce(F.sum("c").over(before), F.lit(0)), "n": F.sum("c").over(Window.partitionBy("law"))})
    own = F.row_number().over(Window.partitionBy("law", "_part").orderBy("path", "row", "message"))
    return ranged.withColumn("r", own).join(counts.drop("c"), ["law", "_part"]).withColumn("k", F.col("r") + F.col("base")).drop("r", "base", "_part")


def snippets(violations: DataFrame, lines: DataFrame) -> DataFrame:
    """violations with the line before, at and after; lines(path, row, line)."""
    order = Window.partitionBy("path").orderBy("row")
    around = lines.withColumns({"before": F.lag("line").over(order), "after": F.lead("line").over(order)})
    return met(violations, around, ["path", "row"], "left")


def one_line(violations: DataFrame) -> DataFrame:
    prefix = F.when(F.col("confidence") == "High", "error").when(F.col("confidence") == "Medium", "warn").otherwise("info")
    return violations.select(F.format_string("%s:%d: %s: [%s] %s", "path", "row", prefix, "law", "message").alias("text"))


def guided(violations: DataFrame) -> DataFrame:
    """violations with why and fix, null for laws without guidance. A lookup of fixed size, so an expression."""
    known = F.create_map(*[x for law, (why, fix) in GUIDANCE.items() for x in (F.lit(law), F.struct(F.lit(why).alias("why"), F.lit(fix).alias("fix")))])
    return violations.withColumn("_g", F.element_at(known, F.col("law"))).select(*violations.columns, "_g.why", "_g.fix")


def grouped(violations: DataFrame, lines: DataFrame) -> DataFrame:
    """The grouped report in one: each finding as the k-th of n of its law, with the lines around it and its law's guidance."""
    return guided(snippets(numbered(violations), lines))


def sorted_worst(violations: DataFrame) -> DataFrame:
    """path, n of all files with findings, most first, then by path."""
    return violations.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path")


def maximal(spans: DataFrame) -> DataFrame:
    """spans(path, low, high) that lie in no other of their path; of equal ones one."""
    order = Window.partitionBy("path").orderBy("low", F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("high").over(order)
    return spans.select("path", "low", "high").distinct().withColumn("before", before).where("before IS NULL OR high > before").drop("before")


def survivors(mutants: DataFrame) -> DataFrame:
    """mutants(path, row, col, original, mutated, kind, survived) -> a JSON document for each survivor."""
    return mutants.where("survived").select(F.to_json(F.struct("path", "row", "col", "original", "mutated", "kind")).alias("mutant"))


def text_report(totals_row: DataFrame, laws: DataFrame, commands: DataFrame) -> DataFrame:
    """section, at, line: sums of the scan, findings by law, commands(command, passed)."""
    head = totals_row.select(F.lit(0).alias("section"), F.lit("").alias("at"), F.format_string("Files: %d, tokens: %d, findings: %d, clean files: %d", "n_files", "n_tokens", "n_violations", "n_clean_files").alias("line"))
    found = laws.select(F.lit(1).alias("section"), F.col("law").alias("at"), F.format_string("[%s] %d", "law", "n").alias("line"))
    run = commands.groupBy("command").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))
    told = run.select(F.lit(2).alias("section"), F.col("command").alias("at"), F.format_string("%s: %d runs, %d failed", "command", "n", "failed").alias("line"))
    return head.unionByName(found).unionByName(told)


def event_lines(events: DataFrame) -> DataFrame:
    """Each row as one line of a log of JSON documents."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def append_log(events: DataFrame, folder: str) -> None:
    event_lines(events).write.mode("append").text(folder)


def file_reports(files: DataFrame, violations: DataFrame) -> DataFrame:
    """files(path, token_count) as JSON documents with their violations, each file's in order of rows."""
    grouped = violations.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row", "law", "message", "confidence"))).alias("violations"))
    joined = met(files, grouped, "path", "left").withColumn("violations", F.coalesce("violations", F.array().cast("array<struct<row:int,law:string,message:string,confidence:string>>")))
    return joined.select("path", F.to_json(F.struct("path", "token_count", "violations")).alias("report"))


def gate(report: DataFrame, commands: DataFrame, locality_passed: bool = True) -> DataFrame:
    """commands(passed): whether there are no violations, locality passed and so did all commands."""
    run = commands.agg(F.count("*").alias("n_commands"), F.count_if(~F.col("passed")).alias("n_failed"))
    return report.crossJoin(run).withColumn("passed", F.col("passed") & (F.col("n_failed") == 0) & F.lit(locality_passed))


def output_counts(commands: DataFrame) -> DataFrame:
    """commands(command, stdout, stderr) -> lines that speak of errors and of warnings."""
    lines = F.split(F.concat_ws("\n", "stdout", "stderr"), "\n")
    count = lambda word: F.size(F.filter(lines, lambda x: F.contains(x, F.lit(word))))
    return commands.select("command", count("error").alias("n_errors"), count("warning").alias("n_warnings"))
