"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger is a Parquet table of (blob, rule_version, spans): only
pairs of a blob and a rule's version that it lacks are scanned, each once however many paths hold the blob, and findings
are joined back to all paths. Everything is DataFrame functions.

A rule's version is a hash of its definition, so that a changed rule is scanned anew and the others aren't. Spans are
half-open code-point ranges; matches are leftmost and non-overlapping, and those too short are dropped after matching.

Defined results: null text is an empty blob without findings; repeated rows each get their findings; an empty table
gives an empty result and adds nothing to the ledger; other columns of the input are kept out of the ledger.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm.common import read_table, shared_dir, spread_join, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression; group: the part whose length counts; least: its least length in characters; hint: a pattern that every text with such a match has a match of."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()[:16]


#: In the order in which spans with equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, r"(?i:password|passwd|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)

LEDGER_SCHEMA = "blob binary, rule_version string, spans array<struct<start:long,end:long>>"
SPANS = "array<struct<start:long,end:long>>"


def find_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>>: the gaps between matches and the matches' lengths add up to positions."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        found = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        good = x["whole"].isNotNull() & (F.length(x["value"]) >= rule.least)
        return F.struct(F.coalesce(end, begin).cast("long").alias("at"), F.when(good, F.concat(acc["spans"], found)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.hint), spans).otherwise(F.array().cast(SPANS))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """An absent ledger is an empty one."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan_unseen(spark: SparkSession, versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = BASE_RULES) -> None:
    """Append to the ledger what it lacks for the texts of versions(text)."""
    own = read_ledger(spark, ledger_path)
    wanted = [r.version for r in rules]
    seen = own.where(F.col("rule_version").isin(wanted)).groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    texts = versions.select(text_or_empty().alias("text")).select(blob_of(F.col("text")).alias("blob"), "text")
    complete = seen.where(F.size("seen") == len(wanted)).select("blob")
    blobs = texts.join(complete, "blob", "left_anti").dropDuplicates(["blob"]).join(seen, "blob", "left")
    lacking = lambda r: F.col("seen").isNull() | ~F.array_contains("seen", r.version)
    found = F.array(
        *[
            F.when(lacking(r), F.struct(F.lit(r.version).alias("rule_version"), find_spans(F.col("text"), r).alias("spans")))
            for r in rules
        ]
    )
    rows = blobs.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("blob", "f.rule_version", "f.spans")
    rows.write.mode("append").parquet(ledger_path)


def findings(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """docs with spans array<struct<start,rank,end,kind>> from the ledger, by start, then by the rules' order."""
    spark = docs.sparkSession
    own = read_ledger(spark, ledger_path).where(F.col("rule_version").isin([r.version for r in rules]))

    def listed(k: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    each = [listed(k, r.kind) for k, r in enumerate(rules)]
    wide = own.groupBy("blob").agg(*[F.max(F.when(F.col("rule_version") == r.version, F.col("spans"))).alias(r.kind) for r in rules])
    wide = wide.select(F.col("blob").alias("_blob"), F.array_sort(F.concat(*each)).alias("_spans")).where(F.size("_spans") > 0)
    keyed = docs.withColumn("_blob", blob_of(text_or_empty()))
    joined = spread_join(keyed, wide, "_blob").drop("_blob")
    empty = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    return joined.withColumn("spans", F.coalesce("_spans", empty)).drop("_spans")


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    scan_unseen(docs.sparkSession, docs, ledger_path, rules)
    return findings(docs, ledger_path, rules)


def fresh_ledger(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/blob-ledger-{uuid.uuid4().hex}"


def redact(docs: DataFrame) -> DataFrame:
    """docs(text, spans): each run of overlapping spans becomes [KIND] of its first; spans goes."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        out = F.when(s["start"] >= acc["at"], new).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("spans", start, step)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(
        F.concat(done["out"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text")))
    )
    return docs.withColumn("text", text).drop("spans")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fresh_ledger(spark))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = F.concat_ws(",", F.transform("spans", written))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans")
    )


def oracle() -> str:
    """The same spans from DuckDB's split and extract functions."""
    rules = ",".join(f"('{r.kind}', {k}, $${r.pattern}$$, {r.group}, {r.least})" for k, r in enumerate(BASE_RULES))
    return f"""
    WITH r(kind, rank, p, grp, least) AS (VALUES {rules}),
    d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS (SELECT doc_id, kind, rank, least, string_split_regex(text, $${BASE_RULES[0].pattern}$$) AS g,
                 regexp_extract_all(text, $${BASE_RULES[0].pattern}$$) AS w, regexp_extract_all(text, $${BASE_RULES[0].pattern}$$, 1) AS v
          FROM d, r WHERE rank = 0
          UNION ALL SELECT doc_id, kind, rank, least, string_split_regex(text, $${BASE_RULES[1].pattern}$$),
                 regexp_extract_all(text, $${BASE_RULES[1].pattern}$$), regexp_extract_all(text, $${BASE_RULES[1].pattern}$$) FROM d, r WHERE rank = 1
          UNION ALL SELECT doc_id, kind, rank, least, string_split_regex(text, $${BASE_RULES[2].pattern}$$),
                 regexp_extract_all(text, $${BASE_RULES[2].pattern}$$), regexp_extract_all(text, $${BASE_RULES[2].pattern}$$) FROM d, r WHERE rank = 2),
    u AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
    s AS (SELECT doc_id, kind, rank, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS b,
                 length(w[i]) AS n FROM u WHERE length(v[i]) >= least),
    a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(kind || ':' || CAST(CAST(b AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(b + n AS BIGINT) AS VARCHAR), ',' ORDER BY b, rank) AS spans
          FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (doc_id)"""
