"""Judging only what changed: a stream of files, a ledger of what was judged, and the findings of each file's latest content.

Every batch asks the ledger for the digests of its paths and judges those alone whose digest is new. What it judged and
found is written under the batch's own number, so a batch that is run again after a failure replaces its own rows and
nothing else, and a finished one is never repeated. Nothing that was written before is rewritten: the state is, for each
path, what its last batch says. The ledger is read by a join on path, and only digests are read, not findings.

A path that comes several times in a batch counts with its highest ord. A null content says that the file is gone: it has
no findings from then on. Files with a null path are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Judge = Callable[[DataFrame], DataFrame]
LEDGER = "path string, digest string, batch long"
FINDINGS = "path string, row int, law string, message string, confidence string, batch long"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest(ledger: DataFrame) -> DataFrame:
    """path, digest, batch of each path's last batch; the digest is null of files that are gone."""
    return ledger.groupBy("path").agg(F.max(F.struct("batch", "digest")).alias("l")).select("path", "l.digest", "l.batch")


def judge_batch(files: DataFrame, batch: int, folder: str, judge: Judge) -> None:
    """files(path, content, ord) of one batch; judge: files(path, content) to findings(path, row, law, message, confidence)."""
    spark = files.sparkSession
    before = latest(_read(spark, f"{folder}/ledger", LEDGER).where(F.col("batch") < batch)).select("path", F.col("digest").alias("known"), F.lit(True).alias("seen"))
    last = files.where("path IS NOT NULL").groupBy("path").agg(F.max_by("content", "ord").alias("content"))
    told = last.withColumn("digest", F.sha2("content", 256)).join(before, "path", "left")
    new = told.where(~F.col("digest").eqNullSafe(F.col("known")) | (F.col("seen").isNull() & F.col("content").isNotNull()))
    found = judge(new.where("content IS NOT NULL").select("path", "content")).select("path", F.col("row").cast("int").alias("row"), "law", "message", "confidence")
    found.write.mode("overwrite").parquet(f"{folder}/findings/batch={batch}")
    new.select("path", "digest").write.mode("overwrite").parquet(f"{folder}/ledger/batch={batch}")  # last: only what is in the ledger counts as judged


def watch(files: DataFrame, folder: str, judge: Judge, checkpoint: str) -> StreamingQuery:
    """Judges a stream of files(path, content, ord) until what is there is read; called again it goes on where it ended."""
    return files.writeStream.foreachBatch(lambda df, k: judge_batch(df, k, folder, judge)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of every file's latest content."""
    now = latest(_read(spark, f"{folder}/ledger", LEDGER)).select("path", "batch")
    return _read(spark, f"{folder}/findings", FINDINGS).join(now, ["path", "batch"], "left_semi").drop("batch")


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """batch, n: how many files each batch judged or dropped."""
    return _read(spark, f"{folder}/ledger", LEDGER).groupBy("batch").agg(F.count("*").alias("n"))
