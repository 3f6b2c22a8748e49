"""Streams of files: only what changed is judged, a repeated batch changes nothing, and a restart goes on."""

from pyspark.sql import functions as F

from archlens.operators import rules
from archlens.streaming import rescan

SCHEMA = "path string, content string, ord long"
BAD = 'let api_key = "abcdefgh";'


def judge(files):
    return rules.check(files, "hardcoded_secrets")


def state(spark, folder):
    return sorted((r["path"], r["row"]) for r in rescan.findings(spark, folder).collect()), {r["batch"]: r["n"] for r in rescan.judged(spark, folder).collect()}


def test_batches(spark, tmp_path):
    folder = str(tmp_path / "state")
    batches = [
        [("a.rs", BAD, 1), ("b.rs", "fn f() { }", 1), ("c.rs", f"\n{BAD}", 1), (None, BAD, 1)],
        [("a.rs", BAD, 2), ("b.rs", BAD, 2), ("b.rs", f"x\n{BAD}", 3), ("c.rs", None, 2), ("gone.rs", None, 2)],
        [],
        [("c.rs", BAD, 4), ("a.rs", "fine", 4)],
    ]
    wanted = [([("a.rs", 1), ("c.rs", 2)], {0: 3}), ([("a.rs", 1), ("b.rs", 2)], {0: 3, 1: 2}), ([("a.rs", 1), ("b.rs", 2)], {0: 3, 1: 2}), ([("b.rs", 2), ("c.rs", 1)], {0: 3, 1: 2, 3: 2})]
    for k, (rows, after) in enumerate(zip(batches, wanted)):
        for _ in range(2):  # run again, as after a failure
            rescan.judge_batch(spark.createDataFrame(rows, SCHEMA), k, folder, judge)
        assert state(spark, folder) == after


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    files, folder, checkpoint = f"{tmp_path}/files", f"{tmp_path}/state", f"{tmp_path}/checkpoint"
    counted = []

    def counting(df):
        counted.append(df.count())
        return judge(df)

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files)
        rescan.watch(stream, folder, counting, checkpoint).awaitTermination()

    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(files)
    put([("a.rs", BAD, 1), ("b.rs", BAD, 1)])
    go()
    go()
    put([("a.rs", BAD, 2), ("b.rs", "fine", 2)])
    go()
    assert counted == [2, 1]
    assert state(spark, folder) == ([("a.rs", 1)], {0: 2, 1: 1})


def test_findings_keep_their_columns(spark, tmp_path):
    rescan.judge_batch(spark.createDataFrame([("a.rs", BAD, 1)], SCHEMA).withColumn("batch", F.lit(9)), 0, str(tmp_path / "s"), judge)
    assert rescan.findings(spark, str(tmp_path / "s")).columns == ["path", "row", "law", "message", "confidence"]
    assert rescan.findings(spark, str(tmp_path / "none")).count() == 0
