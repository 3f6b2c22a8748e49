"""Iterative graph operators on edges(src, dst[, weight]).

Each round is one join and one aggregation keyed by node; lineage is cut by checkpoint() in the shared folder, so that
rounds don't pile up and a lost executor costs a task. Only counts and sums reach the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.operators.joins import met

DAMPING, ITERATIONS = 0.85, 20


def _ready(spark: SparkSession) -> None:
    """Checkpoints go to the folder of spark.checkpoint.dir; to a temporary one only where driver and executors are one process."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder."""
    _ready(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared folder."""
    _ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder. Unlike a checkpoint's, its estimated size is that of its files: estimates of a checkpoint are those of its plan, which loops that join their own results multiply without bound."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_clean(df: DataFrame) -> DataFrame:
    """written, and its shuffles go at once; else they stay until the driver collects its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return written(df)
    finally:
        conf.set(name, before)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()


def symbol_edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """defs(path, name), refs(path, name) -> src, dst, weight: how many symbols that dst defines src refers to. A reference's name is its last :: part."""
    defs = defs.select(F.col("path").alias("dst"), "name").distinct()
    refs = refs.select(F.col("path").alias("src"), F.substring_index("name", "::", -1).alias("name")).distinct()
    return met(refs, defs, "name").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def pagerank(edges: DataFrame, anchor: str | None = None) -> DataFrame:
    """path, rank after exactly ITERATIONS rounds. Dangling nodes pass nothing on; every round is normalised to a sum of 1. With an anchor its restart share is 1 and that of the others stays 1/n."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = checkpointed(nodes_of(edges))
    n = nodes.count()
    restart = F.lit(1.0 / n) if anchor is None else F.when(F.col("path") == anchor, 1.0).otherwise(1.0 / n)
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(ITERATIONS):
        incoming = shares.join(ranks, shares.src == ranks.path).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("incoming"))
        new = nodes.join(incoming, nodes.path == incoming.dst, "left").select("path", ((1 - DAMPING) * restart + DAMPING * F.coalesce("incoming", F.lit(0.0))).alias("raw"))
        new = checkpointed(new)  # used twice, so it would be computed twice for every round after it
        ranks = new.select("path", (F.col("raw") / new.agg(F.sum("raw")).first()[0]).alias("rank"))
    return ranks


def ranked(ranks: DataFrame) -> DataFrame:
    """place, path, rank: from the highest rank on, equal ones by path. Sorted ranges are numbered side by side, so no task holds all."""
    at = ranks.orderBy(F.desc("rank"), "path").withColumn("_at", F.monotonically_increasing_id())
    at = checkpointed(at.withColumn("_part", F.shiftright("_at", 33)))
    parts = at.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each task
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return at.join(F.broadcast(shifts), "_part").select((F.col("_at") + F.col("_shift")).alias("place"), "path", "rank")


def _dropped(*tables: DataFrame) -> None:
    """The files of written tables go; what reads them must be done."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _numbers(names: DataFrame):
    """names(path, id): what nodes go by, their ids (hashes), or their paths where two share an id."""
    unlike = names.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
    return F.xxhash64 if unlike else F.col


def layers(edges: DataFrame) -> DataFrame:
    """path, layer: nodes whose dependencies all have lower layers, from 0 on; what depends on a cycle shares the last one. Loops to itself don't count.

    Rounds run on numbers; a round's tables go when the next ones are written.
    """
    names = written_clean(nodes_of(edges).withColumn("id", F.xxhash64("path")))
    key = _numbers(names)
    left = written_clean(names.select(key("path").alias("id")))
    needs = written_clean(edges.where("src <> dst").select(key("src").alias("id"), key("dst").alias("on")).distinct())
    done, layer, n_left = [], 0, left.count()
    while n_left:
        waiting = needs.select("id").distinct()
        ready = written_clean(met(left, waiting, "id", "left_anti"))
        n_ready = ready.count()
        if not n_ready:
            done.append(left.withColumn("layer", F.lit(layer + 1)))
            break
        done.append(ready.withColumn("layer", F.lit(layer)))
        n_left -= n_ready
        if n_left:
            old = left, needs
            left = written_clean(met(left, ready, "id", "left_anti"))
            needs = written_clean(met(needs, ready.withColumnRenamed("id", "on"), "on", "left_anti").select("id", "on"))
            _dropped(*old)
            layer += 1
    if not done:
        return names.select("path", F.lit(0).alias("layer"))
    told = reduce(DataFrame.unionByName, done)
    return met(names.select("path", key("path").alias("id")), told, "id").select("path", "layer")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges on a way from a cycle to a cycle: nodes without dependencies, or on which nothing depends, are peeled off until none is left. Empty without cycles."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    before = edges.count()
    while before:
        sources, targets = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = checkpointed(edges.join(sources, "dst", "left_semi").join(targets, "src", "left_semi"))
        now = edges.count()
        if now == before:
            break
        before = now
    return edges


def dependencies(edges: DataFrame, anchor: str) -> DataFrame:
    return edges.where(F.col("src") == anchor).select(F.col("dst").alias("path")).distinct()


def dependents(edges: DataFrame, anchor: str) -> DataFrame:
    return edges.where(F.col("dst") == anchor).select(F.col("src").alias("path")).distinct()


def neighbours(edges: DataFrame, anchor: str) -> DataFrame:
    return dependencies(edges, anchor).union(dependents(edges, anchor)).distinct()


def hubs(edges: DataFrame, least: int) -> DataFrame:
    """Nodes with so many dependents at least."""
    return edges.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("n_dependents")).where(F.col("n_dependents") >= least)
