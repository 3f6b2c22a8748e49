"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own that driver and executors share, below spark.checkpoint.dir; what is in it may go when the application has ended. A temporary one only where both are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if found is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{found or jsc.getCheckpointDir().get()}/archlens-{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that later steps and retries don't compute them again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, group: int = 16 << 20) -> DataFrame:
    """The same rows as a table in the shared folder, for rows that carry much: compressed, and written in groups of so many bytes, which a task holds."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", group).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, rows: int = 512, size: int = 32 << 20) -> DataFrame:
    """df, after lowering the session's Arrow batches to so many rows and bytes (and a row more): texts may be long, and a batch is held in the JVM and in Python at once. Plans read both settings when they run, so they stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if not 0 < int(conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


#: A key with more rows than this, and than one part in SHARES of all, is hot.
HOT, SHARES = 1000, 1000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, nullable: bool = False) -> DataFrame:
    """rows left joined to facts, which hold a key once; nullable: keys may be null, and such rows meet nothing. Rows of hot keys stay where they are, and the facts of these, SHARES at most, are broadcast, so no key's rows meet in one task."""
    if nullable:
        return spread_join(rows.where(F.col(key).isNotNull()), facts, key).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > max(HOT, rows.count() // SHARES)).select(key)
    hot = checkpointed(hot)
    if hot.isEmpty():
        return rows.join(facts, key, "left")
    told = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi"))
    return told.where("_hot").drop("_hot").join(few, key, "left").unionByName(told.where("_hot IS NULL").drop("_hot").join(facts, key, "left"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits of SHA-256: the address of a text's content."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(src, dst); component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is two windows over the rows of a node
    and a distinct, three exchanges in all, and the number of rounds grows with the logarithm of a component's size.
    Nothing but three numbers a round (a count and two sums of 64-bit hashes) reaches the driver.
    """
    pairs = (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    pairs, seen, star = checkpointed(pairs), None, Window.partitionBy("u")
    for _ in range(max_rounds):
        both = pairs.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = both.withColumn("m", F.least(F.min("v").over(star), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lower = large.repartition("u").distinct().withColumn("m", F.min("v").over(star))  # one exchange for both
        small = lower.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        pairs = checkpointed(small.where("u <> v").distinct())
        sign = pairs.agg(F.count("*"), *[F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(20,0)")) for k in range(2)]).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of consecutive rows with equal keys, from batches sorted by keys, and where each group begins.

    Holds at least so many rows at a time and the rows of one group more, so groups must be bounded.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def begins(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            column = table.column(k).combine_chunks()
            change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least_rows:
            table = pa.Table.from_batches(held)
            starts = begins(table)
            last = int(starts[-1])
            if last:
                yield table.slice(0, last), starts[:-1]
                table = table.slice(last)
            held, rows = table.combine_chunks().to_batches(), 0
    if held:
        table = pa.Table.from_batches(held)
        yield table, begins(table)


def lowest(near: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest name of its component: a forest in place of all links."""
    a, b = np.nonzero(np.triu(near))
    found = names.copy()
    while True:
        new = found.copy()
        np.minimum.at(new, a, found[b])
        np.minimum.at(new, b, found[a])
        if (new == found).all():
            return found
        found = new


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys side by side in one partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def vector_type(df: DataFrame, name: str) -> str:
    """Floats stay floats where they are shuffled: half the bytes, and their doubles are exact."""
    return "array<float>" if df.schema[name].dataType.simpleString() == "array<float>" else "array<double>"


def usable_vector(name: str) -> Column:
    """Neither null nor empty nor zero, and all components finite. Floats of any size count."""
    odd = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(name, lambda x: x != 0), F.lit(False))
