"""Near-duplicate vectors by spherical-cap filters.

Directions come from a structured random product code: a random rotation, then two blocks, each with its own random
unit codewords; a filter is a pair of codewords. A vector belongs to all filters whose inner product with it exceeds
the cap's threshold, which is taken from the code's own sums so that a vector has a given number of filters on average;
a vector's own cap is widened where it would hold less than half of that. That number and the codewords grow with the
number of vectors until, of sampled pairs at the very cosine, a share of RECALL meets in some filter; pairs nearer than
that meet more often. The sums are list-decoded block by block, never over all pairs of codewords. Vectors that share a
filter are compared by exact cosine in double precision. A filter holds about BUCKET vectors, whatever their number.

Equal vectors are one class, compared once. A filter with many vectors is dealt out in blocks, and every pair of its
blocks is compared in a task of its own, which returns each class's number of links and a spanning forest, not the
links. A link counts in the first filter that its vectors share, so once.

Defined results: null, zero and empty vectors and those with null or non-finite components link with nothing and are
kept; repeated rows are vectors of their own, equal to one another; vectors of different lengths don't link; an empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm.common import checkpointed, connected_components, dealt_by, lowest, read_table, spread_join, usable_vector, vector_type, vectors_of, whole_groups

COSINE = 0.95
#: Vectors of a filter as expected; the largest block of a filter; filters of a vector as expected, at first, and how they grow; numbers of filters in a batch, and filters compared at once.
BUCKET, BLOCK, FILTERS, GROWTH, NUMBERS, AT_ONCE = 64, 500, 24, 1.5, 500_000, 8192
#: Least share of sampled pairs at the cosine that meet in a filter, and how many are sampled: of 2,000 pairs this shows over 0.99.
RECALL, PAIRS = 0.995, 2000
SEED = 20_240


class Cap(NamedTuple):
    """For the vectors of one dimension: codewords of each block, the threshold, least filters of a vector."""

    words: int
    threshold: float
    least: int


@lru_cache(maxsize=4)
def _code(dimension: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and both blocks' codewords, of length 1 / sqrt(2) each; a block of one dimension has two at most."""
    rng = np.random.default_rng([SEED, dimension, words])
    rotation = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
    half = max(1, dimension // 2)
    blocks = [rng.standard_normal((words, size)) for size in (half, max(1, dimension - half))]
    first, second = (b / np.linalg.norm(b, axis=1, keepdims=True) / math.sqrt(2) for b in blocks)
    return rotation, *(np.unique(np.sign(b), axis=0) / math.sqrt(2) if b.shape[1] == 1 else b for b in (first, second))


def _sums(x: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products with either block's codewords."""
    rotation, first, second = _code(x.shape[1], words)
    y = x @ rotation
    half = first.shape[1]
    return y[:, :half] @ first.T, (y[:, half:] if x.shape[1] > 1 else np.zeros((len(y), 1))) @ second.T


def _threshold(x: np.ndarray, words: int, filters: int) -> float:
    """What the sums of so many filters a vector exceed, on average over x."""
    a, b = _sums(x, words)
    b.sort(1)
    low, high = -1.0, 1.0
    for _ in range(24):
        middle = (low + high) / 2
        count = sum(b.shape[1] * a.shape[1] - int(np.searchsorted(v, middle - u).sum()) for u, v in zip(a, b)) / len(x)
        low, high = (middle, high) if count > filters else (low, middle)
    return high


def pairs_at(cosine: float, dimension: int, count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and for each one at that cosine to it."""
    rng = np.random.default_rng([seed, dimension])
    x, z = rng.standard_normal((2, count, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    near = cosine * x + math.sqrt(1 - cosine * cosine) * z
    return x, near / np.linalg.norm(near, axis=1, keepdims=True)


def recall(cap: Cap, x: np.ndarray, y: np.ndarray) -> float:
    """Share of the pairs that meet in a filter."""
    met = 0
    for k in range(0, len(x), 256):
        met += sum(len(np.intersect1d(p, q, True)) > 0 for p, q in zip(list_decode(x[k : k + 256], cap), list_decode(y[k : k + 256], cap)))
    return met / len(x)


@lru_cache(maxsize=64)
def cap_for(dimension: int, vectors: int, cosine: float) -> Cap:
    """The first cap that meets the recall: filters of a vector are added, and codewords with them, until it holds."""
    if vectors <= BUCKET:
        return Cap(1, -2.0, 1)  # all meet in every filter
    x, y = pairs_at(cosine, dimension, PAIRS)
    filters = FILTERS
    while True:
        words = max(4, math.ceil(math.sqrt(filters * vectors / BUCKET)))
        cap = Cap(words, _threshold(x[:128], words, filters), filters // 2)
        if recall(cap, x, y) >= RECALL:
            return cap
        filters = math.ceil(filters * GROWTH)


def list_decode(x: np.ndarray, cap: Cap) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of its filters."""
    a, b = _sums(x, cap.words)
    second = b.shape[1]
    order_a, order_b = np.argsort(-a, 1, "stable"), np.argsort(-b, 1, "stable")
    a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
    corner = (a[:, : cap.least, None] + b[:, None, : cap.least]).reshape(len(x), -1)  # the nearest few filters lie among these
    nth = min(cap.least, corner.shape[1])
    least = np.minimum(cap.threshold, -np.partition(-corner, nth - 1, 1)[:, nth - 1]) - 1e-12
    out = []
    for i in range(len(x)):
        reach = np.searchsorted(-b[i], a[i] - least[i], "right")  # codewords of the second block that go with each of the first
        rows = int(np.count_nonzero(reach))
        reach = reach[:rows]
        first_at = np.repeat(np.arange(rows), reach)
        second_at = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        out.append(np.sort(order_a[i, first_at] * second + order_b[i, second_at]))
    return out


def filter_rows(classes: DataFrame, caps: dict[int, Cap], names_only: bool = False) -> DataFrame:
    """classes(rep, size, vector) -> a row for each filter: filter, rep, size, filters (those below it), vector; or filter alone, for counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sizes = part.column("vector").value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    of = part.take(pa.array(np.flatnonzero(sizes == size)))
                    x = vectors_of(of.column("vector")).astype(np.float64)
                    found = list_decode(x / np.linalg.norm(x, axis=1, keepdims=True), caps[int(size)])
                    if names_only:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64))], ["filter"])
                        continue
                    ends = np.cumsum([len(f) ** 2 // 2 for f in found]) // NUMBERS
                    for low, high in pairwise(np.r_[0, np.flatnonzero(np.diff(ends)) + 1, len(found)].tolist()):
                        names = found[low:high]
                        rows = of.take(pa.array(np.repeat(np.arange(low, high), [len(f) for f in names])))
                        below = np.concatenate([f[np.tril_indices(len(f), -1)[1]] for f in names])
                        offsets = np.r_[0, np.cumsum(np.concatenate([np.arange(len(f)) for f in names]))]
                        lists = pa.ListArray.from_arrays(offsets.astype(np.int32), below.astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).astype(np.int64)), rows.column("rep"), rows.column("size"), lists, rows.column("vector")], ["filter", "rep", "size", "filters", "vector"])

    return classes.select("rep", "size", "vector").mapInArrow(run, "filter long" if names_only else f"filter long, rep long, size long, filters array<long>, vector {vector_type(classes, 'vector')}")


def in_blocks(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with i, j: a filter's rows are dealt to blocks, and each block meets each other (i <= j; side says which of both a row is of). names(filter): the same rows' filters."""
    sizes = names.groupBy("filter").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    big = sizes.select("filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = rows.join(big, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meets = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return meets.select("filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "rep", "size", "filters", "vector")


def _near(x: np.ndarray, cosine: float, across: np.ndarray | None) -> np.ndarray:
    """Symmetric matrix: which rows link; across: the sides, where only rows of different ones may."""
    norms = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / norms[:, None] / norms[None, :] >= cosine
    near |= near.T
    np.fill_diagonal(near, False)
    return near if across is None else near & (across[:, None] != across[None, :])


def _share_before(before: list[np.ndarray]) -> np.ndarray:
    """Symmetric matrix: whose lists of numbers meet."""
    n = len(before)
    names, name = np.unique(np.concatenate(before), return_inverse=True)
    of_row, shared = np.repeat(np.arange(n), [len(f) for f in before]), np.zeros((n, n), np.float32)
    order = np.argsort(name, kind="stable")
    name, of_row = name[order], of_row[order]
    for k in range(0, len(names), AT_ONCE):
        low, high = np.searchsorted(name, (k, k + AT_ONCE))
        holds = np.zeros((n, min(AT_ONCE, len(names) - k)), np.float32)
        holds[of_row[low:high], name[low:high] - k] = 1
        shared += holds @ holds.T
    return shared > 0


def links(rows: DataFrame, cosine: float) -> DataFrame:
    """rows in blocks -> rep, linked, low: how many vectors a class is told to be linked with here, and the smallest class that its links here reach. Each link counts in the first filter that its classes share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["filter", "i", "j"], 4096):
            ends = np.r_[starts[1:], table.num_rows]
            i, j, side, reps, counts = (table.column(c).to_numpy() for c in ("i", "j", "side", "rep", "size"))
            filters, vectors = table.column("filters").combine_chunks(), table.column("vector").combine_chunks()
            found = []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                sizes = vectors[s:e].value_lengths().to_numpy()
                for size in np.unique(sizes):
                    at = s + np.flatnonzero(sizes == size)
                    if len(at) < 2:
                        continue
                    near = _near(vectors_of(vectors.take(pa.array(at))).astype(np.float64), cosine, side[at] if i[s] < j[s] else None)
                    some = np.flatnonzero(near.any(1))
                    if not len(some):
                        continue
                    at, near = at[some], near[np.ix_(some, some)]
                    near &= ~_share_before([filters[k].values.to_numpy() for k in at])
                    linked = near.astype(np.float64) @ counts[at]
                    told = np.flatnonzero(linked)
                    if len(told):
                        found.append((reps[at][told], linked[told].astype(np.int64), lowest(near, reps[at])[told]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["rep", "linked", "low"])

    return dealt_by(rows, "filter", "i", "j").mapInArrow(run, "rep long, linked long, low long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(vector_type(vectors, "embedding")).alias("vector"))
    usable = rows.where(usable_vector("vector") & F.col("vec_id").isNotNull())
    classes = checkpointed(usable.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    dimensions = classes.groupBy(F.size("vector").alias("dimension")).count().collect()  # a row for each dimension
    caps = {r["dimension"]: cap_for(r["dimension"], r["count"], cosine) for r in dimensions}
    found = checkpointed(links(in_blocks(filter_rows(classes, caps), filter_rows(classes, caps, names_only=True)), cosine))
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    components = connected_components(found.select(F.col("rep").alias("src"), F.col("low").alias("dst")))
    told = (
        classes.join(linked, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
        .select("vector", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    seen = rows.withColumn("vector", F.when(usable_vector("vector") & F.col("vec_id").isNotNull(), F.col("vector")))
    out = spread_join(seen, told, "vector", nullable=True).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def oracle() -> str:
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {COSINE}),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
    FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
