"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample by k-means whose assignment cost grows with a cluster's size, so that lists stay
balanced; where there are many, clusters of clusters are fitted first. Centroids are searched by a graph in memory (each
one's nearest others, walked best first with a beam from a few entry points). Every vector is indexed: it goes to its
nearest cluster and, if it lies near a boundary, to others hardly farther, unless the centroid of a cluster already
chosen is much nearer to that centroid than the vector is. A query reads the lists whose centroids are at most a ratio
times as far as the REFERENCE-th nearest one, LEAST_LISTS of them at least. The ratio is the least, RATIO or more, at which a share
TARGET of the true neighbours of PROBES sampled vectors, found by a pass over all vectors, lies in the lists read.
Distances are exact, in double precision.

Lists are dealt out in blocks of bounded size; a block keeps a query's best few, and the best of all blocks are merged.
Equal vectors are one class, searched for and found once; a class stands for its smallest ids only, as many as can matter.

Bounded, whatever the table's size: the sample (about SAMPLE vectors, and SAMPLE_NUMBERS components), taken by hash, and
the number of lists (MOST_LISTS), beyond which lists grow with the data. All vectors are indexed. Measured against brute
force, recall at 10 and the share of rows read are in the README.

Defined results: vectors that are null, empty or zero, of other lengths than most, or that have null or non-finite
components take no part; repeated rows are neighbours like any; fewer candidates than asked for are all returned; ties
go to the smaller id; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.llm.common import checkpointed, dealt_by, read_table, usable_vector, vector_type, vectors_of, whole_groups

NEIGHBOURS, EVERY = 10, 100
SAMPLE, SAMPLE_NUMBERS, MOST_LISTS, LIST = 100_000, 8_000_000, 16_384, 32
#: Sampled vectors of a list: more would make the nearest centroids less telling.
OF_LIST = 14
#: Lists fitted at once; rounds; neighbours of a centroid in the graph; where its walks start; centroids expanded at once.
FLAT, ROUNDS, DEGREE, ENTRIES, WIDTH = 2048, 10, 16, 16, 8
#: What a cluster of twice the usual size gets dearer by in a round, as a share of the mean squared distance.
STEP = 0.03
#: Clusters of a vector at most; how much farther than the nearest they may be.
COPIES, BOUNDARY = 4, 1.15
#: A further cluster's centroid is at least so many times as far from those of the clusters chosen as from the vector.
SPREAD = 0.5
#: Lists of a query: all within a ratio of the nearest centroid's distance, which is no less than this, and at least so many.
RATIO, LEAST_LISTS = 1.0, 24
#: The centroid whose distance the ratio refers to, counted from the nearest: a single one may lie by chance on the query.
REFERENCE = 8
#: Sampled vectors whose true neighbours choose the ratio, and the share of these that lies in the lists read.
PROBES, TARGET = 128, 0.93
BLOCK = 4_096
#: Rows of a matrix of distances while fitting.
AT_ONCE = 256
SEED = 11


def _squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (points**2).sum(1) - 2 * x @ points.T


@dataclass
class Centroids:
    points: np.ndarray
    graph: np.ndarray

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best first over the graph, all rows of x in step: (numbers, distances) of about the beam nearest, nearest first. A beam of a quarter of all looks at all."""
        lists = len(self.points)
        beam = min(beam, lists)
        if 4 * beam >= lists:
            far = _squares(x, self.points)
            ids, far, _ = self._best(np.broadcast_to(np.arange(lists), far.shape), far, np.zeros(far.shape, bool), beam)
        else:
            ids, far = self._walked(x, beam)
        order = np.argsort(far, 1, "stable")
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(np.take_along_axis(far, order, 1), 0))

    def _walked(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, lists = len(x), len(self.points)
        start = np.unique(np.linspace(0, lists - 1, ENTRIES).astype(int))
        seen = np.zeros((n, lists), bool)
        seen[:, start] = True
        norms, own = (self.points**2).sum(1), (x**2).sum(1)
        ids, far = np.full((n, max(beam, len(start))), -1), np.full((n, max(beam, len(start))), np.inf)
        ids[:, : len(start)], far[:, : len(start)] = start, _squares(x, self.points[start])
        done = np.zeros(ids.shape, bool)
        width = min(WIDTH, ids.shape[1])
        while True:
            open_far = np.where(done, np.inf, far)
            a = np.flatnonzero(np.isfinite(open_far.min(1)))
            if not len(a):
                return ids, far
            at = np.argpartition(open_far[a], width - 1, 1)[:, :width]
            live = np.isfinite(np.take_along_axis(open_far[a], at, 1))
            done[a[:, None], at] |= live
            near = self.graph[np.where(live, ids[a[:, None], at], 0)]
            new = np.broadcast_to(live[:, :, None], near.shape).reshape(len(a), -1)
            near = near.reshape(len(a), -1)
            new = new & ~seen[a[:, None], near]
            order = np.argsort(2 * near + ~new, 1)  # of equal ones a new one comes first, and the first counts
            near, new = np.take_along_axis(near, order, 1), np.take_along_axis(new, order, 1)
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            row, column = np.nonzero(new)
            d = np.full(near.shape, np.inf)
            c = near[row, column]
            seen[a[row], c] = True
            d[row, column] = own[a[row]] + norms[c] - 2 * np.einsum("ij,ij->i", x[a[row]], self.points[c])
            ids[a], far[a], done[a] = self._best(np.concatenate([ids[a], near], 1), np.concatenate([far[a], d], 1), np.concatenate([done[a], ~new], 1), ids.shape[1])

    @staticmethod
    def _best(ids: np.ndarray, far: np.ndarray, done: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if ids.shape[1] > keep:
            at = np.argpartition(far, keep - 1, 1)[:, :keep]
            ids, far, done = (np.take_along_axis(v, at, 1) for v in (ids, far, done))
        return np.array(ids), far, done


def _balanced(sample: np.ndarray, lists: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and each vector's, by k-means in which large clusters get dearer."""
    points = sample[rng.choice(len(sample), lists, replace=False)].copy()
    want, penalty = len(sample) / lists, np.zeros(lists, np.float32)
    for _ in range(ROUNDS if lists > 1 else 1):
        own, total = [], 0.0
        for k in range(0, len(sample), AT_ONCE):
            d = _squares(sample[k : k + AT_ONCE], points)
            own.append((d + penalty).argmin(1))
            total += d.min(1).sum()
        own = np.concatenate(own)
        sizes = np.bincount(own, minlength=lists)
        penalty += np.float32(STEP * total / len(sample)) * np.clip(sizes / want - 1, -1, 2).astype(np.float32)
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(sizes)
        points[full] = np.add.reduceat(sample[order], (np.cumsum(sizes) - sizes)[full]) / sizes[full, None]
    return points, own


def fit(sample: np.ndarray, lists: int) -> Centroids:
    """Balanced clusters, of clusters where there are many, then the graph."""
    rng, sample = np.random.default_rng(SEED), sample.astype(np.float32)
    lists = max(1, min(lists, len(sample)))
    if lists <= FLAT:
        points = _balanced(sample, lists, rng)[0]
    else:
        own = _balanced(sample, -(-2 * lists // FLAT), rng)[1]
        parts = [sample[own == k] for k in np.unique(own)]
        points = np.concatenate([_balanced(p, max(1, min(len(p), round(len(p) * lists / len(sample)))), rng)[0] for p in parts])
    points, lists, near = points.astype(np.float64), len(points), []
    degree = min(DEGREE, max(1, lists - 1))
    for k in range(0, lists, AT_ONCE):
        d = _squares(points[k : k + AT_ONCE], points)
        d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
        near.append(np.argpartition(d, degree - 1, 1)[:, :degree].copy() if lists > 1 else np.zeros((1, 1), int))
    follower = np.roll(np.arange(lists), -1)[:, None]  # a ring keeps the graph in one piece
    return Centroids(points, np.concatenate([np.concatenate(near), follower], 1))


def clusters_of(c: Centroids, x: np.ndarray) -> list[np.ndarray]:
    """A vector's clusters: the nearest, and others across a boundary."""
    ids, far = c.nearest(x, 4 * COPIES)
    out = []
    for own, d in zip(ids, far):
        chosen = [own[0]]
        for i, r in zip(own[1:], d[1:]):
            if len(chosen) == COPIES or r > BOUNDARY * d[0]:
                break
            if np.sqrt(((c.points[chosen] - c.points[i]) ** 2).sum(1)).min() >= SPREAD * r:
                chosen.append(i)
        out.append(np.array(chosen))
    return out


def lists_of(c: Centroids, x: np.ndarray, ratio: float | None = None) -> list[np.ndarray]:
    """A query's lists by the ratio of distances: the beam widens until all within it lie in the nearer half."""
    ratio, beam = ratio or RATIO, 4 * LEAST_LISTS
    out: list = [None] * len(x)
    todo = np.arange(len(x))
    while len(todo):
        ids, far = c.nearest(x[todo], beam)
        near = far[:, min(REFERENCE, far.shape[1]) - 1]
        counts = [int(np.searchsorted(d, ratio * r, "right")) for d, r in zip(far, near)]
        whole = np.array([2 * n <= len(d) or len(d) == len(c.points) for n, d in zip(counts, far)])
        for k in np.flatnonzero(whole):
            out[todo[k]] = ids[k, : max(LEAST_LISTS, counts[k])]
        todo, beam = todo[~whole], 4 * beam
    return out


def ratio_for(c: Centroids, queries: np.ndarray, found: np.ndarray) -> float:
    """The ratio at which a share TARGET of found, one of which each query should find, lies in a list read."""
    nearest = np.sqrt(np.maximum(np.partition(_squares(queries, c.points), min(REFERENCE, len(c.points)) - 1, 1)[:, min(REFERENCE, len(c.points)) - 1], 0))
    needed = [np.sqrt(((c.points[own] - q) ** 2).sum(1)).min() for own, q in zip(clusters_of(c, found), queries)]
    return max(RATIO, float(np.quantile(np.array(needed) / np.maximum(nearest, 1e-300), TARGET, method="higher")) * (1 + 1e-9)) if len(needed) else RATIO


def _true_neighbours(members: DataFrame, probes: np.ndarray, k: int) -> DataFrame:
    """members(rep, vector) -> probe, vector of the k nearest to each probe: every task keeps its best few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros((0, probes.shape[1])))] * len(probes)
        for batch in batches:
            for x in np.array_split(vectors_of(batch.column("vector")).astype(np.float64), -(-batch.num_rows // 2048) or 1):
                d = _squares(probes, x)
                at = np.argpartition(d, k - 1, 1)[:, :k] if k < len(x) else np.broadcast_to(np.arange(len(x)), d.shape)
                for p in range(len(probes)):
                    far, kept = np.r_[best[p][0], d[p, at[p]]], np.concatenate([best[p][1], x[at[p]]])
                    order = np.argsort(far, kind="stable")[:k]
                    best[p] = far[order], kept[order]
        for p, (far, kept) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), p, np.int32)), pa.array(far), pa.array(list(kept), pa.list_(pa.float64()))], ["probe", "far", "vector"])

    near = members.select("vector").mapInArrow(run, "probe int, far double, vector array<double>")
    return near.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy("far"))).where(F.col("n") <= k)


def _posted(classes: DataFrame, c: Centroids, choose, tag: int) -> DataFrame:
    """classes(rep, vector) -> list, query, rep, vector: a row for each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = choose(c, vectors_of(part.column("vector")).astype(np.float64))
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                lists = pa.array(np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays([lists, pa.array(np.full(len(lists), tag, np.int32)), *(part.column(n).take(at) for n in ("rep", "vector"))], ["list", "query", "rep", "vector"])

    return classes.select("rep", "vector").mapInArrow(run, f"list int, query int, rep long, vector {vector_type(classes, 'vector')}")


def _within_best(queries: np.ndarray, points: np.ndarray, keep: int, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and points and their exact distance, for every point that isn't surely beyond a query's keep nearest: all within the keep-th rough distance and what it may err by, so that ties stay together."""
    a, b = (queries**2).sum(1), (points**2).sum(1)
    rough = a[:, None] + b - 2 * queries @ points.T
    n = min(len(points), keep)
    edge = np.partition(rough, n - 1, 1)[:, n - 1] + 16 * points.shape[1] * np.finfo(np.float64).eps * (a + b.max())
    i, j = np.nonzero(~(rough > edge[:, None]))  # sums beyond the doubles stay too
    parts = [np.sqrt(((queries[i[k : k + chunk]] - points[j[k : k + chunk]]) ** 2).sum(1)) for k in range(0, len(i), chunk)]
    return i, j, np.concatenate(parts) if parts else np.zeros(0)


def _search(rows: DataFrame, keep: int) -> DataFrame:
    """rows(list, block, part, query, rep, vector) -> a block's best of each query: query, rep, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["list", "block", "part"], 4096):
            tags, reps = table.column("query").to_numpy(), table.column("rep").to_numpy()
            x = vectors_of(table.column("vector")).astype(np.float64)
            for s, e in zip(starts, np.r_[starts[1:], len(tags)]):
                q, v = s + np.flatnonzero(tags[s:e] == 1), s + np.flatnonzero(tags[s:e] == 0)
                if not len(q) or not len(v):
                    continue
                for part in np.array_split(q, -(-len(q) // 256)):
                    i, j, exact = _within_best(x[part], x[v], keep)
                    order = np.lexsort((reps[v[j]], exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < keep
                    yield pa.RecordBatch.from_arrays([pa.array(reps[part[i[best]]]), pa.array(reps[v[j[best]]]), pa.array(exact[best])], ["query", "rep", "score"])

    return dealt_by(rows, "list", "block", "part").mapInArrow(run, "query long, rep long, score double")


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score for ids that every divides."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(vector_type(vectors, "embedding")).alias("vector"))
    rows = rows.where(usable_vector("vector") & F.col("vec_id").isNotNull()).withColumn("size", F.size("vector"))
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.col("size") == usual["size"]).drop("size")
    keep = k + 1  # a query may find itself
    of_class = Window.partitionBy("vector").orderBy("vec_id")
    members = rows.withColumn("n", F.row_number().over(of_class)).where(F.col("n") <= keep)
    members = checkpointed(members.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vector").agg(F.min("vec_id").alias("one")).drop("one")
    n = members.count()
    lists = max(1, min(MOST_LISTS, n // LIST))
    wanted = min(SAMPLE, SAMPLE_NUMBERS // max(1, usual["size"]), max(PROBES, OF_LIST * lists))
    sampled = members.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * wanted / n) + 1)).select("rep", "vector").toArrow()
    order = np.argsort(sampled.column("rep").to_numpy(), kind="stable")
    sample = vectors_of(sampled.column("vector"))[order]
    c = fit(sample, lists)
    probes = sample[np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int)].astype(np.float64)
    true = _true_neighbours(members, probes, keep).where("n > 1").select("probe", "vector").toArrow()  # the first is the probe itself; PROBES x k rows
    ratio = ratio_for(c, probes[true.column("probe").to_numpy()], vectors_of(true.column("vector"))) if true.num_rows else RATIO
    posted = checkpointed(_posted(members, c, clusters_of, 0))
    blocks = checkpointed(posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # about MOST_LISTS rows at most
    held = posted.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    queries = _posted(asking.join(members, "vector").select("rep", "vector"), c, partial(lists_of, ratio=ratio), 1)
    queries = checkpointed(queries)
    parts = checkpointed(queries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))  # about MOST_LISTS rows at most
    asked = queries.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = asked.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")
    held = held.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = _search(held.unionByName(asked), keep).dropDuplicates(["query", "rep"])
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))).where(F.col("n") <= keep).drop("n")
    ids = best.join(members.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("n") <= keep)
    told = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    answers = told.join(members.select(F.col("rep").alias("query"), "vector"), "query").select("vector", "best")
    by_id = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").join(answers, "vector")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return by_id.select("query_id", F.posexplode(others).alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
