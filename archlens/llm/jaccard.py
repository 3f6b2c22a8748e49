"""Join of documents on the Jaccard similarity of their word n-grams, by a MinHash LSH forest.

A document's set holds the hashes of its runs of five words. Each of TREES trees has a signature of DEPTH MinHash values,
and sorting all documents by it lays the tree out as a sorted prefix trie: a node is a run of documents of equal first
values. A document starts with its whole signature in every tree and shortens its matched prefixes step by step until
the expected share of pairs at the threshold that meet it in some tree reaches RECALL. It shortens all trees alike where
few share the next node; a node of more than DENSE documents (a passage that many share) keeps its longer prefix, and
other trees shorten further to make up for it. What is there to be found doesn't steer this, only crowds do, so the
recall holds. A pair meets in a tree if it shares the prefix that either of the two has come to.

Documents that meet are verified exactly on the sets. They are laid out in blocks, those of a cluster (all that chains
of meetings reach) side by side; only blocks that have a trie node in common are compared, each pair of blocks on its
own, and a comparison returns counts and a spanning forest of the links, not the links. Rows therefore grow with
documents, however large a group of near copies is, and no group is held in one task. Equal texts are one class.

Defined results: words are runs of word characters in lower case; a text of one to four words has one n-gram of them all;
equal texts link, texts without words link with nothing else; null text is empty; rows without doc_id take no part and
keep to themselves; repeated rows are documents of their own, equal to one another, and so are different texts of one
doc_id; an empty table gives an empty result; other columns don't matter; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm.common import bounded_batches, checkpointed, connected_components, dealt_by, lowest, read_table, spread_join, text_key, text_or_empty, whole_groups

WORDS, SIMILARITY = 5, 0.8
#: Values of a tree's signature, 16 bits each; the first SHORTEST make its head, the others its tail.
TREES, DEPTH, SHORTEST, RECALL = 24, 8, 4, 0.999
#: A node of more documents is a crowd; rows of a trie that are looked at together, for counting its nodes.
DENSE, AT_ONCE = 64, 20_000
#: Documents of a block; columns of a block's incidence matrix at a time, and from how many documents on a column is dense; distinct words remembered.
BLOCK, COLUMNS, FULL, CACHE = 256, 8_192, 16, 100_000
#: Blocks of a trie node that tell their pairs one by one.
FEW = 4
SEED = 97


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which pairs at the similarity meet in some tree as often as wanted, if all trees have it."""
    return next((d for d in range(depth, 1, -1) if 1 - (1 - similarity**d) ** trees >= recall), 1)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words, _find = _Words(), re.compile(r"\w+").findall


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted set of 64-bit hashes of its word n-grams."""
    out = []
    for text in texts:
        words = _find(text.lower())
        w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
        size = min(n, len(w))
        h = np.zeros(max(0, len(w) - size + 1) if size else 0, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + k + 1]
        out.append(np.unique(_mixed(h + np.uint64(size))))
    return out


def signatures(sets: list[np.ndarray], trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Heads and tails (64 bits each) of each set (row) and tree. Sets aren't empty."""
    rng = np.random.default_rng([SEED, trees])
    xor = rng.integers(0, 2**32, (trees, DEPTH), np.uint32)
    odd = rng.integers(0, 2**31, (trees, DEPTH), np.uint32) * np.uint32(2) + np.uint32(1)
    x = np.concatenate(sets)
    low = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((2, len(sets), trees), np.uint64)
    for t in range(trees):
        for k in range(DEPTH):
            v = (low ^ xor[t, k]) * odd[t, k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            value = _mixed(np.minimum.reduceat(v, starts).astype(np.uint64)) & np.uint64(0xFFFF)
            part = out[k // SHORTEST, :, t]
            part[:] = (part << np.uint64(16)) | value
    return out[0].view(np.int64), out[1].view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, key of the text, heads and tails array<long>, one of each tree (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = shingle_sets(part.column("text").to_pylist())
                full = [i for i, s in enumerate(sets) if len(s)]
                counts = np.zeros(len(sets), np.int32)
                counts[full] = TREES
                both = signatures([sets[i] for i in full], TREES) if full else (np.zeros(0, np.int64),) * 2
                lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), v.ravel()) for v in both]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *lists], ["doc_id", "key", "heads", "tails"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return bounded_batches(rows).mapInArrow(run, "doc_id long, key binary, heads array<long>, tails array<long>")


LEVELS = range(SHORTEST, DEPTH + 1)
TRIE_ROW = "node long, tree int, head long, tail long, " + ", ".join(f"n{d} int" for d in LEVELS)


def tries(classes: DataFrame) -> DataFrame:
    """classes(node, heads, tails) -> a row for each tree in which a class shares its head: node, tree, head, tail, and how many share its first 4, ..., 8 values.

    The rows of all trees are sorted and counted in runs. Runs are counted in what is looked at together, so numbers
    above that or across its edges are low; they steer what crowds cost, not what is found, and a row at an edge stays.
    """

    def counted(table: pa.Table) -> pa.RecordBatch | None:
        tree, head, tail = (table.column(c).to_numpy() for c in ("tree", "head", "tail"))
        n, tail = len(tree), tail.view(np.uint64)
        new, counts = np.r_[True, (tree[1:] != tree[:-1]) | (head[1:] != head[:-1])], []
        for d in LEVELS:
            shift = np.uint64(16 * (DEPTH - d))
            prefix = tail >> shift if d > SHORTEST else np.zeros(n, np.uint64)
            starts = np.flatnonzero(new | np.r_[True, prefix[1:] != prefix[:-1]])
            sizes = np.diff(np.r_[starts, n])
            counts.append(np.repeat(sizes, sizes).astype(np.int32))
        shared = counts[0] > 1
        shared[[0, -1]] = True
        at = pa.array(np.flatnonzero(shared))
        columns = [table.column(c).combine_chunks().take(at) for c in ("node", "tree", "head", "tail")]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c[shared]) for c in counts)], ["node", "tree", "head", "tail", *(f"n{d}" for d in LEVELS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= AT_ONCE:
                yield counted(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield counted(pa.Table.from_batches(held))

    one = F.posexplode(F.arrays_zip("heads", "tails")).alias("tree", "v")
    rows = classes.select("node", one).select("node", "tree", F.col("v.heads").alias("head"), F.col("v.tails").alias("tail"))
    order = ["tree", "head", "tail", "node"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, TRIE_ROW)


def shortened(counts: np.ndarray, similarity: float, recall: float = RECALL) -> np.ndarray:
    """Depth of each document's (row's) prefix in each tree; counts[row, tree, level] tell how many share its first values."""
    n, trees = counts.shape[:2]
    depth, gain = np.full((n, trees), DEPTH), np.log1p(-(similarity ** np.arange(DEPTH + 1)))
    row, tree = np.arange(n)[:, None], np.arange(trees)[None]
    while True:
        short = gain[depth].sum(1) > np.log1p(-recall)
        able = (depth > SHORTEST) & short[:, None]
        if not able.any():
            return depth
        crowd = counts[row, tree, np.maximum(depth - 1 - SHORTEST, 0)]
        free = able & (crowd <= DENSE)
        deepest = np.where(free, depth, 0).max(1)
        depth[free & (depth == deepest[:, None])] -= 1
        stuck = able.any(1) & ~free.any(1)  # the smallest crowd gives way
        if stuck.any():
            at = np.flatnonzero(stuck)
            depth[at, np.where(able, crowd, np.iinfo(np.int64).max)[at].argmin(1)] -= 1


def met(tried: DataFrame, similarity: float) -> DataFrame:
    """A row for each class that shares a head: node, low (of the names below that it has come to, the smallest), names of trie nodes, and whether it has come to each; it may be met in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rows, n = part.column("rows"), part.num_rows
                owner = np.repeat(np.arange(n), rows.value_lengths().to_numpy())
                flat = rows.flatten()
                tree, head, tail = (flat.field(c).to_numpy() for c in ("tree", "head", "tail"))
                counts = np.ones((n, TREES, len(LEVELS)), np.int64)
                for level, d in enumerate(LEVELS):
                    counts[owner, tree, level] = flat.field(f"n{d}").to_numpy()
                depth = shortened(counts, similarity)[owner, tree]
                times = depth - SHORTEST + 1
                at = np.repeat(np.arange(len(owner)), times)
                d = SHORTEST + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                prefix = np.where(d > SHORTEST, tail[at].view(np.uint64) >> (16 * (DEPTH - np.maximum(d, SHORTEST + 1))).astype(np.uint64), np.uint64(0))
                names = _mixed(_mixed(head[at].view(np.uint64) + (tree[at] * 16 + d).astype(np.uint64)) + prefix).view(np.int64)
                asks = d == depth[at]
                sizes = np.bincount(owner[at], minlength=n)
                starts = np.r_[0, np.cumsum(sizes)]
                low = np.minimum.reduceat(np.where(asks, names, np.iinfo(np.int64).max), starts[:-1])
                lists = [pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(v)) for v in (names, asks)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(low), *lists], ["node", "low", "names", "asks"])

    by_node = tried.groupBy("node").agg(F.collect_list(F.struct(*[c for c in tried.columns if c != "node"])).alias("rows"))
    return by_node.mapInArrow(run, "node long, low long, names array<long>, asks array<boolean>")


def _named(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.explode(F.arrays_zip("names", "asks")).alias("v")).select(*columns, F.col("v.names").alias("name"), F.col("v.asks").alias("asks"))


def clustered(meeting: DataFrame) -> DataFrame:
    """met's rows of classes that meet another, with cluster (all that chains of meetings reach) and block: BLOCK neighbours in the order of clusters and low names."""
    named = _named(meeting, "node")
    shared = named.groupBy("name").agg(F.max("asks").alias("asked"), F.min("node").alias("first"), F.max("node").alias("last")).where("asked AND first < last")
    edges = named.join(shared.select("name", "first"), "name").where("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst")).distinct()
    clusters = connected_components(edges).withColumnRenamed("component", "cluster")
    order = meeting.join(clusters, "node").repartitionByRange("cluster", "low", "node").sortWithinPartitions("cluster", "low", "node")
    return checkpointed(order.withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}")))


def blocks_that_meet(placed: DataFrame) -> DataFrame:
    """placed(cluster, block, names, asks) -> cluster, i, j: blocks (i <= j) that have a trie node of the cluster in common.

    Nodes of FEW blocks tell their pairs. A node of more tells each of its blocks the last of them only, and a block meets
    all of its cluster from itself to the last: perhaps some more than needed, but not the square of each crowd.
    """
    shared = _named(placed, "cluster", "block").groupBy("cluster", "name").agg(F.max("asks").alias("asked"), F.collect_set("block").alias("blocks")).where("asked")
    sets = shared.select("cluster", F.sort_array("blocks").alias("blocks")).distinct()
    firsts = sets.where(F.size("blocks") <= FEW).select("cluster", "blocks", F.posexplode("blocks").alias("at", "i"))
    few = firsts.select("cluster", "i", F.explode(F.slice("blocks", F.col("at") + 1, F.size("blocks"))).alias("j"))
    many = sets.where(F.size("blocks") > FEW).select("cluster", F.explode("blocks").alias("i"), F.element_at("blocks", -1).alias("last")).groupBy("cluster", "i").agg(F.max("last").alias("last"))
    whole = placed.select("cluster", "block").groupBy("cluster").agg(F.collect_set("block").alias("blocks"))
    far = many.join(whole, "cluster").select("cluster", "i", F.explode(F.filter("blocks", lambda x: x.between(F.col("i"), F.col("last")))).alias("j"))
    return few.unionByName(far).distinct()


def _with_sets(rows: DataFrame) -> DataFrame:
    """rows(node, cluster, block, size, text) with grams binary, in place of the text."""
    names = ["node", "cluster", "block", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                grams = pa.array([s.tobytes() for s in shingle_sets(part.column("text").to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), grams], [*names, "grams"])

    return rows.select(*names, "text").mapInArrow(run, "node long, cluster long, block long, size long, grams binary")


def in_pairs(rows: DataFrame, meet: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that has its own and meets in its cluster."""
    both = meet.select("cluster", F.col("i").alias("block"), "i", "j").unionByName(meet.where("i < j").select("cluster", F.col("j").alias("block"), "i", "j"))
    pairs = both.groupBy("cluster", "block").agg(F.collect_list(F.struct("i", "j")).alias("pairs"))  # as many as a cluster has blocks
    joined = rows.join(pairs, ["cluster", "block"])
    return joined.select("cluster", "block", "node", "size", "grams", F.explode("pairs").alias("p")).select("cluster", "p.i", "p.j", (F.col("block") > F.col("p.i")).alias("side"), "node", "size", "grams")


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Symmetric matrix: which sets' Jaccard similarity reaches it. Exact."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    names, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes.astype(int))
    shared = counts > 1  # the others meet nothing
    number = np.cumsum(shared) - 1
    keep = shared[at]
    row, column = row[keep], number[at[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, of = np.zeros((n, n), np.float32), np.bincount(column, minlength=1)
    full = of[column] > FULL
    dense, at, now = row[full], (np.cumsum(of > FULL) - 1)[column[full]], int((of > FULL).sum())
    for low in range(0, now, COLUMNS):
        a, b = np.searchsorted(at, (low, low + COLUMNS))
        holds = np.zeros((n, min(COLUMNS, now - low)), np.float32)
        holds[dense[a:b], at[a:b] - low] = 1
        common += holds @ holds.T
    row, column = row[~full], column[~full]
    for k in range(1, FULL):  # pairs of the few documents of a column
        same = column[k:] == column[:-k]
        common += np.bincount(row[:-k][same] * n + row[k:][same], minlength=n * n).reshape(n, n)
        common += np.bincount(row[k:][same] * n + row[:-k][same], minlength=n * n).reshape(n, n)
    np.fill_diagonal(common, sizes)
    return common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6


def verified(rows: DataFrame, similarity: float) -> DataFrame:
    """rows(cluster, i, j, side, node, size, grams) -> node, links to documents of other classes in these blocks, low (the smallest of its component there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["cluster", "i", "j"], 512):
            i, j, side, nodes, sizes = (table.column(c).to_numpy() for c in ("i", "j", "side", "node", "size"))
            grams, out = table.column("grams"), []
            for s, e in zip(starts, np.r_[starts[1:], table.num_rows]):
                if e - s < 2:
                    continue
                near = similar([np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in range(s, e)], similarity)
                if i[s] < j[s]:
                    near &= side[s:e, None] != side[None, s:e]
                np.fill_diagonal(near, False)
                if near.any():
                    linked = near.astype(np.float64) @ sizes[s:e]
                    out += [(r, int(x), m) for r, x, m in zip(nodes[s:e], linked, lowest(near, nodes[s:e])) if x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out)], ["node", "links", "low"])

    return dealt_by(rows, "cluster", "i", "j").mapInArrow(run, "node long, links long, low long")


def join_similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_links, copy_id, class_id, kept: other documents linked, the smallest doc_id of an equal text and of all reachable by links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = checkpointed(signed(docs))
    known = keyed.where(F.col("doc_id").isNotNull())
    classes = known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("heads", "tails")])
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    placed = clustered(checkpointed(met(tries(classes), similarity)))
    meet = blocks_that_meet(placed)
    wanted = classes.join(placed.select("node", "cluster", "block"), "node").select(F.col("rep").alias("doc_id"), "key", "node", "cluster", "block", "size")
    keyed_texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("key", text_key(F.col("text")))
    texts = keyed_texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["node"])
    told = checkpointed(verified(in_pairs(_with_sets(texts), meet), similarity))
    linked = told.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(told.select(F.col("node").alias("src"), F.col("low").alias("dst"))).withColumnRenamed("component", "group")
    grouped = classes.select("node", "key", "rep", "size").join(linked, "node", "left").join(components, "node", "left")
    grouped = grouped.withColumn("group", F.coalesce("group", "node"))
    smallest = grouped.groupBy("group").agg(F.min("rep").alias("class_id"))
    of_class = grouped.join(smallest, "group").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("rep").alias("copy_id"), "class_id")
    known = spread_join(known.select("doc_id", "key"), of_class, "key").drop("key").withColumn("kept", F.col("doc_id") == F.col("class_id"))
    nothing = keyed.where(F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return known.unionByName(nothing)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
