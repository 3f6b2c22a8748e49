"""A manifest of a dataset as Merkle trees: one for each group of documents, and one over the groups' roots.

Slot pivot: children of a run are spread into columns by conditional aggregates, concatenating the columns and hashing
gives their parent, and leaving out a child's own column gives its siblings. One pivot spreads the slots of several levels
(fanout ** levels columns), so the parents above them come from the same row, and a tree of n leaves takes one shuffle of
its leaves and ever smaller ones above. On the way down a pivot's row turns into its children, each with its siblings
before those of the row's own node, so leaves get their proofs without joining the leaves again.

Digests are lowercase hex of SHA-256, and so is what goes into the next one. Leaves are numbered by ranges of (group, id),
so a group that holds most rows is spread like any other.

Defined results: a null field is `-`; null groups come first, null ids first within their group; repeated rows are leaves
of their own, in order of their digests; a group of one leaf has it as its root; an empty table has no rows and no root;
empty texts are fields of no bytes, very long ones are hashed whole; other columns take no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.llm.common import checkpointed, read_table
from archlens.llm.resampling import crc32_sql, crc_table_sql

#: Children of a node; levels that one pivot spreads.
FANOUT, LEVELS = 2, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Its UTF-8 bytes' number, a colon and itself; - if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def whole_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes(g, ...) with idx, their number within their group in that order, and n, the group's size. Sorted ranges are numbered side by side and shifted by the counts of the ranges before."""
    ranged = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.withColumn("_part", F.shiftright("_at", 33)))
    counts = ranged.groupBy("g", "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("g", "_part", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_c").over(Window.partitionBy("g")).alias("n"))
    return ranged.join(shifts, ["g", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def node(level: int, slot: int) -> str:
    return f"d{level}_{slot}"


@dataclass
class Forest:
    """The pivots of trees, the lowest first, with a row for each run of slots; tops(g, n, digest) holds their roots."""

    pivots: list[DataFrame]
    tops: DataFrame
    fanout: int
    levels: int

    @property
    def height(self) -> int:
        return self.levels * len(self.pivots)


def pivoted(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes(g, idx, n, item), item a struct with digest -> g, idx of the run, n, an item a slot, and the digests of all nodes above the run's slots, null where there is none."""
    width = fanout**levels
    slot = F.pmod("idx", F.lit(width))
    spread = [F.max(F.when(slot == s, F.col("item"))).alias(f"c{s}") for s in range(width)]
    rows = nodes.groupBy("g", whole_div(F.col("idx"), width).alias("idx")).agg(F.max("n").alias("n"), *spread)
    rows = rows.withColumns({node(0, s): F.col(f"c{s}.digest") for s in range(width)})
    for level in range(levels):
        several = F.col("n") > fanout**level  # the tree has more than one node at this level
        above = {}
        for s in range(width // fanout ** (level + 1)):
            children = [F.col(node(level, s * fanout + k)) for k in range(fanout)]
            hashed = F.when(several, F.sha2(F.concat_ws("", *children), 256)).otherwise(children[0])
            above[node(level + 1, s)] = F.when(children[0].isNotNull(), hashed)
        rows = rows.withColumns(above)
    return rows


def grown(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Forest:
    """The trees over nodes(g, idx, n, item): every fanout consecutive nodes become one until one is left; the last run may hold fewer, even one."""
    width, pivots = fanout**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        pivots.append(checkpointed(pivoted(nodes, fanout, levels)))
        most = -(-most // width)
        nodes = pivots[-1].select("g", "idx", whole_div(F.col("n") + (width - 1), width).alias("n"), F.struct(F.col(node(levels, 0)).alias("digest")).alias("item"))
        if most == 1:
            return Forest(pivots, nodes.select("g", "n", "item.digest"), fanout, levels)


def proven(forest: Forest, told: DataFrame) -> DataFrame:
    """told(g, proof, told), what each tree's leaves are to know of what is above their root -> g, idx, n, item, proof, told of every leaf; proof holds the siblings' digests, level by level, left to right."""
    fanout, levels = forest.fanout, forest.levels
    width, found = fanout**levels, told.withColumn("idx", F.lit(0).cast("long"))
    for rows in reversed(forest.pivots):
        children = []
        for s in range(width):
            siblings = []
            for level in range(levels):
                own = s // fanout**level
                siblings += [F.col(node(level, k)) for k in range(own - own % fanout, own - own % fanout + fanout) if k != own]
            children.append(F.when(F.col(node(0, s)).isNotNull(), F.struct(F.col(f"c{s}").alias("item"), F.lit(s).alias("slot"), F.concat_ws("", *siblings).alias("siblings"))))
        row = rows.select("g", "idx", "n", F.filter(F.array(*children), lambda x: x.isNotNull()).alias("children"))
        each = row.join(found, ["g", "idx"]).select("g", "idx", "n", "proof", "told", F.explode("children").alias("c"))
        found = each.select("g", (F.col("idx") * width + F.col("c.slot")).alias("idx"), "n", "c.item", F.concat("c.siblings", "proof").alias("proof"), "told")
        lowest = rows is forest.pivots[0]
        found = found if lowest else found.drop("item", "n")
    return found


def folded(leaf: Column, proof: Column, trees: list[tuple[Column, Column, int]], fanout: int = FANOUT) -> Column:
    """The root that a leaf and its siblings lead to through trees of (idx, n, levels at most), the lowest first."""
    at, h = F.lit(1), leaf
    for idx, n, height in trees:

        def step(state: Column, _: Column) -> Column:
            before = F.pmod(state["i"], F.lit(fanout))
            others = F.least(F.lit(fanout).cast("long"), state["n"] - state["i"] + before) - 1
            left = proof.substr(state["at"], (before * _HEX).cast("int"))
            right = proof.substr((state["at"] + before * _HEX).cast("int"), ((others - before) * _HEX).cast("int"))
            hashed = F.when(state["n"] > 1, digest(left, state["h"], right)).otherwise(state["h"])
            return F.struct(hashed.alias("h"), (state["at"] + others * _HEX).cast("int").alias("at"), whole_div(state["i"], fanout).alias("i"), whole_div(state["n"] + (fanout - 1), fanout).alias("n"))

        start = F.struct(h.alias("h"), at.cast("int").alias("at"), idx.cast("long").alias("i"), n.cast("long").alias("n"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(height)), start, step)
        h, at = end["h"], end["at"]
    return h


def tampered(docs: DataFrame) -> Column:
    """Whether a document is tampered with for the check: 7 divides the CRC-32 of its decimal id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves(g, id, leaf, found), g a string that isn't null, found a leaf as it is met now (null: as leaf) -> id, leaf, subroot, root, proof, folded_root, verified."""
    nodes = placed(checkpointed(leaves), "id", "leaf")
    trees = grown(nodes.select("g", "idx", "n", F.struct(F.col("leaf").alias("digest"), "id", "found").alias("item")), fanout, levels)
    roots = placed(trees.tops.select(F.lit("").alias("g"), F.col("g").alias("tree"), "digest"), "tree")
    top = grown(roots.select("g", "idx", "n", F.struct("digest", "tree").alias("item")), fanout, levels)
    below = proven(top, top.tops.select("g", F.lit("").alias("proof"), F.col("digest").alias("told")))
    known = F.struct(F.col("told").alias("root"), F.col("item.digest").alias("subroot"), F.col("idx").alias("top_idx"), F.col("n").alias("top_n"))
    rows = proven(trees, checkpointed(below.select(F.col("item.tree").alias("g"), "proof", known.alias("told"))))
    c = F.col
    root = folded(F.coalesce("item.found", "item.digest"), c("proof"), [(c("idx"), c("n"), trees.height), (c("told.top_idx"), c("told.top_n"), top.height)], fanout)
    out = rows.select(c("item.id").alias("id"), c("item.digest").alias("leaf"), "told.subroot", "told.root", "proof", root.alias("folded_root"))
    return out.withColumn("verified", c("folded_root") == c("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    leaf = digest(*[field(F.col(f)) for f in FIELDS])
    altered = digest(*[field(F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f)) for f in FIELDS])
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))  # - comes before =, so null languages come first
    rows = manifest(docs.select(group.alias("g"), F.col("doc_id").alias("id"), leaf.alias("leaf"), F.when(tampered(docs), altered).alias("found")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def oracle(levels: int = 24, top_levels: int = 8) -> str:
    """The trees level by level, for up to 2 ** levels leaves a language and 2 ** top_levels languages."""

    def say(x: str, add: int = 0) -> str:
        value = f"CAST({x}{f' + {add}' if add else ''} AS VARCHAR)"
        return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"

    def tree(name: str, base: str, height: int) -> str:
        out = [f"{name}0 AS (SELECT g, idx, n, digest FROM {base})"]
        for k in range(1, height + 1):
            hashed = "CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END"
            out.append(f"{name}{k} AS MATERIALIZED (SELECT g, idx // 2 AS idx, any_value((n + 1) // 2) AS n, {hashed} AS digest FROM {name}{k - 1} GROUP BY g, idx // 2)")
        return ", ".join(out)

    def paths(name: str, base: str, height: int) -> str:
        joins = " ".join(f"LEFT JOIN {name}{k} s{k} ON s{k}.g = b.g AND s{k}.idx = xor(b.idx >> {k}, 1)" for k in range(height))
        sides = ", ".join(f"coalesce(s{k}.digest, '') AS sib{k}" for k in range(height))
        return f"SELECT b.*, {sides}, r.digest AS top FROM {base} b {joins} JOIN {name}{height} r ON r.g = b.g"

    def fold(source: str, start: str, name: str, height: int) -> str:
        out, last = [], source
        for k in range(height):
            before = start if k == 0 else "h"
            sides = f"CASE WHEN (idx >> {k}) & 1 = 1 THEN sib{k} || {before} ELSE {before} || sib{k} END"
            out.append(f"{name}{k} AS (SELECT * {'' if k == 0 else 'EXCLUDE (h)'}, CASE WHEN n > {2**k} THEN sha256({sides}) ELSE {before} END AS h FROM {last})")
            last = f"{name}{k}"
        return ", ".join(out)

    fields, changed = " || ".join(say(f) for f in FIELDS), " || ".join(say(f, 1 if f == "n_chars" else 0) for f in FIELDS)
    crc = crc32_sql("CAST(doc_id AS VARCHAR)")
    return f"""
    WITH {crc_table_sql()},
    leaf AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({fields}) AS digest, CASE WHEN {crc} % 7 = 0 THEN sha256({changed}) ELSE sha256({fields}) END AS found FROM documents, crc_table),
    base AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaf),
    {tree('l', 'base', levels)},
    roots AS (SELECT '' AS g, g AS tree, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM l{levels}),
    {tree('t', 'roots', top_levels)},
    p AS ({paths('l', 'base', levels)}),
    {fold('p', 'found', 'f', levels)},
    q AS ({paths('t', 'roots', top_levels)}),
    j AS (SELECT f.doc_id, f.digest AS leaf, f.top AS subroot, q.top AS root, sha256({' || '.join(f'f.sib{k}' for k in range(levels))} || {' || '.join(f'q.sib{k}' for k in range(top_levels))}) AS proof_sha256,
          f.h AS lower, q.idx, q.n, {', '.join(f'q.sib{k}' for k in range(top_levels))} FROM f{levels - 1} f JOIN q ON q.tree = f.g),
    {fold('j', 'lower', 'e', top_levels)}
    SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM e{top_levels - 1}"""
