"""Dependency edges(src, dst): coupling, distance, verdicts and what they sum up to.

Edges are a bag: repeated imports count. Every operator is an aggregation with map-side combine or an expression; a
node's coupling is joined to edges by its path, and Spark picks the join by the tables' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlens.config import LocalityConfig
from archlens.functions.tables import LOCALITY_SUGGESTIONS
from archlens.functions.text import any_of, components, file_name, parent
from archlens.operators.graph import checkpointed
from archlens.operators.joins import met

#: Entries of a text report's lists.
LISTED = 10


def coupling(edges: DataFrame) -> DataFrame:
    """path, ca, ce, instability, skew: one pass over both ends of the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("path"), F.lit(0).alias("a"), F.lit(1).alias("e")), F.struct(F.col("dst").alias("path"), F.lit(1).alias("a"), F.lit(0).alias("e")))).alias("x"))
    counted = ends.groupBy("x.path").agg(F.sum("x.a").alias("ca"), F.sum("x.e").alias("ce"))
    return counted.select("path", "ca", "ce", instability().alias("instability"), skew().alias("skew"))


def instability() -> Column:
    total = F.col("ca") + F.col("ce")
    return F.when(total == 0, 0.0).otherwise(F.col("ce") / total)


def skew() -> Column:
    return F.log((F.col("ca") + 1) / (F.col("ce") + 1))


def identity(ca: Column, ce: Column, config: LocalityConfig = LocalityConfig()) -> Column:
    return (
        F.when((ca > config.god_module_threshold) & (ce > config.god_module_threshold), "GodModule").when(ca + ce < config.deadwood_threshold, "IsolatedDeadwood")
        .when(ca >= 3, "StableHub").when((ca < ce) & (ce >= config.volatile_leaf_efferent), "VolatileLeaf").otherwise("Standard")
    )


def _shared(x: Column, y: Column) -> Column:
    """Leading components that two paths share, from their components."""
    least = F.least(F.size(x), F.size(y))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first_off = F.array_position(same, False)
    return F.when(first_off > 0, first_off - 1).otherwise(least).cast("int")


def shared_depth(a: Column, b: Column) -> Column:
    return _shared(components(a), components(b))


def distance(a: Column, b: Column) -> Column:
    return F.size(components(a)) + F.size(components(b)) - 2 * shared_depth(a, b)


def common_ancestor(a: Column, b: Column) -> Column:
    return F.array_join(F.slice(components(a), F.lit(1), shared_depth(a, b)), "/")


def top_module(path: Column) -> Column:
    """The component after the first src; null without one."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)src/+([^/]+)", 1), F.lit(""))


def _below(path: Column, directory: Column) -> Column:
    return (directory == "") | (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def structural(src: Column, dst: Column) -> Column:
    """Edges that module systems need: from a crate's root, between mod.rs and what is below it, within a module, to a file right below src."""
    return (
        file_name(src).isin("lib.rs", "main.rs")
        | ((file_name(src) == "mod.rs") & _below(dst, parent(src)))
        | ((file_name(dst) == "mod.rs") & _below(src, parent(dst)))
        | F.coalesce(top_module(src) == top_module(dst), F.lit(False))
        | F.regexp_extract(dst, r"(?:^|/)src/+(.*)$", 1).rlike("^[^/]+/*$")
    )


def exempt(path: Column, patterns: tuple[str, ...]) -> Column:
    return any_of([F.startswith(path, F.lit(p.removesuffix("/*"))) if p.endswith("/*") else path == p for p in patterns])


def judged(edges: DataFrame, config: LocalityConfig = LocalityConfig(), nodes: DataFrame | None = None) -> DataFrame:
    """edges with distance, the target's ca, ce and identity, verdict and reason."""
    if nodes is None:
        edges = checkpointed(edges)  # both counted and judged
        nodes = coupling(edges)
    target = nodes.select(F.col("path").alias("dst"), "ca", "ce")
    src, dst = F.col("src"), F.col("dst")
    known = met(edges, target, "dst", "left").fillna(0, ["ca", "ce"])
    known = known.withColumns({"_x": components(src), "_y": components(dst)})  # split once
    known = known.withColumns({"distance": F.size("_x") + F.size("_y") - 2 * _shared(F.col("_x"), F.col("_y")), "identity": identity(F.col("ca"), F.col("ce"), config)}).drop("_x", "_y")
    reason = (
        F.when(structural(src, dst), "Exempted").when(F.col("distance") <= config.l1_threshold, "L1Cache").when(F.col("distance") <= config.max_distance, "WithinDistance")
        .when(F.col("identity") == "StableHub", "VerticalRouting").when(exempt(dst, config.exempt_patterns), "Exempted")
    )
    return known.withColumn("reason", reason).withColumn("passed", F.col("reason").isNotNull())


def module_root(path: Column) -> Column:
    up = parent(path)
    return F.when(file_name(path) == "mod.rs", path).when(up == "", "mod.rs").otherwise(F.concat(up, F.lit("/mod.rs")))


def categorised(failed: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """Failed judged edges with category and suggestion."""
    dst = F.col("dst")
    if layers is not None:
        failed = failed.join(layers.select(F.col("path").alias("src"), F.col("layer").alias("_from")), "src", "left")
        failed = failed.join(layers.select(F.col("path").alias("dst"), F.col("layer").alias("_to")), "dst", "left")
        upward = F.coalesce(F.col("_from"), F.lit(2**31 - 1)) < F.coalesce(F.col("_to"), F.lit(2**31 - 1))
    else:
        upward = F.lit(False)
    category = (
        F.when((file_name(dst) != "mod.rs") & (F.size(components(dst)) > 2), "ENCAPSULATION_BREACH")
        .when((F.col("ca") >= 3) & (F.col("identity") != "StableHub"), "MISSING_HUB").when(upward, "UPWARD_DEP").otherwise("SIDEWAYS_DEP")
    )
    failed = failed.withColumn("category", category).drop("_from", "_to")
    say = lambda name, *values: F.format_string(LOCALITY_SUGGESTIONS[name], *values)
    suggestion = (
        F.when(F.col("category") == "ENCAPSULATION_BREACH", say("ENCAPSULATION_BREACH", module_root(dst), dst)).when(F.col("category") == "MISSING_HUB", say("MISSING_HUB", dst, F.col("ca")))
        .when(F.col("category") == "UPWARD_DEP", say("UPWARD_DEP", dst)).otherwise(say("SIDEWAYS_DEP", dst))
    )
    return failed.withColumn("suggestion", suggestion)


def summary(judged_edges: DataFrame) -> DataFrame:
    """One row: total_edges, failed_edges, entropy (their share), health (percent that passed)."""
    counted = judged_edges.agg(F.count("*").alias("total_edges"), F.count_if(~F.col("passed")).alias("failed_edges"))
    share = F.when(F.col("total_edges") == 0, 0.0).otherwise(F.col("failed_edges") / F.col("total_edges"))
    return counted.withColumns({"entropy": share, "health": (1 - share) * 100})


def god_modules(failed: DataFrame, least: int = 3) -> DataFrame:
    return failed.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("outbound_violations"), F.countDistinct("dst").alias("n_targets")).where(F.col("outbound_violations") >= least)


def hub_candidates(failed: DataFrame, least: int = 2) -> DataFrame:
    """ca is carried by the judged edges, so no second join."""
    return failed.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n_importers"), F.max("ca").alias("fan_in")).where(F.col("n_importers") >= least)


def module_coupling(edges: DataFrame) -> DataFrame:
    """Unordered pairs of different top modules, with their edges."""
    a, b = (F.coalesce(top_module(F.col(c)), F.lit("unknown")) for c in ("src", "dst"))
    modules = edges.select(a.alias("a"), b.alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))  # far fewer than edges
    pairs = modules.select(F.least("a", "b").alias("module_a"), F.greatest("a", "b").alias("module_b"), "n")
    return pairs.groupBy("module_a", "module_b").agg(F.sum("n").alias("n_edges"))


def report_lines(judged_edges: DataFrame, categories: DataFrame) -> DataFrame:
    """section, at, line of a text report: sums, failed edges by category, and the LISTED modules that fail most. judged_edges and categories (of the failed ones) as above."""
    sums = summary(judged_edges).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("at"), F.format_string("Edges: %d, failed: %d, health: %.1f%%", "total_edges", "failed_edges", "health").alias("line"))
    counted = categories.groupBy("category").agg(F.count("*").alias("n")).select(F.lit(1).alias("section"), F.xxhash64("category").alias("at"), F.format_string("%s: %d", "category", "n").alias("line"))
    bad = god_modules(categories).orderBy(F.desc("outbound_violations"), "path").limit(LISTED)
    bad = bad.select(F.lit(2).alias("section"), F.row_number().over(Window.orderBy(F.desc("outbound_violations"), "path")).cast("long").alias("at"), F.format_string("%s fails %d times", "path", "outbound_violations").alias("line"))
    return sums.unionByName(counted).unionByName(bad)
