"""Metrics of types from normalised tables.

scopes(path, scope, row, is_enum, derives array<string>), fields(path, scope, name, is_public),
methods(path, scope, name, field_access, internal_calls, external_calls array<string>, cognitive, is_mutable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.config import RuleConfig
from archlens.functions.tables import DATA_DERIVES, TYPE_MESSAGES
from archlens.functions.text import one_decimal
from archlens.operators.joins import met

KEY = ["path", "scope"]


def _lcom4(methods: Column) -> tuple[Column, Column]:
    """Components and number of an array<struct<name,field_access,internal_calls>> of methods, linked by a field that both use or by a call; methods of one name are one.

    A method is a set of marks: its name, its fields, and the scope's methods that it calls. Sets that overlap are merged one
    by one, as a type's methods are few; what is left are the components. Unknown names and fields link nothing. Nothing
    leaves the row.
    """
    names = F.array_distinct(F.transform(methods, lambda m: m["name"]))
    own = lambda m: F.filter(F.coalesce(m["internal_calls"], F.array().cast("array<string>")), lambda c: F.array_contains(names, c))
    marked = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    fields = lambda m: F.filter(F.coalesce(m["field_access"], F.array().cast("array<string>")), lambda x: x.isNotNull())
    sets = F.transform(F.filter(methods, lambda m: m["name"].isNotNull()), lambda m: F.concat(F.array(F.concat(F.lit("m "), m["name"])), marked("f ", fields(m)), marked("m ", own(m))))
    met = lambda groups, s: F.flatten(F.concat(F.array(s), F.filter(groups, lambda g: F.arrays_overlap(g, s))))
    merged = F.aggregate(sets, F.array().cast("array<array<string>>"), lambda groups, s: F.concat(F.filter(groups, lambda g: ~F.arrays_overlap(g, s)), F.array(F.array_distinct(met(groups, s)))))
    return F.size(merged).cast("long"), F.size(names).cast("long")


def by_scope(methods: DataFrame) -> DataFrame:
    """All that is asked of a scope's methods, by one shuffle: lcom4, n_methods, cbo, sfout, has_behaviour, uses_fields, complexity."""
    grouped = methods.groupBy(*KEY).agg(
        F.collect_list(F.struct("name", "field_access", "internal_calls")).alias("methods"), F.array_distinct(F.flatten(F.collect_list("external_calls"))).alias("calls"),
        F.max(F.size(F.array_distinct(F.filter("external_calls", lambda x: x.isNotNull())))).alias("sfout"), F.max((F.col("cognitive") > 0) | F.col("is_mutable")).alias("has_behaviour"),
        F.max(F.size("field_access") > 0).alias("uses_fields"), F.sum("cognitive").alias("complexity"),
    )
    components, names = _lcom4(F.col("methods"))
    return grouped.select(*KEY, components.alias("lcom4"), names.alias("n_methods"), F.size(F.filter("calls", lambda x: x.isNotNull())).cast("long").alias("cbo"), "sfout", "has_behaviour", "uses_fields", "complexity")


def lcom4(methods: DataFrame) -> DataFrame:
    return by_scope(methods).select(*KEY, "lcom4", "n_methods")


def cbo(methods: DataFrame) -> DataFrame:
    return by_scope(methods).select(*KEY, "cbo")


def sfout(methods: DataFrame) -> DataFrame:
    return by_scope(methods).select(*KEY, "sfout")


def ahf(scopes: DataFrame, fields: DataFrame) -> DataFrame:
    """Percent of fields that are private; 100 without fields."""
    counted = fields.groupBy(*KEY).agg(F.count("*").alias("n_fields"), F.count_if(~F.col("is_public")).alias("n_private"))
    known = met(scopes.select(*KEY), counted, KEY, "left").fillna(0, ["n_fields", "n_private"])
    return known.withColumn("ahf", F.when(F.col("n_fields") == 0, 100.0).otherwise(F.col("n_private") / F.col("n_fields") * 100))


def inspected(scopes: DataFrame, fields: DataFrame, methods: DataFrame, rules: RuleConfig = RuleConfig()) -> DataFrame:
    """All metrics of each scope, one row each."""
    out = met(met(scopes, ahf(scopes, fields), KEY), by_scope(methods), KEY, "left")
    return out.fillna(0, ["lcom4", "n_methods", "cbo", "sfout", "complexity"]).fillna(False, ["has_behaviour", "uses_fields"])


def violations(metrics: DataFrame, rules: RuleConfig = RuleConfig()) -> DataFrame:
    """path, row, law, message, confidence of inspected scopes that break a limit."""
    c = F.col
    say = lambda law, value: F.format_string(TYPE_MESSAGES[law], c("scope"), value)
    data = F.arrays_overlap("derives", F.array(*map(F.lit, DATA_DERIVES)))
    simple = (c("n_fields") <= 3) | (c("complexity") <= 3)
    checks = [
        ("LCOM4", ~c("is_enum") & c("has_behaviour") & c("uses_fields") & (c("n_methods") >= 4) & (c("lcom4") > rules.max_lcom4), say("LCOM4", c("lcom4"))),
        ("AHF", ~c("is_enum") & ~data & ~simple & c("has_behaviour") & (c("n_fields") > 0) & (c("ahf") < rules.min_ahf), say("AHF", one_decimal(c("ahf")))),
        ("CBO", c("cbo") > rules.max_cbo, say("CBO", c("cbo"))),
        ("SFOUT", c("sfout") > rules.max_sfout, say("SFOUT", c("sfout"))),
    ]
    found = F.array(*[F.when(test, F.struct(F.lit(law).alias("law"), message.alias("message"))) for law, test, message in checks])
    return metrics.select("path", "row", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select("path", "row", "v.*", F.lit("Medium").alias("confidence"))
