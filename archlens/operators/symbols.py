"""Definitions, references and types of files, from their text: what the symbol graph and the cohesion of types are made of.

A declaration's owner is the nearest block around it, which a containment join finds; fields are read from the body of
their struct, methods and what they use from the body of theirs. Bodies are cut out of the text by the places that the
blocks know, so each file's text meets its blocks by one join on its path.

What differs from a syntax tree: comments within a body count as its text unless they are line comments; what is called on
the result of another call goes by its own name alone; a struct's field must begin a line or follow a comma or brace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.functions.tables import CALL_LIKE_WORDS, DEFINITION_KINDS
from archlens.functions.text import language
from archlens.operators import cohesion, imports
from archlens.operators.blocks import in_blocks, marked, measured, signs
from archlens.operators.graph import symbol_edges
from archlens.operators.joins import dealt, met
from archlens.operators.ranges import within
from archlens.operators.rules import governed, lines_of

_IMPL_NAME = r"(?:\bfor\s+|^impl(?:\s*<[^{}]*?>)?\s+)([A-Za-z_]\w*)\s*(?:\bwhere\b[\s\S]*)?$"


def _impl_name(head: Column) -> Column:
    """The type of an impl's head, empty unless it is a plain name."""
    return F.regexp_extract(F.trim(head), _IMPL_NAME, 1)


def definitions(files: DataFrame) -> DataFrame:
    """path, name, kind, row, signature (its line, trimmed) of functions, types, modules, constants and impls; of Python, functions and classes."""
    c = F.col
    rows = in_blocks(signs(files))
    word = F.regexp_extract("sign", r"^[a-z]+", 0)
    kinds = F.create_map(*[x for pair in DEFINITION_KINDS.items() for x in map(F.lit, pair)])
    plain = rows.where(word.isin(*DEFINITION_KINDS) & (word != "impl")).select("path", F.regexp_extract("sign", r"\s([A-Za-z_$][\w$]*)$", 1).alias("name"), F.element_at(kinds, word).alias("kind"), "row")
    impls = rows.where("kind = 'impl'").select("path", _impl_name(c("head.text")).alias("name"), F.element_at(kinds, F.lit("impl")).alias("kind"), c("head.row").alias("row"))
    lines = lines_of(dealt(governed(files).select("path", "content")))
    found = r"^\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)"
    python = lines.where((language(c("path")) == "python") & c("line").rlike(found)).select(
        "path", F.regexp_extract("line", found, 2).alias("name"), F.element_at(kinds, F.regexp_extract("line", found, 1)).alias("kind"), c("row").cast("int").alias("row"), F.trim("line").alias("signature"),
    )
    named = plain.unionByName(impls).where("name <> ''")
    told = met(named, lines.select("path", "row", "line"), ["path", "row"]).select("path", "name", "kind", "row", F.trim("line").alias("signature"))
    return told.unionByName(python)


def symbol_graph(files: DataFrame) -> DataFrame:
    """src, dst, weight from files: names that a file's imports end in, joined to the files that define them."""
    refs = imports.imports(files).select("path", F.col("import").alias("name"))
    return symbol_edges(definitions(files).select("path", "name"), refs)


def types(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scopes, fields and methods of Rust files, as the operators on cohesion take them. A type that several blocks of a file tell of is one, in the row of its declaration if the file has it."""
    c = F.col
    rust = files.where(language(c("path")) == "rust").select("path", "content")
    rows = marked(rust)
    blocks = rows.where("opens AND end_at IS NOT NULL").select("path", "kind", "depth", "head", F.col("at").alias("low"), F.col("end_at").alias("high"), "first", "end")
    declared = blocks.where("kind IN ('struct', 'enum')").withColumn("scope", F.regexp_extract("head.text", r"(\w+)$", 1))
    owners = blocks.where("kind = 'impl'").withColumn("scope", _impl_name(c("head.text"))).where("scope <> ''")

    # what stands before a declaration: attributes and comments directly above it
    texts = met(declared, rust, "path")
    above = F.regexp_extract(F.substring(c("content"), F.lit(1), (c("head.first") - 1).cast("int")), r"((?:(?:^|\n)\s*(?:#\[[^\n]*\]|//[^\n]*))*)\s*(?:pub(?:\([^)\n]*\))?\s+)?$", 1)
    derives = F.flatten(F.transform(F.regexp_extract_all(above, F.lit(r"#\[derive\(([^\n]*?)\)\]"), F.lit(1)), lambda x: F.split(x, ",")))
    derives = F.filter(F.transform(derives, lambda x: F.trim(x)), lambda x: x != "")
    body = F.regexp_replace(F.substring(c("content"), c("first").cast("int"), (c("end") - c("first")).cast("int")), r"//[^\n]*", "")
    pattern = r"[{,\n]\s*(?:#\[[^\n]*\]\s*)*(pub(?:\([^)\n]*\))?\s+)?([a-z_]\w*)\s*:(?!:)"
    read = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("pub"), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)).alias("name"))
    held = texts.select("path", "scope", "kind", c("head.row").alias("row"), derives.alias("derives"), F.when(c("kind") == "struct", read).alias("fields"))
    fields = held.select("path", "scope", F.explode("fields").alias("f")).select("path", "scope", "f.name", (c("f.pub") != "").alias("is_public")).dropDuplicates(["path", "scope", "name"])

    functions = rows.where("kind = 'fn' AND end_at IS NOT NULL").select("path", F.regexp_extract("head.text", r"([\w$]+)$", 1).alias("name"), "at", "first", "end", c("head.first").alias("from"), c("depth").alias("own_depth"))
    owned = within(functions, owners.select("path", "scope", "depth", "low", "high", c("head.row").alias("owner_row"))).where("own_depth = depth + 1")
    cut = met(owned, rust, "path")
    header = F.substring(c("content"), c("from").cast("int"), (c("first") - c("from")).cast("int"))
    inner = F.substring(c("content"), c("first").cast("int"), (c("end") - c("first")).cast("int"))
    receiver = F.regexp_extract(header, r"\(\s*((?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?self)\b", 1)
    calls = F.array_distinct(F.filter(F.regexp_extract_all(inner, F.lit(r"((?:\b[A-Za-z_]\w*(?:::|\.))*\b[A-Za-z_]\w*)\s*\("), F.lit(1)), lambda x: ~x.isin(*CALL_LIKE_WORDS)))
    mine = lambda x: F.startswith(x, F.lit("self."))
    methods = cut.select(
        "path", "scope", "name", "owner_row", "at", receiver.alias("receiver"), F.array_distinct(F.regexp_extract_all(inner, F.lit(r"\bself\.([A-Za-z_]\w*)"), F.lit(1))).alias("field_access"),
        F.transform(F.filter(calls, mine), lambda x: F.replace(x, F.lit("self."), F.lit(""))).alias("internal_calls"), F.filter(calls, lambda x: ~mine(x)).alias("external_calls"),
    ).where("receiver <> ''")
    scores = measured(rust, rows).select("path", c("low").alias("at"), "cognitive")
    methods = met(methods, scores, ["path", "at"]).withColumn("is_mutable", F.contains("receiver", F.lit("mut")))

    told = held.where("kind = 'enum' OR size(fields) > 0").select("path", "scope", "row", (c("kind") == "enum").alias("is_enum"), "derives", F.lit(0).alias("rank"))
    told = told.unionByName(owners.select("path", "scope", c("head.row").alias("row"), F.lit(False).alias("is_enum"), F.array().cast("array<string>").alias("derives"), F.lit(1).alias("rank")))
    scopes = told.groupBy("path", "scope").agg(F.min(F.struct("rank", "row", "is_enum", "derives")).alias("s")).select("path", "scope", "s.row", "s.is_enum", "s.derives")
    return scopes, fields, methods.select("path", "scope", "name", "field_access", "internal_calls", "external_calls", "cognitive", "is_mutable")


def type_violations(files: DataFrame) -> DataFrame:
    """Findings on the cohesion of types, from files."""
    return cohesion.violations(cohesion.inspected(*types(files)))
