"""Fingerprints of files from their text: what they import, annotate, take, return, say and export.

Every extractor is one pattern a language over a file's text, and comments and strings are told apart by one pattern that
reads both, so that none is found within the other. All but the nouns of comments stays in the file's row; those are
counted by path and word, which partial sums before the shuffle keep small, so a file in several rows would count as one.

Types of parameters and results are taken as they are written. A parameter list ends at its first closing bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.functions.tables import COMMENT_STOP_WORDS, TELLING_STRINGS
from archlens.functions.text import language
from archlens.operators.blocks import _COMMENT, _LITERALS
from archlens.operators.taxonomy import top_nouns

_SAID = {
    "rust": (rf"({_COMMENT})|({_LITERALS['rust']})"),
    "python": r"""(#[^\n]*+)|(\"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')""",
    "other": rf"({_COMMENT})|({_LITERALS['other']})",
}
_IMPORTS = {"rust": r"\buse\s+([^;]+);", "python": r"(?m)^\s*(?:from|import)\s+([\w.]+)", "go": r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$', "other": r"""(?:\bfrom\s+|\bimport\s+|\brequire\(\s*|\bimport\(\s*)["']([^"'\n]+)["']"""}
_ANNOTATIONS = {"rust": r"#!?\[([^\]\n]+)\]", "python": r"(?m)^\s*@([^\n]+?)\s*$", "go": r"`([^`\n]+)`", "other": r"@([A-Za-z_][\w.]*(?:\([^)\n]*\))?)"}
_SIGNATURES = {
    "rust": r"\bfn\s+\w+(?:\s*<[^>{]*>)?\s*\(([^)]*)\)(?:\s*->\s*([^{;]+?))?\s*(?:\bwhere\b|[{;])",
    "python": r"\bdef\s+\w+\s*\(([^)]*)\)(?:\s*->\s*([^:]+?))?\s*:",
    "go": r"\bfunc\s+(?:\([^)]*\)\s*)?\w+\s*\(([^)]*)\)\s*([^{\n]*?)\s*\{",
    "other": r"\bfunction\b\s*\*?\s*[\w$]*\s*\(([^)]*)\)(?:\s*:\s*([^{;]+?))?\s*[{;]",
}
_EXPORTS = {
    "rust": r"\bpub(?:\([^)\n]*\))?\s+(?:(?:const|async|unsafe|extern)\s+(?=fn\b|unsafe\b|async\b))*(?:fn|struct|enum|trait|const|static|type|mod)\s+(?:mut\s+)?(\w+)",
    "python": r"(?m)^(?:async\s+)?(?:def|class)\s+(\w+)", "go": r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|var\s+|const\s+)([A-Z]\w*)",
    "other": r"\bexport\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+\*?\s*([\w$]+)",
}


def _read(patterns: dict[str, str], group: int) -> Column:
    """All matches by the language's pattern."""
    content, out = F.col("content"), None
    for lang, pattern in patterns.items():
        found = F.regexp_extract_all(content, F.lit(pattern), F.lit(group))
        out = F.when(F.col("lang") == lang, found) if out is None else out.otherwise(found) if lang == "other" else out.when(F.col("lang") == lang, found)
    return out


def _told(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")))


def _types(parameters: Column) -> Column:
    """Types of name: type, or for Go of name type, in lists of parameters."""
    each = F.flatten(F.transform(parameters, lambda x: F.split(x, r",\s*(?=(?:mut\s+)?[\w$]+\??\s*:)|,\s*$")))
    typed = F.transform(each, lambda x: F.regexp_extract(x, r"(?s)^\s*(?:mut\s+)?[\w$]+\??\s*:\s*(.*?)\s*(?:=.*)?$", 1))
    go = F.transform(F.flatten(F.transform(parameters, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"^\s*\w+\s+(\S.*?)\s*$", 1))
    return F.when(F.col("lang") == "go", go).otherwise(typed)


def fingerprints(files: DataFrame, k: int = 5) -> DataFrame:
    """files(path, content) -> path, imports, annotations, param_types, return_types, strings, exports, comment_nouns (the k most frequent), each sorted; for files in a known language."""
    known = files.where("content IS NOT NULL").select("path", "content", language(F.col("path")).alias("lang")).where("lang IS NOT NULL")
    bare = F.transform(_read(_SAID, 2), lambda x: F.regexp_replace(F.regexp_replace(x, r"^r?#*(?:\"\"\"|'''|[\"'`])", ""), r"(?:\"\"\"|'''|[\"'`])#*$", ""))
    strings = F.filter(bare, lambda x: (F.octet_length(x) > 10) | x.rlike(TELLING_STRINGS))
    held = known.select(
        "path", _told(_read(_IMPORTS, 1)).alias("imports"), _told(_read(_ANNOTATIONS, 1)).alias("annotations"), _told(_types(_read(_SIGNATURES, 1))).alias("param_types"),
        _told(_read(_SIGNATURES, 2)).alias("return_types"), _told(strings).alias("strings"), _told(_read(_EXPORTS, 1)).alias("exports"),
    )
    comments = known.select("path", F.explode(F.filter(_read(_SAID, 1), lambda x: x != "")).alias("text"))
    nouns = top_nouns(comments, COMMENT_STOP_WORDS, k).groupBy("path").agg(F.array_sort(F.collect_list("word")).alias("comment_nouns"))
    return held.join(nouns, "path", "left").withColumn("comment_nouns", F.coalesce("comment_nouns", F.array().cast("array<string>")))
