"""Doc comments of source files, by pattern: which text speaks of the whole file, and its first sentence. Also what a C++ file exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archlens.functions.tables import CPP_HANDLERS, CPP_WORDS, DOC_VERBS, INTERNAL_TERMS, LICENSE_SIGNS, QUANTITY_PREFIXES, STATE_PREFIXES
from archlens.functions.text import any_of, extension, has_any, quoted

#: All forms that count as one of the verbs: itself, with s or es, and ies for y.
VERB_FORMS = sorted({form for v in DOC_VERBS for form in (v, f"{v}s", f"{v}es", *([f"{v[:-1]}ies"] if v.endswith("y") else []))})


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    return text.rlike("^(?:" + "|".join(map(quoted, prefixes)) + ")")


def looks_like_item_doc(comment: Column) -> Column:
    """Whether a comment speaks of one item rather than of a module: it tells what something does, when or how much, or is no sentence at all."""
    text = F.regexp_replace(F.trim(comment), r"\.+$", "")
    low = F.lower(text)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    first, second = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    return any_of([
        has_any(low, LICENSE_SIGNS), first.isin(*VERB_FORMS), second.isin("is", "are", "was", "were") & ~first.isin("this", "it", "there", "here"), _starts(low, STATE_PREFIXES),
        text.rlike(r"^[aA][nN]? \p{Ll}"), _starts(low, QUANTITY_PREFIXES), has_any(low, INTERNAL_TERMS), text.rlike(r"(?::|-|e\.g)$"), F.size(words) < 3,
    ])


def first_sentence(lines: Column) -> Column:
    """Lines less signs of headings, joined; up to the first full stop before a space, with one at the end."""
    joined = F.trim(F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", ""))), " "))
    head = F.substring_index(joined, ". ", 1)
    return F.when(F.endswith(head, F.lit(".")), head).otherwise(F.concat(head, F.lit(".")))


def _until(lines: Column, test) -> Column:
    """Lines before the first that passes."""
    at = F.array_position(F.transform(lines, test), True)
    return F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)


def _since(lines: Column, test) -> Column:
    at = F.array_position(F.transform(lines, test), True)
    return F.when(at > 0, F.slice(lines, at.cast("int"), F.size(lines))).otherwise(F.slice(lines, F.lit(1), F.lit(0)))


def rust_doc(content: Column) -> Column:
    lines = F.transform(F.split(content, "\n"), F.trim)
    begins = lambda p: lambda x: F.startswith(x, F.lit(p))
    inner = F.filter(_until(lines, lambda x: (x != "") & ~begins("//")(x)), begins("//!"))
    item = lambda x: x.rlike("^///(?:[^/]|$)")
    outer = F.filter(_until(_since(lines, item), lambda x: ~begins("///")(x)), item)
    strip = lambda xs: F.transform(xs, lambda x: F.substring(x, 4, 1 << 30))
    told = first_sentence(strip(outer))
    return F.when(F.size(inner) > 0, first_sentence(strip(inner))).when((F.size(outer) > 0) & ~looks_like_item_doc(told), told)


def python_doc(content: Column) -> Column:
    found = F.regexp_extract(content, r"""(?s)\A(?:[ \t\r]*(?:#[^\n]*)?\n)*[ \t]*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')""", 1)
    other = F.regexp_extract(content, r"""(?s)\A(?:[ \t\r]*(?:#[^\n]*)?\n)*[ \t]*'''(.*?)'''""", 1)
    text = F.when(found != "", found).otherwise(other)
    return F.when(F.trim(text) != "", first_sentence(F.split(text, "\n")))


def script_doc(content: Column) -> Column:
    body = F.regexp_extract(content, r"(?s)\A(?:\s+|//[^\n]*\n|/\*[^*].*?\*/)*/\*\*(.*?)\*/", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+", ""))), lambda x: (x != "") & ~F.startswith(x, F.lit("@")))
    return F.when(F.size(lines) > 0, first_sentence(lines))


def go_doc(content: Column) -> Column:
    block = F.regexp_extract(content, r"(?m)\A(?:\s*|(?:.*\n)*?\s*\n)((?:[ \t]*//[^\n]*\n)+)[ \t]*package[ \t]", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^//", ""))), lambda x: (x != "") & ~F.lower(x).rlike("^(?:go:|\\+build|copyright)"))
    told = first_sentence(lines)
    return F.when((F.size(lines) > 0) & ~looks_like_item_doc(told), told)


def module_doc(path: Column, content: Column) -> Column:
    """First sentence of what a file says of itself; null without it and for other languages."""
    ext = extension(path)
    return F.when(ext == "rs", rust_doc(content)).when(ext == "py", python_doc(content)).when(ext.isin("ts", "tsx", "js", "jsx", "mjs"), script_doc(content)).when(ext == "go", go_doc(content))


def cpp_exports(path: Column, content: Column) -> Column:
    """Names of types, and of functions at the outermost level: all that a header declares, what other files define. Sorted."""
    header = extension(path).isin("h", "hh", "hpp", "hxx")
    types = F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*(?:class|struct|enum(?:[ \t]+class)?|namespace)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    lines = F.transform(F.split(content, "\n"), F.trim)
    braces = lambda x, b: F.length(x) - F.length(F.replace(x, F.lit(b), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("names"))

    def step(a, line):
        name = F.regexp_extract(line, r"^[A-Za-z_][A-Za-z0-9_:<>,*& \t]*?[ \t*&]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*\(", 1)
        told = (a["depth"] == 0) & (name != "") & ~line.rlike(r"^(?:static |#)|::") & ~_starts(name, CPP_HANDLERS) & (header | F.contains(line, F.lit("{")))
        return F.struct(F.greatest(F.lit(0), a["depth"] + braces(line, "{") - braces(line, "}")).alias("depth"), F.when(told, F.concat(a["names"], F.array(name))).otherwise(a["names"]).alias("names"))

    functions = F.aggregate(lines, start, step)["names"]
    return F.array_sort(F.array_distinct(F.filter(F.concat(types, functions), lambda x: ~x.isin(*CPP_WORDS))))
