"""Text and path expressions. All are Columns; nothing runs in Python."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from archlens.functions.tables import INDEX_NAMES, LANGUAGES, NEEDLES, SHORT_THEMES, TEST_SIGNS, VERB_PRIORITY, VERB_SENTENCES


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower case, empty without one; a leading dot alone starts none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def language(path: Column) -> Column:
    pairs = [x for item in LANGUAGES.items() for x in map(F.lit, item)]
    return F.element_at(F.create_map(*pairs), extension(path))


def one_decimal(value: Column) -> Column:
    """A number with one decimal, as C's %.1f has it: the nearest one by the double's exact value, the even one of two that are equally near (format_string takes the upper one)."""
    return F.call_function("format_number", value, F.lit("0.0"))


def sha256_normalised(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256)


def approx_tokens(text: Column) -> Column:
    """Runs of letters, of digits, and single other signs: an estimate, never to be taken for a tokenizer's count."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]"), F.lit(0)))


def split_identifier(name: Column) -> Column:
    """Words in lower case: at underscores if there are any, else at camel, Pascal and acronym borders."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"(^| )(\p{Lu}+)(\p{Lu}\p{Ll})", "$1$2 $3")
    words = F.when(F.contains(name, F.lit("_")), F.split(name, "_")).otherwise(F.split(spaced, " "))
    return F.transform(F.filter(words, lambda w: w != ""), F.lower)


def expand_verb(verb: Column, rest: Column) -> Column:
    out = F.when(rest == "", F.concat(F.lit("Implements "), verb, F.lit(" functionality.")))
    for verbs, before, after in VERB_SENTENCES:
        out = out.when(verb.isin(*verbs), F.concat(F.lit(before), rest, F.lit(after)))
    return out.otherwise(F.concat(F.lit("Implements "), verb, F.lit(" "), rest, F.lit(".")))


def expand_identifier(name: Column) -> Column:
    words = split_identifier(name)
    whole = F.concat(F.lit("Implements "), name, F.lit(" functionality."))
    return F.when(F.size(words) == 0, whole).otherwise(expand_verb(words[0], F.array_join(F.slice(words, 2, F.size(words)), " ")))


def verb_priority(verb: Column) -> Column:
    out = F.lit(len(VERB_PRIORITY))
    for k, verbs in reversed(list(enumerate(VERB_PRIORITY))):
        out = F.when(verb.isin(*verbs), k).otherwise(out)
    return out


def looks_garbled(theme: Column) -> Column:
    t = F.trim(theme)
    return (t == "") | (t.rlike(r"^[a-z]{1,2}$") & ~t.isin(*SHORT_THEMES))


def has_concept(lang: Column, concept: str, text: Column) -> Column:
    """Whether the text holds any of the language's needles, whatever the case; false for other languages."""
    patterns: dict[tuple[str, ...], list[str]] = {}
    for name, needles in NEEDLES[concept].items():
        patterns.setdefault(needles, []).append(name)
    low, out = F.lower(text), F.lit(False)
    for needles, names in patterns.items():  # one pattern for all needles keeps the generated code small
        out = F.when(lang.isin(*names), low.rlike("|".join(map(quoted, needles)))).otherwise(out)
    return out


def has_any(text: Column, needles: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(quoted, needles))) if needles else F.lit(False)


def is_test_context(lang: Column, path: Column, text: Column, annotations: Column | None = None) -> Column:
    """Whether path, text or annotations (array) tell a test of the language; false for other languages."""
    marks = F.lower(F.array_join(annotations, " ")) if annotations is not None else F.lit("")
    out = F.lit(False)
    for name, (paths, needles, notes) in TEST_SIGNS.items():
        out = F.when(lang == name, has_any(F.lower(path), paths) | has_any(F.lower(text), needles) | has_any(marks, notes)).otherwise(out)
    return out


def has_inline_tests(text: Column) -> Column:
    return text.rlike(r"#\s*\[\s*(?:cfg\s*\(\s*test\s*\)|test)\s*\]")


def quoted(needle: str) -> str:
    """A pattern that matches just this text."""
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", needle)


def length_boundary(lang: Column, line: Column) -> Column:
    """A comparison that lets an index reach a length: x <= len, or len >= x."""
    text = F.trim(line)
    at_most = F.contains(text, F.lit("<="))
    op = F.when(at_most, "<=").when(F.contains(text, F.lit(">=")), ">=")
    at = F.instr(text, "<=")
    at = F.when(at_most, at).otherwise(F.instr(text, ">="))
    left, right = F.trim(F.substring(text, F.lit(1), at - 1)), F.trim(F.substring(text, at + 2, F.length(text)))
    left_length, right_length = has_concept(lang, "length", left), has_concept(lang, "length", right)
    risk = F.when(right_length & (op == "<="), can_be_index(left)).when(left_length & (op == ">="), can_be_index(right))
    return F.coalesce(op.isNotNull() & (left_length != right_length) & F.coalesce(risk, F.lit(False)), F.lit(False))


def can_be_index(operand: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(operand), r"^\(+", ""), r"\)+$", ""), r":+$", ""))
    named = bare.rlike("|".join(INDEX_NAMES))
    plain = bare.rlike(r"^[a-z0-9_.\[\]]*$") & ~bare.rlike("len|size|empty")
    return (bare != "") & ~bare.rlike("^[0-9]+$") & (named | plain)
