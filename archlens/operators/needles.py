"""Many needles found in one reading: an automaton over all of them (Aho-Corasick) reads each text once, so what a text costs doesn't grow with their number.

The needles travel with the task and every worker builds their automaton once. Texts are lowered by Spark, as elsewhere,
and stream through in Arrow batches; nothing is shuffled. A text is held once at a time, with a number for each of its lines.

Defined results: null and empty texts hold no needle; needles may overlap or lie within one another, and each is found; an
empty needle is refused; a needle that stands on a line several times is told once for that line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.functions.tables import NEEDLES
from archlens.functions.text import language

_LINE_END = re.compile("\n")
_automata: dict[tuple[str, ...], object] = {}


def _automaton(needles: tuple[str, ...]):
    if needles not in _automata:
        import ahocorasick

        built = ahocorasick.Automaton()
        for k, needle in enumerate(needles):
            built.add_word(needle, k)
        built.make_automaton()
        _automata[needles] = built
    return _automata[needles]


def hits(texts: DataFrame, text: Column, needles: Sequence[str]) -> DataFrame:
    """texts with hits array<struct<row int, needle int>>: the lines, from 1, on which each needle (by its place among needles) stands in text. Needles without a line break, in the case that text is in."""
    needles = tuple(needles)
    if not all(needles) or any("\n" in x for x in needles) or len(set(needles)) != len(needles):
        raise ValueError("needles must be distinct, not empty, and of one line")
    schema = texts.withColumn("hits", F.lit(None).cast("array<struct<row:int,needle:int>>")).schema
    kind = pa.list_(pa.struct([("row", pa.int32()), ("needle", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _automaton(needles).iter if needles else lambda _: ()
        for batch in batches:
            found = []
            for held in batch.column("_text"):
                held = held.as_py() or ""
                met = list(read(held))
                ends = [m.start() for m in _LINE_END.finditer(held)] if met else []
                found.append([{"row": r, "needle": k} for r, k in sorted({(bisect_right(ends, end) + 1, k) for end, k in met})])
            kept = [batch.column(n) for n in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind)], schema.names)

    return texts.withColumn("_text", text).mapInArrow(run, schema)


def needle_lines(files: DataFrame, needles: Sequence[str]) -> DataFrame:
    """files(path, content) -> path, row, needle for each line that holds it, whatever its case."""
    found = hits(files.select("path", F.lower("content").alias("lowered")), F.col("lowered"), needles).select("path", F.explode("hits").alias("h"))
    return found.select("path", "h.row", F.element_at(F.array(*map(F.lit, needles)), F.col("h.needle") + 1).alias("needle"))


def concepts(files: DataFrame, names: Sequence[str] = tuple(NEEDLES)) -> DataFrame:
    """files(path, content) -> path and, for each concept, whether the file holds a needle of it in its language; one reading for all concepts and languages."""
    needles = sorted({n for name in names for of_lang in NEEDLES[name].values() for n in of_lang})
    places = {n: k for k, n in enumerate(needles)}
    held = hits(files.select("path", F.lower("content").alias("lowered")), F.col("lowered"), needles)
    known = held.select("path", language(F.col("path")).alias("lang"), F.array_distinct(F.transform("hits", lambda h: h["needle"])).alias("held"))
    of = lambda name: [x for lang, found in NEEDLES[name].items() for x in (F.lit(lang), F.array(*[F.lit(places[n]) for n in found]))]
    return known.select("path", *[F.coalesce(F.arrays_overlap("held", F.element_at(F.create_map(*of(name)), F.col("lang"))), F.lit(False)).alias(name) for name in names])
