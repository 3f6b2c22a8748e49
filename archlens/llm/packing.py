"""Best-fit packing of documents into sequences by large-item matching.

Documents become token ids and an end id; longer ones than a sequence are cut. The packing itself needs only how many
pieces there are of each length, at most as many numbers as the capacity, so it is planned on the driver from that
histogram, exactly as one by one: pieces above one third of the capacity are matched greedily, largest first with the
largest that fits, so at most two meet in a sequence; the others go, largest first, to the smallest gap that holds them.
The plan (ranges of equal sequences, at most a few for each length) is broadcast, and pieces of each length are numbered
in salted groups and take their places by that number.

Defined results: null text is empty, and an empty document is its end id alone; repeated rows and null ids are pieces of
their own; an empty table packs into nothing; texts of any length are tokenised whole; <|endoftext|> in a text is its added token.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.llm.bpe import codec, load_ranks
from archlens.llm.common import bounded_batches, read_table, text_or_empty, written

CAPACITY, END_ID = 1024, 2
#: The vocabulary's added token, which is one id wherever a text holds it.
ADDED_TOKENS = {"<|endoftext|>": 50256}
#: White space (of the Unicode property) that is encoded by itself; shorter runs are no trouble to the pattern's matcher.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: Pieces of one length are numbered side by side in groups of a share 1 / SHARES of all pieces; capacity + SHARES offsets are broadcast at most, whatever the table's size.
SHARES = 4096
_encoders: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        import tiktoken

        _encoders[path, pattern] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens=ADDED_TOKENS)
    return _encoders[path, pattern]


def encode(path: str, pattern: str, text: str) -> list[int]:
    """Ids of a text, added tokens included; the text between them is encoded by itself.

    The pattern looks ahead at the end of white space, and its matcher gives up on very long runs. They are cut out: all of a
    run but its last character is one match, whatever stands before it (the whole run, where the text or an added token ends
    it), and what follows is matched as if it began there.
    """
    encoder, ids, at = _encoder(path, pattern), [], 0
    for run in _LONG_SPACE.finditer(text):
        last = run.end() if text.startswith(tuple(ADDED_TOKENS), run.end()) or run.end() == len(text) else run.end() - 1
        ids += encoder.encode(text[at : run.start()], allowed_special="all", disallowed_special=())
        ids += codec(path, pattern).encode_piece(text[run.start() : last].encode())
        at = last
    return ids + encoder.encode(text[at:], allowed_special="all", disallowed_special=())


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.array([*encode(path, pattern, text.as_py()), end_id], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", text_or_empty().alias("text")).transform(bounded_batches).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, how many such sequences)] for {length: pieces}. Work grows with the number of lengths, not of pieces."""
    left = Counter({n: c for n, c in histogram.items() if c})
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    bins: dict[int, list[list]] = {}  # gap -> [lengths, count]
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], count: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append([lengths, count])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if left[b] and b <= capacity - a and (b != a or left[a] > 1)), None)
            if b is None:
                put((a,), left.pop(a))
                break
            count = left[a] // 2 if a == b else min(left[a], left[b])
            put((a, b), count)
            left[a] -= count
            left[b] -= count
    for n in sorted((n for n in left if left[n]), reverse=True):
        todo = left[n]
        at = bisect_left(gaps, n)
        while todo:
            if at < len(gaps):
                gap = gaps[at]
                lengths, count = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap], gaps[at]
            else:
                gap, lengths, count = capacity, (), todo
            each = gap // n  # the bin just filled has the smallest gap, so it takes what it can
            full, rest = divmod(todo, each)
            full, rest = (count, 0) if full >= count else (full, rest)
            if full:
                put((*lengths, *[n] * each), full)
            if rest:
                put((*lengths, *[n] * rest), 1)
            if gap < capacity and (more := count - full - bool(rest)):
                put(lengths, more)
            todo -= full * each + rest
            at = bisect_left(gaps, n)
    return [(lengths, count) for groups in bins.values() for lengths, count in groups]


def places(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, last number + 1, sequence of the first, offset) of each run of pieces of one length."""
    out, taken, sequence = [], Counter(), 0
    for lengths, count in planned:
        offset = 0
        for n in lengths:
            out.append((n, taken[n], taken[n] + count, sequence, offset))
            taken[n] += count
            offset += n
        sequence += count
    return out


def numbered(pieces: DataFrame, *order: str) -> tuple[DataFrame, dict[int, int]]:
    """pieces(length, ...) with _k, their number among those of their length, and {length: pieces}, with as many entries as a sequence has tokens at most. Pieces of one length are numbered in salted groups."""
    spark = pieces.sparkSession
    pieces = written(pieces.withColumn("_id", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(histogram.values())
    salts = spark.createDataFrame([(n, -(-c * SHARES // total)) for n, c in histogram.items()], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts"))).drop("_salts")
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy(*order, "_id")
    rows = salted.withColumn("_k", F.row_number().over(own) - 1).join(F.broadcast(bases), ["length", "_salt"]).withColumn("_k", F.col("_k") + F.col("_base"))
    return rows.drop("_id", "_salt", "_base"), histogram


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, length, ...) with sequence_id and offset."""
    rows, histogram = numbered(pieces, "doc_id", "piece")
    schema = "length long, _from long, _to long, _sequence long, _offset long"
    ranges = pieces.sparkSession.createDataFrame(places(plan(histogram, capacity)), schema)
    found = rows.join(F.broadcast(ranges), "length").where("_k >= _from AND _k < _to")
    return found.withColumns({"sequence_id": F.expr("_sequence + _k - _from"), "offset": F.col("_offset")}).drop("_k", "_from", "_to", "_sequence", "_offset")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
