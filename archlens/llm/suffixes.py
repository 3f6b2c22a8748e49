"""Exact removal of long repeated strings by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts at another place of any document. Equal windows of
that length share the smallest hash of their shorter strings (grams_of), so consecutive windows with one such hash form a
segment, and only a segment whose hash stands in another one, or in itself again, can hold a window that repeats:

1. Hashes and contents of segments are counted. A segment whose hash stands once needs nothing more; all windows of a
   content that stands twice repeat.
2. The other contents under a common hash are dealt out by it to shards. A shard's segments are concatenated and its
   suffix array is built by induced sorting: suffixes are classified, leftmost-smaller (LMS) substrings are sorted and
   named, the string of names is sorted by renaming pairs of names until all differ (README says why not recursively),
   and the array is induced from it bucket by bucket. Common prefixes are computed in text order: only where the
   preceding bytes differ are they compared.
3. A hash with more than HOT contents (a passage that very many documents share) would make too large a shard: its
   contents are cut into segments anew, by the smallest hash of longer strings, which few of them share, and so on with
   strings ever closer to a window's length. At one byte less there are few different contents under a hash, since a
   segment is a few windows long or a run of few letters, which is cut into pieces that runs share, so shards stay small.

Equal texts are one text with one set of marks. Python sees at most PIECE bytes of texts, or a shard's groups, at a time.

Defined results: null text is empty; texts shorter than LENGTH keep all; repeated rows are documents of their own, so
that their whole text repeats; an empty table gives an empty result; other columns don't matter; texts of any length are
read whole; null ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.llm.common import bounded_batches, checkpointed, dealt_by, read_table, text_key, text_or_empty, whole_groups

LENGTH, HOT, PIECE = 400, 800, 1 << 19
#: Windows of a piece of a run at most: the power of two at a window's length, doubled so often.
PIECES = 1
#: Texts whose copies a task remembers at a time.
TOLD = 100_000
_NULL = "_text_is_null"
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SEGMENT = "key binary, at int, start int, length int, hash long, content long, again boolean, wanted boolean"


def grams_of(length: int) -> list[int]:
    """Bytes of the strings whose smallest hash deals windows out, step by step: longer ones make more segments, shorter ones meet more often by chance."""
    grams, rest = [], length - max(1, length * 2 // 5)
    while rest > 1:
        grams.append(length - rest)
        rest //= 4
    return [*grams, max(1, length - 1)]


# Hashes


def _rolling(data: np.ndarray, size: int, base: int) -> np.ndarray:
    """64-bit polynomial hashes, well mixed, of all strings of that size; all wrap around 2**64."""
    n = len(data)
    if base not in _powers or len(_powers[base][0]) <= n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, PIECE + 4 * LENGTH) + 1, base, np.uint64)
            back = np.full(len(steps), pow(base, -1, 1 << 64), np.uint64)
            steps[0] = back[0] = 1
            _powers[base] = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    power, inverse = _powers[base]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[size:] - sums[: n - size + 1]) * inverse[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours: running minima from both ends of blocks of w."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _pieces(windows: int, length: int) -> list[int]:
    """A segment of more windows than have its string in common repeats it: such runs are cut into powers of two, small ones at both ends, so that runs of other lengths share pieces."""
    sizes, size, rest = [], 1, windows
    while 2 * (windows - rest + size) <= windows:
        sizes.append(size)
        rest, size = rest - size, min(2 * size, 1 << PIECES + length.bit_length() - 1)
    while rest:
        size = min(size, 1 << rest.bit_length() - 1)
        sizes.append(size)
        rest -= size
    return sizes


def segments_of(data: bytes, sizes: list[int], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: text, start within data, length, hash and content of each segment, and whether its hash stands in it more than once."""
    flat = np.frombuffer(data, np.uint8)
    if len(flat) < length:
        return (np.zeros(0, np.int64),) * 6
    grams, w = _rolling(flat, gram, _BASE), length - gram + 1
    low = _sliding_min(grams, w)
    text = np.repeat(np.arange(len(sizes)), sizes)
    valid = text[: len(low)] == text[length - 1 :]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1 : len(low)] != text[: len(low) - 1]) | ~valid[:-1]
    starts = np.flatnonzero(new & valid)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 6
    windows = np.flatnonzero(valid & np.r_[new[1:] | ~valid[1:], True]) + 1 - starts
    if (windows > w).any():
        cuts = [_pieces(n, length) if n > w else [n] for n in windows.tolist()]
        windows = np.array([n for c in cuts for n in c])
        starts = np.concatenate([s + np.cumsum([0, *c[:-1]]) for s, c in zip(starts.tolist(), cuts)])
    ends = starts + windows + length - 1
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    around = np.full(len(low) + 2 * (w - 1), np.iinfo(np.uint64).max, np.uint64)
    around[w - 1 : w - 1 + len(low)] = ~low
    values, counts = np.unique(grams[~_sliding_min(around, w) == grams], return_counts=True)  # of strings that are the smallest of some window
    again = np.isin(low[starts], values[counts > 1])
    for k in np.flatnonzero(again).tolist():
        again[k] = np.count_nonzero(grams[starts[k] : ends[k] - gram + 1] == low[starts[k]]) > 1
    return text[starts], starts, ends - starts, low[starts].view(np.int64), content.view(np.int64), again


def segments(source: DataFrame, length: int, gram: int) -> DataFrame:
    """source(key, at, wanted, data) -> a row for each segment; start counts from the text's start, of which at is the data's place. A task tells copies twice as a rule: more say no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple[bytes, int], int] = {}
        rows, parts, size = [], [], 0

        def made() -> pa.RecordBatch:
            text, start, n, hashes, content, again = segments_of(b"".join(parts), [len(p) for p in parts], length, gram)
            first = np.cumsum([0, *map(len, parts)])[:-1]
            keys, at, starts, wanted = (pa.array(c, k).take(pa.array(text)) for c, k in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int32(), pa.bool_())))
            start = (start - first[text] + starts.to_numpy()).astype(np.int32)
            columns = [keys, at, pa.array(start), pa.array(n.astype(np.int32)), pa.array(hashes), pa.array(content), pa.array(again.astype(bool)), wanted]
            return pa.RecordBatch.from_arrays(columns, ["key", "at", "start", "length", "hash", "content", "again", "wanted"])

        for batch in batches:
            for key, at, wanted, cell in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "wanted")), batch.column("data")):
                data = cell.as_buffer()
                if len(told) > TOLD:
                    told.clear()
                told[key, at] = told.get((key, at), 0) + 1
                if len(data) < length or told[key, at] > 2:
                    continue
                for s in range(0, len(data) - length + 1, PIECE):  # each window in one piece
                    rows.append((key, at, at + s, wanted))
                    parts.append(data[s : s + PIECE + length - 1])
                    size += len(parts[-1])
                    if size >= PIECE:
                        yield made()
                        rows, parts, size = [], [], 0
        if parts:
            yield made()

    return bounded_batches(source.select("key", "at", "wanted", "data")).mapInArrow(run, SEGMENT)


# The suffix array


def _classified(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next; t ends in its only smallest value."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    nearest = differs[np.searchsorted(differs, np.arange(n - 1))]
    return np.r_[t[nearest] < t[nearest + 1], True]


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, values: int) -> np.ndarray:
    """The suffix array that the given order of LMS suffixes induces. Whole runs of a bucket move at a time."""
    larger: list[list[np.ndarray]] = [[] for _ in range(values)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(values)]

    def spread(suffixes: np.ndarray, want: bool, to: list[list[np.ndarray]], c: int) -> np.ndarray:
        """Deals the preceding suffixes of the wanted type to their buckets; those of the same bucket come back."""
        before = suffixes[suffixes > 0] - 1
        before = before[small[before] == want]
        if not len(before):
            return before
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.r_[0, np.flatnonzero(first[1:] != first[:-1]) + 1, len(first)]
        same = before[:0]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            v = int(first[a])
            to[v].append(before[a:b])
            if v == c:
                same = before[a:b]
        return same

    order = np.argsort(t[lms], kind="stable")
    firsts = np.searchsorted(t[lms][order], np.arange(values + 1))
    sorted_lms = lms[order]
    for c in range(values):
        k = 0
        while k < len(larger[c]):
            wave, k = (larger[c][k], k + 1) if len(larger[c]) == k + 1 else (np.concatenate(larger[c][k:]), len(larger[c]))
            spread(wave, False, larger, c)
        if firsts[c] < firsts[c + 1]:
            spread(sorted_lms[firsts[c] : firsts[c + 1]], False, larger, c)
    smaller[int(t[-1])].append(np.array([len(t) - 1], np.int32))
    out = []
    for c in range(values - 1, -1, -1):
        k = 0
        while k < len(smaller[c]):
            wave, k = (smaller[c][k], k + 1) if len(smaller[c]) == k + 1 else (np.concatenate(smaller[c][k:]), len(smaller[c]))
            spread(wave, True, smaller, c)
        high = np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int32)
        if len(high):
            spread(high[::-1], True, smaller, c)
        out.append(np.concatenate(smaller[c]) if smaller[c] else np.zeros(0, np.int32))
        out.append(high[::-1])
    return np.concatenate(out)[::-1]


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: pairs of names are named again until no two are equal."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step if step < n else 0] = rank[step:] + 1
        pair = rank * (n + 2) + following
        order = np.argsort(pair, kind="stable")
        new = np.r_[0, np.cumsum(pair[order][1:] != pair[order][:-1])]
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a string of small positive integers, without the empty suffix."""
    t = np.r_[text, 0].astype(np.int32)
    if len(t) <= 2:
        return np.zeros(len(t) - 1, np.int32)
    small = _classified(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    values = int(t.max()) + 1
    rough = _induced(t, small, lms, values)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    number = np.cumsum(is_lms, dtype=np.int32) - 1
    ends = np.r_[lms[1:], len(t) - 1].astype(np.int32)
    lengths = ends - lms
    a, b = ordered[:-1], ordered[1:]
    sizes = lengths[number[a]]
    equal = sizes == lengths[number[b]]
    equal[0:1] = False  # the empty suffix, which comes first, equals none
    active, k = np.flatnonzero(equal), 0
    while len(active):
        off = t[a[active] + k] != t[b[active] + k]
        equal[active[off]] = False
        active = active[~off]
        active = active[sizes[active] > k]
        k += 1
    names = np.zeros(len(lms), np.int64)
    names[number[ordered]] = np.r_[0, np.cumsum(~equal)]
    if names.max() < len(lms) - 1:
        ordered = lms[_order_of_names(names)]
    return _induced(t, small, ordered, values)[1:]


def common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each place of the text, whose values are below 512, the length its suffix shares with the one before it in the array (0 for the first)."""
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[array[1:]] = array[:-1]
    padded = np.r_[text.astype(np.uint64), np.zeros(16, np.uint64)]
    words = np.zeros(n + 8, np.uint64)
    for k in range(7):  # seven values of nine bits: a byte plus 1, or the mark between parts
        words |= padded[k : n + 8 + k] << np.uint64(9 * k)
    has = before >= 0
    previous = np.r_[0, text[:-1].astype(np.int64)]
    compared = has & ((np.arange(n) == 0) | (before == 0) | (previous != previous[np.maximum(before, 0)]))
    at = np.flatnonzero(compared)
    a, b, size = at, before[at], np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    while len(active):
        i, j = a[active] + size[active], b[active] + size[active]
        x = words[np.minimum(i, n)] ^ words[np.minimum(j, n)]
        same = np.where(x == 0, 7, 0)
        odd = np.flatnonzero(x)
        low = x[odd] & (~x[odd] + np.uint64(1))
        same[odd] = np.log2(low.astype(np.float64)).astype(np.int64) // 9
        size[active] += same
        active = active[(same == 7) & (np.maximum(a[active], b[active]) + size[active] < n)]
    reach = np.full(n, -1, np.int64)
    reach[at] = size + at
    return np.where(has, np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0), 0)


def repeated_windows(parts: list[bytes], length: int) -> np.ndarray:
    """Which places of the parts, laid end to end with one place between, start a string of that length that starts elsewhere too (it may reach beyond its part)."""
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int32) + 1
    text[np.cumsum([len(p) + 1 for p in parts]) - 1] = 257  # between parts: no byte
    array = suffix_array(text)
    long = common_prefixes(text, array)[array] >= length
    out = np.zeros(len(text), bool)
    out[array] = long | np.r_[long[1:], False]
    return out


# Marks


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cut_out(rows: DataFrame) -> DataFrame:
    """rows(key, at, data, parts array<struct<start,length,hash,single,hot>>) -> the parts' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            out: list[list] = [[], [], [], [], [], []]
            for key, at, cell, parts in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), batch.column("data"), batch.column("parts")):
                data = cell.as_buffer()
                for p in parts.as_py():
                    low = p["start"] - at
                    for column, v in zip(out, (p["hash"], key, p["start"], p["single"], p["hot"], data[low : low + p["length"]].to_pybytes())):
                        column.append(v)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["hash", "key", "start", "single", "hot", "data"])

    return rows.select("key", "at", "data", "parts").mapInArrow(run, "hash long, key binary, start int, single boolean, hot boolean, data binary")


def _by_suffix_array(rows: DataFrame, length: int) -> DataFrame:
    """rows(hash, key, start, single, data) -> marks of those that stand once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, ["hash"], 768):
            parts = table.column("data").to_pylist()
            found, at = repeated_windows(parts, length), 0
            keys, lows, highs = [], [], []
            for key, start, single, data in zip(table.column("key").to_pylist(), table.column("start").to_pylist(), table.column("single").to_pylist(), parts):
                if single:
                    low, high = _runs(found[at : at + len(data) - length + 1])
                    keys += [key] * len(low)
                    lows.append(start + low)
                    highs.append(start + high - 1 + length)
                at += len(data) + 1
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (lows, highs))], ["key", "low", "high"])

    return dealt_by(rows, "hash").mapInArrow(run, "key binary, low int, high int")


def met_again(found: DataFrame) -> DataFrame:
    """segments' rows whose hash stands more than once, with mixed (not all of one content and apart), contents and open (one that is wanted stands once) of the hash, n (rows of the content), and whether the row is the content's first and single one.

    Windows over one exchange: the segments are made and moved once, and nothing is joined back.
    """
    by_hash, by_content, place = Window.partitionBy("hash"), Window.partitionBy("hash", "content"), ["key", "at", "start", "length", "wanted"]
    rows = found.repartition("hash").withColumns({"n": F.count("*").over(by_content), "first": F.row_number().over(by_content.orderBy(*place)) == 1})
    rows = rows.withColumn("single", F.col("first") & (F.col("n") == 1) & F.col("wanted"))
    of_hash = {"rows": F.count("*"), "contents": F.sum(F.col("first").cast("int")), "any": F.max("again"), "open": F.max("single")}
    rows = rows.withColumns({name: v.over(by_hash) for name, v in of_hash.items()}).where("rows > 1 OR any")
    return rows.withColumn("mixed", F.expr("contents > 1 OR any")).drop("rows", "any", "again", "content")


def marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(text) -> key of a text, spans array<struct<low,high>> of bytes in strings that repeat (they may overlap)."""
    keyed = docs.select(text_or_empty().alias("text")).where(F.octet_length("text") >= length).select(text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("data"))
    source = keyed.select("key", F.lit(0).alias("at"), F.lit(True).alias("wanted"), "data")
    whole = lambda rows: rows.select("key", F.col("start").alias("low"), (F.col("start") + F.col("length")).alias("high"))
    told, grams = [], grams_of(length)
    for step, gram in enumerate(grams):
        met = checkpointed(met_again(segments(source, length, gram)))
        told.append(whole(met.where("wanted AND (NOT mixed OR n > 1)")))
        hot = F.col("contents") > HOT if step + 1 < len(grams) else F.lit(False)
        compared = met.where("mixed AND open AND first").select("key", "at", F.struct("start", "length", "hash", "single", hot.alias("hot")).alias("part"))
        more = not compared.where("part.hot").isEmpty()
        texts = source.dropDuplicates(["key"]) if step == 0 else source
        cut = _cut_out(texts.drop("wanted").join(compared.groupBy("key", "at").agg(F.collect_list("part").alias("parts")), ["key", "at"]))
        cut = checkpointed(cut) if more else cut
        told.append(_by_suffix_array(cut.where("NOT hot"), length))
        if not more:
            break
        source = cut.where("hot").select("key", F.col("start").alias("at"), F.col("single").alias("wanted"), "data")
    return reduce(DataFrame.unionByName, told).distinct().groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(at[::2], at[1::2]))


def _apply(docs: DataFrame, length: int, tell, told: str) -> DataFrame:
    """row struct (docs' other columns) and told, which is tell(data, runs) of the text: one join by the text's key, the only move of whole rows."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), text_or_empty().alias("data")).select("row", text_key(F.col("data")).alias("key"), F.col("data").cast("binary").alias("data"))
    joined = rows.join(marks(docs, length), "key", "left").select("row", "data", "spans")
    schema = joined.select("row", F.lit(None).cast(told).alias("told")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            found = [tell(t.as_py(), merged(s.as_py() or [])) for t, s in zip(batch.column("data"), batch.column("spans"))]
            columns = [pa.array(c) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(columns, schema["told"].dataType.names)], ["row", "told"])

    return bounded_batches(joined).mapInArrow(run, schema)


def _text_without(data: bytes, runs: list[tuple[int, int]]) -> str:
    """A character cut in two goes as a whole."""
    return without(data, [_to_characters(data, r) for r in runs]).decode("utf-8", "ignore")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining text."""

    def tell(data: bytes, runs: list[tuple[int, int]]) -> tuple:
        return len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(data, runs)).hexdigest(), _text_without(data, runs)

    told = _apply(docs.select("doc_id", "text"), length, tell, "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,text:string>")
    return told.select("row.doc_id", "told.*")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with text less its repeated strings; null texts stay null."""
    marked = docs.withColumn("text", F.col("text").cast("string"))
    told = _apply(marked.withColumn(_NULL, F.col("text").isNull()), length, lambda data, runs: (_text_without(data, runs),), "struct<text:string>")
    text = F.when(~F.col(f"row.{_NULL}"), F.col("told.text"))
    return told.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _to_characters(data: bytes, run: tuple[int, int]) -> tuple[int, int]:
    low, high = run
    while low > 0 and data[low] & 0xC0 == 0x80:
        low -= 1
    while high < len(data) and data[high] & 0xC0 == 0x80:
        high += 1
    return low, high


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
