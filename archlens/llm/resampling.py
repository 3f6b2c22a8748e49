"""Importance resampling towards a target distribution, drawn by a distributed radix sort.

Features of a text are its runs of consecutive words, hashed into buckets. Both corpora are counted over the buckets, and
a bucket's gain tells how much likelier it is in the target; the gains are one array of fixed size, which every task
reads. A document's weight is the mean of its features' gains, and its score adds Gumbel noise from a hash of its id, so
that the highest scores are a draw without replacement in proportion to exp(weight / 1000).

The draw ranks documents by a least-significant-digit radix sort: for each digit of the composite key (score falling, then
doc_id) one stable counting-sort pass counts digits a block of places, turns the counts into global offsets by prefix
sums, and moves each row to its offset plus its number among the block's rows of that digit. No block or digit is one task
however the keys are spread. A coarse histogram of scores shows below which none is drawn; those rows stay out of the sort.

Defined results: null and empty texts, and texts without words, have no features and weight 0, and aren't drawn below
least_words; a null doc_id is hashed as empty and comes after all others of its score; repeated rows are drawn each by
itself; an empty target leaves every gain the prior's; an empty table gives an empty result; other columns are left out.
Texts of any length are read whole, in slices. doc_id must be integral.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.llm.common import bounded_batches, checkpointed, read_table

BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Bits of a radix digit, places of a block, and bits of a score that the coarse histogram leaves out.
DIGIT_BITS, BLOCK, COARSE = 16, 1 << 20, 8
#: A text is folded and split so many bytes at a time; gains of so many features are remembered.
SLICE, REMEMBERED = 1 << 20, 200_000
#: Letters fall to lower case, digits and bytes of other scripts stay, all else separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, cut between words into slices of about so many bytes."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def feature_slices(text: bytes, longest: int, size: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, runs of 1 to longest consecutive words that end in the slice) of each slice."""
    before: list[bytes] = []
    for words in word_slices(text, size):
        found, joined, old = list(words), before + words, len(before)
        for n in range(2, longest + 1):
            found += [b" ".join(joined[i : i + n]) for i in range(max(0, old - n + 1), len(joined) - n + 1)]
        before = joined[max(0, len(joined) - longest + 1) :] if longest > 1 else []
        yield len(words), found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of texts(text) lie in each bucket: one row a bucket and task, summed, so the driver gets the buckets alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").drop_null().cast(pa.binary()):
                for _, found in feature_slices(text.as_py(), longest):
                    seen.update(found)
            at = np.fromiter((zlib.crc32(f) % buckets for f in seen), np.int64, len(seen))
            np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    counted = bounded_batches(texts.select(F.col("text").cast("string"))).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """A thousandth of a nat each, floored, of the ratio of smoothed frequencies."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _GainOf(dict):
    """Feature -> gain, remembered."""

    def __init__(self, table: list[int]):
        super().__init__()
        self.table = table

    def __missing__(self, feature: bytes) -> int:
        found = self[feature] = self.table[zlib.crc32(feature) % len(self.table)]
        return found


def scored(docs: DataFrame, table: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_features, weight, score; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = _GainOf(table)
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
                n_words = n = total = 0
                for more, found in feature_slices(text.as_py() or b"", longest):
                    n_words, n, total = n_words + more, n + len(found), total + sum(map(gain.__getitem__, found))
                    if len(gain) > REMEMBERED:
                        gain.clear()
                weight = total // n if n else 0
                rows.append((n_words, n, weight, weight + noise(doc_id, seed)))
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return bounded_batches(texts).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def digits_of(key: Column, width: int = 64, bits: int = DIGIT_BITS) -> list[Column]:
    """Digits of an unsigned whole number of so many bits, the lowest first."""
    return [F.shiftrightunsigned(key, at).bitwiseAND(F.lit((1 << bits) - 1)) for at in range(0, width, bits)]


def radix_sorted(rows: DataFrame, digits: list[Column], block: int = BLOCK) -> DataFrame:
    """rows with place, from 0, in rising order of digits (the least significant first), rows of equal digits in their present order.

    Every pass is a counting sort: counts of (block, digit), their exclusive sums in order of digit and block, and a row's
    number among its block's rows of its digit. Passes over a digit that all rows share are left out.
    """
    names = [f"_d{k}" for k in range(len(digits))]
    rows = checkpointed(rows.withColumns(dict(zip(names, digits, strict=True)) | {"place": F.monotonically_increasing_id()}))
    spans = rows.agg(*[(F.max(n) > F.min(n)).alias(n) for n in names]).first()
    passes = [n for n in names if spans[n]] or names[:1]
    for k, name in enumerate(passes):
        # before the first pass places are numbers of partitions and rows, each partition a block
        dealt = rows.withColumn("_block", F.shiftright("place", 33) if k == 0 else F.call_function("div", F.col("place"), F.lit(block)))
        counts = dealt.groupBy("_block", name).agg(F.count("*").alias("_n"))
        earlier = Window.partitionBy(name).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        totals = counts.groupBy(name).agg(F.sum("_n").alias("_all"))  # a row for each value of the digit
        lower = Window.partitionBy(F.lit(0)).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.select(name, F.coalesce(F.sum("_all").over(lower), F.lit(0)).alias("_base"))
        offsets = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(bases, name)
        offsets = offsets.select("_block", name, (F.col("_base") + F.col("_earlier")).alias("_offset"))
        own = F.row_number().over(Window.partitionBy("_block", name).orderBy("place")) - 1
        moved = dealt.withColumn("_own", own).join(offsets, ["_block", name])
        rows = checkpointed(moved.withColumn("place", F.col("_offset") + F.col("_own")).select(rows.columns))
    return rows.drop(*names)


def draw(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, block: int = BLOCK) -> DataFrame:
    """scores(doc_id, n_words, score, ...) with rank: 1, 2, 3, ... from the highest score, ties to the smaller doc_id, of the percent that is drawn; null for the others."""
    fit, coarse = F.col("n_words") >= least_words, F.shiftright("score", COARSE)
    histogram = scores.where(fit).groupBy(coarse.alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()  # some hundred rows: scores are bounded by their formula
    wanted, reached, cut = percent * sum(r["n"] for r in histogram) // 100, 0, None
    for r in histogram:
        if reached < wanted:
            reached, cut = reached + r["n"], r["c"] << COARSE
    if cut is None:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    enters = fit & (F.col("score") >= cut)
    top = (histogram[0]["c"] + 1) << COARSE
    known = F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))  # signed order as unsigned
    key = [*digits_of(known), F.col("doc_id").isNull().cast("long"), *digits_of(F.lit(top) - F.col("score"), 32)]
    ranked = radix_sorted(scores.where(enters), key, block)
    rank = F.when(F.col("place") < wanted, F.col("place") + 1)
    return ranked.withColumn("rank", rank).drop("place").unionByName(scores.where(~enters).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_features, weight, score, rank, where target(text) is what the drawn documents should be like."""
    table = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    return draw(checkpointed(scored(docs, table, longest, seed)), percent, least_words)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def crc32_sql(text: str) -> str:
    """DuckDB's crc32 of a string's UTF-8 bytes; crc_table(t) must be in scope."""
    folded = f"list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))"
    return f"xor({folded}, 4294967295)"


def crc_table_sql() -> str:
    """The 256 remainders of bytes by the reflected polynomial."""
    step = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), {step}) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b))"


def oracle() -> str:
    letters, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{low}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH {crc_table_sql()},
    d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
    w AS (SELECT r, unnest(ws) AS word FROM d),
    b AS (SELECT unnest({words}) AS word FROM benchmark),
    v AS (SELECT word, {crc32_sql('word')} % {BUCKETS} AS bucket FROM (SELECT word FROM w UNION SELECT word FROM b), crc_table),
    s AS (SELECT bucket, count(*) AS n FROM w JOIN v USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM b JOIN v USING (word) GROUP BY bucket),
    sums AS (SELECT (SELECT count(*) FROM w) + {BUCKETS} AS s_all, (SELECT count(*) FROM b) + {BUCKETS} AS t_all),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * s_all / ((s.n + 1)::DOUBLE * t_all)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
    m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
    x AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
    y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
    z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM y WHERE n_features >= {LEAST_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN k <= n * {PERCENT} // 100 THEN k END AS rank FROM y LEFT JOIN z USING (r)"""
