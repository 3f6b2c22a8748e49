"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on windows of toxic and one on windows of ordinary text.
Most of a toxic text is like any other, so the contrast decides which windows train: toxic ones are where byte n-grams
stand whose document frequencies differ significantly between the classes, less windows that both classes share;
ordinary ones hold none of these n-grams. The ordinary content is part of both, so that they differ by what marks toxic text. Every window of a text is compressed with both;
the difference of the lengths in bytes tells which class it is closer to. A text's windows at or above each of several
differences are counted, and a logistic model of those counts and the number of windows, fitted on texts that its
dictionaries haven't seen (two folds), calibrates them to a probability.

Only fitting uses labels, and only a bounded sample of labelled texts reaches the driver: SAMPLE texts of each class at
most, those of the lowest hash among those no longer than SAMPLE_CHARS; n-grams are counted in a table of fixed size, and
WINDOWS ordinary windows at most train. Scoring reads every whole text, in tasks.

Defined results: null text is empty; an empty text is scored like any other, as one empty window; equal texts have equal
scores; without labelled texts of both classes every score is 0; other columns never matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm.common import bounded_batches, read_table, text_or_empty

SAMPLE, SAMPLE_CHARS = 2000, 20_000
WINDOW, STEP, GRAM, LONG_GRAM = 48, 32, 6, 24
#: A run of n-grams is toxic if each has at least this G-squared (1 degree of freedom), stands in at least this share of toxic texts, and so many times as often in them as in ordinary ones.
SIGNIFICANT, SUPPORT, RATIO = 25.0, 0.02, 3.0
#: Sizes of the dictionaries' content, and of the segments that training picks for each; few bytes keep the toxic one to what recurs.
ORDINARY_BYTES, ORDINARY_SEGMENT, TOXIC_BYTES, TOXIC_SEGMENT = 12_000, 64, 4_000, 40
#: Bytes on either side of a marked run that its window has at most, ordinary windows that train at most, and the power of two of counters for n-grams.
AROUND, WINDOWS, COUNTERS = 24, 200_000, 22
LEVELS = (1, 2, 3, 4, 5, 6, 8)
THRESHOLD = 0.7


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def __setstate__(self, state):
        self.__dict__.update(state, _compressors=None)

    def differences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes saved by the toxic dictionary in each window, and each text's number of windows."""
        if self._compressors is None:
            self._compressors = [_compressor(d) for d in (self.ordinary, self.toxic)]
        counts = np.array([max(1, -(-(len(t) - WINDOW) // STEP) + 1) for t in texts])
        begins = np.cumsum(np.r_[0, [len(t) for t in texts]])
        own = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(begins[:-1], counts) + own * STEP
        stops = np.minimum(starts + WINDOW, np.repeat(begins[1:], counts))
        data = b"".join(texts)
        out, part = np.zeros(len(starts), np.int64), 200_000
        for k in range(0, len(starts), part):
            a, b = starts[k : k + part], stops[k : k + part]
            full = np.flatnonzero(b > a)  # an empty window has no difference
            low, high = (int(a[full].min()), int(b[full].max())) if len(full) else (0, 0)
            segments = np.stack([a[full] - low, b[full] - a[full]], 1).astype("<u8").tobytes()
            if len(full):
                sizes = [_sizes(c, data[low:high], segments, len(full)) for c in self._compressors]
                out[k + full] = sizes[0] - sizes[1]
        return out, counts

    def features(self, texts: list[bytes]) -> np.ndarray:
        diff, counts = self.differences(texts)
        first = np.cumsum(counts) - counts
        hits = np.stack([np.add.reduceat((diff >= k).astype(np.int64), first) for k in LEVELS], 1)
        return np.column_stack([np.log1p(hits), hits / np.sqrt(counts)[:, None], np.log(counts), np.clip(np.maximum.reduceat(diff, first), 0, 12)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts or self.weights is None:
            return np.zeros(len(texts))
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.weights, -30, 30)))


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    own = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    parameters = zstd.ZstdCompressionParameters.from_level(
        5, source_size=WINDOW, dict_size=len(dictionary), strategy=zstd.STRATEGY_GREEDY, min_match=4, search_log=6, chain_log=14, hash_log=14,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    return zstd.ZstdCompressor(dict_data=own, compression_params=parameters)


def _sizes(compressor: zstd.ZstdCompressor, data: bytes, segments: bytes, n: int) -> np.ndarray:
    out = compressor.multi_compress_to_buffer(zstd.BufferWithSegments(data, segments), threads=1)
    return np.fromiter((len(out[i]) for i in range(n)), np.int64, n)


def _hashes(text: bytes, size: int) -> np.ndarray:
    """64-bit hashes of all n-grams."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(data) - size + 1), np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + data[k : k + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _counters(text: bytes) -> np.ndarray:
    return (_hashes(text, GRAM) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _frequencies(texts: list[bytes]) -> np.ndarray:
    counts = np.zeros(1 << COUNTERS, np.int32)
    for t in texts:
        counts[np.unique(_counters(t))] += 1
    return counts


def _g_squared(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Of a in n texts of one class against b in m of the other."""
    p, out = (a + b) / (n + m), np.zeros(len(a))
    for k, of in ((a, n), (b, m)):
        for x, e in ((k, of * p), (of - k, of * (1 - p))):
            out += np.where(x > 0, 2 * x * np.log(np.maximum(x, 1) / np.maximum(e, 1e-300)), 0)
    return out


def _marks(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Which counters' n-grams mark toxic texts."""
    a, b, n, m = _frequencies(toxic), _frequencies(ordinary), len(toxic), len(ordinary)
    able = np.flatnonzero((a >= max(3, SUPPORT * n)) & (a.astype(np.int64) * m > RATIO * b * n))
    marks = np.zeros(1 << COUNTERS, bool)
    marks[able[_g_squared(a[able].astype(float), n, b[able].astype(float), m) >= SIGNIFICANT]] = True
    return marks


def _marked_windows(text: bytes, marks: np.ndarray) -> list[bytes]:
    """Where runs of marked n-grams stand: each word that the run has some bytes of, with AROUND bytes beyond the run at most, and a space on either side."""
    edge, out = np.diff(np.r_[0, marks[_counters(text)].astype(np.int8), 0]), []
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + GRAM - 1).tolist()):
        for low, high in [(i + m.start(), i + m.end()) for m in re.finditer(rb"\S+", text[i:j])]:
            if high - low >= GRAM - 2:
                before, after = text[max(0, low - AROUND) : low].split(), text[high : high + AROUND].split()
                head = before[-1] if before and not text[low - 1 : low].isspace() else b""
                tail = after[0] if after and not text[high : high + 1].isspace() else b""
                out.append(b" " + head + text[low:high] + tail + b" ")
    return out


def _telling_windows(toxic: list[bytes], ordinary: list[bytes], marks: np.ndarray) -> list[bytes]:
    """Marked windows less those that both classes share."""
    windows = [_marked_windows(t, marks) for t in toxic]
    of_toxic = Counter(w for own in windows for w in set(own))
    of_ordinary = Counter(w for t in ordinary for x in set(t.split()) if (w := b" " + x + b" ") in of_toxic)
    able = {w for w, k in of_toxic.items() if k >= 2 and k * len(ordinary) > RATIO * of_ordinary[w] * len(toxic)}
    return [w for own in windows for w in own if w in able]


def _trained(windows: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstd.train_dictionary(size + 4096, windows, k=segment, d=GRAM).as_bytes()[-size:]
    except zstd.ZstdError:  # too few windows to choose from
        return b"".join(windows)[-size:]


def make_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    marks = _marks(toxic, ordinary)
    starts = [(t, i) for t in ordinary for i in range(0, len(t), WINDOW)]
    plain = [w for t, i in starts[:: -(-len(starts) // WINDOWS) or 1] if len(w := t[i : i + WINDOW]) > GRAM and not marks[_counters(w)].any()]
    base = _trained(plain, ORDINARY_BYTES, ORDINARY_SEGMENT)
    telling = _telling_windows(toxic, ordinary, marks)
    marked = _trained([a + b for a, b in zip(telling, telling[1:] + telling[:1])], TOXIC_BYTES, TOXIC_SEGMENT)  # pairs, so that segments hold whole windows
    return Model(base or b"-" * 8, marked + base or b"-" * 8)  # what both hold lies equally far back in both


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _unlike(texts: list[bytes]) -> list[bytes]:
    """One of each group of copies and near copies, told by the smallest hashes of their long n-grams: else a copied text's words would count as often as it does."""
    seen, out = set(), []
    for t in texts:
        hashes = _hashes(t, LONG_GRAM)
        keys = {(k, int((hashes * np.uint64(odd)).min())) for k, odd in enumerate((1, 0x9E3779B97F4A7C15))} if len(hashes) else {t}
        if seen.isdisjoint(keys):
            out.append(t)
        seen |= keys
    return out


def fit(toxic: list[str], ordinary: list[str], odds: float | None = None) -> Model:
    """odds: toxic to ordinary among all labelled texts, where the sample has other ones."""
    if min(len(toxic), len(ordinary)) < 4:
        return Model(b"-" * 8, b"-" * 8)
    classes = [_unlike([normal(t) for t in texts]) for texts in (ordinary, toxic)]
    if min(map(len, classes)) < 4:
        return Model(b"-" * 8, b"-" * 8)
    x, y = [], []
    for fold in (0, 1):
        other = make_dictionaries(classes[1][1 - fold :: 2], classes[0][1 - fold :: 2])
        for label, texts in enumerate(classes):
            x.append(other.features(texts[fold::2]))
            y.append(np.full(len(x[-1]), label))
    x, y = np.concatenate(x), np.concatenate(y)
    model = make_dictionaries(classes[1], classes[0])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, y)
    if odds:
        model.weights[0] += math.log(odds) - math.log(y.sum() / (len(y) - y.sum()))
    return model


def fit_on_sample(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic); usable: of which doc_id the labels may be learned."""
    marked = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.length(text_or_empty()) <= SAMPLE_CHARS).select("doc_id")
    able = marked.join(short, "doc_id", "left_semi")
    ids = able.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    ids = ids.unionByName(able.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    rows = (
        docs.select("doc_id", text_or_empty().alias("text")).where(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("toxic", "text").limit(2 * SAMPLE).collect()
    )
    counts = dict(marked.groupBy("toxic").count().collect())
    odds = counts[1] / counts[0] if counts.get(0) and counts.get(1) else None
    return fit([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0], odds)


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score double. Narrow: no shuffle."""
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.concatenate([[0.0], *(model.score([normal(t or "") for t in batch.column(text).slice(k, 256).to_pylist()]) for k in range(0, batch.num_rows, 256))])[1:]
            yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns) if n != "score"], pa.array(scores, pa.float64())], [*[n for n in batch.schema.names if n != "score"], "score"])

    order = [c for c in docs.columns if c != "score"]
    return docs.select(order).transform(bounded_batches).mapInArrow(run, schema if "score" not in docs.columns else docs.select(order).withColumn("score", F.lit(0.0)).schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_sample(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
