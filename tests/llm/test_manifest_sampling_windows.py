"""The Merkle manifest, importance resampling and window packing against plain versions, and the last mended faults of older operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from archlens.llm import ann, merkle, nnls, packing, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, idx long, n long, item string, place long, rank long"


def folder_of(spark, path, rows, **others):
    """A documents table of (doc_id, text, lang, source, n_chars), with more columns whose names the operators use themselves."""
    spark.createDataFrame([(*r, "x", 7, 7, "x", 7, 7) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    for name, df in others.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    """(siblings left and right) of each level."""
    out = []
    for level in levels[:-1]:
        run = i - i % 2
        out.append((level[run:i], level[i + 1 : run + 2]))
        i //= 2
    return out


def plain_manifest(rows):
    say = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha(say(r[0]), say(r[3]), say(r[2]), say(None if r[4] is None else r[4] + more), say(r[1]))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = plain_levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = plain_path(trees[g], i) + plain_path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, 1) if bad else own
            for left, right in path:
                h = sha(*left, h, *right)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], sha(*[x for left, right in path for x in left + right]), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [3, 0, 1], [40, 17, 1, 2, 16], [300]])
def test_op11_against_a_plain_tree(spark, tmp_path, sizes):
    rng, rows = random.Random(sum(sizes)), []
    for lang, n in zip(["en", None, "", "zh-汉", "de"], sizes):
        rows += [(rng.choice([rng.randrange(10**6), None, 5]) if rng.random() < 0.1 else rng.randrange(10**6), rng.choice(["", None, "text é", "long " * 20_000]), lang, rng.choice([None, "s", "ü"]), rng.choice([None, 3])) for _ in range(n)]
    rows += rows[:2]
    got = merkle.op11_merkle_manifest(spark, folder_of(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    if len(rows) > 40:
        assert {r["verified"] for r in got} == {True, False}


def test_op11_without_rows(spark, tmp_path):
    assert merkle.op11_merkle_manifest(spark, folder_of(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("fanout, levels", [(3, 2), (2, 1), (4, 1)])
def test_trees_of_other_widths(spark, fanout, levels):
    leaves = [("a", k, sha(str(k))) for k in range(23)]
    df = spark.createDataFrame(leaves, "g string, id long, leaf string").withColumn("found", F.lit(None).cast("string"))
    rows = merkle.manifest(df, fanout, levels).collect()
    level = [x[2] for x in leaves]
    while len(level) > 1:
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    assert {r["subroot"] for r in rows} == set(level) == {r["root"] for r in rows} and all(r["verified"] for r in rows) and len(rows) == 23


def plain_resampling(rows, target, longest=1, percent=10, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    features = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    ranked = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(ranked[: percent * len(ranked) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def a_corpus(n, seed):
    rng = random.Random(seed)
    words = ["The", "of", "naïve", "x1", "日本", "B-C", "\x00", "ÉTÉ", "word" * 30] + [f"w{k}" for k in range(60)]
    text = lambda: " ".join(rng.choices(words, k=rng.choice([0, 1, 19, 20, 40, 90])))
    rows = [(rng.choice([None, 3, rng.randrange(-(2**40), 2**62)]) if rng.random() < 0.1 else rng.randrange(10**5), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]
    return rows + rows[: n // 10], [text() for _ in range(n // 4)] + [None]


@pytest.mark.parametrize("n", [0, 5, 400])
def test_op12_against_a_plain_version(spark, tmp_path, n):
    rows, target = a_corpus(n, n)
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.op12_importance_resampling(spark, folder_of(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in rows], benchmark=benchmark)).collect()
    assert sorted(map(tuple, got), key=str) == plain_resampling(rows, target)


def test_longer_features_and_slices():
    text = " ".join(f"w{k % 7}" for k in range(500)).encode()
    whole = Counter(f for _, fs in resampling.feature_slices(text, 3, 1 << 20) for f in fs)
    assert whole == Counter(f for _, fs in resampling.feature_slices(text, 3, 16) for f in fs)
    assert sum(whole.values()) == 500 + 499 + 498 and sum(n for n, _ in resampling.feature_slices(text, 3, 16)) == 500


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_radix_sort_is_stable_and_whole(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([0, 5, 70_000, 2**33 + 1, 2**33 + 2]), rng.randrange(3), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, k long").repartition(7)
    given = [tuple(r) for r in df.withColumn("at", F.monotonically_increasing_id()).orderBy("at").select("a", "b", "k").collect()]
    found = resampling.radix_sorted(df, [F.col("b"), *resampling.digits_of(F.col("a"))], block).orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(300))
    assert [(r["a"], r["b"], r["k"]) for r in found] == sorted(given, key=lambda r: (r[0], r[1]))


def padding(lengths, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def check_windows(pieces, ids_of, capacity):
    """Every id in one piece, windows gapless and within the capacity; the windows' lengths."""
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    out = []
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
        out.append(at)
    return out


TEXTS = ["", None, "A word", "İstanbul ΣΑΣ", "a<|endoftext|>b<|startoftext|>", "don't WE'LL", "x" * 9000, "many words of it " * 3000, "é Å ﬁ 漢字 ٣½ ÷ªµ", "\x0b\x1c! ?", "1234.5e6 " * 300]


def test_op13_ids_and_windows(spark, tmp_path):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(TEXTS * 9)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    got = nnls.op13_window_packing(spark, folder_of(spark, tmp_path, rows)).collect()
    lengths = check_windows(got, wanted, 2048)
    assert padding(lengths, 2048) == 0 and len(lengths) <= sum(map(len, wanted.values())) // 2048 + 12


def test_op13_edges(spark, tmp_path):
    assert nnls.op13_window_packing(spark, folder_of(spark, tmp_path, [])).count() == 0
    twice = [(None, "same words", "en", "s", 1)] * 3
    got = nnls.op13_window_packing(spark, folder_of(spark, tmp_path, twice)).collect()
    assert sum(r["length"] for r in got) == 9 and {r["doc_tokens"] for r in got} == {3}


PARTS = ["'s", "'re", "'ve", "'m", "'ll", "'", "'r", "'S", "a", "Zz", "é", "Ÿ", "0", "12", " ", "\t", "\r\n", "!", "--", "e", "st", "x", "İ", "\0", "漢", "<|endoftext|>", "<|"]


@pytest.mark.parametrize("odd", [False, True])
def test_op13_ids_of_texts_side_by_side(odd):
    rng = random.Random(3)
    parts = PARTS if odd else PARTS[:22]
    texts = ["'", "'s", "'s's", "x's't", "", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)), "y" * 200, "'ll"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = nnls.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))(texts)
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class Counted(dict):
    """A dictionary that counts what is asked of it."""

    asked = 0

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)


def test_op13_asks_once_for_each_different_piece_of_many_texts():
    encoder = nnls.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.known = Counted()
    encoder(["the same few words, again and again"] * 300)
    assert encoder.known.asked <= 8


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_token_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 16, 31, 64])
    histogram = {n: rng.choice([1, 2, 7, 100]) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity - 1))}
    plan, windows = nnls.Plan(histogram, capacity), defaultdict(list)
    for n, count in histogram.items():
        for k in range(count):
            parts = plan.at(n, k)
            assert [p[0] for p in parts] == list(np.cumsum([0, *[p[1] for p in parts[:-1]]])) and sum(p[1] for p in parts) == n
            for _, size, sequence, offset in parts:
                windows[sequence].append((offset, size))
    lengths = []
    for held in windows.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        lengths.append(at)
    assert sorted(windows) == list(range(plan.windows)) and max(lengths) <= capacity
    assert padding(lengths, capacity) == 0 or capacity & (capacity - 1)


def test_repeats_are_least_squares():
    """No step along any combination that keeps its repeats from 0 on lowers the sum of squares."""
    rng = np.random.default_rng(1)
    counts = np.r_[0, rng.integers(0, 50, 24)]
    full = len(counts) - 1
    combos = [(a, full - a) for a in range(1, full // 2 + 1)] + [(a, b, full - a - b) for a in range(1, full) for b in range(a, full) if full - a - b >= b]
    matrix = np.array([[c.count(n) for c in combos] for n in range(full + 1)], float)
    x = np.zeros(len(combos))
    for lengths, repeats in nnls.solved(counts, rounds=3000):
        if len(lengths) > 1:
            x[combos.index(tuple(sorted(lengths)))] = repeats
    target = counts.astype(float)
    target[full] = 0
    rest = lambda y: ((target - matrix @ y) ** 2).sum()
    slope = matrix.T @ (matrix @ x - target)
    descent = np.zeros(len(combos))
    for _ in range(20000):  # plain projected gradient
        descent = np.maximum(0, descent - 0.01 * matrix.T @ (matrix @ descent - target))
    assert rest(x) <= rest(descent) * 1.02 + 1.0 and slope.min() > -1.5 * len(combos) ** 0.5


def test_op10_very_long_white_space():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 1_000_000
    for text in (" " * n, "a" + " " * n + "b", "a" + "\t" * 20_000 + "<|endoftext|>b", "x" + " \n" * 20_000 + "'s " + "　" * 15_000 + "é", " " * 9_999 + "q" + " " * 10_001 + "!"):
        assert packing.encode(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [200, 700])
def test_op2_ties_go_to_the_smaller_ids(spark, n):
    rows = [(k, [float(k == j) for j in range(n)]) for k in range(n)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    for q in range(0, n, 100):
        assert [r["vec_id"] for r in got if r["query_id"] == q] == [k for k in range(12) if k != q][:10]


def test_op2_large_components(spark):
    rows = [(k, [1e200 * (k + 1), 1.0]) for k in range(20)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 11))
