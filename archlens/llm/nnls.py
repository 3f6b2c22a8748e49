"""Packing of token streams into windows by non-negative least squares.

Documents become token ids and an end id, and those longer than a window are cut. What is left to plan is the histogram of
lengths, as many numbers as a window has tokens. All combinations of one to three lengths that fill a window exactly are
enumerated, and their repeat counts x >= 0 are solved for least squares against the histogram by exact block coordinate
descent: pairs share no length, so all are one step; triples with one shortest length share only that, so a sorted sum
gives their joint minimum. Counts are rounded, the largest first, as far as there are pieces. Residuals are packed
greedily: first by combinations that still fill a window exactly, then one after the other into windows, with a cut where
one is full. What stays at the end is cut into windows of powers of two, which aren't padded. So no window is padded.

The plan is a run of windows for each repeated combination, bounded by the window's size and not by the data; tasks find a
piece's window by binary search. Ids move once, two bytes each, to be numbered.

Defined results: null text is empty, and an empty document is its end id alone; repeated rows and null ids are documents of
their own; an empty table packs into nothing; texts of any length are tokenised whole; other columns are left out.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm.common import bounded_batches, read_table, text_or_empty
from archlens.llm.packing import cut, numbered

CAPACITY, END_ID = 2048, 1
#: Rounds of descent over all combinations at most, and the change in a round, against the mean count, below which it ends.
ROUNDS, SETTLED = 40, 0.01
#: Pieces of words whose ids a worker remembers, twice over, and the length up to which; characters of texts that are encoded at once, and a text more.
REMEMBERED, LONG, GROUP = 150_000, 64, 1 << 21
#: Texts of these characters alone are lowered and cut into pieces at once: for them it is what the tokenizer does. All other words go through it whole.
_PLAIN = re.compile("[^ \\t\\r\\n!-~À-ÖØ-öø-įı-ſ]")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \\t\\r\\na-z0-9ß-öø-ſ]+")
#: White space that the tokenizer drops for certain; other white space is left to it.
_WORDS = re.compile("[^ \\t\\r\\n]+")
#: What a byte of a plain, lowered text is, where all that isn't ASCII is letters: nothing, a letter, a digit or another mark.
_GAP, _LETTER, _DIGIT, _MARK = range(4)
_KINDS = np.array([_GAP if b in b"\0 \t\r\n" else _LETTER if b >= 128 or 97 <= b <= 122 else _DIGIT if 48 <= b <= 57 else _MARK for b in range(256)], np.uint8)
_encoders: dict[str, WordEncoder] = {}


def byte_letters() -> dict[int, str]:
    """What stands for each byte in a byte-level vocabulary: printable ones are themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(kept)))}


class WordEncoder:
    """Ids of whole texts by a tokenizer that lowers letters, drops white space and merges within pieces of words alone, so that a piece's ids don't depend on its neighbours and are found once for many texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.earlier = Tokenizer.from_file(path), {}, {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")

    def _ids(self, piece: bytes | str) -> bytes:
        """A word goes through the whole tokenizer, a piece's bytes only through its merges."""
        if isinstance(piece, str):
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.model.tokenize(piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _found(self, pieces: list[bytes | str]) -> list[bytes]:
        """Ids of different pieces; long ones aren't remembered."""
        known = self.known
        found = list(map(known.get, pieces))
        for k, piece in enumerate(pieces):
            if found[k] is None:
                ids = found[k] = self.earlier.get(piece) or self._ids(piece)
                if len(piece) <= LONG:
                    known[piece] = ids
        if len(known) > REMEMBERED:  # what is used again comes back from there
            self.earlier, self.known = known, {}
        return found

    def _odd(self, text: str) -> bool:
        return bool(_PLAIN.search(text)) or any(a in text for a in self.added)

    def _mixed(self, text: str) -> np.ndarray:
        """Ids of a text with odd words."""
        pieces: list[bytes | str] = []
        for word in _WORDS.findall(text):
            pieces += [word] if self._odd(word) else map(str.encode, _PIECES.findall(word.lower()))
        different = list(set(pieces))
        ids = dict(zip(different, self._found(different), strict=True))
        return np.frombuffer(b"".join(map(ids.__getitem__, pieces)), self.kind)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts: their pieces are cut side by side, and each different one is looked up once."""
        data = np.frombuffer(("\0".join(texts).lower() + "\0\0\0\0").encode(), np.uint8)
        starts, pieces = cut_pieces(data)
        coded = pieces.dictionary_encode()
        ids = pa.array(self._found(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // np.dtype(self.kind).itemsize
        flat = np.frombuffer(ids.buffers()[2], self.kind, at[-1]) if at[-1] else np.zeros(0, self.kind)
        ends = at[np.searchsorted(starts, np.flatnonzero(data == 0)[: len(texts)])]
        return np.split(flat, ends[:-1])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if self._odd(text):
                out[k] = self._mixed(text)
            else:
                group.append(k)
                size += len(text)
            if group and (size >= GROUP or k == len(texts) - 1):
                for j, ids in zip(group, self._plain([texts[j] for j in group]), strict=True):
                    out[j] = ids
                group, size = [], 0
        return out


def cut_pieces(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the pieces (_PIECES) of plain, lowered texts begin, and the pieces; a zero byte ends each text, three more the last."""
    kind = _KINDS[data]
    inside = kind != _GAP
    begin = inside.copy()
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    at = np.flatnonzero(begin & (data == ord("'")))  # the others are within a run of marks
    a, b = data[at + 1], data[at + 2]
    size = np.isin(a, [*b"stmd"]) + 2 * ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    at, size = at[size > 0], size[size > 0]
    begin[at + 1] = False
    begin[at + 1 + size] = inside[at + 1 + size]
    bounds = np.append(np.flatnonzero(begin[inside]), np.count_nonzero(inside))
    held = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[inside])]
    return np.flatnonzero(begin), pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, held)


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, length, doc_tokens, ids (little-endian, two or four bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            rows, start, length, total, held = [], [], [], [], []
            for row, found in enumerate(encode(batch.column("text").to_pylist())):
                ids = np.append(found, np.array([end_id], encode.kind))
                for s, n in cut(len(ids), capacity):
                    rows.append(row)
                    start.append(s)
                    length.append(n)
                    total.append(len(ids))
                    held.append(ids[s : s + n].tobytes())
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, total)], pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).transform(bounded_batches).mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def solved(counts: np.ndarray, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """[(combination, repeats)] of least squares against counts[length], for combinations of up to three lengths that fill a window of len(counts) - 1. Repeats aren't whole."""
    full = len(counts) - 1
    left = counts.astype(float)  # counts less what the combinations take
    left[full] = 0.0  # a window of its own
    half = np.arange(1, full // 2 + 1)
    twice = half * 2 == full
    pairs, triples = np.zeros(len(half)), {}
    for a in range(1, full // 3 + 1):
        b = np.arange(a + 1, (full - a - 1) // 2 + 1)
        triples[a] = [b, full - a - b, np.zeros(len(b)), 0.0, 0.0]  # lengths above a, their repeats, those of (a, a, c) and (a, b, b)

    def alone(x: float, column: dict[int, int]) -> float:
        """One combination's minimum, with left brought up to date."""
        new = max(0.0, x + sum(k * left[n] for n, k in column.items()) / sum(k * k for k in column.values()))
        for n, k in column.items():
            left[n] -= k * (new - x)
        return new

    mean = max(1e-9, counts.sum() / max(1, np.count_nonzero(counts)))
    for _ in range(rounds):
        moved = 0.0
        gain = np.where(twice, left[half] / 2, (left[half] + left[full - half]) / 2)
        new = np.maximum(0.0, pairs + gain)
        step = new - pairs
        left[half] -= np.where(twice, 2 * step, step)
        left[full - half[~twice]] -= step[~twice]
        pairs, moved = new, float(np.abs(step).max(initial=0.0))
        for a, held in triples.items():
            b, c, x = held[:3]
            if len(b):
                wish = left[b] + left[c] + 2 * x
                falling = np.sort(wish)[::-1]
                shared = (2 * (left[a] + x.sum()) - np.cumsum(falling)) / (2 + np.arange(1, len(b) + 1))
                some = np.flatnonzero(falling + shared > 0)
                new = np.maximum(0.0, (wish + shared[some[-1]]) / 2) if len(some) else np.zeros(len(b))
                step = new - x
                left[b] -= step
                left[c] -= step
                left[a] -= step.sum()
                held[2], moved = new, max(moved, float(np.abs(step).max()))
            if full - 2 * a > a:
                held[3] = alone(held[3], {a: 2, full - 2 * a: 1})
            elif full == 3 * a:
                held[3] = alone(held[3], {a: 3})
            if (full - a) % 2 == 0 and (full - a) // 2 > a:
                held[4] = alone(held[4], {a: 1, (full - a) // 2: 2})
        if moved < SETTLED * mean:
            break
    out = [((full,), float(counts[full]))] + [((int(a), int(full - a)), float(x)) for a, x in zip(half, pairs, strict=True) if x >= 0.5]
    for a, (b, c, x, low, high) in triples.items():
        some = np.flatnonzero(x >= 0.5)
        out += [((a, int(b[k]), int(c[k])), float(x[k])) for k in some]
        out += [(lengths, n) for lengths, n in (((a, a, full - 2 * a), low), ((a, (full - a) // 2, (full - a) // 2), high)) if n >= 0.5]
    return out


def rounded(repeats: list[tuple[tuple[int, ...], float]], left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats, the largest first, as far as there are pieces; left is brought up to date."""
    out = []
    for lengths, x in sorted(repeats, key=lambda r: (-r[1], r[0])):
        parts = {n: lengths.count(n) for n in lengths}
        if n := min(int(x + 0.5), *(int(left[p]) // k for p, k in parts.items())):
            out.append((lengths, n))
            for p, k in parts.items():
                left[p] -= n * k
    return out


def filled(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of two or three lengths that still fill a window, the longest lengths first; left is brought up to date."""
    full, out = len(left) - 1, []

    def take(*lengths: int) -> bool:
        parts = {n: lengths.count(n) for n in lengths}
        n = min(int(left[p]) // k for p, k in parts.items())
        if n:
            out.append((lengths, n))
            for p, k in parts.items():
                left[p] -= n * k
        return bool(n)

    for a in range(full - 1, 0, -1):
        gap = full - a
        if left[a] and gap > 1:
            take(a, gap) if gap != a else take(a, a)
        while left[a]:
            b = np.arange(gap - 1, (gap - 1) // 2, -1)
            some = b[(left[b] > 0) & (left[gap - b] > 0)]
            if not any(take(a, int(n), gap - int(n)) for n in some):
                break
    return out


def tail(n: int, capacity: int) -> list[int]:
    """Lengths of the last windows, for n tokens that fill less than one: powers of two, the largest first."""
    return [1 << k for k in range(capacity.bit_length(), -1, -1) if n >> k & 1]


class Plan:
    """Where the k-th piece of each length goes: (sequence, offset), or a place in the stream of residuals."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        counts = np.zeros(capacity + 1, np.int64)
        for n, c in histogram.items():
            counts[n] = c
        left, taken = counts.copy(), [0] * (capacity + 1)
        combined = rounded(solved(counts), left) + filled(left)
        runs, sequence = [], 0
        for lengths, count in combined:
            offset = 0
            for n in lengths:
                runs.append((n, taken[n], sequence, offset))
                taken[n] += count
                offset += n
            sequence += count
        self.capacity, self.first, at = capacity, sequence, 0
        for n in range(capacity, 0, -1):
            if left[n]:
                runs.append((n, taken[n], -1, at))
                at += int(left[n]) * n
        self.streamed, self.whole = at, at // capacity
        self.tail = np.cumsum([0, *tail(at % capacity, capacity)])
        runs.sort()
        table = np.array(runs, np.int64).reshape(-1, 4)
        self.length, self.number, self.sequence, self.offset = table.T.copy()
        self.windows = self.first + self.whole + len(self.tail) - 1
        self._starts = np.searchsorted(self.length, np.arange(capacity + 2))

    def at(self, n: int, k: int) -> list[tuple[int, int, int, int]]:
        """[(start within the piece, length, sequence, offset)] of the k-th piece of n tokens."""
        low, high = self._starts[n], self._starts[n + 1]
        run = low + int(np.searchsorted(self.number[low:high], k, "right")) - 1
        ahead = k - int(self.number[run])
        if self.sequence[run] >= 0:
            return [(0, n, int(self.sequence[run]) + ahead, int(self.offset[run]))]
        place, out, done = int(self.offset[run]) + ahead * n, [], 0
        while done < n:
            window, offset = divmod(place + done, self.capacity)
            sequence, room = self.first + window, self.capacity - offset
            if window == self.whole:  # the last one is several, of powers of two
                j = int(np.searchsorted(self.tail, offset, "right")) - 1
                sequence, room, offset = sequence + j, int(self.tail[j + 1]) - offset, offset - int(self.tail[j])
            size = min(room, n - done)
            out.append((done, size, sequence, offset))
            done += size
        return out


def pack(pieces: DataFrame, kind: str, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces' rows, with ids of that numpy kind -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows, histogram = numbered(pieces, "doc_id", "start")
    plan = Plan(histogram, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.to_pydict()
            out: list[tuple] = []
            for row, (k, n, s, ids) in enumerate(zip(held["_k"], held["length"], held["start"], held["ids"], strict=True)):
                wide = np.frombuffer(ids, kind).astype("<u4")
                out += [(row, s + b, size, zlib.crc32(wide[b : b + size].tobytes()), sequence, offset) for b, size, sequence, offset in plan.at(n, k)]
            row, start, length, crc, sequence, offset = (pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)) if out else [pa.array([], pa.int64())] * 6
            taken = batch.select(["doc_id", "doc_tokens"]).take(row)
            yield pa.RecordBatch.from_arrays([taken.column("doc_id"), start, length, crc, taken.column("doc_tokens"), sequence, offset], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    doc_id = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, " + ", ".join(f"{n} long" for n in names[1:])
    return rows.select("doc_id", "start", "length", "doc_tokens", "ids", "_k").mapInArrow(run, schema)


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(token_pieces(read_table(spark, sf_dir, "documents"), path), WordEncoder(path).kind)
