"""Byte-level BPE encoding and decoding as a monoid's tree reduction.

A text's encoding is reduced over a binary tree: halves are encoded recursively and neighbours are joined. Two joins:

* Pieces (the matches of the split pattern): the window around a cut grows, doubling, until a place on either side where
  a match provably ends whatever lies beyond the window (a letter followed by something else), and is split anew.
* Tokens within a long piece: the window around a cut grows, doubling, until both pairs of tokens at its edges stay apart
  when encoded by themselves. Merges are taken by lowest rank, then leftmost; a pair of neighbours meets the same merges
  in the same order alone as within the whole, so if no merge crosses a boundary in the pair, none does in the whole:
  where all pairs of neighbours stay apart the sequence is the encoding, and all but the window's pairs did so before.

Decoding maps ids to bytes and concatenates both halves up the tree, from runs of IDS_LEAF ids on.

Defined results: null and empty texts have no ids; equal texts have equal ids; texts of any length are encoded whole, in
memory proportional to the text; other columns of the input don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from archlens.llm.common import bounded_batches, read_table, text_or_empty

#: Characters of text in a leaf of the tree; bytes of a piece in a leaf of its own tree; pieces kept encoded.
TEXT_LEAF, PIECE_LEAF, CACHE = 4096, 64, 200_000
#: Ids that are decoded at once.
IDS_LEAF = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Pieces(dict):
    """Piece -> its ids, made on first sight; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = self[piece] = self.make(piece)
        return ids


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.vocabulary = ranks, {i: b for b, i in ranks.items()}
        self._split = regex.compile(pattern).findall
        self._safe = regex.compile(r"\p{L}(?!\p{L})")
        self._apart: dict[tuple[int, int], bool] = {}
        self._encoded = _Pieces(lambda piece: tuple(self.encode_piece(piece.encode())))

    # Tokens within a piece

    def merge(self, data: bytes) -> list[int]:
        """The merges of one run of bytes: always the pair of lowest rank, the leftmost of equals."""
        n, rank = len(data), self.ranks.get
        if n == 1:
            return [self.ranks[data]]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each place
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop or not alive[j]:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := rank(data[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stay_apart(self, a: int, b: int) -> bool:
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) >= CACHE:
                self._apart.clear()
            known = self._apart[a, b] = self.merge(self.vocabulary[a] + self.vocabulary[b]) == [a, b]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stay_apart(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(self.decode(left[-i:]) + self.decode(right[:j]))
            left_holds = i == len(left) or self.stay_apart(left[-i - 1], window[0])
            right_holds = j == len(right) or self.stay_apart(window[-1], right[j])
            if left_holds and right_holds:
                return left[:-i] + window + right[j:]
            i, j = (i if left_holds else min(len(left), 2 * i)), (j if right_holds else min(len(right), 2 * j))

    def _reduce_piece(self, data: bytes) -> list[int]:
        if len(data) <= PIECE_LEAF:
            return self.merge(data)
        middle = len(data) // 2
        return self.join_tokens(self._reduce_piece(data[:middle]), self._reduce_piece(data[middle:]))

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is a token is that token, whatever its merges lead to."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._reduce_piece(data)

    # Pieces of a text

    def join_pieces(self, text: str, start: int, cut: int, stop: int, left: list[str], right: list[str]) -> list[str]:
        size = 32
        while True:
            low = max(start, cut - size)
            ends = [m.end() for m in self._safe.finditer(text, low, cut) if m.end() < cut]
            if ends or low == start:
                p = ends[-1] if ends else start
                break
            size *= 2
        size = 32
        while True:
            high = min(stop, cut + size)
            m = next((m for m in self._safe.finditer(text, cut, high) if m.end() < high), None)
            if m or high == stop:
                q = m.end() if m else stop
                break
            size *= 2
        i, at = len(left), cut
        while at > p:
            i -= 1
            at -= len(left[i])
        j, to = 0, cut
        while to < q:
            to += len(right[j])
            j += 1
        if at != p or to != q:  # a match that isn't as local as the pattern's others: the whole is split
            return self._split(text[start:stop])
        del left[i:]
        left += self._split(text[p:q])
        left += right[j:] if j else right
        return left

    def _reduce_text(self, text: str, start: int, stop: int) -> list[str]:
        if stop - start <= TEXT_LEAF:
            return self._split(text[start:stop])
        cut = (start + stop) // 2
        return self.join_pieces(text, start, cut, stop, self._reduce_text(text, start, cut), self._reduce_text(text, cut, stop))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        add, encoded = ids.extend, self._encoded
        for piece in self._reduce_text(text, 0, len(text)):
            add(encoded[piece])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of both halves, one after the other, up the tree."""
        if len(ids) <= IDS_LEAF:
            return b"".join(map(self.vocabulary.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_codecs: dict[tuple[str, str], TreeBpe] = {}


def codec(path: str, pattern: str) -> TreeBpe:
    """One for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = TreeBpe(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_documents(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """df(doc_id, text) -> (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", text_or_empty().alias("text")).transform(bounded_batches).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip_digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """df(doc_id, text) -> n_tokens and digests of the ids and of what they decode to; ids don't leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = codec(path, pattern), hashlib.sha256
        written = {i: str(i) for i in bpe.vocabulary}.__getitem__
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids))
                ids_sha.append(sha(",".join(map(written, ids)).encode()).hexdigest())
                text_sha.append(sha(bpe.decode(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select("doc_id", text_or_empty().alias("text")).transform(bounded_batches).mapInArrow(run, schema)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
