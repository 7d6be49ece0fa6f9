"""Byte-level BPE encoding and decoding (operator 1), by monoid tree reduction.

A text is cut in halves down to leaves, and each leaf is encoded by itself. Neighbours join by encoding anew a
window around their boundary, which grows until the tokens outside it are proven to stay. There are two proofs.

Between pieces of the pattern:

* the pattern never looks back, and no piece of it goes on from a character that isn't white space to one that is;
  so a place between two such characters (a "seam") is a boundary of pieces in the text and in any part of it that
  holds both characters;
* pieces are encoded separately, so tokens left of a seam in the left element and right of a seam in the right one
  are those of the joined text.

Windows of 32, 64, 128, ... characters to each side are searched for the outermost seams.

Within a piece: a sequence of tokens is the encoding of its bytes if and only if every two neighbours in it are the encoding
of their own bytes. So a window of the last and the first few tokens of two elements is encoded anew, and doubled until its
first and last token get on with the tokens outside.

Stretches of over ``run_chars`` characters without a seam (scripts without spaces, or spaces only) would make windows of the first kind as
long. They are split into pieces by the pattern once, in linear time, and long pieces are encoded by the second kind of tree, so
windows are short, and no text is so long that it exhausts the library's stack.

The join of two elements is thus exactly the element of the joined text, whichever way the tree is cut: a
homomorphism. Decoding splits the ids in halves and concatenates bytes up the tree.

Defined results: null text encodes to no ids (as an empty text), and no ids or null ids decode to empty bytes.
Other columns, whatever their names, are not touched. Rows are independent, so ties, repeated rows and empty tables
need no rule. Texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gyrolens.llm.common import release

LEAF_CHARS = 1 << 14
LEAF_IDS = 1 << 14
FIRST_WINDOW = 32
#: Stretches without a seam that are longer are encoded piece by piece.
RUN_CHARS = 1 << 13
#: Bytes of a leaf within a piece: a multiple of the tokens of like bytes, which have powers of two of them.
LEAF_BYTES = 1 << 12
#: Before each match the text has a seam. Narrower than the pattern's white space on both sides, never wider.
SEAM = re.compile(r"(?<=\S)[ \t\n]")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class TreeBpe:
    """Encoder and decoder for one vocabulary and pattern. Elements of the monoid are arrays of ids, with their text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, first_window: int = FIRST_WINDOW, run_chars: int = RUN_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pattern = regex.compile(pattern)
        self.leaf_chars, self.first_window = max(1, leaf_chars), max(1, first_window)
        # A leaf that is one token would be taken whole, so leaves are longer than any token.
        self.run_chars, self.leaf_bytes = max(1, run_chars), max(leaf_bytes, 1 + max(map(len, ranks), default=0))
        self.by_id = {i: token for token, i in ranks.items()}

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), np.uint32)

    def _encode(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self.leaf_chars:
            return self._plain(text[start:end])
        mid = (start + end) // 2
        return self._join(text, self._encode(text, start, mid), start, mid, end, self._encode(text, mid, end))

    def _join(self, text: str, left: np.ndarray, start: int, mid: int, end: int, right: np.ndarray) -> np.ndarray:
        a, b = self._seam_before(text, start, mid), self._seam_after(text, mid, end)
        kept = len(left) - len(self._plain(text[a:mid])) if a > start else 0
        dropped = len(self._plain(text[mid:b])) if b < end else len(right)
        return np.concatenate([left[:kept], self._plain(text[a:b]), right[dropped:]])

    def _seam_before(self, text: str, start: int, mid: int) -> int:
        width = self.first_window
        while mid - width > start:
            if found := SEAM.search(text, mid - width, mid):  # the left element must hold the seam's second character
                if found.start() > start:
                    return found.start()
            width *= 2
        return start

    def _seam_after(self, text: str, mid: int, end: int) -> int:
        width = self.first_window
        while True:
            for found in SEAM.finditer(text, mid, min(end, mid + width)):
                if found.start() > mid:  # and the right one its first
                    return found.start()
            if mid + width >= end:
                return end
            width *= 2

    def encode(self, text: str | None) -> np.ndarray:
        if not text or len(text) <= min(self.leaf_chars, self.run_chars):
            return self._plain(text) if text else np.empty(0, np.uint32)
        parts, start = [], 0
        for a, b in self._runs(text):
            parts += [self._encode(text, start, a), self._encode_run(text[a:b])] if a > start else [self._encode_run(text[a:b])]
            start = b
        if start < len(text):
            parts.append(self._encode(text, start, len(text)))
        return np.concatenate(parts)

    def _runs(self, text: str) -> Iterator[tuple[int, int]]:
        """Long stretches from seam to seam."""
        start = 0
        for seam in SEAM.finditer(text):
            if seam.start() - start > self.run_chars:
                yield start, seam.start()
            start = seam.start()
        if len(text) - start > self.run_chars:
            yield start, len(text)

    def _encode_run(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for found in self.pattern.finditer(text):
            ids += self._piece(found[0].encode())
        return np.array(ids, np.uint32)

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of a piece: a tree over its bytes."""
        if len(piece) <= self.leaf_bytes:
            return self.core.encode_single_piece(piece)
        leaves = -(-len(piece) // self.leaf_bytes)
        mid = leaves // 2 * self.leaf_bytes
        return self._join_tokens(self._piece(piece[:mid]), self._piece(piece[mid:]))

    def _get_on(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        return self.core.encode_single_piece(self.by_id[a] + self.by_id[b]) == [a, b]

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        width = 0
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = left[a:] + right[:b]
            if window:
                window = self.core.encode_single_piece(b"".join(map(self.by_id.__getitem__, window)))
            edges = [*left[max(0, a - 1) : a], *window, *right[b : b + 1]]
            inner = [(edges[0], edges[1])] if a and len(edges) > 1 else []
            if b < len(right) and len(edges) > 1:
                inner.append((edges[-2], edges[-1]))
            if all(self._get_on(x, y) for x, y in inner):
                return left[:a] + window + right[b:]
            width = 2 * width or 1

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.core.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple[int, str], TreeBpe] = {}


def _codec(vocabulary: Broadcast, pattern: str) -> TreeBpe:
    """One codec for each vocabulary in a Python worker."""
    key = (hash(vocabulary.value), pattern)
    if key not in _CODECS:
        _CODECS[key] = TreeBpe(parse_ranks(vocabulary.value), pattern)
    return _CODECS[key]


class BpeCodec:
    """Encoder and decoder columns. The rank file (about a megabyte, whatever the data) is broadcast once."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        vocabulary = spark.sparkContext.broadcast(read_ranks(ranks_path))

        def as_lists(ids: list[np.ndarray]) -> pa.Array:
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            codec = _codec(vocabulary, pattern)
            return as_lists([codec.encode(t.as_py()) for t in texts])

        @F.arrow_udf("binary")
        def decode(ids: pa.Array) -> pa.Array:
            codec = _codec(vocabulary, pattern)
            offsets, flat = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)
            return pa.array([codec.decode(flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.binary())

        @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
        def round_trip(texts: pa.Array) -> pa.Array:
            codec = _codec(vocabulary, pattern)
            ids = [codec.encode(t.as_py()) for t in texts]
            decoded = pa.array([codec.decode(x.tolist()) for x in ids], pa.binary())
            release()
            return pa.StructArray.from_arrays([as_lists(ids), decoded], ["ids", "decoded"])

        self._encode, self._decode, self._round_trip = encode, decode, round_trip

    def encode(self, text: Column) -> Column:
        """Ids of a text, array<int>."""
        return self._encode(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids, binary."""
        return self._decode(F.coalesce(ids, F.array().cast("array<int>")))

    def round_trip(self, text: Column) -> Column:
        """Ids of a text and the bytes they decode to, struct<ids, decoded>: both in one Python worker of a task."""
        return self._round_trip(F.coalesce(text, F.lit("")))
