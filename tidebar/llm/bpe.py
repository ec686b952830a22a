"""Byte-level byte-pair encoding and decoding with the vocabulary of a public tokenizer."""

from __future__ import annotations

import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebar.llm.common import col, small

# The pattern that cuts a text into pieces, and its form for texts of ASCII and Latin letters only.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+", re.ASCII)
BEYOND_LATIN = re.compile(rf"[^\x00-\x7f{LATIN}]")


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """Packed ids of the pieces seen lately: two generations, the older one dropped when the newer is full."""

    def __init__(self, encode, limit: int = 120_000):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder of one vocabulary file (JSON with ``model.vocab``, ``model.merges``, ``added_tokens``)."""

    def __init__(self, file: str):
        spec = json.loads(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.first = [vocab[c] for c in letters]
        self.merges = {}  # by left << 32 | right
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = rank, vocab[a + b]
        self.strings = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.strings |= {i: content.encode() for content, i in self.special.items()}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = Pieces(self.encode_piece)

    def encode_piece(self, piece: str) -> bytes:
        """Merge the pair of lowest rank, leftmost first, until none is left.

        The symbols form a doubly linked list; the queue holds rank << 32 | place,
        and an entry is skipped when the pair at its place no longer has its rank.
        """
        symbol = [self.first[b] for b in piece.encode("utf-8", "replace")]
        n, merges = len(symbol), self.merges.get
        if n == 1:
            return symbol[0].to_bytes(4, "little")
        queue = [m[0] << 32 | i for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (m := merges(a << 32 | b))]
        if queue:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            symbol.append(-1)
            heapq.heapify(queue)
            pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            left, right = symbol[i], symbol[j]
            if left < 0 or right < 0 or not (m := merges(left << 32 | right)) or m[0] != entry >> 32:
                continue
            symbol[i], symbol[j] = merged, _ = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges(merged << 32 | symbol[k]):
                    push(queue, m[0] << 32 | i)
            h = before[i]
            if h >= 0 and (m := merges(symbol[h] << 32 | merged)):
                push(queue, m[0] << 32 | h)
        return pack([s for s in symbol if s >= 0])

    def _plain(self, text: str) -> bytes:
        found = PIECES.findall(text) if BEYOND_LATIN.search(text) else LATIN_PIECES.findall(text)
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, special ones included, concatenated; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[int, Bpe] = {}


def _bpe(file) -> Bpe:
    """One per Python worker."""
    if file.id not in _loaded:
        _loaded.clear()
        _loaded[file.id] = Bpe(file.value)
    return _loaded[file.id]


class _File:
    """A vocabulary file sent to the executors once: its size is that of the vocabulary, whatever the input."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.id, self._broadcast = hash(text), spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self._broadcast.value


def _mapped(df: DataFrame, column: str, tokenizer: str, outs: dict[str, T.DataType], step, keep: bool) -> DataFrame:
    """``df`` with the columns ``outs`` = step(bpe, value) for each value of ``column``; the column itself only with ``keep``."""
    file = _File(df.sparkSession, tokenizer)
    names = [c for c in df.columns if c not in outs and (keep or c != column)]
    # names by place, as those of the caller may hold dots
    given = df.select(*(col(c).alias(f"c{i}") for i, c in enumerate(names)), col(column).alias("read"))
    fields = [T.StructField(c, df.schema[c].dataType) for c in names]
    schema = T.StructType([*fields, *(T.StructField(out, kind) for out, kind in outs.items())])
    kinds = [pa.binary() if kind == T.BinaryType() else pa.string() for kind in outs.values()]

    def run(batches):
        bpe = _bpe(file)
        for batch in small(batches):
            made = zip(*(step(bpe, v) for v in batch.column("read").to_pylist()))
            arrays = [pa.array(values, kind) for values, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *arrays], names=schema.names)

    return given.mapInArrow(run, schema)


def encode(df: DataFrame, text: str, tokenizer: str, out: str = "ids", keep: bool = True) -> DataFrame:
    """Adds ``out``: the ids of the whole text as packed little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a vocabulary file on the driver. Null and empty
    texts have no ids. Strings of special tokens in a text become their ids.
    Pieces have no maximum length: a piece of n bytes takes O(n log n).
    A column named ``out`` is replaced; the text column goes unless ``keep``.
    """
    return _mapped(df, text, tokenizer, {out: T.BinaryType()}, lambda bpe, t: (bpe.encode(t or ""),), keep)


def decode(df: DataFrame, ids: str, tokenizer: str, out: str = "decoded", keep: bool = True) -> DataFrame:
    """Adds ``out``: the text of packed ids. Null ids give an empty text; an id outside the vocabulary is an error."""
    return _mapped(df, ids, tokenizer, {out: T.StringType()}, lambda bpe, i: (bpe.decode(i or b""),), keep)


def codec(df: DataFrame, text: str, tokenizer: str, ids: str = "ids", decoded: str = "decoded", keep: bool = True) -> DataFrame:
    """:func:`encode`, then :func:`decode` of its ids, in one pass: one Python worker and one vocabulary per task."""

    def step(bpe, t):
        packed = bpe.encode(t or "")
        return packed, bpe.decode(packed)

    return _mapped(df, text, tokenizer, {ids: T.BinaryType(), decoded: T.StringType()}, step, keep)
