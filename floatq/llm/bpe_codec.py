"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The model is written field by field as a protocol buffer: one piece per rank, spelt with the
printable characters that stand for bytes, scored by its negative rank, under the identity
normalisation. Its merges then follow the ranks, and decoding is the inverse mapping of the pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .token_counts import MEMO, WHITE, byte_symbols, slices

#: A space before white space: only there can a match begin before a space and go past it.
_SPACE_RUN = re.compile(f" [{WHITE}]")


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in the order of their ranks, from lines of base64 and rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def serialize_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece comes after them."""
    symbols = byte_symbols()
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))
    pieces = b"".join(piece("".join(map(symbols.__getitem__, t)), -float(rank), 1) for rank, t in enumerate(tokens))
    bpe, unk, bos, eos, pad = 3, 40, 41, 42, 43
    trainer = _number(bpe, 2) + _number(unk, len(tokens)) + _number(bos, -1) + _number(eos, -1) + _number(pad, -1)
    no_prefix, keep_spaces, plain_spaces = _number(3, 0), _number(4, 0), _number(5, 0)
    return pieces + piece("<unk>", 0.0, 2) + _block(2, trainer) + _block(3, _block(1, b"identity") + no_prefix + keep_spaces + plain_spaces)


class ByteBpe:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(tokens))
        to_byte = {ord(c): b for b, c in enumerate(byte_symbols())}
        self.bytes_of = [bytes(map(to_byte.__getitem__, map(ord, self.model.id_to_piece(i)))) for i in range(len(tokens))]
        self.symbols = byte_symbols()
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.segments: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, segments: set[str]) -> None:
        cut = {s: self.pattern.findall(s) for s in segments}
        unknown = list({w for words in cut.values() for w in words if w not in self.words})
        if unknown:
            table = self.symbols
            spelt = ["".join(map(table.__getitem__, w.encode())) for w in unknown]
            for w, ids in zip(unknown, self.model.encode(spelt, out_type=int, num_threads=1), strict=True):
                self.words[w] = struct.pack(f"<{len(ids)}I", *ids)
        self.segments.update({s: b"".join(map(self.words.__getitem__, words)) for s, words in cut.items()})

    def _cut(self, text: str) -> list[str]:
        """Segments that are matched on their own: each begins with its space."""
        if " " not in text or text[-1] == " " or _SPACE_RUN.search(text):
            return [text]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + s for s in rest]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for lo, hi in slices(texts):
            if len(self.segments) > MEMO or len(self.words) > MEMO:
                self.segments.clear()
                self.words.clear()
            cut = [self._cut(t) if t else [] for t in texts[lo:hi]]
            self._learn({s for segments in cut for s in segments if s not in self.segments})
            for segments in cut:
                yield b"".join(map(self.segments.__getitem__, segments))
            for segments in cut:  # whole texts are not worth keeping
                if len(segments) == 1:
                    self.segments.pop(segments[0], None)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (binary, little-endian unsigned 32-bit), decoded (binary).

    ``ranks`` is the path, on every executor, of a rank file; each match of ``pattern`` is encoded
    separately, without special tokens. A null or empty text has no ids. Rows are encoded one by one:
    repeated rows repeat, a null id stays null, and other columns are ignored.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (ranks, pattern) not in _LOADED:
            _LOADED[ranks, pattern] = ByteBpe(ranks, pattern)
        codec = _LOADED[ranks, pattern]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = codec.encode(texts)
            for lo, hi in slices(texts):
                ids = [next(done) for _ in range(lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], names=[id_col, "ids", "decoded"]
                )

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(code, schema)
