"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut at white space, which no token of a word-end BPE crosses, and each distinct piece is
counted once while it stays in a bounded memo. The pre-tokens of unknown pieces lie one after
another in one array of symbol ids. A round looks up the rank of every adjacent pair, takes the
lowest rank of each sequence and merges all its occurrences, in all sequences at once; sequences
without a mergeable pair leave the array, and their surviving symbols are their count. A pre-token of thousands of bytes
without a break would take a round for each pair; such ones get the same symbols from a heap.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts are handled in slices of about this many characters; memos are emptied beyond this many pieces.
SLICE_CHARS, MEMO = 2_000_000, 400_000
#: Bytes of a pre-token from which it is merged by a heap.
LONG_BYTES = 4096
# The Unicode White_Space characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Characters at which str.split() parts text though they are not White_Space.
_SPLIT_ONLY = regex.compile("[\x1c-\x1f]")
_WHITE_RUN = regex.compile(f"[{WHITE}]+")
_MARKS = frozenset(".,;:!?")
_NO_RANK = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairTable:
    """Rank and merged id of symbol pairs: multiplicative hashing, colliding keys go one level down."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        self.levels = []
        bits, factor = 20, 0x9E3779B97F4A7C15
        while len(keys):
            mult = np.uint64(factor)
            slot = ((keys.astype(np.uint64) * mult) >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, -1, np.int32)
            table[slot[first]] = np.arange(len(first))
            self.levels.append((bits, mult, table, np.append(keys[first], -1), np.append(ranks[first], _NO_RANK), np.append(merged[first], -1)))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, ranks, merged = keys[rest], ranks[rest], merged[rest]
            factor = (factor * 0xBF58476D1CE4E5B9 | 1) & (1 << 64) - 1

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(keys), _NO_RANK), np.full(len(keys), -1, np.int64)
        for bits, mult, table, own, ranks, ids in self.levels:
            at = table[((keys.astype(np.uint64) * mult) >> np.uint64(64 - bits)).astype(np.int64)]
            hit = (own[at] == keys) & (at >= 0)
            rank[hit], merged[hit] = ranks[at[hit]], ids[at[hit]]
        return rank, merged


class Numbered(dict):
    """Numbers keys as they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Ragged:
    """Growing rows of ids: row i is ids[start[i] : start[i] + size[i]]."""

    def __init__(self) -> None:
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.start = self.size

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.start = np.cumsum(self.size) - self.size

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows, one row after another, and the rows' sizes."""
        size = self.size[rows]
        jump = self.start[rows] - (np.cumsum(size) - size)
        return self.ids[np.repeat(jump, size) + np.arange(size.sum())], size


def sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given sizes."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


class WordBpe:
    """Ids and counts of a byte-level BPE with a word-end suffix, read from a tokenizer.json file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + end] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, both = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.merges = left << 17 | right, np.arange(len(left)), both
        self.pairs, self.ranked = PairTable(*self.merges), None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.forget()

    def forget(self) -> None:
        self.pieces, self.words = Numbered(), Numbered()
        self.piece_ids, self.word_ids = Ragged(), Ragged()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of non-empty pre-tokens, one pre-token after another, and their numbers.

        A round merges one pair of each pre-token, so very long ones, which would take very many rounds, are merged one by one.
        """
        alone = {i: self.merge_long(w) for i, w in enumerate(words) if len(w) > LONG_BYTES}
        if not alone:
            return self.merge_rounds(words)
        ids, size = self.merge_rounds([w for i, w in enumerate(words) if i not in alone])
        rest = iter(np.split(ids, np.cumsum(size)[:-1]) if len(size) else [])
        rows = [alone[i] if i in alone else next(rest) for i in range(len(words))]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Surviving symbols of one pre-token, by a heap of its pairs: of the lowest rank the leftmost first."""
        if self.ranked is None:
            self.ranked = {int(k): (int(r), int(i)) for k, r, i in zip(*self.merges, strict=True)}
        ranked = self.ranked
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranked[k][0], i, k) for i in range(n - 1) if (k := ids[i] << 17 | ids[i + 1]) in ranked]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or ids[i] << 17 | ids[j] != k:  # one of the two has been merged since
                continue
            ids[i], ids[j] = ranked[k][1], -1
            right[i] = after = right[j]
            if after < n:
                left[after] = i
            for a, b in ((left[i], i), (i, after)):
                if a >= 0 and b < n and (k := ids[a] << 17 | ids[b]) in ranked:
                    heapq.heappush(heap, (ranked[k][0], a, k))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same by rounds, in which each sequence's pairs of lowest rank are merged at once."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, seq = self.inner[raw], np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size) - 1
        ids[ends] = self.last[raw[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank, merged = self.pairs.find(ids[:-1] << 17 | ids[1:])
            rank[seq[:-1] != seq[1:]] = _NO_RANK
            rank, merged = np.append(rank, _NO_RANK), np.append(merged, -1)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(seq)))
            going = np.repeat(best < _NO_RANK, length)
            done.append((seq[~going], ids[~going]))
            at = np.flatnonzero(going & (rank == np.repeat(best, length)))
            if len(at):
                # In a run of overlapping occurrences (aaa) every other one merges, from the left.
                fresh = np.append(True, np.diff(at) > 1)
                at = at[(at - at[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
                ids[at] = merged[at]
                going[at + 1] = False
            ids, seq = ids[going], seq[going]
        seq, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(seq, kind="stable")].astype(np.uint32), np.bincount(seq, minlength=len(words))

    def split(self, text: str) -> list[str]:
        return [p for p in _WHITE_RUN.split(text) if p] if _SPLIT_ONLY.search(text) else text.split()

    def pre_tokens(self, pieces: list[str]) -> list[list[str]]:
        """Pre-tokens of each piece; special strings are pre-tokens that keep their case."""
        # Rust lower-cases character by character, Python's capital sigma looks around itself.
        joined = unicodedata.normalize("NFC", "\n".join(pieces)).replace("Σ", "σ").lower()
        find = self.pattern.findall
        # Letters alone, or before one mark, need no pattern: isalpha() is \p{L} of all characters.
        out = [[p] if p.isalpha() else [p[:-1], p[-1]] if p[-1:] in _MARKS and p[:-1].isalpha() else find(p) for p in joined.split("\n")]
        if "<|" in joined:
            for i, p in enumerate(pieces):
                parts = self.special_pattern.split(p)
                if len(parts) > 1:
                    out[i] = [w for k, part in enumerate(parts) if part for w in ([part] if k % 2 else self.pre_tokens([part])[0])]
        return out

    def learn(self) -> None:
        """Get the ids of pieces that were numbered since the last call."""
        fresh = list(islice(reversed(self.pieces), len(self.pieces) - len(self.piece_ids.size)))[::-1]
        if not fresh:
            return
        cut = self.pre_tokens(fresh)
        number = self.words.__getitem__
        words = np.fromiter((number(w) for ws in cut for w in ws), np.int64)
        new = list(islice(reversed(self.words), len(self.words) - len(self.word_ids.size)))[::-1]
        if new:
            ids, size = self.merge([w.encode() for w in new])
            if any(w in self.special for w in new):
                rows = np.split(ids, np.cumsum(size)[:-1])
                rows = [np.array([self.special[w]], np.uint32) if w in self.special else r for w, r in zip(new, rows, strict=True)]
                ids, size = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
            self.word_ids.add(ids, size)
        ids, size = self.word_ids.take(words)
        self.piece_ids.add(ids, sums(size, np.fromiter(map(len, cut), np.int64, len(cut))))

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of the texts, one text after another, and how many each text has."""
        if len(self.pieces) > MEMO or len(self.words) > MEMO:
            self.forget()
        number = self.pieces.__getitem__
        size = np.zeros(len(texts), np.int64)
        rows = []
        for i, t in enumerate(texts):
            if t:
                rows.append(np.fromiter(map(number, self.split(t)), np.int64))
                size[i] = len(rows[-1])
        self.learn()
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), size

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for lo, hi in slices(texts):
            rows, size = self.numbered(texts[lo:hi])
            out.append(sums(self.piece_ids.size[rows], size))
        return np.concatenate(out)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for lo, hi in slices(texts):
            rows, size = self.numbered(texts[lo:hi])
            ids, per = self.piece_ids.take(rows)
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = 4 * np.cumsum(sums(per, size))
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                yield bytes(raw[a:b])


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``chars`` characters, of one text at least."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > chars:
            yield lo, i
            lo, total = i, 0
        total += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


_LOADED: dict[str, WordBpe] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary`` is the path, on every executor, of a tokenizer.json with a word-end BPE. A null or
    empty text has no bytes and no tokens. Special strings inside a text count as one token each. Rows are counted one by one:
    repeated rows repeat, a null id stays null, and other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = WordBpe(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = _LOADED[vocabulary].counts(texts)
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(count, schema)
