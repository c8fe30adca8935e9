"""MinHash near-deduplication of documents with odd sketches.

Each document becomes the set of its distinct word shingles (as 64-bit hashes). MinHash samples give
the keys of the bands, and are folded into an odd sketch: each (sample number, minimum) flips one
bit of a bitmap, so the XOR of two bitmaps counts the samples in which two documents differ. Where
documents are similar this estimate is sharp, and it dismisses candidates before any text moves.
What it leaves is confirmed on the full sets. Documents of one set (by a 128-bit digest) are one item.

Recall: with 48 bands of 7 samples a pair at similarity 0.8 shares no key with odds of 1.3e-5, and
less above it; the sketch's bound lies six standard deviations below the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, gathered, pick, quoted, row_key
from .similar import GROUP, NAME, BlockTest, band_keys, group_columns, link_components, lists, mix, permutations
from .token_counts import slices

BANDS, ROWS, SKETCH_BITS, SEED = 48, 7, 1024, 20
#: Similarity of a link, in percent.
THRESHOLD = 80
#: Words whose hashes are kept, and shingles hashed at a time.
WORD_MEMO, CHUNK = 500_000, 1024
#: Members per block of buckets that hubs don't settle.
BLOCK = 256
#: Standard deviations of the samples that a link may lie below the threshold by its sketches.
DEVIATIONS = 6


def sketch_bits(similarity: float, samples: int, bits: int) -> int:
    """Differing bits that are expected of two odd sketches."""
    return round(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity))))


def sketch_bound(threshold: float, samples: int, bits: int, deviations: float) -> int:
    """Most differing bits of a possible link, so many standard deviations of the samples below the threshold."""
    return sketch_bits(threshold - deviations * math.sqrt(threshold * (1 - threshold) / samples), samples, bits)


def odd_sketches(minima: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of minima (n x samples), as longs (n x bits / 64)."""
    n, samples = minima.shape
    at = mix(minima.astype(np.uint64) << np.uint64(16) | np.arange(samples, dtype=np.uint64)[None, :]) % np.uint64(bits)
    word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
    out, row = np.zeros((n, bits // 64), np.uint64), np.arange(n)
    for k in range(samples):
        out[row, word[:, k]] ^= bit[:, k]
    return out.view(np.int64)


class Shingler:
    """Distinct word shingles of texts as sorted 64-bit hashes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.memo: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        # bytes.lower() changes A-Z only, and bytes.split() parts at 0x20 and 0x09-0x0D only.
        words = text.encode().lower().split() if text else []
        memo = self.memo
        if len(memo) > WORD_MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ h[i : i + n])
        return np.unique(out)


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of 32-bit integers; an empty set has the largest integer."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), CHUNK):
        h = x[None, i : i + CHUNK] * a
        h += b
        np.minimum(out, h.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """row, doc, n_shingles, h1 and h2 (digest of the set; null if empty), bands, sketch."""
    a, b = permutations(BANDS * ROWS, SEED)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in slices(texts):
                sets = [shingler.shingles(t) for t in texts[lo:hi]]
                low = np.stack([minima((s >> np.uint64(32)).astype(np.uint32), a, b) for s in sets])
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                full = np.array([len(s) > 0 for s in sets])
                names = [pa.array(digests[:, k], mask=~full) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(map(len, sets), pa.int64()),
                        *names,
                        lists(band_keys(low, ROWS)[full], full),
                        lists(odd_sketches(low, SKETCH_BITS)[full], full),
                    ],
                    names=["row", "doc", "n_shingles", "h1", "h2", "bands", "sketch"],
                )

    key = row_key(id_col, text_col)
    df = gathered(docs.select(key.alias("row"), F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text")))
    fields = [df.schema["row"], df.schema["doc"], *(T.StructField(c, T.LongType()) for c in ("n_shingles", "h1", "h2")), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("bands", "sketch"))]
    return df.mapInArrow(sign, T.StructType(fields))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements of two sorted sets that are in both."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges two sorted runs
    return int(np.count_nonzero(both[1:] == both[:-1]))


@dataclass(frozen=True)
class WordShingles:
    """Sets of word shingles, linked from ``threshold`` percent on."""

    width: int
    threshold: int

    def of(self, text: str) -> np.ndarray:
        return _shingler(self.width).shingles(text)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        same = shared(a, b)
        return 100 * same >= self.threshold * (len(a) + len(b) - same)

    def length(self, a: np.ndarray) -> int:
        return len(a)


@cache
def _shingler(width: int) -> Shingler:
    return Shingler(width)


def near_dedup(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, id, n_shingles, component_id, kept.

    Texts are lower-cased in A-Z and cut at ASCII white space. A text with fewer than ``width`` words
    is one shingle; a null or empty one has no shingles, is linked with nothing and stays.
    Documents are linked if 100 * intersection >= ``threshold`` * union of their sets. component_id is
    the smallest id reachable, and the document with this id stays (ties: rows that repeat an id are one
    document). A null id is never a component's name: it stays only where all ids of its component are null.
    ``row`` is ``row_key`` of the input row, to join the verdict with other columns. An empty table gives an empty result.
    """
    if not 80 <= threshold <= 100:
        raise ValueError("the bands are made for a threshold of 80 to 100 percent")
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.save(signatures(docs, id_col, text_col, width), "signed")
    # The values of one set are equal, so any of its rows can stand for it.
    items = signed.where(F.col("h1").isNotNull()).dropDuplicates(NAME)
    items = scratch.save(items.select(*NAME, "row", F.col("n_shingles").alias("size"), "bands", "sketch"), "items")
    docs = docs.select(row_key(id_col, text_col).alias("row"), F.col(quoted(text_col)).alias("text"))

    def fetch(names: DataFrame) -> DataFrame:
        wanted = scratch.save(items.select(*NAME, "row").join(names, NAME).select("id", "row"), "rows")
        # A row may be there more than once.
        return pick(docs, wanted, "row").select("id", "text").dropDuplicates(["id"])

    test = BlockTest(threshold / 100, sketch_bound(threshold / 100, BANDS * ROWS, SKETCH_BITS, DEVIATIONS), SKETCH_BITS // 64, BLOCK)
    linked = link_components(items, fetch, WordShingles(width, threshold), scratch, test)
    tagged = pick(signed.select("row", "doc", "n_shingles", *NAME), linked, NAME, "left")
    # Documents of one set that is linked with no other one are a group too.
    tagged = scratch.save(tagged.select("row", "doc", "n_shingles", *group_columns()), "tagged")
    # A document alone in its group names itself, so only groups of several need a row.
    names = tagged.where(F.col("ga").isNotNull()).groupBy(*GROUP).agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc"))
    names = scratch.save(names.withColumn("named", F.lit(True)), "names")
    return pick(tagged, names, GROUP, "left").select(
        "row", F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept")
    )
