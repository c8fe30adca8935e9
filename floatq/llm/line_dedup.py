"""Deduplication of fuzzy lines by MinHash.

Lines (cut at \\n) become sets of character shingles; a line shorter than a shingle is one, so such lines are linked
if they are equal. Equal lines are one item, told by a 128-bit hash; MinHash samples of the others give the keys of
high-recall bands, candidates are verified by the exact Jaccard similarity of their shingle sets, and distributed
union-find joins the linked lines. Of each component one line stays: the first of the smallest document id. Lines of nothing
but white space part paragraphs: they are no items and always stay.

Recall: with 12 bands of 4 samples a pair of lines at similarity 0.8 shares no key with odds of
0.0018, at 0.85 of 1.4e-4, at 0.9 of 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .near_dedup import odd_sketches, shared, sketch_bound
from .shared import Scratch, gathered, pick, quoted, row_key, unused
from .similar import GROUP, NAME, BlockTest, band_keys, group_columns, link_components, lists, permutations, rows_of
from .token_counts import slices

BANDS, ROWS, SKETCH_BITS, SEED = 12, 4, 256, 7
THRESHOLD, SHINGLE = 80, 8
#: Rows of the matrix that a line's shingles are dealt to, and members per block of buckets that hubs don't settle.
LANES, BLOCK = 8, 1024
#: Shingles that are hashed at a time, and most line numbers that are broadcast to texts.
CHUNK, MAX_BROADCAST_LINES = 1 << 16, 2_000_000
#: Standard deviations of the samples that a link may lie below the threshold by its sketches: lost odds of 3e-5.
DEVIATIONS = 4
#: Characters of the texts that are handled at a time.
SLICE_CHARS = 500_000
#: Seeds of Spark's xxhash64 of a line, and of 1 and a line, so that both sides name a line alike.
SPARK_SEEDS = 42, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def line_names(lines: list[str]) -> np.ndarray:
    """What Spark's ``xxhash64(line)`` and ``xxhash64(1, line)`` give for the lines (n x 2)."""
    coded = [line.encode() for line in lines]
    halves = [np.fromiter((xxhash.xxh64_intdigest(c, seed) for c in coded), np.uint64, len(coded)) for seed in SPARK_SEEDS]
    return np.stack(halves, axis=1).view(np.int64)


def windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the character shingles of lines (each of SHINGLE characters at least), and where each line's begin.

    A polynomial over the characters, put together from those over 2, 4 and 8; its high bits are kept.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    two = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n, width, out = len(two), 1, None
    base = 0x9E3779B97F4A7C15
    at = 0  # characters that ``out`` covers
    while True:
        if SHINGLE & width:
            power = np.uint64(pow(base, width, 1 << 64))
            out = two if out is None else out[: len(two) - at] * power + two[at:][: len(out)]
            at += width
        if 2 * width > SHINGLE:
            break
        two = two[:-width] * np.uint64(pow(base, width, 1 << 64)) + two[width:]
        width *= 2
    begins = np.cumsum(size) - size
    inside = np.ones(n, bool)
    for i in range(1, SHINGLE):
        inside[begins + size - i] = False
    counts = size - SHINGLE + 1
    out = out[inside[: len(out)]] * np.uint64(0xD6E8FEB86659FD93)
    return ((out ^ (out >> np.uint64(29))) >> np.uint64(16)).astype(np.uint32), np.cumsum(counts) - counts


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd multipliers: each permutes the 32-bit integers."""
    return permutations(n, seed)[0][:, 0]


def line_minima(lines: list[str], odd: np.ndarray) -> np.ndarray:
    """MinHash samples (lines x samples), a stretch of about CHUNK shingles at a time.

    The shingles of a line are dealt to LANES rows of a matrix, whose minima are whole-array steps;
    only their result, a LANES-th of the length, is reduced line by line. A line's last shingle fills its gaps.
    """
    out = np.empty((len(lines), len(odd)), np.uint32)
    lo = 0
    while lo < len(lines):
        hi, total = lo, 0
        while hi < len(lines) and (hi == lo or total + len(lines[hi]) <= CHUNK):
            total += len(lines[hi])
            hi += 1
        x, begins = windows(lines[lo:hi])
        counts = np.diff(np.append(begins, len(x)))
        groups = -(-counts // LANES)
        starts = np.cumsum(groups) - groups
        line = np.repeat(np.arange(hi - lo), groups)
        place = np.arange(len(line)) - starts[line]
        steps = np.arange(LANES)[:, None] * groups[line][None, :] + place[None, :]
        block = x[np.minimum(steps, counts[line][None, :] - 1) + begins[line][None, :]]
        y, least = np.empty_like(block), np.empty(block.shape[1], np.uint32)
        for k, m in enumerate(odd):
            np.multiply(block, m, out=y)
            np.minimum.reduce(y, axis=0, out=least)
            out[lo:hi, k] = np.minimum.reduceat(least, starts)
        lo = hi
    return out


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc, pos, h1, h2, size, bands, sketch of every line that isn't blank.

    Within a batch only the first of equal lines has bands and sketch, and lines shorter than a shingle have none, as they are only linked with equal ones.
    """
    odd = multipliers(BANDS * ROWS, SEED)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in slices(texts, SLICE_CHARS):
                at, pos, place = [], [], []
                distinct: dict[str, int] = {}
                for i in range(lo, hi):
                    for p, line in enumerate((texts[i] or "").split("\n")):
                        if line and not line.isspace():
                            at.append(i)
                            pos.append(p)
                            place.append(distinct.setdefault(line, len(distinct)))
                if not place:
                    continue
                lines_ = list(distinct)
                size = np.fromiter(map(len, lines_), np.int64, len(lines_)) - SHINGLE + 1
                low = line_minima([x for x, n in zip(lines_, size, strict=True) if n > 0], odd)
                which = np.array(place)
                first = np.zeros(len(which), bool)
                first[np.unique(which, return_index=True)[1]] = True  # in the order of the distinct lines
                first &= size[which] > 0
                names = line_names(lines_)[which]
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(pos, pa.int32()),
                        pa.array(names[:, 0]),
                        pa.array(names[:, 1]),
                        pa.array(np.maximum(size, 1)[which].astype(np.int32)),
                        lists(band_keys(low, ROWS), first),
                        lists(odd_sketches(low, SKETCH_BITS), first),
                    ],
                    names=["row", "doc", "pos", *NAME, "size", "bands", "sketch"],
                )

    df = gathered(docs.select(row_key(id_col, text_col).alias("row"), F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text")))
    longs = T.ArrayType(T.LongType())
    fields = [df.schema["row"], df.schema["doc"], *(T.StructField(c, t) for c, t in (("pos", T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType()), ("size", T.IntegerType()), ("bands", longs), ("sketch", longs)))]
    return df.mapInArrow(sign, T.StructType(fields))


@dataclass(frozen=True)
class LineShingles:
    """Sets of character shingles, linked from ``threshold`` percent on.

    Eight characters of one byte each are a 64-bit integer, so the sets of such lines are sorted arrays; those of lines with
    other characters are made of strings. Both are exact.
    """

    threshold: int

    def of(self, text: str) -> tuple[np.ndarray | frozenset[str], str]:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.strings(text), text
        found = np.sort(np.ndarray((len(raw) - SHINGLE + 1,), "<u8", raw, strides=(1,)))
        return found[np.append(True, found[1:] != found[:-1])], text

    @staticmethod
    def strings(text: str) -> frozenset[str]:
        return frozenset(text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1))

    def linked(self, a: tuple, b: tuple) -> bool:
        (p, x), (q, y) = a, b
        if 100 * min(len(p), len(q)) < self.threshold * max(len(p), len(q)):
            return False
        if isinstance(p, np.ndarray) and isinstance(q, np.ndarray):
            same = shared(p, q)
        else:
            same = len(self.strings(x) & self.strings(y))
        return 100 * same >= self.threshold * (len(p) + len(q) - same)

    def length(self, a: tuple) -> int:
        return len(a[0])


def dropped_lines(docs: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, drop (sorted line numbers from 0) of rows that lose lines."""
    signed = scratch.save(line_rows(docs, id_col, text_col), "lines")
    items = signed.select(*NAME, "size", "bands", "sketch")

    def fetch(ids: DataFrame) -> DataFrame:
        text = F.col(quoted(text_col))
        lines = docs.select(F.explode(F.split(text, "\n")).alias("text")).select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
        return pick(lines, ids, NAME).select("id", "text").dropDuplicates(["id"])

    # Sizes count repeated shingles too, so they bound nothing; the exact sets decide.
    test = BlockTest(0.0, sketch_bound(threshold / 100, BANDS * ROWS, SKETCH_BITS, DEVIATIONS), SKETCH_BITS // 64, BLOCK)
    linked = link_components(items, fetch, LineShingles(threshold), scratch, test)
    tagged = pick(signed.select("row", "doc", "pos", *NAME), linked, NAME, "left").select("row", "doc", "pos", *group_columns())
    tagged = scratch.save(tagged, "tagged")
    many = scratch.save(tagged.groupBy(*GROUP).count().where("count > 1").select(*GROUP), "many")
    repeated = scratch.save(pick(tagged, many, GROUP), "repeated")
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "row", "pos")
    # Written first, so that a common line's rows can be split if they are shuffled.
    stays = scratch.save(repeated.groupBy(*GROUP).agg(F.min(place).alias("first")), "stays", rows_of(repeated))
    return pick(repeated, stays, GROUP).where(~F.col("first").eqNullSafe(place)).groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text without its repeated lines, and n_lines and n_dropped (long).

    Lines are linked if 100 * intersection >= ``threshold`` * union of their distinct character
    shingles. Of a component the line at the smallest id (null last), then earliest in the text, stays. Remaining
    lines are joined by \\n as they were. A null text stays null and has no lines; rows that repeat id and text are one
    document and keep the same lines. Columns of the names this adds are replaced, all others stay. An empty table gives an empty result.
    """
    if not 80 <= threshold <= 100:
        raise ValueError("the bands are made for a threshold of 80 to 100 percent")
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select([quoted(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    drop = scratch.save(dropped_lines(docs, scratch, threshold, id_col, text_col), "drop")
    row, lost, kept = unused(docs.columns, "row", "lost", "kept_lines")
    drop = drop.select(F.col("row").alias(row), F.col("drop").alias(lost))
    size = drop.agg(F.coalesce(F.sum(F.size(lost) + 4), F.lit(0))).first()[0]
    out = docs.withColumn(row, row_key(id_col, text_col)).join(F.broadcast(drop) if size <= MAX_BROADCAST_LINES else drop, row, "left")
    text = quoted(text_col)
    # Both steps hash or index, so a text of very many lines takes time in proportion.
    out = out.withColumn(kept, F.expr(f"CASE WHEN {lost} IS NOT NULL THEN array_except(sequence(0, size(split({text}, '\\n')) - 1), {lost}) END"))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(text), "\n"))).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long"))
    (cut,) = unused([*out.columns], "cut")
    out = out.withColumn(cut, F.expr(f"CASE WHEN {lost} IS NOT NULL THEN split({text}, '\\n') END"))
    # Named twice, so that the optimizer keeps the column instead of splitting the text for each line.
    rest = F.expr(f"CASE WHEN {cut} IS NOT NULL THEN array_join(transform({kept}, i -> get({cut}, i)), '\\n') END")
    columns = [F.when(F.col(lost).isNull(), F.col(text)).otherwise(rest).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns]
    return out.select(*columns, "n_lines", "n_dropped")
