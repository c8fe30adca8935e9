"""Best-fit packing of token sequences by a configuration linear program.

The program has a variable for each configuration (a multiset of lengths that fits a sequence) and a
covering row for each length. Only the histogram of lengths, at most ``capacity`` rows, goes to the
driver; its size does not depend on the corpus. Pieces as long as a sequence are set apart. For the others multiplicative weights price
the lengths, and a knapsack dynamic program finds configurations of the largest price, one for each of the lengths that are
covered least. Prices over the largest configuration's price are a dual solution, which bounds every packing from below and
tells the gap. The fractional solution is rounded to whole sequences; what the rounding leaves is packed best-fit
decreasing, length class by length class. Plain best fit is only taken if it needs fewer sequences.

Pieces then get their places without meeting one another: a piece's rank among its length, from
counts per (length, bucket), falls into the run of one configuration, which tells sequence and offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, gathered, quoted, unused
from .token_counts import WordBpe, slices

#: Most rounds of pricing, configurations of a round, strength of an update, and the gap to the bound that is enough.
ROUNDS, BATCH, EPSILON, GAP = 400, 256, 0.5, 0.01
#: Share of its scarcest length's pieces that a configuration covers at a time, and a little more price for long pieces, as these are the hard ones.
STEP, LONGER = 0.1, 0.02
#: Rounds after which the gap is looked at.
LOOK = 20
#: Least fill of a rounded configuration whose pieces have run out, in shares of its whole fill, and shares of the fractional solution
#: that are rounded in turn: the rest of the pieces, which best fit places, is larger for each.
LEAST_FILL, SHARES = 0.999, (1.0, 0.9, 0.8, 0.7)
#: Rows of a length that are numbered in one bucket, about.
BUCKET_ROWS = 500
Configurations = list[tuple[dict[int, int], int]]


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest total price within each room up to ``capacity``, and the piece to take first there (0: leave a token empty).

    Pieces may be used any number of times; ``price[l]`` is 0 for unused lengths.
    """
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(price > 0)
    values = price[lengths]
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        best[room], n = best[room - 1], ends[room]
        if n:
            gain = values[:n] + best[room - lengths[:n]]
            k = n - 1 - int(gain[::-1].argmax())  # of equal gains the longest piece
            if gain[k] > best[room]:
                best[room], took[room] = gain[k], lengths[k]
    return best, took


def filled(took: np.ndarray, room: int, first: int) -> dict[int, int]:
    """The multiset of ``first`` and what the knapsack puts into the room left by it."""
    out = {first: 1}
    while room > 0:
        length = int(took[room])
        if length:
            out[length] = out.get(length, 0) + 1
        room -= length or 1
    return out


class Covering(NamedTuple):
    """A fractional solution: amounts by configuration, their sum, and the lower bound of every solution."""

    amounts: dict[tuple[tuple[int, int], ...], float]
    value: float
    bound: float


def pruned(amounts: dict[tuple[tuple[int, int], ...], float], need: np.ndarray) -> dict[tuple[tuple[int, int], ...], float]:
    """Amounts without what covers lengths more often than needed, least filled configurations first."""
    slack = -need.astype(float)
    for key, amount in amounts.items():
        for length, times in key:
            slack[length] += amount * times
    out = {}
    for key in sorted(amounts, key=lambda key: sum(length * times for length, times in key)):
        spare = min(amounts[key], max(0.0, min(slack[length] / times for length, times in key)))
        for length, times in key:
            slack[length] -= spare * times
        if amounts[key] > spare:
            out[key] = amounts[key] - spare
    return out


def cover(hist: np.ndarray, capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> Covering:
    """Fractional covering of all pieces by multiplicative weights.

    Weights fall exponentially with the share of a length that is covered. A round prices lengths by size and weight, solves
    the knapsack once, and takes for each of the least covered lengths the best configuration with it, unless it uses a
    length that this round has covered enough already. All amounts are scaled so that every length is covered, and pruned;
    the rounds end when their sum is within ``gap`` of the bound.
    """
    need = hist.astype(float)
    have = np.flatnonzero(hist)
    if not len(have):
        return Covering({}, 0.0, 0.0)
    done = np.zeros(capacity + 1)
    amounts: dict[tuple, float] = {}
    bound = float(need @ np.arange(capacity + 1)) / capacity
    found: dict[tuple, float] = {}
    for k in range(1, rounds + 1):
        price = np.zeros(capacity + 1)
        price[have] = have * (1 + LONGER * have / capacity) * np.exp(-EPSILON * (done[have] - done[have].min()))
        best, took = knapsack(price, capacity)
        bound = max(bound, float(need @ price) / best[capacity])
        before = done.copy()
        for length in have[np.argsort(done[have], kind="stable")][:BATCH].tolist():
            if done[length] > before[length]:
                continue
            chosen = filled(took, capacity - length, length)
            at, times = np.fromiter(chosen, np.int64), np.fromiter(chosen.values(), np.int64)
            if (done[at] - before[at]).max() >= 2 * STEP:
                continue
            step = STEP * float((need[at] / times).min())
            key = tuple(sorted(chosen.items(), reverse=True))
            amounts[key] = amounts.get(key, 0.0) + step
            done[at] += step * times / need[at]
        least = float(done[have].min())
        if least > 0 and (k % LOOK == 0 or k == rounds):
            found = pruned({key: v / least for key, v in amounts.items()}, need)
            if sum(found.values()) <= (1 + gap) * bound:
                break
    if not found:  # more lengths than the rounds reach: these alone, as often as they fit
        missed = {((length, capacity // length),): need[length] / (capacity // length) for length in have[done[have] == 0].tolist()}
        least = min(1.0, float(done[done > 0].min()))
        found = pruned({key: v / least for key, v in amounts.items()} | missed, need)
    return Covering(found, sum(found.values()), bound)


def rounded(amounts: dict[tuple[tuple[int, int], ...], float], hist: np.ndarray, share: float = 1.0) -> Configurations:
    """Whole numbers of sequences that use no piece twice.

    Running sums of the amounts are rounded down, so their total is kept whatever their sizes. A configuration goes on without
    lengths that have run out, as long as it is filled nearly as well.
    """
    left = hist.copy()
    out: Configurations = []
    running, taken = 0.0, 0
    for key in sorted(amounts, reverse=True):
        running += share * amounts[key]
        n = int(running + 1e-9) - taken
        taken += n
        chosen = dict(key)
        while n:
            chosen = {k: min(m, int(left[k])) for k, m in chosen.items() if left[k]}
            if sum(k * m for k, m in chosen.items()) < LEAST_FILL * sum(k * m for k, m in key):
                break
            take = min(n, min(int(left[k]) // m for k, m in chosen.items()))
            out.append((dict(chosen), take))
            for k, m in chosen.items():
                left[k] -= m * take
            n -= take
    return out


def best_fit(hist: np.ndarray, capacity: int, bins: Configurations) -> Configurations:
    """Add the pieces of ``hist`` to ``bins``, longest first, each class to the fullest bins it fits."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for chosen, n in bins:
        by_room.setdefault(capacity - sum(k * m for k, m in chosen.items()), []).append((chosen, n))
    for length in range(capacity, 0, -1):
        n = int(hist[length])
        for room in [r for r in sorted(by_room) if r >= length] if n else []:
            while n and by_room.get(room):
                chosen, count = by_room[room].pop()
                # Bins of one kind are filled alike, as far as the class goes.
                per = min(room // length, max(1, n // count))
                full = min(count, n // per)
                fuller = dict(chosen)
                fuller[length] = fuller.get(length, 0) + per
                by_room.setdefault(room - per * length, []).append((fuller, full))
                if count > full:
                    by_room[room].append((chosen, count - full))
                n -= per * full
        while n:
            per = min(capacity // length, n)
            full = n // per
            by_room.setdefault(capacity - per * length, []).append(({length: per}, full))
            n -= per * full
    return [x for group in by_room.values() for x in group if x[1]]


def configurations(hist: np.ndarray, capacity: int) -> Configurations:
    """Configurations with counts that hold exactly the pieces of ``hist`` (index: length).

    The program's solution is rounded for each of SHARES and completed; the fewest sequences win. Plain best fit is only taken if it needs fewer still.
    """
    rest = hist.copy()
    rest[capacity] = 0
    whole: Configurations = [({capacity: 1}, int(hist[capacity]))] if hist[capacity] else []
    amounts = cover(rest, capacity).amounts
    found = [packed(rest, capacity, rounded(amounts, rest, share)) for share in SHARES]
    return whole + min(*found, packed(rest, capacity, []), key=lambda c: sum(n for _, n in c))


def packed(hist: np.ndarray, capacity: int, chosen: Configurations) -> Configurations:
    """``chosen`` and what it leaves of ``hist``, by best fit."""
    left = hist.copy()
    for lengths, n in chosen:
        for k, m in lengths.items():
            left[k] -= m * n
    if (left < 0).any():
        raise AssertionError("a length was used more often than it is there")
    return best_fit(left, capacity, chosen)


def runs(chosen: Configurations) -> dict[str, np.ndarray]:
    """For each length and configuration a run of ranks: key (length, first rank), sequence base, pieces per sequence, offset."""
    first = {}
    rows = []
    base = 0
    for lengths, n in chosen:
        offset = 0
        for length in sorted(lengths, reverse=True):
            per = lengths[length]
            rank = first.get(length, 0)
            rows.append((length << 44 | rank, rank, base, per, offset))
            first[length] = rank + per * n
            offset += per * length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "rank", "base", "per", "offset"), table.T.copy(), strict=True))


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset (long): sequences of at most ``capacity``, filled from 0 without gaps.

    Every row is one piece; its length is 1 to ``capacity``. ``order`` numbers pieces of a length; rows that repeat it
    are told apart, as each row takes a place of its own. An empty table gives an empty result. Columns named sequence_id or offset are replaced.
    """
    scratch = Scratch(pieces.sparkSession, "pack")
    columns = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = scratch.save(pieces.select([quoted(c) for c in columns]), "pieces")
    size = F.col(quoted(length_col))
    counted = pieces.groupBy(size.alias("l")).count().limit(capacity + 1).collect()
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in counted:
        if length is None or not 1 <= length <= capacity:
            raise ValueError(f"a piece has length {length}; 1 to {capacity} fit")
        hist[length] = n
    table = runs(configurations(hist, capacity))
    bucket, nth, ranked_as, first_rank, key = unused(columns, "bucket", "nth", "rank", "first_rank", "key")
    # Buckets in proportion to the pieces of a length, so frequent lengths are split and rare ones are not.
    buckets = F.array(*[F.lit(int(-(-n // BUCKET_ROWS))) for n in hist])
    names = [quoted(c) for c in order]
    rows = pieces.withColumn(bucket, F.pmod(F.xxhash64(*names), buckets[size.cast("int")]).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(size.alias("length"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("length").alias(key), F.col("bucket").alias(nth), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first_rank))
    # A row for each bucket: their number is known.
    counts = scratch.save(counts.coalesce(max(2 * pieces.sparkSession.sparkContext.defaultParallelism, int(hist.sum()) // BUCKET_ROWS // 100_000)), "counts")
    within = Window.partitionBy(quoted(length_col), bucket).orderBy(*names)
    ranked = rows.withColumn(ranked_as, F.row_number().over(within).cast("long")).join(counts, (size == F.col(key)) & (F.col(bucket) == F.col(nth)))
    ranked = ranked.select(*[quoted(c) for c in columns], (F.col(first_rank) + F.col(ranked_as) - 1).alias(ranked_as))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(table["key"], length << 44 | rank, side="right") - 1
            nth = rank - table["rank"][at]
            sequence = table["base"][at] + nth // table["per"][at]
            offset = table["offset"][at] + nth % table["per"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


_LOADED: dict[str, WordBpe] = {}


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    A document is its ids without special tokens, then ``end_id``; a null or empty text is the end alone. Documents longer than
    ``capacity`` are cut into pieces of that length, of which the last may be shorter. Repeated rows give their pieces again, a
    null id stays null, other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = WordBpe(vocabulary)
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                at, piece, parts = [], [], []
                for i, ids in enumerate(_LOADED[vocabulary].encode(texts[lo:hi])):
                    ids += end
                    for k in range(0, len(ids), step):
                        at.append(lo + i)
                        piece.append(k // step)
                        parts.append(ids[k : k + step])
                n = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(n), pa.array(n.astype(np.int64) * capacity), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    names=[id_col, "piece", "start", "length", "ids"],
                )

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return gathered(docs.select(quoted(id_col), quoted(text_col))).mapInArrow(cut, schema)
