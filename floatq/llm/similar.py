"""Pairs of similar items from banded signatures, without listing the pairs of a group.

An item is (h1, h2 long: its 128-bit name, size int, bands array<long>, sketch array<long>); ``bands`` holds one key per band,
``sketch`` a parity bitmap of its samples. Items that share a key are candidates of one another. They get
a number of 64 bits, settled by writing it, so that what follows compares single longs and yet mixes no two items up.
The search goes in this order:

* Members: items of keys that two items share. The keys are counted with map-side combining; the few that hold many rows
  are passed map-side, so no key brings its rows to one task.
* Hubs: in each bucket the member with most shared keys. Hubs against
  their bucket is a number of pairs linear in the members; in a group of near copies the hub is
  mostly the original, so these pairs join the group.
* Rest: buckets that still hold several components, without their hub. Members outside the largest
  component meet all members in blocks of fixed size; a block compares its sketches as one array and
  only passes on pairs that may be links and are in different components.

Every pair of a bucket is thus decided: it was verified, or lies in one component, or was
dismissed by its sketches. A verified link is exact; what is lost is what the bands or
the sketches miss, for which the operators state the odds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, pick, pick_hot

#: Elements of sets that are kept while pairs are confirmed, as hubs come again.
KEPT_ELEMENTS = 400_000
#: Rows with texts or bands, or pairs to confirm, for which a task is worth its while.
WIDE_ROWS = 20_000
NAME, GROUP = ["h1", "h2"], ["linked", "ga", "gb"]


def group_columns() -> list[Column]:
    """The group of an item as three columns that are never null for a named item: its component ``g``, or itself without one."""
    linked = F.col("g").isNotNull()
    return [linked.alias("linked"), F.coalesce("g", "h1").alias("ga"), F.when(linked, F.lit(0)).otherwise(F.col("h2")).alias("gb")]


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n permutations of 32-bit integers, as columns."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 31, n, dtype=np.uint64) * 2 + 1
    return odd.astype(np.uint32)[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """Keys (n x bands, int64) of minima (n x bands * rows)."""
    n, bands = len(minima), minima.shape[1] // rows
    key = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    parts = minima.reshape(n, bands, rows).astype(np.uint64)
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def lists(rows: np.ndarray, there: np.ndarray | None = None) -> pa.ListArray:
    """The rows of a matrix of longs as lists; ``there`` (boolean, longer) tells which lists are not null."""
    there = np.ones(len(rows), bool) if there is None else there
    offsets = pa.array(np.append(0, np.cumsum(there * rows.shape[1])).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()), mask=pa.array(~there))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rows_of(written: DataFrame) -> int:
    """Rows of a written table, from its files' footers."""
    return written.select().count()


def numbered(items: DataFrame, scratch: Scratch) -> DataFrame:
    """Written rows (id, h1, h2, keys) of items that share a key with another item."""
    rows = items.where("bands IS NOT NULL").select(*NAME, F.explode("bands").alias("key"))
    # Two items of equal h1 that are alone in a bucket pass as one here: odds of 2**-64 for each such bucket.
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    shared = scratch.save(counted.where("lo < hi").select("key", "n"), "keys")
    joined = pick_hot(rows, shared, "key", scratch)
    # At most a key for each band, so the set is small.
    members = joined.groupBy(*NAME).agg(F.collect_set("key").alias("keys"))
    return scratch.save(members.select(F.monotonically_increasing_id().alias("id"), *NAME, "keys"), "ids")


def _popcounts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each row of x differs from each row of y (both n x words of 64 bits)."""
    out = np.zeros((len(x), len(y)), np.int32)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


class Shape(Protocol):
    """How texts become sets, and the link of two sets."""

    def of(self, text: str) -> Any: ...

    def linked(self, a: Any, b: Any) -> bool: ...

    def length(self, a: Any) -> int: ...


@dataclass(frozen=True)
class BlockTest:
    """Compares the members of a block outside the largest component (side 0) with all members (side 1).

    ``most_bits``: differing sketch bits of a possible link; ``words``: longs of a sketch; ``block``: members per block.
    """

    least_ratio: float
    most_bits: int
    words: int
    block: int

    def near(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places x, y in the block of pairs in different components that may be links, and their bits."""
        side, comp, size = (rows.column(c).to_numpy() for c in ("side", "comp", "size"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            return x[:0], y[:0], x[:0]
        p, q = size[x][:, None], size[y][None, :]
        near = (comp[x][:, None] != comp[y][None, :]) & (np.minimum(p, q) >= self.least_ratio * np.maximum(p, q))
        sketch = matrix(rows.column("sketch")).view(np.uint64)  # counts of signed numbers are of their absolute values
        bits = _popcounts(sketch[x], sketch[y])
        i, j = np.nonzero(near & (bits <= self.most_bits))
        return x[i], y[j], bits[i, j]

    def links(self, rows: pa.RecordBatch, shape: Shape) -> Iterator[tuple[int, int]]:
        """Confirmed links that join the block's components, looked for from the nearest pair on.

        A pair is looked at in the first bucket that it shares only, and not if links of this block already join it.
        """
        x, y, bits = self.near(rows)
        if not len(x):
            return
        bands, key = matrix(rows.column("bands")), rows.column("key")[0].as_py()
        keep = np.zeros(len(x), bool)
        for lo in range(0, len(x), 10_000):
            mine = bands[x[lo : lo + 10_000]]
            first = (mine == bands[y[lo : lo + 10_000]]).argmax(1)
            keep[lo : lo + 10_000] = mine[np.arange(len(mine)), first] == key
        order = np.flatnonzero(keep)[np.argsort(bits[keep], kind="stable")]
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while up.get(v, v) != v:
                up[v] = v = up.get(up[v], up[v])
            return v

        sets: dict[int, Any] = {}
        ids, comp, texts = rows.column("id").to_numpy(), rows.column("comp").to_numpy(), rows.column("text")
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            p, q = root(int(comp[i])), root(int(comp[j]))
            if p == q:
                continue
            a, b = int(ids[i]), int(ids[j])
            for at, name in ((i, a), (j, b)):
                if name not in sets:
                    sets[name] = shape.of(texts[at].as_py())
            if shape.linked(sets[a], sets[b]):
                up[p] = q
                yield min(a, b), max(a, b)


def hub_pairs(ids: DataFrame, scratch: Scratch, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (key, id), hubs (key, hub, n) of all buckets, and the pairs (a, b) of each member with the hubs of its buckets."""
    members = ids.select("id", F.explode("keys").alias("key"), F.size("keys").cast("long").alias("shared"))
    # Of equal shares the place in a shuffled order decides, the same in every bucket.
    score = F.shiftleft("shared", 40).bitwiseOR(F.shiftrightunsigned(F.xxhash64("id"), 24))
    hubs = scratch.save(members.groupBy("key").agg(F.max_by("id", score).alias("hub"), F.count(F.lit(1)).alias("n")), "hubs", most)
    members = members.select("key", "id")
    pairs = pick_hot(members, hubs, "key", scratch).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    return members, hubs, pairs


def open_buckets(members: DataFrame, hubs: DataFrame, comps: DataFrame, scratch: Scratch, most: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, id, comp) of buckets without their hub, and buckets that hold several components.

    An open bucket has its largest component (most), and how many members it has (n_all) and has outside
    that component (n_out).
    """
    left = pick_hot(members, hubs.where("n > 2"), "key", scratch).where("id <> hub").select("key", "id")
    left = pick(left, comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    left = scratch.save(left, "left", most)
    several = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = scratch.save(several.where("lo < hi").select("key", "n"), "several", most)
    left = pick_hot(left, several, "key", scratch).drop("n")
    parts = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_keys = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n_all"))
    return left, open_keys.select("key", F.col("top.comp").alias("most"), "n_all", (F.col("n_all") - F.col("top.n")).alias("n_out"))


def rest_links(left: DataFrame, open_keys: DataFrame, items: DataFrame, test: BlockTest, shape: Shape, texts: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """Links (a, b) between components of open buckets, confirmed by the ``texts`` (id, text) that members bring to their blocks."""
    blocks = lambda n: F.ceil(F.col(n) / test.block).cast("int")
    open_keys = open_keys.select("key", "most", blocks("n_all").alias("n_all"), blocks("n_out").alias("n_out"), F.col("n_all").alias("n"))
    sized = pick_hot(left, scratch.save(open_keys, "open-sizes", most), "key", scratch).drop("n")
    wanted = scratch.save(sized.select("id").distinct(), "open-ids", most)
    more = scratch.save(pick(items.select("id", "size", "sketch", "bands"), wanted, "id").join(texts, "id"), "open-items", most, WIDE_ROWS)
    sized = sized.join(more, "id")
    row = ["id", "comp", "size", "sketch", "bands", "text"]
    out = sized.where("comp <> most").select(
        "key", F.pmod(F.xxhash64("id"), "n_out").cast("int").alias("ob"), F.explode(F.expr("sequence(0, n_all - 1)")).alias("ab"), F.lit(0).alias("side"), *row
    )
    every = sized.select(
        "key", F.explode(F.expr("sequence(0, n_out - 1)")).alias("ob"), F.pmod(F.xxhash64("id"), "n_all").cast("int").alias("ab"), F.lit(1).alias("side"), *row
    )
    blocks = out.unionByName(every).repartition("key", "ob", "ab").sortWithinPartitions("key", "ob", "ab", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block may go on in the next batch; it is held until another begins."""
        held: list[pa.RecordBatch] = []
        block = None
        found: list[tuple[int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                found.clear()

        def close() -> None:
            if held:
                found.extend(test.links(held[0] if len(held) == 1 else pa.concat_batches(held), shape))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "ob", "ab")])
            starts = np.flatnonzero(np.append(True, (ids[:, 1:] != ids[:, :-1]).any(0))).tolist()
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                name = tuple(ids[:, lo].tolist())
                if name != block:
                    close()
                    block = name
                held.append(batch.slice(lo, hi - lo))
                if len(found) > 50_000:
                    yield from flush()
        close()
        yield from flush()

    return blocks.mapInArrow(search, "a long, b long").distinct()


def differing_bits(x: str, y: str, words: int) -> Column:
    """Bits in which two sketches differ."""
    return F.expr(" + ".join(f"bit_count({x}[{w}] ^ {y}[{w}])" for w in range(words)))


def near_pairs(pairs: DataFrame, items: DataFrame, test: BlockTest) -> DataFrame:
    """``pairs`` whose sizes and sketches allow a link."""
    side = lambda c: items.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("size_a", "size_b") >= test.least_ratio * F.greatest("size_a", "size_b"))
    return both.where(differing_bits("sketch_a", "sketch_b", test.words) <= test.most_bits).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, shape: Shape) -> DataFrame:
    """Pairs (a, b) that are links by their texts (id, text)."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, Any] = {}
        held = 0
        for batch in batches:
            linked = []
            texts = batch.column(2), batch.column(3)
            for at, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if held > KEPT_ELEMENTS:
                    sets.clear()
                    held = 0
                for i, column in zip(pair, texts, strict=True):
                    if i not in sets:
                        sets[i] = shape.of(column[at].as_py())
                        held += shape.length(sets[i])
                linked.append(shape.linked(sets[pair[0]], sets[pair[1]]))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def link_components(items: DataFrame, fetch: Callable[[DataFrame], DataFrame], shape: Shape, scratch: Scratch, test: BlockTest) -> DataFrame:
    """Written rows (h1, h2, g) of linked items; g numbers their component.

    Rows of one item in ``items`` are alike; some may lack bands and sketch. ``fetch`` returns (id, text) for a written table (id, h1, h2).
    """
    ids = numbered(items, scratch)
    scratch.release()
    names = ids.select("id", *NAME)
    # Bounds of the rows of what follows: the items, and their places in buckets.
    n = ids.count()
    most = ids.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    more = pick(items.where(F.col("sketch").isNotNull()), names, NAME).select("id", "size", "sketch", "bands")
    items = scratch.save(more.dropDuplicates(["id"]), "candidates", n, WIDE_ROWS)
    members, hubs, pairs = hub_pairs(ids, scratch, most)
    pairs = scratch.save(near_pairs(pairs, items, test), "hub-pairs", most)
    # Texts of items that no sketch lets near another one are not needed.
    texts = scratch.save(fetch(names), "texts", n, WIDE_ROWS)
    links = scratch.save(confirmed(pairs, texts, shape), "hub-links", most, WIDE_ROWS)
    comps = connected_components(links, scratch)
    left, open_keys = open_buckets(members, hubs, comps, scratch, most)
    open_keys = scratch.save(open_keys, "open", most)
    if not open_keys.isEmpty():
        found = scratch.save(rest_links(left, open_keys, items, test, shape, texts, scratch, most), "rest-links")
        if not found.isEmpty():
            # The components so far are edges too, fewer than the links they came from.
            comps = connected_components(comps.toDF("a", "b").unionByName(found), scratch)
    # A component's first item names it and has no row of its own.
    every = comps.select("id", F.col("component").alias("g")).unionByName(comps.select(F.col("component").alias("id"), F.col("component").alias("g")).distinct())
    return scratch.save(names.join(every, "id").select(*NAME, "g"), "named", n)
