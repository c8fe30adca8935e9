"""Distances, nearest neighbours, classification and batched matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of one side that a task holds, rows of a tile whose least distance is noted, and queries compared at a time.
BLOCK, TILE, WIDE = 32_768, 128, 2_048


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def distance_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot_product(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def knn1(vectors: DataFrame, target: list[float] | Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The nearest vector (index, distance) by squared distance; of equally near ones the last."""
    t = target if isinstance(target, Column) else F.array(*[F.lit(float(x)) for x in target])
    near = F.max(F.struct((-distance_squared(doubles(F.col(vec_col)), t)).alias("d"), F.col(id_col).alias("i")))
    return vectors.agg(near.alias("m")).select(F.col("m.i").alias("index"), (-F.col("m.d")).alias("distance"))


def _matrices(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column by length: (their places, matrix). Vectors that are null or not finite are left out."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # an empty column
        return []
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    flat = lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    begins = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = []
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        rows = flat[begins[at][:, None] + np.arange(n)]
        fine = np.isfinite(rows).all(1)
        out.append((at[fine], rows[fine]))
    return out


def _distinct(rows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of distinct rows, of equal ones that of the largest rank."""
    order = np.argsort(-rank, kind="stable")
    if not rows.shape[1]:
        return order[:1]
    whole = np.ascontiguousarray(rows + 0.0).view(np.dtype((np.void, rows.shape[1] * 8))).ravel()  # -0.0 is 0.0
    return order[np.unique(whole[order], return_index=True)[1]]


def nearest(train: np.ndarray, rank: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the row of ``train`` nearest to each query (of equally near ones the largest rank), and its squared distance.

    Products of matrices in single precision tell which tiles of rows can hold the nearest one, within the bound of their
    rounding; distances in these tiles are then summed exactly as written, in double precision and the order of the elements.
    """
    keep = _distinct(train, rank)
    x, dims = train[keep], train.shape[1]
    middle = x.mean(0) if len(x) else 0.0
    reach = max(1e-300, float(np.abs(x - middle).max(initial=0)), float(np.abs(queries - middle).max(initial=0)))
    xs, qs = ((v - middle) / reach for v in (x, queries))
    squares = (xs * xs).sum(1)
    left = np.ascontiguousarray(np.hstack([-2 * xs, squares[:, None]]).astype(np.float32))
    right = np.ascontiguousarray(np.hstack([qs, np.ones((len(qs), 1))]).astype(np.float32))
    slack = 8 * (dims + 4) * 2.0**-24 * (np.sqrt(squares.max(initial=0)) + np.sqrt((qs * qs).sum(1)) + 1e-30) ** 2
    tiles = range(0, len(x), TILE)
    least = np.empty((len(tiles), len(queries)), np.float32)
    for lo in range(0, len(queries), WIDE):
        for k, at in enumerate(tiles):
            np.min(left[at : at + TILE] @ right[lo : lo + WIDE].T, axis=0, out=least[k, lo : lo + WIDE])
    close = least <= least.min(0) + slack
    best, place = np.full(len(queries), np.inf), np.full(len(queries), -1)
    held = rank[keep]
    for k, at in enumerate(tiles):
        rows, ranks = x[at : at + TILE], held[at : at + TILE]
        order = np.argsort(-ranks, kind="stable")
        rows, ranks = rows[order], ranks[order]
        wanted = np.flatnonzero(close[k])
        for lo in range(0, len(wanted), WIDE):
            some = wanted[lo : lo + WIDE]
            total = np.zeros((len(some), len(rows)))
            for j in range(dims):
                step = queries[some, j][:, None] - rows[:, j][None, :]
                total += step * step
            first = total.argmin(1)
            d, r = total[np.arange(len(some)), first], ranks[first]
            better = (d < best[some]) | ((d == best[some]) & ((place[some] < 0) | (r > rank[place[some]])))
            best[some[better]] = d[better]
            place[some[better]] = keep[at : at + TILE][order][first[better]]
    return place, best


def classify(train: DataFrame, test: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """1-NN label of each test vector: (id, label, predicted).

    Both sides are dealt into blocks of about BLOCK vectors; each pair of blocks meets in one task, which returns a row
    for each of its test vectors. So a task's memory is bounded whatever the tables' sizes, nothing is broadcast, and neither side has a limit.
    Distances go over the shorter length; of equally near vectors the last id counts. A vector that is null or has elements
    that are null or no finite numbers is near to nothing; a test vector without a neighbour gets a null label.
    """
    shape = [F.col(id_col).cast("long").alias("i"), doubles(F.col(vec_col)).alias("v"), F.col(label_col).alias("l")]
    train, test = train.select(*shape), test.select(*shape).withColumn("h", F.xxhash64("v"))
    # Counted in one pass each; the numbers of blocks follow the tables.
    parts = [max(1, -(-df.count() // BLOCK)) for df in (train, test)]
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("i", "v"), F.lit(n)).cast("int")
    rows = train.withColumns({"tb": deal(parts[0]), "qb": number(parts[1])})
    asked = test.select("i", "h", "v", deal(parts[1]).alias("qb")).withColumn("tb", number(parts[0]))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("i").fill_null(np.iinfo(np.int64).min).to_numpy()
        best, place = np.full(right.num_rows, np.inf), np.full(right.num_rows, -1)
        known = _matrices(left.column("v")) if left.num_rows else []
        for q_at, queries in _matrices(right.column("v")) if right.num_rows else []:
            for t_at, vectors in known:
                n = min(vectors.shape[1], queries.shape[1])
                if not len(t_at) or not len(q_at):
                    continue
                found, d = nearest(vectors[:, :n], ids[t_at], queries[:, :n])
                found = t_at[found]
                better = (d < best[q_at]) | ((d == best[q_at]) & ((place[q_at] < 0) | (ids[found] > ids[place[q_at]])))
                best[q_at[better]], place[q_at[better]] = d[better], found[better]
        some = pa.array(np.flatnonzero(place >= 0))
        at = pa.array(place[place >= 0])
        return pa.table({"q": right.column("i").take(some), "h": right.column("h").take(some), "d": pa.array(best[place >= 0]), "i": left.column("i").take(at), "l": left.column("l").take(at)})

    kind = train.schema["l"].dataType.simpleString()
    pairs = rows.groupBy("tb", "qb").cogroup(asked.groupBy("tb", "qb")).applyInArrow(meet, f"q long, h long, d double, i long, l {kind}")
    best = pairs.groupBy("q", "h").agg(F.max(F.struct((-F.col("d")).alias("d"), "i", "l")).alias("m"))
    named = best.select(F.col("q").alias("bq"), F.col("h").alias("bh"), F.col("m.l").alias("predicted"))
    met = F.col("i").eqNullSafe(F.col("bq")) & (F.col("h") == F.col("bh"))
    return test.join(named, met, "left").select(F.col("i").alias(id_col), F.col("l").alias(label_col), "predicted")


def accuracy(classified: DataFrame) -> DataFrame:
    return classified.agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))


def matmul(batch: DataFrame, target: list[list[float]], rows: int, inner: int) -> DataFrame:
    """C = A B for matrices ``(batch, a)``: a is row-major rows x inner, ``target`` is B by columns. (batch, i, j, value).

    Each product is made inside its row: no join, no shuffle.
    """
    if any(len(c) != inner for c in target):
        raise ValueError("a column of the target has another length than a row of the batch")
    right = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in target])
    fits = F.when(F.size("a") == rows * inner, F.col("a")).otherwise(F.raise_error(F.lit("a matrix has another size")))
    cells = batch.withColumn("a", fits).select("batch", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice("a", i * inner + 1, inner))).alias("i", "row"))
    cells = cells.select("batch", "i", "row", F.posexplode(right).alias("j", "column"))
    return cells.select("batch", "i", "j", dot_product(F.col("row"), F.col("column")).alias("value"))


def transpose(rows: list[list[float]]) -> list[list[float]]:
    """A target given by rows, as columns."""
    return [list(c) for c in zip(*rows, strict=True)]


def flatten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", length: int = 64) -> DataFrame:
    """Vectors of one length as a column of doubles with row positions."""
    return vectors.select(F.col(id_col).alias("v"), F.posexplode(doubles(F.col(vec_col))).alias("p", "value")).select((F.col("v") * length + F.col("p")).alias("row_id"), "value")


def reshape(df: DataFrame, length: int) -> DataFrame:
    """A column of doubles as vectors of ``length``, whatever its chunks: (vec_id, embedding)."""
    grouped = df.groupBy(F.expr(f"row_id div {int(length)}").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("row_id", "value"))).alias("e"))
    return grouped.select("vec_id", F.transform("e", lambda s: s["value"]).alias("embedding"))
