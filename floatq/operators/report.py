"""Reports over result tables (dataset, method, metrics): means, pivots, ranks, tests of difference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def means(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def mean_of_means(results: DataFrame, inner: list[str], outer: list[str], metric: str) -> DataFrame:
    """Averages of the averages of ``inner`` groups, so that each of these counts alike."""
    return results.groupBy(*inner).agg(F.avg(metric).alias(metric)).groupBy(*outer).agg(F.avg(metric).alias(metric))


def pivot(results: DataFrame, key: str, column: str, values: list, metric: str) -> DataFrame:
    return results.groupBy(key).pivot(column, values).agg(F.avg(metric))


def unpivot(wide: DataFrame, key: str, columns: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return wide.unpivot([key], columns, variable, value)


def exists_matrix(results: DataFrame, key: str, column: str, values: list) -> DataFrame:
    counted = results.groupBy(key).pivot(column, values).count()
    return counted.select(key, *[(F.coalesce(F.col(str(v)), F.lit(0)) > 0).alias(str(v)) for v in values])


def exclude(results: DataFrame, column: str, values: list) -> DataFrame:
    return results.where(~F.col(column).isin(values))


def without_gaps(results: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of keys that have all methods."""
    methods = results.agg(F.count_distinct(column).alias("_n"))
    full = results.groupBy(key).agg(F.count_distinct(column).alias("_n")).join(F.broadcast(methods), "_n")
    return results.join(full.select(key), key, "left_semi")


def average_rank(metric: Column, partition: list[str], descending: bool = False) -> Column:
    """Rank with ties at their mean rank."""
    w = Window.partitionBy(*partition)
    ordered = w.orderBy(metric.desc() if descending else metric.asc())
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, metric)) - 1) / 2


def mean_ranks(results: DataFrame, dataset: str, method: str, metric: str, descending: bool = False) -> DataFrame:
    ranked = results.withColumn("rank", average_rank(F.col(metric), [dataset], descending))
    return ranked.groupBy(method).agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


def best_per_row(results: DataFrame, dataset: str, method: str, metric: str, descending: bool = False) -> DataFrame:
    """Each dataset's best method (of equal ones the first by name) and its metric."""
    best = (F.max_by if descending else F.min_by)(F.struct(method, metric), F.struct(F.col(metric), method)).alias("b")
    if descending:
        top = results.withColumn("_top", F.max(metric).over(Window.partitionBy(dataset))).where(F.col(metric) == F.col("_top"))
        return top.groupBy(dataset).agg(F.min(method).alias(method), F.max(metric).alias(metric))
    return results.groupBy(dataset).agg(best).select(dataset, f"b.{method}", f"b.{metric}")


def relative_to(results: DataFrame, dataset: str, method: str, base: str | int, metric: str) -> DataFrame:
    """The metric over that of the base method on the same dataset."""
    of_base = F.max(F.when(F.col(method) == F.lit(base), F.col(metric))).over(Window.partitionBy(dataset))
    return results.select(dataset, method, (F.col(metric) / of_base).alias("relative"))


def over_maximum(results: DataFrame, metric: str) -> DataFrame:
    top = results.agg(F.max(metric).alias("_max"))
    return results.join(F.broadcast(top)).withColumn(metric, F.col(metric) / F.col("_max")).drop("_max")


def run_means(runs: DataFrame, keys: list[str], total: str, segments: list[str], size: str) -> DataFrame:
    """Means over repeated runs: the total time, segments with what they leave as ``others``, each segment's share, and bytes per unit of time."""
    spent = runs.groupBy(*keys).agg(F.avg(total).alias(total), *[F.avg(c).alias(c) for c in segments], F.max(size).alias(size))
    spent = spent.withColumn("others", F.col(total) - sum((F.col(c) for c in segments), F.lit(0)))
    shares = {f"{c}_share": F.col(c) / F.col(total) for c in [*segments, "others"]}
    return spent.withColumn("throughput", F.col(size) / F.col(total)).withColumns(shares)


def per_size(results: DataFrame, columns: list[str], size: str) -> DataFrame:
    """Times over the uncompressed size, such as seconds a gigabyte."""
    return results.withColumns({c: F.col(c) / F.col(size) for c in columns})


def flattened(results: DataFrame, keys: list[str], nested: str) -> DataFrame:
    """A row per operation of ``nested`` (map of operation to a struct of metrics): keys, operation, metrics."""
    return results.select(*keys, F.explode(nested).alias("operation", "of")).select(*keys, "operation", "of.*")


def fact_table(flat: DataFrame, keys: list[str], operations: list[str], metric: str) -> DataFrame:
    """One row per key with a column for each operation's metric, null where it was not run."""
    return flat.groupBy(*keys).pivot("operation", operations).agg(F.max(metric))


def dimension(stats: DataFrame, key: str, names: dict[str, str], whole: list[str], lookups: dict[str, dict[str, str]]) -> DataFrame:
    """Statistics (key, statistic, value) as one row per key: rounded to two places, renamed, counts as whole numbers, and looked-up labels of the key."""
    wide = stats.groupBy(key).pivot("statistic", list(names)).agg(F.round(F.max("value"), 2))
    columns = [F.col(old).cast("long" if new in whole else "double").alias(new) for old, new in names.items()]
    label = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[F.col(key)]
    return wide.select(key, *columns, *[label(pairs).alias(name) for name, pairs in lookups.items()])


def class_means(results: DataFrame, method: str, metric: str, classes: dict[str, Column]) -> DataFrame:
    """Each method's mean over each class of rows, null where a class has none of it."""
    return results.groupBy(method).agg(*[F.avg(F.when(of, F.col(metric))).alias(name) for name, of in classes.items()])


def with_averages(results: DataFrame, dataset: str, method: str, methods: list, metric: str, classes: dict[str, Column]) -> DataFrame:
    """The pivot of datasets by methods, and a row of averages over each class of datasets."""
    rows = results.select(dataset, method, metric)
    for name, of in classes.items():
        rows = rows.unionByName(results.where(of).groupBy(method).agg(F.avg(metric).alias(metric)).select(F.lit(name).alias(dataset), method, metric))
    return pivot(rows, dataset, method, methods, metric)


def from_name(df: DataFrame, name: str, pattern: str, groups: list[str]) -> DataFrame:
    """Whole numbers that a file's name states, by the groups of a pattern; null where it doesn't match."""
    return df.withColumns({g: F.when(F.col(name).rlike(pattern), F.regexp_extract(name, pattern, i + 1).cast("long")) for i, g in enumerate(groups)})


def rank_matrix(results: DataFrame, dataset: str, method: str, metrics: dict[str, bool]) -> DataFrame:
    """Ranks of methods on each dataset, averaged over metrics; True ranks the largest value first."""
    ranks = [average_rank(F.col(m), [dataset], descending) for m, descending in metrics.items()]
    return results.select(dataset, method, (sum(ranks, F.lit(0.0)) / len(ranks)).alias("rank"))


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in the order of a list, others after them by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(F.lit(len(order) + 1)), column)


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x), by the series or the continued fraction of the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return 1 - front * total
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


#: Most methods that a test compares; their ranks go to the driver.
MAX_METHODS = 10_000


def friedman(ranks: DataFrame, method: str = "method") -> dict:
    """Statistic and p-value of mean ranks of k methods over n datasets (columns ``mean_rank``, ``n``)."""
    rows = ranks.select(method, "mean_rank", "n").limit(MAX_METHODS + 1).collect()
    if len(rows) > MAX_METHODS:
        raise ValueError(f"more than {MAX_METHODS} methods")
    k, n = len(rows), rows[0]["n"] if rows else 0
    if k < 2 or any(r["n"] != n for r in rows):
        raise ValueError("every method needs a rank on every dataset")
    q = 12 * n / (k * (k + 1)) * (sum(r["mean_rank"] ** 2 for r in rows) - k * (k + 1) ** 2 / 4)
    return {"statistic": q, "p_value": chi_square_tail(q, k - 1), "methods": k, "datasets": n}


# Critical values of the Nemenyi test at 0.05 for 2 to 20 methods.
NEMENYI_05 = [1.960, 2.344, 2.569, 2.728, 2.850, 2.948, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544]


def critical_difference(methods: int, datasets: int) -> float:
    return NEMENYI_05[methods - 2] * math.sqrt(methods * (methods + 1) / (6 * datasets))


def cliques(ranks: dict[str, float], difference: float) -> list[list[str]]:
    """Maximal groups of two or more methods whose mean ranks lie within ``difference``."""
    order = sorted(ranks, key=lambda m: (ranks[m], m))
    spans = []
    for i, m in enumerate(order):
        last = max(j for j in range(i, len(order)) if ranks[order[j]] - ranks[m] <= difference)
        if last > i and (not spans or last > spans[-1][1]):
            spans.append((i, last))
    return [order[i : j + 1] for i, j in spans]
