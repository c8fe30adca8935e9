"""Queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floatq.functions import fp
from floatq.operators import report, stats, vectors
from floatq.operators.column import ColumnFrame, mask_and, mask_minus, mask_of, mask_or, mask_range
from floatq.plans import predicate as P
from floatq.plans.aggregation import Aggregation, compute
from floatq.plans.expr import Col, Lit
from floatq.sources import container, text
from floatq.sources.chunkstore import ChunkStore
from floatq.sources.codecs import CODECS
from floatq.sources.folders import temporary
from floatq.streaming.ingest import ingest_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EV = "(SELECT event_id AS row_id, event_id // 1024 AS chunk_id, value FROM events)"
CHUNK = 1024


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> ColumnFrame:
    return ColumnFrame.of(table(spark, d, "events"), "value", "event_id", CHUNK)


def mask() -> Column:
    return F.col("row_id") % 3 != 1


MASK = "row_id % 3 <> 1"


def rnd(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, as sums depend on the order of the rows."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# TPC-H ------------------------------------------------------------------------------------------

H06 = "l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"


def h06(spark: SparkSession, d: str, dated: bool = False) -> DataFrame:
    df = table(spark, d, "lineitem")
    if dated:
        df = df.where("l_shipdate >= timestamp_ntz'1996-01-01' AND l_shipdate < timestamp_ntz'1997-01-01'")
    where = P.between(0.05, 0.07).to_column(F.col("l_discount")) & P.below(24).to_column(F.col("l_quantity"))
    return rnd(compute(df, Aggregation("sum", Col("l_extendedprice") * Col("l_discount"), "revenue"), mask=where), 2)


def h01_aggregations(simplified: bool) -> list[Aggregation]:
    qty, price, disc, tax = (Col(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax"))
    sums = [Aggregation("sum", qty, "sum_qty"), Aggregation("sum", price, "sum_base_price")]
    if simplified:
        sums.append(Aggregation("sum", disc, "sum_disc"))
    else:
        sums += [Aggregation("sum", price * (1 - disc), "sum_disc_price"), Aggregation("sum", price * (1 - disc) * (1 + tax), "sum_charge")]
    return [*sums, Aggregation("avg", qty, "avg_qty"), Aggregation("avg", price, "avg_price"), Aggregation("avg", disc, "avg_disc"), Aggregation("count", qty, "count_order")]


def sql_h01(simplified: bool) -> str:
    extra = ["round(sum(l_discount), 2) AS sum_disc"] if simplified else ["round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price", "round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge"]
    return ", ".join(["round(sum(l_quantity), 2) AS sum_qty", "round(sum(l_extendedprice), 2) AS sum_base_price", *extra, "round(avg(l_quantity), 2) AS avg_qty", "round(avg(l_extendedprice), 2) AS avg_price", "round(avg(l_discount), 2) AS avg_disc", "count(*) AS count_order"])


def q1(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rnd(compute(df, *h01_aggregations(False), by=("l_returnflag", "l_linestatus")), 2).orderBy("l_returnflag", "l_linestatus")


add("tpch_h06", h06, f"SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE {H06}")
add("tpch_q6_full", lambda s, d: h06(s, d, True), f"SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE {H06} AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'")
add("tpch_h01", lambda s, d: rnd(compute(table(s, d, "lineitem"), *h01_aggregations(False)), 2), f"SELECT {sql_h01(False)} FROM lineitem")
add("tpch_h01_simplified", lambda s, d: rnd(compute(table(s, d, "lineitem"), *h01_aggregations(True)), 2), f"SELECT {sql_h01(True)} FROM lineitem")
add("tpch_q1_full", q1, f"SELECT l_returnflag, l_linestatus, {sql_h01(False)} FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")

# Materialize, filter, filter and materialize -------------------------------------------------------

for name, args, where in (("all", (False, None), "true"), ("mask", (True, None), MASK), ("chunk", (False, 2), "chunk_id = 2"), ("mask_chunk", (True, 2), f"{MASK} AND chunk_id = 2")):
    add(f"materialize_{name}", lambda s, d, m=args[0], c=args[1]: events(s, d).materialize(mask() if m else None, c), f"SELECT row_id, value FROM {EV} WHERE {where}")

LO, HI = 50.25, 200.5


def steps_frame(spark: SparkSession, d: str) -> ColumnFrame:
    """The events' values in steps of 250, so that many are equal."""
    return ColumnFrame(events(spark, d).df.withColumn("value", F.floor(F.col("value") / 250).cast("double")))


SIDES = {"i": P.Bound.INCLUSIVE, "e": P.Bound.EXCLUSIVE, "n": P.Bound.NONE}


def rng(a: str, b: str) -> P.Range:
    return P.Range(SIDES[a], None if a == "n" else LO, SIDES[b], None if b == "n" else HI)


add("filter_eq", lambda s, d: events(s, d).filter(P.Eq(99.5)), f"SELECT row_id FROM {EV} WHERE value = 99.5")
# Values that the tables hold at every size.
add("filter_eq_found", lambda s, d: events(s, d).filter(P.Eq(5.0)), f"SELECT row_id FROM {EV} WHERE value = 5.0")
add("filter_materialize_eq_found", lambda s, d: steps_frame(s, d).filter_materialize(P.Eq(1.0), mask()), f"SELECT row_id, value FROM (SELECT row_id, floor(value / 250) AS value FROM {EV}) WHERE value = 1 AND {MASK}")
add("filter_ne", lambda s, d: events(s, d).filter(P.Ne(99.5)), f"SELECT row_id FROM {EV} WHERE value <> 99.5")
for a in SIDES:
    for b in SIDES:
        parts = [x for x in ({"i": f"value >= {LO}", "e": f"value > {LO}"}.get(a), {"i": f"value <= {HI}", "e": f"value < {HI}"}.get(b)) if x]
        add(f"filter_range_{a}{b}", lambda s, d, a=a, b=b: events(s, d).filter(rng(a, b)), f"SELECT row_id FROM {EV} WHERE {' AND '.join(parts) or 'true'}")
II = f"value BETWEEN {LO} AND {HI}"
for name, args, where in (("mask", (True, None), MASK), ("chunk", (False, 3), "chunk_id = 3"), ("mask_chunk", (True, 3), f"{MASK} AND chunk_id = 3"), ("chunk_out_of_range", (False, 10**9), "chunk_id = 1000000000")):
    add(f"filter_{name}", lambda s, d, m=args[0], c=args[1]: events(s, d).filter(rng("i", "i"), mask() if m else None, c), f"SELECT row_id FROM {EV} WHERE {II} AND {where}")
add("filter_materialize_range", lambda s, d: events(s, d).filter_materialize(rng("i", "i"), mask()), f"SELECT row_id, value FROM {EV} WHERE {II} AND {MASK}")
add("filter_materialize_eq", lambda s, d: events(s, d).filter_materialize(P.Eq(99.5)), f"SELECT row_id, value FROM {EV} WHERE value = 99.5")
add("filter_materialize_ne", lambda s, d: events(s, d).filter_materialize(P.Ne(99.5), None, 1), f"SELECT row_id, value FROM {EV} WHERE value <> 99.5 AND chunk_id = 1")


def by_percentile(kind: str, p: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = events(spark, d).df
        at = stats.percentile(df, [p]).select(F.col("value").alias("_x"))
        joined = df.join(F.broadcast(at))
        return joined.where({"gt": "value > _x", "eq": "value = _x", "ne": "value <> _x"}[kind]).select("row_id")

    return run


for kind, p, op in (("gt", 10, ">"), ("gt", 50, ">"), ("gt", 90, ">"), ("eq", 50, "="), ("ne", 50, "<>")):
    add(f"filter_{kind}_p{p}", by_percentile(kind, p), f"WITH e AS {EV}, o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM e) SELECT row_id FROM e WHERE value {op} (SELECT value FROM o WHERE i = n * {p} // 100)")


def customers(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("row_id"), F.col("c_acctbal").alias("value"))
    return df.select("row_id", F.expr(f"row_id div {CHUNK}").alias("chunk_id"), "value")


CUST = "(SELECT c_custkey - 1 AS row_id, (c_custkey - 1) // 1024 AS chunk_id, c_acctbal AS value FROM customer)"
add("filter_quantized_sprintz", lambda s, d: customers(s, d).where(P.rounded(P.at_least(100.26), F.col("value"), 10)).select("row_id"), f"SELECT row_id FROM {CUST} WHERE round(value * 10) >= 1003")
add("filter_quantized_buff", lambda s, d: customers(s, d).where(P.fixed(P.below(-10.3), F.col("value"), 5)).select("row_id"), f"SELECT row_id FROM {CUST} WHERE trunc(value * 32) < trunc(-10.3 * 32)")

# Masks -------------------------------------------------------------------------------------------

below, above = P.below(300), P.above(100)
A, B = f"SELECT row_id FROM {EV} WHERE value < 300", f"SELECT row_id FROM {EV} WHERE value > 100"
add("mask_and", lambda s, d: mask_and(events(s, d).filter(below), events(s, d).filter(above)), f"{A} INTERSECT {B}")
add("mask_or", lambda s, d: mask_or(events(s, d).filter(below), events(s, d).filter(above)), f"{A} UNION {B}")
add("mask_minus", lambda s, d: mask_minus(events(s, d).filter(below), events(s, d).filter(above)), f"{A} EXCEPT {B}")
add("mask_in_list", lambda s, d: events(s, d).materialize(mask_of(s, [0, 2, 3, 5, 77, 10**9])), f"SELECT row_id, value FROM {EV} WHERE row_id IN (0, 2, 3, 5, 77, 1000000000)")
add("mask_range", lambda s, d: events(s, d).materialize(mask_range(s, 100, 777)), f"SELECT row_id, value FROM {EV} WHERE row_id >= 100 AND row_id < 777")
add("filter_from_json", lambda s, d: events(s, d).filter(P.from_json(P.to_json(rng("e", "i")))), f"SELECT row_id FROM {EV} WHERE value > {LO} AND value <= {HI}")
add("filter_mapped_swapped", lambda s, d: events(s, d).filter(rng("i", "e").map(lambda x: -x).swap().map(lambda x: -2 * x).swap()), f"SELECT row_id FROM {EV} WHERE value >= {2 * LO} AND value < {2 * HI}")
add("mask_chained", lambda s, d: events(s, d).filter(below, P.above(100).to_column(F.col("value")) & mask()), f"SELECT row_id FROM {EV} WHERE value < 300 AND value > 100 AND {MASK}")

# Aggregates --------------------------------------------------------------------------------------

for fn in ("sum", "min", "max"):
    for name, args, where in (("all", (False, None), "true"), ("mask", (True, None), MASK), ("chunk", (False, 1), "chunk_id = 1")):
        add(f"{fn}_{name}", lambda s, d, fn=fn, m=args[0], c=args[1]: rnd(events(s, d).aggregate(mask() if m else None, c).select(fn), 2), f"SELECT round({fn}(value), 2) AS {fn} FROM {EV} WHERE {where}")
add("agg_empty", lambda s, d: events(s, d).aggregate(F.col("row_id") < 0), "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS sum, 'inf'::DOUBLE AS min, '-inf'::DOUBLE AS max")
add("agg_per_chunk", lambda s, d: rnd(events(s, d).aggregate(per_chunk=True), 2), f"SELECT chunk_id, count(*) AS n, round(sum(value), 2) AS sum, round(min(value), 2) AS min, round(max(value), 2) AS max FROM {EV} GROUP BY 1")
add("chunk_metadata", lambda s, d: events(s, d).chunks(), f"SELECT chunk_id, min(row_id) AS logical_offset, count(*) AS number_of_records FROM {EV} GROUP BY 1")
SPECIAL = "(1, 1.5), (2, 'nan'), (3, 'inf'), (4, '-inf'), (5, -0.0), (6, 2.5)"


def special(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1.5), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, -0.0), (6, 2.5)], "row_id long, value double")


def nan_semantics(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    tests = {"eq_nan": fp.eq(v, float("nan")), "ne_nan": fp.ne(v, float("nan")), "eq": fp.eq(v, 1.5), "ne": fp.ne(v, 1.5), "gt": fp.bound(v, 1.5, ">"), "le": fp.bound(v, 1.5, "<="), "eq_zero": fp.eq(v, 0.0)}
    counts = [F.count_if(c).alias(n) for n, c in tests.items()]
    return special(spark).where("row_id NOT IN (3)").agg(*counts, fp.min_(v).alias("min"), fp.max_(v).alias("max"))


add("agg_nan_semantics", nan_semantics, f"""
SELECT 0::BIGINT AS eq_nan, count(*) AS ne_nan, count(*) FILTER (NOT isnan(v) AND v = 1.5) AS eq, count(*) FILTER (isnan(v) OR v <> 1.5) AS ne,
  count(*) FILTER (NOT isnan(v) AND v > 1.5) AS gt, count(*) FILTER (NOT isnan(v) AND v <= 1.5) AS le, count(*) FILTER (NOT isnan(v) AND v = 0) AS eq_zero,
  min(v) FILTER (NOT isnan(v)) AS min, max(v) FILTER (NOT isnan(v)) AS max
FROM (SELECT x::DOUBLE AS v FROM (VALUES ('1.5'), ('nan'), ('-inf'), ('-0.0'), ('2.5')) t(x))""")

# Expressions -------------------------------------------------------------------------------------

LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def expression(e: object) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, "lineitem").select(*LINE.split(", "), fp.round_scale(e.to_column(), 10_000).alias("value"))  # type: ignore[attr-defined]


qty, price, disc, tax = (Col(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax"))
for name, e, sql in (
    ("add", qty + price, "l_quantity + l_extendedprice"), ("sub", price - qty, "l_extendedprice - l_quantity"), ("mul", qty * Lit(1.5), "l_quantity * 1.5"),
    ("nested", price * (1 - disc) * (1 + tax) - qty, "l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_quantity"),
):
    add(f"expr_{name}", expression(e), f"SELECT {LINE}, round({sql}, 4) AS value FROM lineitem")
add("expr_div_ieee", expression((qty - 25) / (disc * 100 - 5)), f"SELECT {LINE}, round((l_quantity - 25) / (l_discount * 100 - 5), 4) AS value FROM lineitem")
add("agg_multiple", lambda s, d: rnd(compute(table(s, d, "lineitem"), Aggregation("sum", qty, "a"), Aggregation("sum", qty * price + price, "b"), Aggregation("max", qty * disc, "c"), Aggregation("min", price - qty, "d"), mask=F.col("l_quantity") > 10), 2), "SELECT round(sum(l_quantity), 2) AS a, round(sum(l_quantity * l_extendedprice + l_extendedprice), 2) AS b, round(max(l_quantity * l_discount), 2) AS c, round(min(l_extendedprice - l_quantity), 2) AS d FROM lineitem WHERE l_quantity > 10")


def zipped(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of one file, met by position as columns kept in separate files would be."""
    at = lambda c: ColumnFrame.parquet(spark, f"{d}/lineitem.parquet", c, CHUNK).df.select("row_id", F.col("value").alias(c))
    return at("l_quantity").join(at("l_tax"), "row_id").select("row_id", (F.col("l_quantity") + F.col("l_tax")).alias("value"))


add("zip_columns_by_position", zipped, "SELECT row_number() OVER () - 1 AS row_id, l_quantity + l_tax AS value FROM lineitem")
add("affine_map", lambda s, d: events(s, d).df.select("row_id", F.round((F.col("value") / 500 - 0.5) * 8, 6).alias("value")), f"SELECT row_id, round((value / 500 - 0.5) * 8, 6) AS value FROM {EV}")
add("round_scale", lambda s, d: events(s, d).df.select("row_id", fp.round_scale(F.col("value"), 10).alias("value")), f"SELECT row_id, round(value * 10) / 10 AS value FROM {EV}")
add("preview", lambda s, d: events(s, d).materialize().orderBy("row_id").limit(5), f"SELECT row_id, value FROM {EV} ORDER BY row_id LIMIT 5")

# Statistics --------------------------------------------------------------------------------------

add("dataset_stats", lambda s, d: rnd(stats.describe(events(s, d).df)), f"SELECT count(*) AS n, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round((count(*) - count(DISTINCT value)) / count(*), 4) AS non_unique_ratio FROM {EV}")
add("non_unique_ratio", lambda s, d: rnd(stats.describe(events(s, d).df).select("non_unique_ratio"), 6), f"SELECT round((count(*) - count(DISTINCT value)) / count(*), 6) AS non_unique_ratio FROM {EV}")
add("xor_zero_stats", lambda s, d: rnd(stats.xor_zeros(events(s, d).df)))
add("exponent_stats", lambda s, d: rnd(stats.exponents(events(s, d).df)), f"SELECT min(e) AS min, max(e) AS max, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std FROM (SELECT floor(log2(value))::BIGINT AS e FROM {EV})")
powers = lambda s, d: events(s, d).df.withColumn("value", F.pow(F.lit(2.0), F.pmod(F.col("row_id") * F.col("row_id"), F.lit(11)).cast("double")))
add("xor_zero_stats_of_powers", lambda s, d: rnd(stats.xor_zeros(powers(s, d)), 6), f"WITH e AS (SELECT row_id, 1023 + row_id * row_id % 11 AS e FROM {EV}), x AS (SELECT xor(e, lag(e) OVER (ORDER BY row_id)) AS x FROM e), y AS (SELECT x FROM x WHERE x IS NOT NULL) SELECT round(avg(CASE WHEN x = 0 THEN 64 ELSE 11 - floor(log2(x)) END), 6) AS leading, round(avg(CASE WHEN x = 0 THEN 64 ELSE 52 + log2(x & -x) END), 6) AS trailing FROM y")
add("embedding_precision", lambda s, d: stats.digits_percentile(vectors.flatten(table(s, d, "embeddings"))), "SELECT quantile_cont(length(split_part(rtrim(printf('%.15f', v), '0'), '.', 2)), 0.9) AS digits FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)")
add("exponent_counts", lambda s, d: events(s, d).df.select(fp.exponent(fp.bits(F.col("value"))).alias("exponent")).groupBy("exponent").count(), f"SELECT CASE WHEN value = 0 THEN -1023 ELSE floor(log2(abs(value)))::BIGINT END AS exponent, count(*) AS count FROM {EV} GROUP BY 1")
DIGITS = "CASE WHEN s LIKE '%.%' THEN length(s) - strpos(s, '.') ELSE 0 END"
CENTS = "(SELECT regexp_replace(regexp_replace(printf('%d.%02d', round(value * 100)::BIGINT // 100, round(value * 100)::BIGINT % 100), '0+$', ''), '[.]$', '.0') AS s FROM events)"
add("decimal_precision_strings", lambda s, d: stats.precision_counts(events(s, d).df.withColumn("s", F.col("value").cast("string")), "s").select(F.col("digits").cast("long").alias("digits"), "count"), f"SELECT ({DIGITS})::BIGINT AS digits, count(*) AS count FROM {CENTS} GROUP BY 1")
add("precision_stats", lambda s, d: rnd(stats.precision_stats(events(s, d).df.withColumn("s", F.col("value").cast("string")), "s").withColumns({c: F.col(c).cast("long") for c in ("min", "max")})), f"SELECT min(g) AS min, max(g) AS max, round(avg(g), 4) AS mean, round(stddev_pop(g), 4) AS std FROM (SELECT {DIGITS} AS g FROM {CENTS})")
for exact in (False, True):
    name = "detect_precision_exact" if exact else "detect_precision"
    least = "count(*) FILTER (g >= p) > 0" if exact else "count(*) FILTER (g >= p) >= 0.01 * count(*)"
    add(name, lambda s, d, exact=exact: stats.detect_precision(events(s, d).df.withColumn("s", F.col("value").cast("string")), "s", exact=exact).select(F.col("digits").cast("long").alias("digits")), f"SELECT max(p)::BIGINT AS digits FROM (SELECT p FROM (SELECT {DIGITS} AS g FROM {CENTS}), range(0, 20) r(p) GROUP BY p HAVING {least})")
add("percentiles", lambda s, d: stats.percentile(events(s, d).df, [10, 50, 90]).select(F.col("p").cast("long").alias("p"), "value"), f"SELECT p::BIGINT AS p, value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM {EV}), (VALUES (10), (50), (90)) v(p) WHERE i = n * p // 100")

# Codecs that SQL can express -------------------------------------------------------------------------

QUANT = "(SELECT event_id AS row_id, event_id // 1024 AS chunk_id, floor(value / 250) AS value FROM events)"
RUNS = f"WITH m AS (SELECT *, CASE WHEN lag(value) OVER w = value THEN 0 ELSE 1 END AS f FROM {QUANT} WINDOW w AS (PARTITION BY chunk_id ORDER BY row_id)), r AS (SELECT *, sum(f) OVER (PARTITION BY chunk_id ORDER BY row_id) AS run FROM m), g AS (SELECT chunk_id, min(row_id) AS start, count(*) AS length, min(value) AS value FROM r GROUP BY chunk_id, run)"
steps = lambda s, d: events(s, d).df.withColumn("value", F.floor(F.col("value") / 250).cast("double"))
add("rle_runs", lambda s, d: stats.rle_runs(steps(s, d)), f"{RUNS} SELECT * FROM g")
add("rle_size", lambda s, d: stats.rle_size(steps(s, d)), f"{RUNS} SELECT chunk_id, (8 + 9 * sum(ceil(length / 255)))::BIGINT AS bytes FROM g GROUP BY 1")
FIXED = f"WITH f AS (SELECT *, trunc(value * 256)::BIGINT AS fixed FROM {CUST}), b AS (SELECT *, min(fixed) OVER (PARTITION BY chunk_id) AS base FROM f), e AS (SELECT *, fixed - base AS delta FROM b)"
SUBTRACT = "(CASE WHEN max(delta) = 0 THEN 0 ELSE floor(log2(max(delta))) + 1 END)"
add("buff_encode", lambda s, d: stats.byte_sliced(customers(s, d), 2).select("row_id", "chunk_id", "base", "delta"), f"{FIXED} SELECT row_id, chunk_id, base, delta FROM e")
add("buff_decode", lambda s, d: stats.byte_sliced_decode(stats.byte_sliced(customers(s, d), 2), 2), f"{FIXED} SELECT row_id, chunk_id, (base + delta) / 256.0::DOUBLE AS value FROM e")
add("buff_size", lambda s, d: stats.byte_sliced_size(stats.byte_sliced(customers(s, d), 2)), f"{FIXED} SELECT chunk_id, (20 + ceil({SUBTRACT} * count(*) / 8))::BIGINT AS bytes FROM e GROUP BY 1")
add("buff_precision_1", lambda s, d: stats.byte_sliced_decode(stats.byte_sliced(customers(s, d), 2), 2, 1).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs("value")), 0).alias("largest")))
KEPT = "(CASE WHEN width >= 8 AND (width - 8) % 8 <= 3 THEN (width - 8) % 8 ELSE 0 END)"
add("buff_precision_rows", lambda s, d: stats.byte_sliced_decode(stats.byte_sliced(customers(s, d), 2), 2, 1), f"{FIXED}, w AS (SELECT *, (CASE WHEN max(delta) OVER (PARTITION BY chunk_id) = 0 THEN 0 ELSE floor(log2(max(delta) OVER (PARTITION BY chunk_id))) + 1 END)::BIGINT AS width FROM e) SELECT row_id, chunk_id, (base + delta // (1 << {KEPT}) * (1 << {KEPT})) / 256.0::DOUBLE AS value FROM w")
DELTA = f"WITH q AS (SELECT row_id, chunk_id, round(value * 100)::BIGINT AS q FROM {EV}), d AS (SELECT *, coalesce(q - lag(q) OVER (PARTITION BY chunk_id ORDER BY row_id), 0) AS dl FROM q), z AS (SELECT *, CASE WHEN dl >= 0 THEN 2 * dl ELSE -2 * dl - 1 END AS z FROM d)"
add("sprintz_encode", lambda s, d: stats.delta_coded(events(s, d).df, 100).select("row_id", "chunk_id", "q", "z"), f"{DELTA} SELECT row_id, chunk_id, q, z FROM z")
add("sprintz_roundtrip", lambda s, d: stats.delta_decode(stats.delta_coded(events(s, d).df, 100), 100), f"{DELTA} SELECT row_id, chunk_id, q / 100.0::DOUBLE AS value FROM z")
add("sprintz_size", lambda s, d: stats.delta_size(stats.delta_coded(events(s, d).df, 100)), f"{DELTA} SELECT chunk_id, ceil((104 + count(*) * (CASE WHEN max(z) = 0 THEN 0 ELSE floor(log2(max(z))) + 1 END)) / 8)::BIGINT AS bytes FROM z GROUP BY 1")

# Vectors -----------------------------------------------------------------------------------------

EMB = "(SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
first = lambda s, d: table(s, d, "embeddings").where("vec_id = 0").select(vectors.doubles(F.col("embedding")).alias("t"))
with_first = lambda s, d: table(s, d, "embeddings").join(F.broadcast(first(s, d)))
T0 = f"(SELECT e AS t FROM {EMB} WHERE vec_id = 0)"
D2 = "list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
add("distance_squared", lambda s, d: with_first(s, d).select("vec_id", F.round(vectors.distance_squared(vectors.doubles(F.col("embedding")), F.col("t")), 6).alias("d2")), f"SELECT vec_id, round({D2.format(a='e', b='t')}, 6) AS d2 FROM {EMB}, {T0}")
add("dot_product", lambda s, d: with_first(s, d).select("vec_id", F.round(vectors.dot_product(vectors.doubles(F.col("embedding")), F.col("t")), 6).alias("dot")), f"SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: e[i] * t[i])), 6) AS dot FROM {EMB}, {T0}")
add("knn1", lambda s, d: rnd(vectors.knn1(with_first(s, d).where("vec_id <> 0"), F.col("t")), 6), f"SELECT vec_id AS index, round(d2, 6) AS distance FROM (SELECT vec_id, {D2.format(a='e', b='t')} AS d2 FROM {EMB}, {T0} WHERE vec_id <> 0) ORDER BY d2, vec_id DESC LIMIT 1")


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    df = table(spark, d, "embeddings")
    return vectors.classify(df.where("vec_id % 20 <> 0"), df.where("vec_id % 20 = 0"))


KNN = f"(SELECT q.vec_id, q.label, arg_min(t.label, {D2.format(a='t.e', b='q.e')}) AS predicted FROM {EMB} q, {EMB} t WHERE q.vec_id % 20 = 0 AND t.vec_id % 20 <> 0 GROUP BY 1, 2)"
add("knn_classify", classified, f"SELECT vec_id, label, predicted FROM {KNN}")
add("knn_classify_accuracy", lambda s, d: rnd(vectors.accuracy(classified(s, d)), 6), f"SELECT round(avg((label = predicted)::INT), 6) AS accuracy FROM {KNN}")
TARGET = [[float((i * 3 + j * 5) % 7 - 3) for i in range(8)] for j in range(4)]
batch = lambda s, d: table(s, d, "embeddings").select(F.col("vec_id").alias("batch"), vectors.doubles(F.col("embedding")).alias("a"))
PRODUCT = "SELECT vec_id AS batch, i::INT AS i, j::INT AS j, round(list_sum(list_transform(range(0, 8), lambda k: e[i * 8 + k + 1] * ((k * 3 + j * 5) % 7 - 3))), 6) AS value FROM " + f"{EMB}, range(0, 8) r(i), range(0, 4) c(j)"
add("matmul_batch", lambda s, d: rnd(vectors.matmul(batch(s, d), TARGET, 8, 8), 6), PRODUCT)
add("matmul_row_target", lambda s, d: rnd(vectors.matmul(batch(s, d), vectors.transpose([[TARGET[j][k] for j in range(4)] for k in range(8)]), 8, 8), 6), PRODUCT)
add("embedding_flatten", lambda s, d: vectors.flatten(table(s, d, "embeddings")), "SELECT vec_id * 64 + i AS row_id, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(0, 64) r(i)")

# Reports -----------------------------------------------------------------------------------------

METHODS = [1, 2, 3, 4, 5, 6, 7]
RES = "(SELECT l_returnflag AS dataset, l_linenumber AS method, round(avg(l_quantity), 6) AS ratio, count(*) AS runs FROM lineitem GROUP BY 1, 2)"
results = lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("method")).agg(F.round(F.avg("l_quantity"), 6).alias("ratio"), F.count(F.lit(1)).alias("runs"))
named = lambda df: df.select("dataset", *[F.round(str(m), 4).alias(f"m{m}") for m in METHODS])
wide = lambda s, d: named(report.pivot(results(s, d), "dataset", "method", METHODS, "ratio"))
WIDE = "SELECT dataset, " + ", ".join(f"round(max(ratio) FILTER (method = {m}), 4) AS m{m}" for m in METHODS) + f" FROM {RES} GROUP BY 1"
add("report_mean", lambda s, d: rnd(report.means(results(s, d), ["method"], ["ratio"])), f"SELECT method, round(avg(ratio), 4) AS ratio FROM {RES} GROUP BY 1")
add("report_mean_of_means", lambda s, d: rnd(report.mean_of_means(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_returnflag"], "l_quantity")), "SELECT l_returnflag, round(avg(q), 4) AS l_quantity FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
add("report_pivot", wide, WIDE)
add("report_unpivot", lambda s, d: report.unpivot(wide(s, d), "dataset", [f"m{m}" for m in METHODS]), f"SELECT dataset, 'm' || method AS variable, round(ratio, 4) AS value FROM {RES}")
add("report_exists", lambda s, d: report.exists_matrix(report.exclude(results(s, d), "dataset", ["R"]).withColumn("method", F.concat(F.lit("m"), "method")), "dataset", "method", ["m1", "m2", "m9"]), f"SELECT dataset, count(*) FILTER (method = 1) > 0 AS m1, count(*) FILTER (method = 2) > 0 AS m2, false AS m9 FROM {RES} WHERE dataset <> 'R' GROUP BY 1")
RANKED = f"(SELECT *, rank() OVER (PARTITION BY dataset ORDER BY ratio) + (count(*) OVER (PARTITION BY dataset, ratio) - 1) / 2 AS r FROM {RES})"
add("report_rank_avg", lambda s, d: rnd(report.mean_ranks(results(s, d), "dataset", "method", "ratio")), f"SELECT method, round(avg(r), 4) AS mean_rank, count(*) AS n FROM {RANKED} GROUP BY 1")
add("friedman_ranks", lambda s, d: rnd(results(s, d).withColumn("rank", report.average_rank(F.col("ratio"), ["dataset"])).select("dataset", "method", "rank")), f"SELECT dataset, method, round(r, 4) AS rank FROM {RANKED}")
add("report_join_stats", lambda s, d: results(s, d).join(F.broadcast(results(s, d).groupBy("dataset").agg(F.sum("runs").alias("total"))), "dataset").select("dataset", "method", "runs", "total"), f"SELECT r.dataset, method, runs, total FROM {RES} r JOIN (SELECT dataset, sum(runs)::BIGINT AS total FROM {RES} GROUP BY 1) t USING (dataset)")
add("report_best_per_row", lambda s, d: report.best_per_row(results(s, d), "dataset", "method", "ratio"), f"SELECT dataset, method, ratio FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ratio, method) AS k FROM {RES}) WHERE k = 1")
add("report_best_per_row_desc", lambda s, d: report.best_per_row(results(s, d), "dataset", "method", "ratio", True), f"SELECT dataset, method, ratio FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ratio DESC, method) AS k FROM {RES}) WHERE k = 1")
add("report_rank_desc", lambda s, d: rnd(report.mean_ranks(results(s, d), "dataset", "method", "ratio", True)), f"SELECT method, round(avg(r), 4) AS mean_rank, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY ratio DESC) + (count(*) OVER (PARTITION BY dataset, ratio) - 1) / 2 AS r FROM {RES}) GROUP BY 1")
add("report_without_gaps", lambda s, d: report.without_gaps(results(s, d).where("method < 7 OR dataset <> 'N'"), "dataset", "method").select("dataset", "method"), f"SELECT dataset, method FROM {RES} WHERE dataset <> 'N'")
add("report_relative_to_base", lambda s, d: rnd(report.relative_to(results(s, d), "dataset", "method", 1, "ratio"), 6), f"SELECT r.dataset, r.method, round(r.ratio / b.ratio, 6) AS relative FROM {RES} r JOIN {RES} b ON r.dataset = b.dataset AND b.method = 1")
add("report_normalise_max", lambda s, d: rnd(report.over_maximum(results(s, d), "ratio").select("dataset", "method", "ratio"), 6), f"SELECT dataset, method, round(ratio / max(ratio) OVER (), 6) AS ratio FROM {RES}")


def friedman(spark: SparkSession, d: str) -> DataFrame:
    out = report.friedman(report.mean_ranks(results(spark, d), "dataset", "method", "ratio"))
    return spark.createDataFrame([(round(out["statistic"], 6), round(out["p_value"], 6), report.critical_difference(out["methods"], out["datasets"]))], "statistic double, p_value double, critical_difference double")


add("friedman_test", friedman)


add("friedman_statistic", lambda s, d: friedman(s, d).select("statistic"), f"SELECT round(12.0 * n / (k * (k + 1)) * (s - k * (k + 1) * (k + 1) / 4.0), 6) AS statistic FROM (SELECT count(*) AS k, max(n) AS n, sum(m * m) AS s FROM (SELECT method, avg(r) AS m, count(*) AS n FROM {RANKED} GROUP BY 1))")

# Runs: a line is a run of a method (its line number) on a dataset (its return flag); quantity and tax are segments of its time.
runs_of = lambda s, d: table(s, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.concat(F.lit("m"), "l_linenumber").alias("method"), F.col("l_extendedprice").alias("total"), F.col("l_quantity").alias("seek"), F.col("l_tax").alias("read"), F.lit(4096.0).alias("size"))
mean_runs = lambda s, d: report.run_means(runs_of(s, d), ["dataset", "method"], "total", ["seek", "read"], "size")
RUNS_OF = "(SELECT l_returnflag AS dataset, 'm' || l_linenumber AS method, avg(l_extendedprice) AS total, avg(l_quantity) AS seek, avg(l_tax) AS read, 4096.0::DOUBLE AS size FROM lineitem GROUP BY 1, 2)"
add("report_run_means", lambda s, d: rnd(mean_runs(s, d), 6), f"SELECT dataset, method, round(total, 6) AS total, round(seek, 6) AS seek, round(read, 6) AS read, size, round(total - seek - read, 6) AS others, round(size / total, 6) AS throughput, round(seek / total, 6) AS seek_share, round(read / total, 6) AS read_share, round((total - seek - read) / total, 6) AS others_share FROM {RUNS_OF}")
add("report_per_size", lambda s, d: rnd(report.per_size(mean_runs(s, d), ["total", "seek"], "size").select("dataset", "method", "total", "seek"), 6), f"SELECT dataset, method, round(total / size, 6) AS total, round(seek / size, 6) AS seek FROM {RUNS_OF}")
nested = lambda s, d: mean_runs(s, d).select("dataset", "method", F.create_map(F.lit("compress"), F.struct(F.col("seek").alias("time"), F.col("seek_share").alias("share")), F.lit("sum"), F.struct(F.col("read").alias("time"), F.col("read_share").alias("share"))).alias("of"))
flat = lambda s, d: report.flattened(nested(s, d), ["dataset", "method"], "of")
add("report_flatten", lambda s, d: rnd(flat(s, d), 6), f"SELECT dataset, method, unnest(['compress', 'sum']) AS operation, round(unnest([seek, read]), 6) AS time, round(unnest([seek / total, read / total]), 6) AS share FROM {RUNS_OF}")
add("report_fact_table", lambda s, d: rnd(report.fact_table(flat(s, d), ["dataset", "method"], ["compress", "sum", "max"], "time"), 6), f"SELECT dataset, method, round(seek, 6) AS compress, round(read, 6) AS sum, NULL::DOUBLE AS max FROM {RUNS_OF}")
FLAGS = {"A": "series", "N": "table", "R": "series"}
statistics = lambda s, d: report.unpivot(table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("dataset")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_quantity").alias("mean")), "dataset", ["n", "mean"], "statistic", "value")
add("report_dimension", lambda s, d: report.dimension(statistics(s, d), "dataset", {"n": "num_values", "mean": "average"}, ["num_values"], {"kind": FLAGS}), "SELECT l_returnflag AS dataset, count(*) AS num_values, round(avg(l_quantity), 2) AS average, CASE l_returnflag WHEN 'N' THEN 'table' ELSE 'series' END AS kind FROM lineitem GROUP BY 1")
SERIES = "dataset <> 'N'"
classes = lambda **names: {name: F.expr(of) for name, of in names.items()}
add("report_class_means", lambda s, d: rnd(report.class_means(results(s, d), "method", "ratio", classes(series=SERIES, tables="dataset = 'N'", all="true")), 4), f"SELECT method, round(avg(ratio) FILTER (dataset <> 'N'), 4) AS series, round(avg(ratio) FILTER (dataset = 'N'), 4) AS tables, round(avg(ratio), 4) AS all FROM {RES} GROUP BY 1")
add("report_average_rows", lambda s, d: named(report.with_averages(results(s, d), "dataset", "method", METHODS, "ratio", {"Series AVG": F.expr(SERIES), "Overall AVG": F.lit(True)})), f"WITH e AS (SELECT dataset, method, ratio FROM {RES}), u AS (FROM e UNION ALL SELECT 'Series AVG', method, avg(ratio) FROM e WHERE dataset <> 'N' GROUP BY method UNION ALL SELECT 'Overall AVG', method, avg(ratio) FROM e GROUP BY method) SELECT dataset, " + ", ".join(f"round(max(ratio) FILTER (method = {m}), 4) AS m{m}" for m in METHODS) + " FROM u GROUP BY 1")
sized = lambda s, d: report.from_name(table(s, d, "part").select("p_partkey", F.concat(F.lit("matrix_"), F.col("p_partkey") % 4 * 128, F.lit("_p"), F.col("p_size") % 3, F.lit(".json")).alias("file"), F.col("p_retailprice").alias("time")), "file", r"matrix_(\d+)_p(\d+)\.json$", ["side", "digits"])
add("report_by_file_name", lambda s, d: rnd(report.means(sized(s, d), ["side", "digits"], ["time"])), "SELECT p_partkey % 4 * 128 AS side, (p_size % 3)::BIGINT AS digits, round(avg(p_retailprice), 4) AS time FROM part GROUP BY 1, 2")
RANKS2 = f"(SELECT dataset, method, (rank() OVER (PARTITION BY dataset ORDER BY ratio) + (count(*) OVER (PARTITION BY dataset, ratio) - 1) / 2 + rank() OVER (PARTITION BY dataset ORDER BY runs DESC) + (count(*) OVER (PARTITION BY dataset, runs) - 1) / 2) / 2 AS rank FROM {RES})"
add("report_rank_matrix", lambda s, d: rnd(report.rank_matrix(results(s, d), "dataset", "method", {"ratio": False, "runs": True}), 6), f"SELECT dataset, method, round(rank, 6) AS rank FROM {RANKS2}")
add("report_rank_of_ranks", lambda s, d: rnd(report.means(report.rank_matrix(results(s, d), "dataset", "method", {"ratio": False, "runs": True}), ["method"], ["rank"]), 6), f"SELECT method, round(avg(rank), 6) AS rank FROM {RANKS2} GROUP BY 1")
add("report_in_order", lambda s, d: rnd(report.in_order(report.means(results(s, d), ["dataset"], ["ratio"]), "dataset", ["R", "A"])), f"SELECT dataset, round(avg(ratio), 4) AS ratio FROM {RES} GROUP BY 1")

# Codecs by chunk ---------------------------------------------------------------------------------

for codec, options in (("uncompressed", {}), ("rle", {}), ("gorilla", {}), ("chimp", {}), ("chimp128", {}), ("elf", {}), ("elf_on_chimp", {}), ("zstd", {}), ("gzip", {}), ("snappy", {}), ("alp", {})):
    add(f"roundtrip_{codec}", lambda s, d, c=codec, o=options: container.round_trip(events(s, d).df, c, **o), f"SELECT row_id, chunk_id, value FROM {EV}")
add("roundtrip_buff", lambda s, d: container.round_trip(customers(s, d), "buff", digits=2), f"SELECT row_id, chunk_id, trunc(value * 256) / 256 AS value FROM {CUST}")
add("roundtrip_sprintz", lambda s, d: container.round_trip(events(s, d).df, "sprintz", scale=100), f"SELECT row_id, chunk_id, round(value * 100) / 100 AS value FROM {EV}")


def ratios(spark: SparkSession, d: str) -> DataFrame:
    """Compressed over uncompressed size of each codec; lower is better."""
    sizes = container.sizes_by_codec(events(spark, d).df, {c: {} for c in sorted(CODECS)})
    return sizes.groupBy("codec").agg(F.round(F.sum("bytes") / (8 * F.sum("rows")), 6).alias("ratio"))


add("compression_ratio_by_codec", ratios)
add("sizes_by_codec", lambda s, d: container.sizes_by_codec(steps_frame(s, d).df, {"uncompressed": {}, "rle": {}}), f"{RUNS}, b AS (SELECT chunk_id, (8 + 9 * sum(ceil(length / 255)))::BIGINT AS rle, sum(length)::BIGINT AS rows FROM g GROUP BY 1) SELECT chunk_id, 'rle' AS codec, rows, rle AS bytes FROM b UNION ALL SELECT chunk_id, 'uncompressed', rows, 8 * rows FROM b")
add("size_uncompressed", lambda s, d: container.encoded_sizes(events(s, d).df, "uncompressed"), f"SELECT chunk_id, count(*) AS rows, 8 * count(*) AS bytes FROM {EV} GROUP BY 1")

# Chunk store -------------------------------------------------------------------------------------


def stored(spark: SparkSession, d: str, codec: str = "gorilla", upto: int | None = None) -> ChunkStore:
    """The events' values, written chunk by chunk and read back."""
    store = ChunkStore(spark, temporary(spark, "store"))
    df = events(spark, d).materialize()
    store.write(df if upto is None else df.where(F.col("row_id") < upto), codec, CHUNK)
    return store


def store_append(spark: SparkSession, d: str) -> DataFrame:
    """Half of the rows, then the others with another codec."""
    store = stored(spark, d, "zstd", 5 * CHUNK)
    store.append(events(spark, d).materialize(F.col("row_id") >= 5 * CHUNK), "gorilla", CHUNK)
    return store.scan()


def store_rewind(spark: SparkSession, d: str) -> DataFrame:
    """All rows, taken back to two chunks, then a third added."""
    store = stored(spark, d)
    store.rewind(2 * CHUNK)
    store.append(events(spark, d).materialize((F.col("row_id") >= 2 * CHUNK) & (F.col("row_id") < 3 * CHUNK)), "zstd", CHUNK)
    return store.scan()


add("container_scan", lambda s, d: stored(s, d).scan(), f"SELECT row_id, chunk_id, value FROM {EV}")
add("container_filter_pushdown", lambda s, d: stored(s, d).scan(rng("i", "e")).select("row_id", "value"), f"SELECT row_id, value FROM {EV} WHERE value >= {LO} AND value < {HI}")
add("container_filter_none", lambda s, d: stored(s, d).scan(P.above(1e6)).select("row_id", "value"), f"SELECT row_id, value FROM {EV} WHERE value > 1000000")
add("container_mask", lambda s, d: stored(s, d, "chimp").scan(P.below(HI), mask(), 3).select("row_id", "value"), f"SELECT row_id, value FROM {EV} WHERE value < {HI} AND {MASK} AND chunk_id = 3")
add("container_aggregate", lambda s, d: rnd(stored(s, d, "alp").aggregate(), 2), f"SELECT count(*) AS n, round(sum(value), 2) AS sum, round(min(value), 2) AS min, round(max(value), 2) AS max FROM {EV}")
add("container_append", store_append, f"SELECT row_id, chunk_id, value FROM {EV}")
add("container_rewind", store_rewind, f"SELECT row_id, chunk_id, value FROM {EV} WHERE row_id < {3 * CHUNK}")
add("container_chunks", lambda s, d: stored(s, d).chunks().select("chunk_id", "logical_offset", "rows", "least", "most", "nan"), f"SELECT chunk_id, min(row_id) AS logical_offset, count(*) AS rows, min(value) AS least, max(value) AS most, false AS nan FROM {EV} GROUP BY 1")

def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, stored batch by batch."""
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")
    path = temporary(spark, "stream")
    ingest_store(stream.select(F.col("event_id").alias("row_id"), "value"), f"{path}/store", f"{path}/progress", "gorilla", CHUNK).awaitTermination()
    return ChunkStore(spark, f"{path}/store").scan().select("row_id", "value")


add("stream_ingest", streamed, f"SELECT row_id, value FROM {EV}")

# Bits --------------------------------------------------------------------------------------------

add("bits_round_trip", lambda s, d: events(s, d).df.select("row_id", fp.from_bits(fp.bits(F.col("value"))).alias("value")), f"SELECT row_id, value FROM {EV}")
add("bit_zeros", lambda s, d: events(s, d).df.select("row_id", *[of(F.col("row_id")).cast("long").alias(n) for n, of in (("leading", fp.leading_zeros), ("trailing", fp.trailing_zeros), ("bits", fp.bit_length))]), f"SELECT row_id, CASE WHEN row_id = 0 THEN 64 ELSE 64 - length(bin(row_id)) END AS leading, CASE WHEN row_id = 0 THEN 64 ELSE length(bin(row_id)) - length(rtrim(bin(row_id), '0')) END AS trailing, CASE WHEN row_id = 0 THEN 0 ELSE length(bin(row_id)) END AS bits FROM {EV}")
signed = lambda s, d: events(s, d).df.select("row_id", (F.col("row_id") - 5000).alias("x"))
add("zigzag_round_trip", lambda s, d: signed(s, d).select("row_id", fp.zigzag(F.col("x")).alias("z"), fp.unzigzag(fp.zigzag(F.col("x"))).alias("x")), f"SELECT row_id, CASE WHEN row_id >= 5000 THEN 2 * (row_id - 5000) ELSE 9999 - 2 * row_id END AS z, row_id - 5000 AS x FROM {EV}")

# Sources -----------------------------------------------------------------------------------------


def lines(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "line long, value string")


add("csv_parse", lambda s, d: text.csv_values(lines(s, ["1.2, 2.0,3.31", "", "4.0,,5e-1"])).select("line", F.col("pos").cast("long").alias("pos"), "value"), "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 1.2::DOUBLE), (0, 1, 2.0), (0, 2, 3.31), (2, 0, 4.0), (2, 2, 0.5)) t(line, pos, value)")
add("ucr_parse", lambda s, d: text.labelled_series(lines(s, ["head\tx", "2\t1.25\tNaN\t3", "1\t0.5"]), scale=10).select("line", F.col("label").cast("long").alias("label"), F.posexplode("pixels").alias("pos", "value")).select("line", "label", F.col("pos").cast("long").alias("pos"), "value"), "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 0::BIGINT, 1.3::DOUBLE), (1, 2, 1, 0.0), (1, 2, 2, 3.0), (2, 1, 0, 0.5)) t(line, label, pos, value)")
add("numeric_columns", lambda s, d: text.numeric_columns(table(s, d, "lineitem").drop("l_shipdate")).agg(*[F.round(F.sum(c), 2).alias(c) for c in ("l_discount", "l_quantity", "l_tax")]), "SELECT round(sum(l_discount), 2) AS l_discount, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 2) AS l_tax FROM lineitem")
