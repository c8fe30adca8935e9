"""Statistics of a column, decimal precision, percentiles and predicates made from data, and codec sizes by SQL windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floatq.functions import fp
from floatq.sources.folders import temporary


def describe(df: DataFrame) -> DataFrame:
    """count, min, max, mean, population deviation, and the share of values that are not unique."""
    df = df.withColumn("_bits", fp.bits(F.col("value")))
    v = F.col("value")
    n = F.count(F.lit(1))
    deviation = F.when(n <= 1, F.lit(0.0)).otherwise(F.stddev_pop(v))
    repeated = F.when(n == 0, F.lit(0.0)).otherwise((n - F.count_distinct("_bits")) / F.greatest(n, F.lit(1)))
    return df.agg(
        n.alias("n"), F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(deviation, F.lit(0.0)).alias("std"), repeated.alias("non_unique_ratio"),
    )


def in_chunks(order: str = "row_id") -> Window:
    """Neighbours within a chunk: sorting is bounded by the chunk, and chunks are independent."""
    return Window.partitionBy("chunk_id").orderBy(order)


#: Chunks whose last values one task passes on.
SPAN = 4096


def _previous(lasts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with the value of the next smaller key instead of its own, null for the first.

    Neighbours are looked up in spans of keys; a span's first key gets the last value of the span before, from a table of a row per span.
    """
    span = F.floor(F.col(key) / SPAN)
    spans = lasts.groupBy(span.alias("span")).agg(F.max(F.struct(key, value))[value].alias("carried"))
    carried = spans.select("span", F.lag("carried").over(Window.orderBy("span")).alias("carried"))
    within = Window.partitionBy("span").orderBy(key)
    told = lasts.withColumn("span", span).withColumn("n", F.row_number().over(within)).withColumn("before", F.lag(value).over(within))
    return told.join(carried, "span").select(key, F.when(F.col("n") == 1, F.col("carried")).otherwise(F.col("before")).alias(value))


def with_previous(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the value of the row before by position, over chunk borders too.

    Rows are sorted within their chunk; a chunk's first row gets the last value of the nearest chunk
    before, which is passed on in spans of chunks. So no task sorts the whole column, or a row of every chunk.
    """
    w = in_chunks()
    lasts = df.groupBy("chunk_id").agg(F.max(F.struct("row_id", column))[column].alias("_last"))
    before = _previous(lasts, "chunk_id", "_last")
    return df.join(before, "chunk_id").withColumn(name, F.when(F.row_number().over(w) == 1, F.col("_last")).otherwise(F.lag(column).over(w))).drop("_last")


def xor_zeros(df: DataFrame) -> DataFrame:
    """Mean leading and trailing zero bits of the XOR of consecutive values; 64 and 64 below two rows."""
    x = with_previous(df.withColumn("bits", fp.bits(F.col("value"))), "bits", "before").where(F.col("before").isNotNull()).select(F.col("bits").bitwiseXOR(F.col("before")).alias("x"))
    return x.agg(F.coalesce(F.avg(fp.leading_zeros(F.col("x"))), F.lit(64.0)).alias("leading"), F.coalesce(F.avg(fp.trailing_zeros(F.col("x"))), F.lit(64.0)).alias("trailing"))


def exponents(df: DataFrame) -> DataFrame:
    """min, max, mean and population deviation of the IEEE exponents of values that are set; 0 of none."""
    e = df.where(F.col("value").isNotNull()).select(fp.exponent(fp.bits(F.col("value"))).alias("e"))
    return e.agg(*[F.coalesce(of("e"), F.lit(0)).alias(name) for name, of in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))])


def precision_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(fp.decimal_digits(F.col(text)).alias("digits")).groupBy("digits").count()


def precision_stats(df: DataFrame, text: str) -> DataFrame:
    """min, max, mean and population deviation of the decimal digits; 0 of no values."""
    d = F.col("digits")
    return df.select(fp.decimal_digits(F.col(text)).alias("digits")).agg(*[F.coalesce(of(d), F.lit(0)).alias(name) for name, of in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))])


def detect_precision(df: DataFrame, text: str, least_share: float = 0.01, exact: bool = False) -> DataFrame:
    """The largest number of digits that at least ``least_share`` of the values reach (exact: any value)."""
    counts = precision_counts(df, text)  # a few dozen rows at most
    reach = counts.select("digits", F.sum("count").over(Window.orderBy(F.col("digits").desc()).rowsBetween(Window.unboundedPreceding, 0)).alias("reach"), F.sum("count").over(Window.partitionBy()).alias("total"))
    fits = F.col("reach") > 0 if exact else F.col("reach") >= least_share * F.col("total")
    return reach.where(fits).agg(F.coalesce(F.max("digits"), F.lit(0)).alias("digits"))


def digits_percentile(df: DataFrame, share: float = 0.9, places: int = 15) -> DataFrame:
    """The percentile (interpolated) of the digits that values need when written with ``places`` places."""
    written = F.rtrim(F.format_string(f"%.{places}f", F.col("value")), F.lit("0"))
    digits = F.length(F.split_part(written, F.lit("."), F.lit(2)))
    # Values need few different numbers of digits, so the counts are small.
    return df.where(F.col("value").isNotNull()).select(digits.alias("d")).groupBy("d").count().agg(F.percentile("d", F.lit(share), F.col("count")).alias("digits"))


def percentile(df: DataFrame, percents: list[int]) -> DataFrame:
    """The value at index n * p div 100 of the sorted values, for each p: (p, value).

    Sorted by range partitions: positions come from counts per partition, so no task sorts the whole column.
    NaN is not allowed.
    """
    checked = df.select(F.when(F.isnan("value"), F.raise_error(F.lit("percentiles of NaN"))).otherwise(F.col("value")).alias("value"))
    # Equal values are counted first, which bounds what one value brings to a partition. Written, so that all that follows sees the same partitions.
    counts = checked.groupBy("value").count().repartitionByRange("value").withColumn("part", F.spark_partition_id())
    path = temporary(df.sparkSession, "percentile")
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    totals = counts.groupBy("part").agg(F.sum("count").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    upto = F.sum("count").over(Window.partitionBy("part").orderBy("value"))
    placed = counts.withColumn("upto", upto).join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("upto")).alias("upto"), "count", "total")
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.expr(f"total * {int(p)} div 100").alias("at")) for p in percents]))
    return placed.withColumn("w", wanted).where("w.at < upto AND w.at >= upto - count").select("w.p", "value")


def rle_runs(df: DataFrame, column: str = "value") -> DataFrame:
    """Runs of equal bits within chunks: (chunk_id, start, length, value)."""
    w = in_chunks()
    b = fp.bits(F.col(column))
    marked = df.withColumn("b", b).withColumn("fresh", (F.lag("b").over(w).isNull() | (F.lag("b").over(w) != F.col("b"))).cast("int")).withColumn("run", F.sum("fresh").over(w))
    return marked.groupBy("chunk_id", "run").agg(F.min("row_id").alias("start"), F.count(F.lit(1)).alias("length"), F.min(column).alias("value")).drop("run")


def rle_size(df: DataFrame, column: str = "value") -> DataFrame:
    """Bytes of a chunk: a header of 8 and 9 for each run of at most 255."""
    return rle_runs(df, column).groupBy("chunk_id").agg((8 + 9 * F.sum(F.ceil(F.col("length") / 255))).alias("bytes"))


# Fraction bits that hold 0 to 12 decimal digits.
FRACTION_BITS = [0, 5, 8, 11, 15, 18, 21, 25, 28, 31, 35, 38, 50]


def byte_sliced(df: DataFrame, digits: int) -> DataFrame:
    """Fixed-point deltas against the chunk's least: fixed, base, delta, width (bits of the largest delta)."""
    f = FRACTION_BITS[digits]
    chunk = Window.partitionBy("chunk_id")
    fixed = df.withColumn("fixed", (F.col("value") * F.lit(float(1 << f))).cast("long"))
    based = fixed.withColumn("base", F.min("fixed").over(chunk)).withColumn("delta", F.col("fixed") - F.col("base"))
    return based.withColumn("width", F.max(fp.bit_length(F.col("delta"))).over(chunk))


def byte_sliced_decode(encoded: DataFrame, digits: int, keep_digits: int | None = None) -> DataFrame:
    """Values of the deltas; ``keep_digits`` reads only the leading byte columns these need."""
    f = FRACTION_BITS[digits]
    delta = F.col("delta")
    if keep_digits is not None:
        unneeded = max(0, f - FRACTION_BITS[keep_digits])
        # The leading byte is always read; then whole bytes, as long as they hold needed bits.
        dropped = F.when(F.col("width") < 8, 0)
        for width in range(8, 65):
            rest = width - 8
            while rest >= 8 and rest > unneeded:
                rest -= 8
            dropped = dropped.when(F.col("width") == width, rest if rest and rest <= unneeded else 0)
        delta = F.expr("shiftleft(shiftright(delta, _r), _r)")
        encoded = encoded.withColumn("_r", dropped)
    return encoded.select("row_id", "chunk_id", ((F.col("base") + delta) / F.lit(float(1 << f))).alias("value"))


def byte_sliced_size(encoded: DataFrame) -> DataFrame:
    """Bytes of a chunk: a header of 20 and the packed deltas."""
    return encoded.groupBy("chunk_id").agg((20 + F.ceil(F.max("width") * F.count(F.lit(1)) / 8)).alias("bytes"))


def delta_coded(df: DataFrame, scale: int) -> DataFrame:
    """q = round(value * scale), z = zigzag of its delta within the chunk (first 0)."""
    q = df.withColumn("q", F.round(F.col("value") * F.lit(float(scale)), 0).cast("long"))
    return q.withColumn("z", fp.zigzag(F.coalesce(F.col("q") - F.lag("q").over(in_chunks()), F.lit(0).cast("long"))))


def delta_decode(encoded: DataFrame, scale: int) -> DataFrame:
    first = F.first("q").over(in_chunks().rowsBetween(Window.unboundedPreceding, 0))
    return encoded.select("row_id", "chunk_id", ((first + F.sum(fp.unzigzag(F.col("z"))).over(in_chunks())) / F.lit(float(scale))).alias("value"))


def delta_size(encoded: DataFrame) -> DataFrame:
    """Bytes of a chunk: 104 bits of header and n deltas of the largest width."""
    return encoded.groupBy("chunk_id").agg(F.ceil((104 + F.count(F.lit(1)) * F.max(fp.bit_length(F.col("z")))) / 8).alias("bytes"))
