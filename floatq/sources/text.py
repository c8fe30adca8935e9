"""Raw binary, CSV, labelled series and Parquet tables as columns of doubles; JSON results and configurations."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType, StringType

from floatq.functions import fp


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_id, value) of little-endian doubles; a rest of fewer than 8 bytes is dropped."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(data, "<f8", len(data) // 8)
                for i in range(0, len(values), 1 << 16):
                    part = values[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), pa.array(part)], names=["path", "row_id", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, row_id long, value double")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): lines of text files (a file, folder or glob), numbered from 0 in each file.

    A line's number is its place in its split and the lines of the splits before, of which there is a row each; no line is shuffled.
    """
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(splits), ["path", "start"]).select("path", (F.col("id") + F.col("shift")).alias("line"), "value")


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_id, value): the numbers of comma-separated files without a header, in the order of lines and fields.

    Blank fields are skipped; a field that is no number fails the query, and with it what it writes.
    """
    lines = numbered_lines(spark, path)
    counted = lines.select("path", "line", F.size(F.filter(F.split("value", ","), lambda x: F.trim(x) != "")).cast("long").alias("n"))
    # A line's first position: fields of the lines before in its block of lines, and of the blocks before.
    block = F.floor(F.col("line") / 65_536)
    blocks = counted.groupBy("path", block.alias("block")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("path", "block", F.coalesce(upto, F.lit(0)).alias("skipped"))
    within = F.sum("n").over(Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    split = lines.withColumn("fields", F.filter(F.split("value", ","), lambda x: F.trim(x) != "")).withColumns({"n": F.size("fields").cast("long"), "block": block})
    placed = split.join(F.broadcast(blocks), ["path", "block"]).withColumn("at", F.col("skipped") + F.coalesce(within, F.lit(0)))
    return placed.select("path", "at", F.posexplode("fields").alias("k", "field")).select("path", (F.col("at") + F.col("k")).alias("row_id"), F.trim("field").cast("double").alias("value"))


def csv_values(lines: DataFrame, text: str = "value", order: str = "line") -> DataFrame:
    """(line, pos, value): fields of comma-separated lines without a header; blanks are skipped, a field that is no number fails."""
    fields = lines.select(F.col(order).alias("line"), F.posexplode(F.split(text, ",")).alias("pos", "field")).withColumn("field", F.trim("field"))
    return fields.where("field <> ''").select("line", "pos", F.col("field").cast("double").alias("value"))


def labelled_series(lines: DataFrame, text: str = "value", order: str = "line", scale: int | None = None) -> DataFrame:
    """(line, label, pixels) of tab-separated lines after the first: a label, then numbers, NaN as 0."""
    # The first line is no data: its fields must not even be looked at, whenever Spark applies the filter.
    parts = F.split(F.when(F.col(order) > 0, F.col(text)), "\t")
    number = lambda x: F.nanvl(x.cast("double"), F.lit(0.0))
    pixel: object = number if scale is None else lambda x: fp.round_scale(number(x), scale)
    return lines.where(F.col(order) > 0).select(F.col(order).alias("line"), parts[0].cast("double").cast("int").alias("label"), F.transform(F.slice(parts, 2, 1_000_000_000), pixel).alias("pixels"))


def numeric_columns(df: DataFrame) -> DataFrame:
    """Numeric columns as doubles in the order of their names, null as NaN; strings are dropped, other types are an error."""
    out: list[Column] = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        if isinstance(field.dataType, (NumericType, DecimalType)):
            out.append(F.coalesce(F.col(field.name).cast("double"), F.lit(float("nan"))).alias(field.name))
        elif not isinstance(field.dataType, StringType):
            raise ValueError(f"column {field.name} has type {field.dataType.simpleString()}")
    return df.select(*out)


def synthetic_sums(spark: SparkSession, n: int, seeds: int = 11, top: int = 5) -> DataFrame:
    """(row_id, value): sums of seeded random numbers with random whole weights, to test XOR codecs."""
    terms = sum((F.rand(2 * s) * F.floor(F.rand(2 * s + 1) * (top + 1)) for s in range(seeds)), F.lit(0.0))
    return spark.range(n).select(F.col("id").alias("row_id"), terms.alias("value"))


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def save_json(result: dict, path: str | Path) -> Path:
    """Save a result; an existing file is never overwritten, a numbered one is made beside it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    for k in range(10_000):
        at = path if not k else path.with_name(f"{path.stem}-{k}{path.suffix}")
        try:
            with at.open("x", encoding="utf-8") as f:
                json.dump(result, f, indent=1)
            return at
        except FileExistsError:
            continue
    raise FileExistsError(path)
