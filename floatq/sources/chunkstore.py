"""Encoded columns as Parquet tables of chunks: a row for each chunk, with its place, statistics and bytes.

Everything goes through Spark's own readers and writers, so the store lives on any file system that Spark reaches, is
committed by Spark, and its chunk table is itself distributed. A scan's predicate becomes a filter on the chunks'
statistics, which Parquet applies to row groups before any chunk is decoded; counts, minima and maxima of whole chunks
are answered from the statistics alone.

A store is a folder of generations. Appending writes a new one. Taking rows back writes a small generation that says from
which row on the earlier ones end, so nothing is rewritten and a failed job leaves the store as it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floatq.functions import fp
from floatq.plans.predicate import Eq, Predicate, Range
from floatq.sources.codecs import make

CHUNK_ROWS = 65_536
SCHEMA = "chunk_id long, logical_offset long, rows long, least double, most double, nan boolean, codec string, options string, data binary, cut long"
VALUES = "row_id long, chunk_id long, value double"


def encoded(df: DataFrame, codec: str, rows: int, start: int = 0, first_chunk: int = 0, **options: int) -> DataFrame:
    """The chunks of (row_id, value), row ids without gaps: ``rows`` rows each from row ``start`` on. One task holds a chunk at a time."""
    made = json.dumps(options, sort_keys=True)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        coder, values = make(codec, **options), table.column("value").to_numpy()
        numbers = values[~np.isnan(values)]
        known = coder.exact and len(numbers) > 0
        row = {
            "chunk_id": table.column("chunk_id")[0].as_py(), "logical_offset": table.column("row_id")[0].as_py(), "rows": len(values), "least": float(numbers.min()) if known else None,
            "most": float(numbers.max()) if known else None, "nan": len(numbers) < len(values), "codec": codec, "options": made, "data": coder.encode(values), "cut": None,
        }
        return pa.Table.from_pylist([row], pa.schema([("chunk_id", pa.int64()), ("logical_offset", pa.int64()), ("rows", pa.int64()), ("least", pa.float64()), ("most", pa.float64()), ("nan", pa.bool_()), ("codec", pa.string()), ("options", pa.string()), ("data", pa.binary()), ("cut", pa.int64())]))

    at = F.col("row_id").cast("long")
    chunk = F.lit(first_chunk) + F.floor((at - start) / rows)
    return df.select(at.alias("row_id"), chunk.cast("long").alias("chunk_id"), F.col("value").cast("double").alias("value")).groupBy("chunk_id").applyInArrow(run, SCHEMA)


class ChunkStore:
    """A column at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _generations(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return 0
        names = [f.getPath() for f in files.listStatus(path)]
        done = [int(p.getName().split("=")[1]) for p in names if p.getName().startswith("generation=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(done, default=-1) + 1

    def put(self, chunks: DataFrame, generation: int) -> None:
        """Write a generation; what is there under its number is replaced."""
        chunks.write.mode("overwrite").parquet(f"{self.path}/generation={generation}")

    def chunks(self) -> DataFrame:
        """The chunks that count, with their metadata and bytes."""
        n = self._generations()
        if not n:
            return self.spark.createDataFrame([], SCHEMA)
        every = self.spark.read.schema(SCHEMA + ", generation int").option("basePath", self.path).parquet(*[f"{self.path}/generation={g}" for g in range(n)])
        # As many as times that rows were taken back; later cuts apply to earlier chunks only.
        cuts = [(r.generation, r.cut) for r in every.where("cut IS NOT NULL").select("generation", "cut").collect()]
        ends = F.lit(True)
        for generation, cut in cuts:
            ends &= (F.col("generation") > generation) | (F.col("logical_offset") < cut)
        return every.where(F.col("cut").isNull() & ends).drop("cut", "generation")

    def count(self) -> int:
        return self.chunks().agg(F.coalesce(F.max(F.col("logical_offset") + F.col("rows")), F.lit(0))).first()[0]

    def write(self, df: DataFrame, codec: str = "zstd", rows: int = CHUNK_ROWS, **options: int) -> None:
        """Make (row_id, value) the content; a store that is there is replaced by a cut at row 0 and a new generation."""
        if self._generations():
            self.rewind(0)
        self.put(encoded(df, codec, rows, **options), self._generations())

    def append(self, df: DataFrame, codec: str = "zstd", rows: int = CHUNK_ROWS, **options: int) -> None:
        """Add rows, whose ids go on from the last one; the codec may be another one."""
        last = self.chunks().agg(F.coalesce(F.max(F.col("logical_offset") + F.col("rows")), F.lit(0)), F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()
        self.put(encoded(df, codec, rows, last[0], last[1], **options), self._generations())

    def rewind(self, n: int) -> None:
        """Take back the rows from n on, a border of chunks."""
        if self.chunks().where((F.col("logical_offset") < n) & (F.col("logical_offset") + F.col("rows") > n)).limit(1).count():
            raise ValueError("rows are taken back by whole chunks")
        cut = self.spark.range(1).select(*[(F.lit(n) if c == "cut" else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ") for x in SCHEMA.split(", "))])
        self.put(cut, self._generations())

    def scan(self, predicate: Predicate | None = None, mask: Column | None = None, chunk_id: int | None = None, digits: int | None = None) -> DataFrame:
        """(row_id, chunk_id, value) of rows that satisfy predicate and mask; ``digits`` reads no more decimal digits of a byte-sliced chunk."""
        chunks = self.chunks()
        if chunk_id is not None:
            chunks = chunks.where(F.col("chunk_id") == chunk_id)
        if predicate is not None and digits is None:
            chunks = chunks.where(may_hold(predicate))
        rows = decoded(chunks, digits)
        if mask is not None:
            rows = rows.where(mask)
        return rows if predicate is None else rows.where(predicate.to_column(F.col("value")))

    def aggregate(self) -> DataFrame:
        """n, sum, min and max of all rows. Counts and bounds come from the chunks' statistics; only sums decode."""
        known = self.chunks().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.count_if(F.col("least").isNull()).alias("unknown"), F.min("least").alias("least"), F.max("most").alias("most")).first()
        v = F.col("value")
        bounds = [fp.min_(v), fp.max_(v)] if known.unknown else [F.lit(known.least if known.n else fp.INF), F.lit(known.most if known.n else -fp.INF)]
        return self.scan().agg(F.lit(known.n).cast("long").alias("n"), fp.sum_(v).alias("sum"), bounds[0].alias("min"), bounds[1].alias("max"))


def may_hold(predicate: Predicate) -> Column:
    """Whether a chunk can have rows that satisfy the predicate, by its statistics; chunks without are read."""
    least, most = F.col("least"), F.col("most")
    if isinstance(predicate, Eq):
        return least.isNull() | ((least <= predicate.value) & (most >= predicate.value))
    fits = F.lit(True)
    if isinstance(predicate, Range):
        if predicate.start is not None:
            fits &= most >= predicate.start
        if predicate.end is not None:
            fits &= least <= predicate.end
        return least.isNull() | fits
    # Of chunks with one value only, those of another one are read, and all with NaN.
    return least.isNull() | F.col("nan") | (least != predicate.value) | (most != predicate.value)


def decoded(chunks: DataFrame, digits: int | None = None) -> DataFrame:
    """(row_id, chunk_id, value) of chunks, one held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, start, n, codec, options, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                coder = make(codec, **json.loads(options))
                values = coder.decode(data, n, digits) if digits is not None and codec == "buff" else coder.decode(data, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), pa.array(np.full(n, chunk)), pa.array(values)], names=["row_id", "chunk_id", "value"])

    return chunks.select("chunk_id", "logical_offset", "rows", "codec", "options", "data").mapInArrow(run, VALUES)
