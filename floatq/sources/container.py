"""The chunked container of a float column, as a Spark data source (format ``floatq``).

A container is a folder: data files with the encoded chunks one after another, and a manifest that the
driver writes at commit and that makes the chunks visible. The manifest names the codec and, for each chunk, its file, place,
number of rows, first position, and least and greatest value, so a scan reads only the chunks that a
filter on chunk_id, row_id or value can need, one task each. The folder must be reachable from all executors.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .codecs import make

MAGIC, VERSION, MANIFEST = "FQC1", 1, "_manifest.json"
SCHEMA = "row_id bigint, chunk_id bigint, value double"
#: Rows of a chunk: large enough to compress, small enough to decode in parallel.
CHUNK_ROWS = 65_536


def chunk_rows(kind: str, n: int | None = None) -> int | None:
    """Rows of a chunk by policy: full (None: all rows), record_count, or byte_size (best effort)."""
    if kind == "full":
        return None
    if n is None or n <= 0:
        raise ValueError("a chunk needs a positive size")
    if kind == "record_count":
        return n
    if kind == "byte_size":
        return math.ceil(n * 1.5 / 8)
    raise ValueError(f"unknown chunk policy {kind}")


def _manifest(path: str) -> dict:
    with open(os.path.join(path, MANIFEST), encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("magic") != MAGIC or spec.get("version") != VERSION:
        raise ValueError(f"{path} is no container of this version")
    return spec


def _swap(path: str, spec: dict) -> None:
    """Replace the manifest by a rename, so there is always a whole one."""
    temporary = os.path.join(path, f".{MANIFEST}.{uuid.uuid4().hex}")
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    os.replace(temporary, os.path.join(path, MANIFEST))


@dataclass
class Chunk(InputPartition):
    file: str
    offset: int
    size: int
    rows: int
    logical_offset: int
    chunk_id: int
    codec: str
    options: dict


@dataclass
class Written(WriterCommitMessage):
    chunks: list


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, digits: int | None) -> None:
        self.path, self.digits = path, digits
        self.tests: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters choose chunks; Spark applies all of them to the rows again."""
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in ops and len(f.attribute) == 1 and not isinstance(f.value, str):
                self.tests.append((f.attribute[0], ops[type(f)], f.value))
            yield f

    def _needed(self, c: dict) -> bool:
        spans = {"chunk_id": (c["chunk_id"], c["chunk_id"]), "row_id": (c["logical_offset"], c["logical_offset"] + c["rows"] - 1)}
        if c["min"] is not None and not c["nan"]:
            spans["value"] = (c["min"], c["max"])
        for column, op, x in self.tests:
            if column in spans and x is not None:
                lo, hi = spans[column]
                if not {"=": lo <= x <= hi, ">": hi > x, ">=": hi >= x, "<": lo < x, "<=": lo <= x}[op]:
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        spec = _manifest(self.path)
        options = dict(spec["options"])
        keys = ("file", "offset", "size", "rows", "logical_offset", "chunk_id")
        return [Chunk(*(c[k] for k in keys), spec["codec"], options) for c in spec["chunks"] if self._needed(c)]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        if chunk is None:
            return
        with open(os.path.join(self.path, chunk.file), "rb") as f:
            f.seek(chunk.offset)
            data = f.read(chunk.size)
        codec = make(chunk.codec, **chunk.options)
        values = codec.decode(data, chunk.rows, self.digits) if self.digits is not None and chunk.codec == "buff" else codec.decode(data, chunk.rows)
        rows = np.arange(chunk.logical_offset, chunk.logical_offset + chunk.rows)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(chunk.rows, chunk.chunk_id)), pa.array(values)], names=["row_id", "chunk_id", "value"])


class ContainerWriter(DataSourceArrowWriter):
    """Each task writes one file of the chunks it gets; rows must come sorted by row_id within a chunk."""

    def __init__(self, path: str, codec: str, options: dict, overwrite: bool) -> None:
        self.path, self.codec, self.options, self.overwrite = path, codec, options, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        codec, chunks, name, at = make(self.codec, **self.options), [], f"data-{uuid.uuid4().hex}.bin", 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now: int | None = None
        with open(os.path.join(self.path, name), "wb") as f:

            def flush() -> int:
                rows, values = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(rows, kind="stable")
                data = codec.encode(values[order])
                f.write(data)
                numbers = values[~np.isnan(values)]
                bounds = {"min": float(numbers.min()), "max": float(numbers.max())} if len(numbers) and np.isfinite(numbers).all() and codec.exact else {"min": None, "max": None}
                chunks.append({"file": name, "offset": at, "size": len(data), "rows": len(values), "logical_offset": int(rows.min()), "chunk_id": now, "nan": len(numbers) < len(values)} | bounds)
                held.clear()
                return len(data)

            for batch in batches:
                ids, rows, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk_id", "row_id", "value"))
                cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
                for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                    if held and ids[lo] != now:
                        at += flush()
                    now = int(ids[lo])
                    held.append((rows[lo:hi].copy(), values[lo:hi].copy()))
            if held:
                at += flush()
        if not chunks:
            os.remove(os.path.join(self.path, name))
        return Written(chunks)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        chunks = sorted((c for m in messages if m for c in m.chunks), key=lambda c: c["chunk_id"])
        if not self.overwrite and os.path.exists(os.path.join(self.path, MANIFEST)):
            old = _manifest(self.path)
            if old["codec"] != self.codec or old["options"] != self.options:
                raise ValueError("rows are appended with the codec of the container")
            chunks = sorted(old["chunks"] + chunks, key=lambda c: c["chunk_id"])
        if len({c["chunk_id"] for c in chunks}) < len(chunks):
            raise ValueError("two tasks wrote rows of one chunk; write through write_column")
        spec = {"magic": MAGIC, "version": VERSION, "codec": self.codec, "options": self.options, "number_of_records": sum(c["rows"] for c in chunks), "number_of_chunks": len(chunks), "chunks": chunks}
        before = {c["file"] for c in _manifest(self.path)["chunks"]} if os.path.exists(os.path.join(self.path, MANIFEST)) else set()
        _swap(self.path, spec)
        # Only files that the manifest named before, so another writer keeps its own.
        for name in before - {c["file"] for c in chunks}:
            if os.path.exists(os.path.join(self.path, name)):
                os.remove(os.path.join(self.path, name))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for name in {c["file"] for m in messages if m for c in m.chunks}:
            if os.path.exists(os.path.join(self.path, name)):
                os.remove(os.path.join(self.path, name))


class Container(DataSource):
    """Options: path, codec, scale or digits or level of the codec; read_digits for controlled precision."""

    @classmethod
    def name(cls) -> str:
        return "floatq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        digits = self.options.get("read_digits")
        return ContainerReader(self.options["path"], None if digits is None else int(digits))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        options = {k: int(self.options[k]) for k in ("scale", "digits", "level") if k in self.options}
        return ContainerWriter(self.options["path"], self.options.get("codec", "zstd"), options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Container)


def write_column(df: DataFrame, path: str, codec: str = "zstd", rows: int | None = CHUNK_ROWS, mode: str = "overwrite", **options: int) -> None:
    """Write (row_id, value) as a container with ``rows`` rows a chunk (None: one chunk).

    All rows of a chunk go to one task; chunks are dealt evenly over the tasks.
    """
    register(df.sparkSession)
    chunk = F.lit(0).cast("long") if rows is None else F.expr(f"row_id div {int(rows)}")
    out = df.select(F.col("row_id").cast("long"), chunk.alias("chunk_id"), F.col("value").cast("double").alias("value"))
    writer = out.repartition("chunk_id").sortWithinPartitions("chunk_id", "row_id").write.format("floatq").mode(mode).option("path", path).option("codec", codec)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()


def read_column(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(row_id, chunk_id, value); filters reach the chunks if spark.sql.python.filterPushdown.enabled is true."""
    register(spark)
    reader = spark.read.format("floatq").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def chunks(path: str) -> list[dict]:
    """Metadata of the chunks."""
    return _manifest(path)["chunks"]


def rewind(path: str, n: int) -> None:
    """Forget the chunks that begin at or after row n; n must be a chunk border."""
    spec = _manifest(path)
    keep = [c for c in spec["chunks"] if c["logical_offset"] < n]
    if any(c["logical_offset"] + c["rows"] > n for c in keep):
        raise ValueError("rows are taken back by whole chunks")
    spec |= {"chunks": keep, "number_of_chunks": len(keep), "number_of_records": sum(c["rows"] for c in keep)}
    _swap(path, spec)


def delete(path: str) -> None:
    """Remove a container, and nothing else."""
    _manifest(path)
    shutil.rmtree(path)


def _coded(df: DataFrame, codec: str, options: dict, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.Table] | pa.Table) -> pa.Table:
        values = batches.sort_by("row_id")
        return row(make(codec, **options), values)

    return df.groupBy("chunk_id").applyInArrow(run, schema)


def encoded_sizes(df: DataFrame, codec: str, **options: int) -> DataFrame:
    """(chunk_id, rows, bytes) that the codec would make of each chunk."""

    def row(c, t: pa.Table) -> pa.Table:
        values = t.column("value").to_numpy()
        return pa.table({"chunk_id": t.column("chunk_id")[:1], "rows": [len(values)], "bytes": [len(c.encode(values))]})

    return _coded(df, codec, options, "chunk_id long, rows long, bytes long", row)


def sizes_by_codec(df: DataFrame, codecs: dict[str, dict]) -> DataFrame:
    """(chunk_id, codec, rows, bytes) for several codecs, given with their options: each chunk is shuffled and held once."""

    def run(table: pa.Table) -> pa.Table:
        values = table.sort_by("row_id").column("value").to_numpy()
        sizes = [len(make(c, **options).encode(values)) for c, options in codecs.items()]
        n = len(codecs)
        return pa.table({"chunk_id": pa.array([table.column("chunk_id")[0].as_py()] * n, pa.int64()), "codec": list(codecs), "rows": [len(values)] * n, "bytes": sizes})

    return df.groupBy("chunk_id").applyInArrow(run, "chunk_id long, codec string, rows long, bytes long")


def round_trip(df: DataFrame, codec: str, **options: int) -> DataFrame:
    """The rows after encoding and decoding each chunk."""

    def row(c, t: pa.Table) -> pa.Table:
        values = t.column("value").to_numpy()
        return pa.table({"row_id": t.column("row_id"), "chunk_id": t.column("chunk_id"), "value": c.decode(c.encode(values), len(values))})

    return _coded(df, codec, options, "row_id long, chunk_id long, value double", row)
