from __future__ import annotations

import json
import math
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from floatq import cli
from floatq.plans import predicate as P
from floatq.sources import container, text
from floatq.sources.bits import Reader, leading, pack, trailing, unpack
from floatq.sources.chunkstore import ChunkStore, may_hold
from floatq.sources.codecs import CODECS, ByteSliced, XorCodec, make, raw_bits, register
from floatq.streaming.ingest import ingest

RNG = np.random.default_rng(3)
SPECIAL = np.array([0.0, -0.0, np.nan, np.inf, -np.inf, 1e-310, 5e-324, 1.7e308, -1.5, 100.19, 0.1, 1e22, 123456.789])
COLUMNS = {
    "cents": np.round(RNG.random(1003) * 500 - 100, 2), "repeats": np.repeat(np.round(RNG.random(50), 1), RNG.integers(1, 600, 50)), "constant": np.full(300, 100.19), "normal": RNG.normal(0, 1, 1025),
    "doubling": np.append(1.1 * 2.0 ** np.arange(1000), [np.inf] * 30), "special": SPECIAL, "empty": np.zeros(0), "one": np.array([3.3]),
}


@pytest.mark.parametrize("name", CODECS)
def test_codecs_round_trip(name):
    codec = make(name)
    for label, values in COLUMNS.items():
        if not codec.exact and label in ("doubling", "special", "normal"):
            continue
        got = codec.decode(codec.encode(values), len(values))
        assert len(got) == len(values)
        if codec.exact:
            assert (raw_bits(got) == raw_bits(values)).all(), label
        else:
            assert np.abs(got - values).max(initial=0) < 0.0051, label


def test_inexact_codecs_check_their_range():
    for name in ("buff", "sprintz"):
        for bad in (np.array([np.nan]), np.array([1e300])):
            with pytest.raises(ValueError):
                make(name).encode(bad)


def test_controlled_precision_reads_fewer_columns():
    values = np.round(RNG.random(100) * 1000, 5)
    codec = ByteSliced(5)
    data = codec.encode(values)
    assert np.abs(codec.decode(data, 100, 1) - values).max() < 0.1


def test_bits():
    assert pack([5, 1, 0xFFFFFFFFFFFFFFFF], [3, 1, 64])[:2] == bytes([0b10111111, 0xFF])
    r = Reader(pack([5, 1, 77], [3, 1, 64]))
    assert (r.read(3), r.read(1), r.read(64)) == (5, 1, 77)
    assert unpack(pack(np.arange(20), np.full(20, 5)), 5, 20).tolist() == list(range(20))
    x = np.array([0, 1, 8, 1 << 63, (1 << 64) - 1], np.uint64)
    assert leading(x).tolist() == [64, 63, 60, 0, 0] and trailing(x).tolist() == [64, 0, 3, 63, 0]


def column(spark, values):
    return spark.createDataFrame(list(enumerate(np.asarray(values).tolist())), "row_id long, value double")


def test_container(spark, tmp_path):
    values, path = np.round(np.arange(1000) * 0.37, 2), str(tmp_path / "c")
    container.write_column(column(spark, values).repartition(5), path, "chimp", 128)
    df = container.read_column(spark, path)
    rows = df.orderBy("row_id").collect()
    assert [r.value for r in rows] == values.tolist() and [r.chunk_id for r in rows] == [i // 128 for i in range(1000)]
    assert df.where("chunk_id = 3").rdd.getNumPartitions() == 1 and df.where("chunk_id = 3").count() == 128
    assert df.where("value > 365.0").rdd.getNumPartitions() == 1 and df.where("chunk_id = 99").count() == 0
    assert [c["logical_offset"] for c in container.chunks(path)] == list(range(0, 1000, 128))
    container.write_column(column(spark, [1.0]).selectExpr("row_id + 1024 AS row_id", "value"), path, "chimp", 128, "append")
    assert container.read_column(spark, path).count() == 1001
    container.rewind(path, 256)
    assert container.read_column(spark, path).count() == 256
    with pytest.raises(ValueError, match="whole chunks"):
        container.rewind(path, 100)
    with pytest.raises(Exception, match="codec of the container"):
        container.write_column(column(spark, [1.0]).selectExpr("row_id + 9999 AS row_id", "value"), path, "zstd", 128, "append")
    container.delete(path)
    assert not Path(path).exists()


def test_chunk_policies():
    assert (container.chunk_rows("full"), container.chunk_rows("record_count", 7), container.chunk_rows("byte_size", 5274)) == (None, 7, 989)
    with pytest.raises(ValueError):
        container.chunk_rows("record_count", 0)


def test_round_trip_and_sizes(spark):
    df = column(spark, COLUMNS["cents"]).selectExpr("row_id", "row_id div 100 AS chunk_id", "value")
    assert sorted(container.round_trip(df, "alp").collect()) == sorted(df.collect())
    assert container.encoded_sizes(df, "uncompressed").selectExpr("sum(bytes) AS b").first().b == 8 * 1003


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(struct.pack("<3d", 1.5, -2.0, 3.25) + b"abc")
    assert [(r.row_id, r.value) for r in text.binary(spark, str(tmp_path / "x.bin")).collect()] == [(0, 1.5), (1, -2.0), (2, 3.25)]
    df = spark.sql("SELECT CAST(1.25 AS DECIMAL(9, 2)) AS b, 2 AS a, 'x' AS s UNION ALL SELECT NULL, 3, 'y'")
    got = text.numeric_columns(df)
    assert got.columns == ["a", "b"] and str([tuple(r) for r in got.collect()]) == "[(2.0, 1.25), (3.0, nan)]"
    with pytest.raises(ValueError, match="type"):
        text.numeric_columns(spark.sql("SELECT current_date() AS d"))
    a, b = text.save_json({"x": 1}, tmp_path / "r.json"), text.save_json({"x": 2}, tmp_path / "r.json")
    assert (a.name, b.name) == ("r.json", "r-1.json") and text.read_config(str(a)) == {"x": 1}
    assert text.synthetic_sums(spark, 10).count() == 10


def test_ingest(spark, tmp_path):
    column(spark, np.arange(50.0)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, value double").parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), "rle", 16).awaitTermination()
    assert container.read_column(spark, str(tmp_path / "out/batch-000000000")).count() == 50


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "x.bin").write_bytes(np.round(np.arange(100) * 0.25, 2).tobytes())
    source, target = str(tmp_path / "x.bin"), str(tmp_path / "c")
    config = cli.main(["create-filter-config", "-i", source])
    assert config["gt_50"]["predicate"]["predicate"]["start"] == {"Exclusive": 12.5}
    (tmp_path / "f.json").write_text(json.dumps(config["gt_50"]))
    assert cli.main(["compress", "-i", source, "-t", target, "--codec", "sprintz"])["compression_ratio"] < 1
    assert cli.main(["filter", "-i", target, "-c", str(tmp_path / "f.json"), "-n", "1"])["rows"] == 49
    assert cli.main(["max", "-i", target, "-n", "1"])["result"] == 24.75


def stored_values(store, **how):
    return [(r.row_id, r.chunk_id, r.value) for r in store.scan(**how).orderBy("row_id").collect()]


@pytest.mark.parametrize("codec", ["gorilla", "rle", "zstd"])
def test_chunk_store(spark, tmp_path, codec):
    values = [*np.round(RNG.normal(0, 50, 400), 2).tolist(), math.nan, math.inf, -0.0, *np.linspace(500, 600, 97).tolist()]
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, value double").repartition(7)
    store = ChunkStore(spark, f"{tmp_path}/column")
    assert store.count() == 0 and store.chunks().collect() == [] and stored_values(store) == []
    store.write(df.where("row_id < 300"), codec, 64)
    # The last chunk has 44 rows; what follows begins a chunk of its own.
    store.append(df.where("row_id >= 300"), "zstd", 50)
    chunk = lambda i: i // 64 if i < 300 else 5 + (i - 300) // 50
    every = [(i, chunk(i), v) for i, v in enumerate(values)]
    assert str(stored_values(store)) == str(every) and store.count() == 500
    for predicate, says in ((P.above(499.5), lambda v: v > 499.5), (P.between(-10, 10), lambda v: -10 <= v <= 10), (P.Eq(values[7]), lambda v: v == values[7]), (P.Ne(values[7]), lambda v: v != values[7]), (P.Range(), lambda v: True)):
        assert str(stored_values(store, predicate=predicate)) == str([r for r in every if says(r[2])])
        assert str(stored_values(store, predicate=predicate, mask=F.col("row_id") % 2 == 0, chunk_id=2)) == str([r for r in every if says(r[2]) and r[0] % 2 == 0 and r[1] == 2])
    got = store.aggregate().first()
    assert (got["n"], got["min"], got["max"]) == (500, min(v for v in values if v == v), math.inf) and math.isnan(got["sum"])
    with pytest.raises(ValueError, match="whole chunks"):
        store.rewind(70)
    store.rewind(128)
    assert str(stored_values(store)) == str(every[:128])
    store.append(df.where("row_id >= 128"), codec, 500)
    assert [r[0] for r in stored_values(store)] == list(range(500)) and store.chunks().count() == 3
    (tmp_path / "column" / "generation=4").mkdir()  # of a job that failed
    assert store.count() == 500
    store.write(df.where("row_id < 10"), codec, 4)
    assert str(stored_values(store)) == str([(i, i // 4, values[i]) for i in range(10)])


def test_chunk_store_prunes_by_statistics(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS row_id", "CAST(id AS double) AS value")
    store = ChunkStore(spark, f"{tmp_path}/column")
    store.write(df, "gorilla", 100)
    plan = store.scan(P.between(250, 260))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(most,250.0)" in plan and "LessThanOrEqual(least,260.0)" in plan
    assert store.chunks().where(may_hold(P.between(250, 260))).count() == 1
    empty = ChunkStore(spark, f"{tmp_path}/empty")
    empty.write(df.limit(0), "gorilla", 100)
    assert tuple(empty.aggregate().first()) == (0, 0.0, math.inf, -math.inf)


def test_a_codec_can_be_added():
    class Halves(CODECS["uncompressed"]):
        """Values as 32-bit floats where that loses nothing."""

        name = "halves"

        def encode(self, values):
            small = values.astype("<f4")
            return b"s" + small.tobytes() if (raw_bits(small.astype(float)) == raw_bits(values)).all() else b"l" + super().encode(values)

        def decode(self, data, n):
            return np.frombuffer(data[1:], "<f4", n).astype(float) if data[:1] == b"s" else super().decode(data[1:], n)

    register(Halves)
    try:
        for values in (np.array([0.5, -2.25]), np.array([0.1])):
            assert make("halves").decode(make("halves").encode(values), len(values)).tolist() == values.tolist()
    finally:
        CODECS.pop("halves")


def test_files_of_text_in_order(spark, tmp_path):
    """Lines and fields keep their order over splits and files."""
    rng = np.random.default_rng(5)
    want = {}
    for name in ("b", "a"):
        rows = [[round(float(x), 3) for x in rng.normal(0, 9, rng.integers(0, 7))] for _ in range(700)]
        (tmp_path / f"{name}.csv").write_text("\n".join(", ".join(map(str, r)) if k % 5 else ",".join(f" {x} ," for x in r) for k, r in enumerate(rows)) + "\n")
        want[name] = [x for r in rows for x in r]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = text.numbered_lines(spark, str(tmp_path)).collect()
        got = text.csv_files(spark, f"{tmp_path}/*.csv").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in want:
        mine = sorted((r.line, r.value) for r in lines if r.path.endswith(f"{name}.csv"))
        assert [v for _, v in mine] == (tmp_path / f"{name}.csv").read_text().splitlines() and [k for k, _ in mine] == list(range(len(mine)))
        values = sorted((r.row_id, r.value) for r in got if r.path.endswith(f"{name}.csv"))
        assert [k for k, _ in values] == list(range(len(values))) and [v for _, v in values] == want[name]
    (tmp_path / "bad.txt").write_text("1.5,x\n")
    with pytest.raises(Exception, match="CAST"):
        text.csv_files(spark, f"{tmp_path}/bad.txt").collect()


def test_all_commands(spark, tmp_path, capsys):
    """Every command once, on small inputs."""
    values = np.round(RNG.normal(20, 5, 300), 1)
    (tmp_path / "x.bin").write_bytes(values.tobytes())
    source, target = str(tmp_path / "x.bin"), str(tmp_path / "c")
    (tmp_path / "f.json").write_text(json.dumps(cli.main(["create-filter-config", "-i", source])["ne_50"]))
    made = cli.main(["create-default-compressor-config", "-i", source, "--chunk-rows", "64"])
    assert made["buff"] == {"chunk_rows": 64, "codec": "buff", "options": {"digits": 1}} and set(made) == set(CODECS)
    cli.main(["compress", "-i", source, "-t", target, "--codec", "gorilla", "--chunk-rows", "64"])
    middle = sorted(values)[150]
    assert cli.main(["filter-materialize", "-i", target, "-c", str(tmp_path / "f.json"), "-n", "1"])["rows"] == int((values != middle).sum())
    assert cli.main(["materialize", "-i", target, "-n", "1"])["runs"] == 1
    assert cli.main(["min", "-i", target, "-n", "1"])["result"] == values.min()
    assert math.isclose(cli.main(["sum", "-i", target, "-n", "1"])["result"], values.sum())
    assert cli.main(["embedding", "-i", source, "-n", "1", "--chunk-rows", "100"]).keys() == {c for c in CODECS if CODECS[c].exact}
    for name, shift in (("train", 0.0), ("test", 0.1)):
        (tmp_path / f"{name}.tsv").write_text("header\t0\n" + "\n".join(f"{k % 3}\t{k % 3 + shift}\t{k % 3 * 2}\tNaN" for k in range(12)))
    assert cli.main(["ucr2018", "-i", f"{tmp_path}/train.tsv", "-t", f"{tmp_path}/test.tsv", "-n", "1"])["accuracy"] == 1.0
    assert cli.main(["matrix", "--size", "4", "-n", "1"])["elapsed_time_nanos"] > 0
    assert len(cli.main(["tpch", "-i", "/root/testdata/sf0.001", "-n", "1"])) == 3
    spark.createDataFrame([(d, m, float((d + m) % 4)) for d in range(6) for m in range(3)], "dataset long, method long, metric double").write.parquet(f"{tmp_path}/ranks")
    got = cli.main(["friedman", "-i", f"{tmp_path}/ranks"])
    assert got["methods"] == 3 and got["datasets"] == 6 and 0 < got["p_value"] <= 1
    out = str(tmp_path / "all.json")
    every = cli.main(["all", "-i", source, "-t", str(tmp_path / "all"), "-n", "1", "-o", out])
    assert set(every) == set(CODECS) and every["rle"]["compress"]["uncompressed_size"] == 2400
    kept = dict(list(every.items())[2:])
    (tmp_path / "some.json").write_text(json.dumps(kept))
    again = cli.main(["all-patch", "-i", source, "-t", str(tmp_path / "all2"), "-n", "1", "-c", str(tmp_path / "some.json")])
    assert set(again) == set(CODECS) and all(again[c] == kept[c] for c in kept)


def test_a_xor_coder_can_be_added():
    class Bytes(XorCodec):
        """Four bits for the number of low bytes, then these."""

        name = "xor_bytes"

        def fields(self, x):
            size = (71 - leading(x)) // 8
            return np.stack([size.astype(np.uint64), x], axis=1), np.stack([np.full(len(x), 4), 8 * size], axis=1)

        def xors(self, r, n):
            for _ in range(n):
                yield r.read(8 * r.read(4))

    register(Bytes)
    try:
        for values in COLUMNS.values():
            coded = make("xor_bytes").encode(values)
            assert (raw_bits(make("xor_bytes").decode(coded, len(values))) == raw_bits(values)).all()
    finally:
        CODECS.pop("xor_bytes")
