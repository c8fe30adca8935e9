"""Command line: python -m floatq.cli COMMAND ... Results are JSON; an existing file is never overwritten."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floatq.functions import fp
from floatq.operators import report, stats, vectors
from floatq.plans import predicate as P
from floatq.sources import container, text
from floatq.sources.codecs import CODECS


def timed(run: Callable[[], DataFrame], times: int) -> dict:
    """Mean nanoseconds of a query whose rows go nowhere, after a run that does not count."""
    run().write.format("noop").mode("overwrite").save()
    spent = []
    for _ in range(times):
        began = time.perf_counter_ns()
        run().write.format("noop").mode("overwrite").save()
        spent.append(time.perf_counter_ns() - began)
    return {"elapsed_time_nanos": sum(spent) / len(spent), "runs": times}


def column(spark: SparkSession, path: str) -> DataFrame:
    return container.read_column(spark, path) if container.os.path.isdir(path) else text.binary(spark, path).drop("path")


def digits_of(df: DataFrame) -> int:
    return stats.detect_precision(df.select(F.col("value").cast("string").alias("s")), "s").first()["digits"]


def options_of(codec: str, digits: int) -> dict[str, int]:
    return {"buff": {"digits": digits}, "sprintz": {"scale": 10**digits}}.get(codec, {})


def create_filter_config(spark: SparkSession, a: argparse.Namespace) -> dict:
    x = {r.p: r.value for r in stats.percentile(column(spark, a.input), [10, 50, 90]).collect()}
    made = {"gt_10": P.above(x[10]), "gt_50": P.above(x[50]), "gt_90": P.above(x[90]), "eq_50": P.Eq(x[50]), "ne_50": P.Ne(x[50])}
    return {k: {"predicate": json.loads(P.to_json(p)), "chunk_id": None, "bitmask": None} for k, p in made.items()}


def create_default_compressor_config(spark: SparkSession, a: argparse.Namespace) -> dict:
    digits = digits_of(column(spark, a.input))
    return {c: {"chunk_rows": a.chunk_rows, "codec": c, "options": options_of(c, digits)} for c in CODECS if digits <= 12 or CODECS[c].exact}


def compress(spark: SparkSession, a: argparse.Namespace) -> dict:
    df = column(spark, a.input)
    began = time.perf_counter_ns()
    container.write_column(df, a.target, a.codec, a.chunk_rows, **options_of(a.codec, digits_of(df)))
    spent = time.perf_counter_ns() - began
    chunks = container.chunks(a.target)
    plain, packed = 8 * sum(c["rows"] for c in chunks), sum(c["size"] for c in chunks)
    return {"compression_elapsed_time_nano_secs": spent, "uncompressed_size": plain, "compressed_size": packed, "compression_ratio": packed / plain if plain else 0.0}


def masked(df: DataFrame, a: argparse.Namespace) -> tuple[DataFrame, P.Predicate]:
    config = text.read_config(a.config)
    if config.get("chunk_id") is not None:
        df = df.where(F.col("chunk_id") == config["chunk_id"])
    if config.get("bitmask") is not None:
        df = df.join(F.broadcast(df.sparkSession.createDataFrame([(r,) for r in config["bitmask"]], "row_id long")), "row_id", "left_semi")
    return df, P.from_json(json.dumps(config["predicate"]))


def filter_(spark: SparkSession, a: argparse.Namespace, values: bool = False) -> dict:
    df, p = masked(column(spark, a.input), a)
    rows = df.where(p.to_column(F.col("value"))).select("row_id", *(["value"] if values else []))
    return timed(lambda: rows, a.n) | {"rows": rows.count()}


def filter_materialize(spark: SparkSession, a: argparse.Namespace) -> dict:
    return filter_(spark, a, True)


def materialize(spark: SparkSession, a: argparse.Namespace) -> dict:
    return timed(lambda: column(spark, a.input).select("row_id", "value"), a.n)


def aggregate(kind: str) -> Callable[[SparkSession, argparse.Namespace], dict]:
    def run(spark: SparkSession, a: argparse.Namespace) -> dict:
        made = {"sum": fp.sum_, "min": fp.min_, "max": fp.max_}[kind]
        query = lambda: column(spark, a.input).agg(made(F.col("value")).alias(kind))
        return timed(query, a.n) | {"result": query().first()[0]}

    return run


def all_(spark: SparkSession, a: argparse.Namespace, done: dict | None = None) -> dict:
    """Every codec over one column: sizes, and times of materialize, sum and max. ``done`` cells stay."""
    df = column(spark, a.input)
    digits, out = digits_of(df), dict(done or {})
    for codec in CODECS:
        if codec in out or not (CODECS[codec].exact or digits <= 12):
            continue
        a.codec, target = codec, f"{a.target}/{codec}"
        b = argparse.Namespace(**vars(a) | {"target": target})
        c = argparse.Namespace(**vars(a) | {"input": target})
        out[codec] = {"compress": compress(spark, b), "materialize": materialize(spark, c), "max": aggregate("max")(spark, c), "sum": aggregate("sum")(spark, c)}
    return out


def all_patch(spark: SparkSession, a: argparse.Namespace) -> dict:
    """As all, but cells of the saved result given by --config stay."""
    return all_(spark, a, text.read_config(a.config))


def ucr(spark: SparkSession, a: argparse.Namespace) -> dict:
    def series(path: str) -> DataFrame:
        # Each file's first line is skipped; a file's place among the paths comes before the line.
        lines = text.numbered_lines(spark, path).where("line > 0")
        files = lines.select("path").distinct().withColumn("file", F.row_number().over(Window.orderBy("path")))
        numbered = lines.join(F.broadcast(files), "path").select((F.shiftleft(F.col("file").cast("long"), 40) + F.col("line")).alias("line"), "value")
        return text.labelled_series(numbered).select(F.col("line").alias("vec_id"), "label", F.col("pixels").alias("embedding"))

    classified = vectors.classify(series(a.input), series(a.target))
    return timed(lambda: classified, a.n) | {"accuracy": vectors.accuracy(classified).first()[0]}


def matrix(spark: SparkSession, a: argparse.Namespace) -> dict:
    n = a.size
    batch = spark.range(40).select(F.col("id").alias("batch"), F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: fp.round_scale((F.pmod(F.xxhash64("id", i), F.lit(1_000_003)) / 1_000_003 - 0.5) * 8, 10**3)).alias("a"))
    target = [[float((i * 3 + j * 5) % 7 - 3) for i in range(n)] for j in range(n)]
    return timed(lambda: vectors.matmul(batch, target, n, n), a.n)


def embedding(spark: SparkSession, a: argparse.Namespace) -> dict:
    df = column(spark, a.input).withColumn("chunk_id", F.expr(f"row_id div {a.chunk_rows}"))
    return {c: timed(lambda c=c: container.round_trip(df, c), a.n) for c in CODECS if CODECS[c].exact}


def tpch(spark: SparkSession, a: argparse.Namespace) -> dict:
    from floatq.queries import QUERIES

    return {k: timed(lambda k=k: QUERIES[k](spark, a.input), a.n) for k in ("tpch_h01", "tpch_h01_simplified", "tpch_h06")}


def friedman(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Ranks of methods over datasets from a Parquet table (dataset, method, metric)."""
    ranks = report.mean_ranks(spark.read.parquet(a.input), "dataset", "method", "metric")
    means = {r.method: r.mean_rank for r in ranks.collect()}
    test = report.friedman(ranks)
    gap = report.critical_difference(test["methods"], test["datasets"])
    return test | {"critical_difference": gap, "cliques": report.cliques(means, gap)}


COMMANDS = {
    "create-filter-config": create_filter_config, "create-default-compressor-config": create_default_compressor_config, "compress": compress, "filter": filter_, "filter-materialize": filter_materialize,
    "materialize": materialize, "max": aggregate("max"), "min": aggregate("min"), "sum": aggregate("sum"), "all": all_, "all-patch": all_patch, "ucr2018": ucr, "matrix": matrix, "embedding": embedding, "tpch": tpch, "friedman": friedman,
}


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="floatq", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--input", "-i", help="column file, container, or folder of tables")
    p.add_argument("--target", "-t", help="container to write, or test series")
    p.add_argument("--config", "-c", help="predicate or saved result")
    p.add_argument("--output", "-o", help="file for the result; else it is printed")
    p.add_argument("--codec", default="zstd", choices=sorted(CODECS))
    p.add_argument("--chunk-rows", type=int, default=container.CHUNK_ROWS)
    p.add_argument("--size", type=int, default=128)
    p.add_argument("-n", type=int, default=5, help="runs that count")
    a = p.parse_args(argv)
    result = COMMANDS[a.command](SparkSession.builder.getOrCreate(), a)
    print(text.save_json(result, a.output) if a.output else json.dumps(result))
    return result


if __name__ == "__main__":
    main()
