from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from floatq.functions import fp
from floatq.operators import report, stats, vectors
from floatq.operators.column import ColumnFrame, mask_and, mask_minus, mask_of, mask_or, mask_range, pack_mask
from floatq.plans import predicate as P
from floatq.plans.aggregation import Aggregation, compute
from floatq.plans.expr import Binary, Col, Lit, checked

I, E, N = P.Bound.INCLUSIVE, P.Bound.EXCLUSIVE, P.Bound.NONE


def readings(n, seed, digits=2, levels=None):
    """Own test values: rounded normal numbers, or draws from a few levels, so that equal values occur."""
    rng = random.Random(seed)
    return [rng.choice(levels) if levels else round(rng.gauss(0, 250), digits) for _ in range(n)]


NORMAL, STEPS = readings(60, 1), readings(75, 2, levels=[-40.5, -0.25, 0.0, 12.75, 13.0, 88.125])
MIDDLE, HIGH = sorted(NORMAL)[30], sorted(NORMAL)[50]
#: (values, rows of a chunk, predicate, the same in Python, rows of the mask, chunk)
FILTERS = [
    (NORMAL, 7, P.at_least(MIDDLE), lambda v: v >= MIDDLE, None, None),
    (NORMAL, 7, P.above(MIDDLE), lambda v: v > MIDDLE, None, None),
    (NORMAL, 9, P.below(MIDDLE), lambda v: v < MIDDLE, range(0, 60, 2), None),
    (NORMAL, 11, P.between(MIDDLE, HIGH), lambda v: MIDDLE <= v <= HIGH, None, None),
    (NORMAL, 11, P.Range(E, MIDDLE, I, HIGH), lambda v: MIDDLE < v <= HIGH, None, 3),
    (NORMAL, 11, P.Range(I, MIDDLE, E, HIGH), lambda v: MIDDLE <= v < HIGH, range(20, 45), 2),
    (NORMAL, 60, P.Range(E, MIDDLE, E, HIGH), lambda v: MIDDLE < v < HIGH, None, 0),
    (NORMAL, 16, P.Range(), lambda v: True, range(5, 60, 7), None),
    (NORMAL, 16, P.Range(), lambda v: True, None, 99),
    (STEPS, 10, P.Eq(13.0), lambda v: v == 13.0, None, None),
    (STEPS, 10, P.Ne(13.0), lambda v: v != 13.0, range(1, 75, 3), None),
    (STEPS, 8, P.Eq(-0.25), lambda v: v == -0.25, range(30, 70), 5),
    (STEPS, 75, P.at_least(12.75), lambda v: v >= 12.75, None, None),
    (STEPS, 4, P.Eq(1.0), lambda v: False, None, None),
    ([*([17.5] * 40), 17.25], 50, P.Ne(17.25), lambda v: v != 17.25, None, None),
    ([31_000_555.75, -4.5, 6.125, 0.5, 6.125, -9e8], 4, P.Eq(6.125), lambda v: v == 6.125, None, None),
]


def chosen(values, chunk, mask, chunk_id):
    return [i for i in range(len(values)) if (mask is None or i in mask) and (chunk_id is None or i // chunk == chunk_id)]


def frame(spark, values, chunk=5):
    return ColumnFrame.of(spark.createDataFrame(list(enumerate(values)), "row_id long, value double"), "value", "row_id", chunk)


@pytest.mark.parametrize("case", range(len(FILTERS)))
def test_filter_matches_plain_loops(spark, case):
    values, chunk, predicate, says, mask, chunk_id = FILTERS[case]
    want = [i for i in chosen(values, chunk, mask, chunk_id) if says(values[i])]
    rows = frame(spark, values, chunk).filter(predicate, None if mask is None else mask_of(spark, list(mask)), chunk_id)
    assert sorted(r.row_id for r in rows.collect()) == want
    both = frame(spark, values, chunk).filter_materialize(predicate, None if mask is None else F.col("row_id").isin(list(mask)), chunk_id)
    assert [(r.row_id, r.value) for r in both.orderBy("row_id").collect()] == [(i, values[i]) for i in want]


def test_materialize_and_aggregate(spark):
    c = frame(spark, NORMAL, 25)
    mask = list(range(3, 60, 4))
    assert [r.value for r in c.materialize(mask_of(spark, mask), 1).orderBy("row_id").collect()] == [NORMAL[i] for i in chosen(NORMAL, 25, mask, 1)]
    last = NORMAL[50:]
    got = c.aggregate(chunk_id=2).first()
    assert got[0] == 10 and math.isclose(got[1], sum(last)) and got[2:] == (min(last), max(last))
    assert tuple(c.aggregate(F.lit(False)).first()) == (0, 0.0, math.inf, -math.inf)
    assert [(r.chunk_id, r.logical_offset, r.number_of_records) for r in c.chunks().orderBy("chunk_id").collect()] == [(0, 0, 25), (1, 25, 25), (2, 50, 10)]


def test_nan_rules(spark):
    c = frame(spark, [1.5, math.nan, math.inf, -0.0, 2.5])
    got = lambda p: sorted(r.row_id for r in c.filter(p).collect())
    assert got(P.Eq(math.nan)) == [] and got(P.Ne(math.nan)) == [0, 1, 2, 3, 4]
    assert got(P.Eq(0.0)) == [3] and got(P.Ne(1.5)) == [1, 2, 3, 4] and got(P.above(1.5)) == [2, 4] and got(P.at_least(math.nan)) == []
    assert c.aggregate().select("min", "max").first() == (-0.0, math.inf)


def test_masks(spark):
    a, b = mask_of(spark, [1, 2, 3]), mask_range(spark, 2, 6)
    rows = lambda m: sorted(r.row_id for r in m.collect())
    assert rows(mask_and(a, b)) == [2, 3] and rows(mask_or(a, b)) == [1, 2, 3, 4, 5] and rows(mask_minus(a, b)) == [1]
    assert pack_mask(mask_range(spark, 0, 40_000)).selectExpr("sum(bitmap_count(bitmap)) AS n").first().n == 40_000


def test_predicates_as_json():
    for p in (P.Eq(1.5), P.Ne(-2.0), P.Range(), P.Range(I, 1.0, N, None), P.Range(E, 1.0, I, 2.0)):
        assert P.from_json(P.to_json(p)) == p
    assert P.Range(I, 1.0, E, 2.0).swap() == P.Range(E, 2.0, I, 1.0) and P.Eq(2.0).map(lambda x: x * 3) == P.Eq(6.0)
    with pytest.raises(ValueError, match="bound"):
        P.Range(I, None)


def test_expressions(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.randrange(-8, 9)), float(rng.randrange(1, 9))) for i in range(17)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    a, b = Col("a"), Col("b")
    got = compute(df, Aggregation("sum", a * b + b, "s"), Aggregation("max", a * b, "m"), Aggregation("min", a - b, "n"), Aggregation("none", 10 * a, "v"), Aggregation("count", a, "c"), Aggregation("avg", b, "g")).first()
    assert tuple(got)[:5] == (sum(x * y + y for _, x, y in rows), max(x * y for _, x, y in rows), min(x - y for _, x, y in rows), [10 * x for _, x, _ in rows], 17)
    assert math.isclose(got.g, sum(y for *_, y in rows) / 17)
    assert compute(df, Aggregation("sum", a, "s"), mask=F.col("row_id").isin(1, 6, 8)).first().s == sum(rows[i][1] for i in (1, 6, 8))
    assert (a * b - 2).columns() == ["a", "b"]
    for wrong in (lambda: checked(Lit(1)), lambda: Binary("+", Lit(1), Lit(2)), lambda: Aggregation("sum", Lit(1), "x")):
        with pytest.raises(ValueError):
            wrong()


def test_ieee_division(spark):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (math.nan, 0.0), (3.0, 2.0), (-math.inf, 0.0), (1.0, math.nan)]
    got = [r.q for r in spark.createDataFrame(pairs, "a double, b double").select(fp.div(F.col("a"), F.col("b")).alias("q")).collect()]
    want = [math.inf, -math.inf, -math.inf, math.nan, math.nan, 1.5, -math.inf, math.nan]
    assert [str(x) for x in got] == [str(x) for x in want]


def test_ieee_division_to_the_bit(spark):
    """As the machine divides, the bits of 0/0 included, also after rounding as in expr_div_ieee."""
    values = [0.0, -0.0, 3.0, -3.0, math.inf, -math.inf, math.nan]
    pairs = pd.DataFrame([(a, b) for a in values for b in values], columns=["a", "b"])
    got = spark.createDataFrame(pairs).select("a", "b", fp.div(F.col("a"), F.col("b")).alias("q"), fp.round_scale(fp.div(F.col("a"), F.col("b")), 10_000).alias("r")).toPandas()
    with np.errstate(all="ignore"):
        want = got.a.to_numpy() / got.b.to_numpy()
    assert len(got) == len(pairs)
    for column in ("q", "r"):
        assert (got[column].to_numpy().view("int64") == want.view("int64")).all(), column


def test_scalar_functions(spark):
    rng = random.Random(3)
    texts = ["7", "-18", "0.0", "45.50", "1.5e2", "25e-4", "-6.25e-2", "9E0"[:1] + "e0"] + [f"{rng.randrange(-999, 999)}.{rng.randrange(10 ** k):0{k}d}{rng.choice(['', 'e-3', 'e2'])}" for k in range(1, 9)]

    def digits(text):
        """By the rule: written digits after the point, less the exponent, none below zero."""
        mantissa, _, exponent = text.partition("e")
        return max(0, len(mantissa.partition(".")[2]) - int(exponent or 0))

    df = spark.createDataFrame([(k,) for k in texts], "s string")
    assert {r.s: r.d for r in df.select("s", fp.decimal_digits(F.col("s")).alias("d")).collect()} == {k: digits(k) for k in texts}
    longs = [0, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, *(rng.randrange(-(1 << 63), 1 << 63) >> rng.randrange(63) for _ in range(40))]
    x = spark.createDataFrame([(v,) for v in longs], "x long").select("x", fp.leading_zeros(F.col("x")).alias("l"), fp.trailing_zeros(F.col("x")).alias("t"), fp.zigzag(F.col("x")).alias("z"), fp.unzigzag(fp.zigzag(F.col("x"))).alias("u"))
    for r in x.collect():
        plain = f"{r.x & (1 << 64) - 1:064b}"
        assert r.l == len(plain) - len(plain.lstrip("0")) and r.t == len(plain) - len(plain.rstrip("0")) and r.u == r.x
        assert r.z & (1 << 64) - 1 == (2 * r.x if r.x >= 0 else -2 * r.x - 1)
    scaled = [(v, s) for v in (1.005, -2.5, 2.675, 0.125, -0.001, 0.0, -0.0, 1e15 + 0.3) for s in (1.0, 10.0, 100.0)]
    rounds = spark.createDataFrame([(v,) for v, _ in scaled[::3]], "v double").select("v", *[fp.round_scale(F.col("v"), s).alias(f"s{int(s)}") for s in (1.0, 10.0, 100.0)])
    for r in rounds.collect():
        for s in (1.0, 10.0, 100.0):
            y = r.v * s
            assert str(r[f"s{int(s)}"]) == str(math.copysign(math.floor(abs(y) + 0.5), y) / s), (r.v, s)


def test_statistics(spark):
    rng = random.Random(4)
    values = [round(rng.uniform(-50, 50), 1) for _ in range(997)]
    df = frame(spark, values, 100).df
    assert {r.p: r.value for r in stats.percentile(df.repartition(7), [0, 10, 50, 90]).collect()} == {p: sorted(values)[len(values) * p // 100] for p in (0, 10, 50, 90)}
    got = stats.xor_zeros(df).first()
    import struct

    b = [struct.unpack("<Q", struct.pack("<d", v))[0] for v in values]
    xs = [p ^ q for p, q in zip(b, b[1:], strict=False)]
    assert math.isclose(got.leading, sum(64 - x.bit_length() for x in xs) / len(xs)) and math.isclose(got.trailing, sum(64 if x == 0 else (x & -x).bit_length() - 1 for x in xs) / len(xs))
    assert tuple(stats.xor_zeros(df.limit(1)).first()) == (64.0, 64.0)
    texts = spark.createDataFrame([("1.25",)] * 3 + [("1.5",)] * 200 + [("1.23456",)], "s string")
    assert stats.detect_precision(texts, "s").first().digits == 2 and stats.detect_precision(texts, "s", exact=True).first().digits == 5
    empty = stats.describe(df.limit(0)).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    exact = [math.frexp(v)[1] - 1 if v else -1023 for v in values]
    got = stats.exponents(df.union(df.limit(1).selectExpr("row_id", "chunk_id", "CAST(NULL AS double)"))).first()
    mean = sum(exact) / len(exact)
    assert (got["min"], got["max"]) == (min(exact), max(exact)) and math.isclose(got["mean"], mean)
    assert math.isclose(got["std"], math.sqrt(sum((e - mean) ** 2 for e in exact) / len(exact)))
    assert tuple(stats.exponents(df.limit(0)).first()) == (0, 0, 0.0, 0.0)


def test_sql_codecs(spark):
    values = [-5.25, -1.01, 0.0, 3.99, 3.99, 3.99, 100.5, 0.01]
    df = frame(spark, values, 4).df
    rows = lambda d: [r.value for r in d.orderBy("row_id").collect()]
    assert rows(stats.byte_sliced_decode(stats.byte_sliced(df, 2), 2)) == [math.trunc(v * 256) / 256 for v in values]
    low = rows(stats.byte_sliced_decode(stats.byte_sliced(df, 2), 2, 0))
    assert all(abs(a - b) < 1 for a, b in zip(low, values, strict=True))
    assert [round(v, 2) for v in rows(stats.delta_decode(stats.delta_coded(df, 100), 100))] == values
    runs = stats.rle_runs(df).orderBy("start").collect()
    assert [(r.chunk_id, r.start, r.length, r.value) for r in runs][3:5] == [(0, 3, 1, 3.99), (1, 4, 2, 3.99)]
    assert {r.chunk_id: r.bytes for r in stats.rle_size(df).collect()} == {0: 44, 1: 35}


def test_vectors(spark):
    rng = random.Random(8)
    points = [(i, [float(rng.randrange(-9, 10)) for _ in range(3)]) for i in range(12)]
    points += [(12, points[4][1]), (13, points[7][1])]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    for target in (points[4][1], points[7][1], [0.5, -0.5, 2.0], [40.0, 0.0, 0.0]):
        d = {i: sum((x - y) ** 2 for x, y in zip(v, target, strict=True)) for i, v in points}
        want = max(i for i in d if d[i] == min(d.values()))
        assert tuple(vectors.knn1(df, target).first()) == (want, d[want])
    rows, inner, columns = 4, 3, 5
    batch = [(b, [float(rng.randrange(-5, 6)) for _ in range(rows * inner)]) for b in range(3)]
    target = [[float(rng.randrange(-5, 6)) for _ in range(inner)] for _ in range(columns)]
    by_rows = [[target[j][k] for j in range(columns)] for k in range(inner)]
    a = spark.createDataFrame(batch, "batch int, a array<double>")
    want = {(b, i, j): sum(m[i * inner + k] * target[j][k] for k in range(inner)) for b, m in batch for i in range(rows) for j in range(columns)}
    for t in (target, vectors.transpose(by_rows)):
        assert {(r.batch, r.i, r.j): r.value for r in vectors.matmul(a, t, rows, inner).collect()} == want
    with pytest.raises(ValueError, match="length"):
        vectors.matmul(a, target, rows, inner + 1)
    flat = vectors.flatten(df, length=3)
    assert [(r.vec_id, r.embedding) for r in vectors.reshape(flat, 3).orderBy("vec_id").collect()] == points


def test_classification_matches_brute_force(spark, monkeypatch):
    """Copies, ties, several blocks, vectors of another length, and rows that are near to nothing."""
    monkeypatch.setattr(vectors, "BLOCK", 70)
    rng = random.Random(12)
    known = [(i, [float(rng.randrange(-3, 4)) for _ in range(6 if i % 9 else 4)], i % 5) for i in range(300)]
    known += [(1000 + i, [1e3 + rng.random() / 1e4 for _ in range(6)], 7) for i in range(40)]
    asked = [(5000 + i, [float(rng.randrange(-3, 4)) + (0.25 if i % 2 else 0.0) for _ in range(6)], i % 5) for i in range(150)]
    asked += [(6000 + i, v, 7) for i, v, _ in known[-20:]] + [(7000, None, 1), (7001, [math.nan] * 6, 1), (5000, asked[0][1], 0)]
    odd = [(2000, None, 1), (2001, [math.nan] * 6, 2), (2002, [math.inf] * 6, 3)]
    kind = "vec_id long, embedding array<double>, label int"
    got = vectors.classify(spark.createDataFrame(known + odd, kind), spark.createDataFrame(asked, kind)).collect()

    def predicted(v):
        if v is None or not all(map(math.isfinite, v)):
            return None
        return min(known, key=lambda r: (sum((x - y) * (x - y) for x, y in zip(r[1], v, strict=False)), -r[0]))[2]

    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    assert sorted(map(tuple, got), key=key) == sorted(((i, n, predicted(v)) for i, v, n in asked), key=key)
    assert vectors.classify(spark.createDataFrame([], kind), spark.createDataFrame(asked[:2], kind)).select("predicted").collect() == [(None,)] * 2


def test_reports(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("x", "c", 2.0), ("y", "a", 3.0), ("y", "b", 1.0), ("y", "c", 2.0)], "dataset string, method string, metric double")
    ranks = {r.method: r.mean_rank for r in report.mean_ranks(df, "dataset", "method", "metric").collect()}
    assert ranks == {"a": 2.0, "b": 1.75, "c": 2.25}
    top = {r.dataset: (r.method, r.metric) for r in report.best_per_row(df, "dataset", "method", "metric", True).collect()}
    assert top == {"x": ("b", 2.0), "y": ("a", 3.0)}
    low = {r.dataset: (r.method, r.metric) for r in report.best_per_row(df, "dataset", "method", "metric").collect()}
    assert low == {"x": ("a", 1.0), "y": ("b", 1.0)}
    assert report.without_gaps(df.where("method <> 'c' OR dataset = 'x'"), "dataset", "method").count() == 3
    assert abs(report.chi_square_tail(3.841459, 1) - 0.05) < 1e-6 and abs(report.chi_square_tail(18.307, 10) - 0.05) < 1e-5 and report.chi_square_tail(0, 3) == 1
    assert report.cliques({"a": 1.0, "b": 1.5, "c": 2.2, "d": 4.0}, 1.0) == [["a", "b"], ["b", "c"]]
    assert 0 < report.friedman(report.mean_ranks(df, "dataset", "method", "metric"))["p_value"] <= 1


def test_reports_of_several_metrics(spark):
    rng = random.Random(10)
    rows = [(d, m, float(rng.randrange(5)), float(rng.randrange(5))) for d in "pqr" for m in "wxyz"]
    df = spark.createDataFrame(rows, "dataset string, method string, small double, large double")

    def place(values, v, descending):
        better = sum(o > v if descending else o < v for o in values)
        return better + (sum(o == v for o in values) + 1) / 2

    want = {(d, m): (place([r[2] for r in rows if r[0] == d], a, False) + place([r[3] for r in rows if r[0] == d], b, True)) / 2 for d, m, a, b in rows}
    assert {(r.dataset, r.method): r["rank"] for r in report.rank_matrix(df, "dataset", "method", {"small": False, "large": True}).collect()} == want
    assert [r.method for r in report.in_order(df.select("method").distinct(), "method", ["y", "w"]).collect()] == ["y", "w", "x", "z"]
    names = spark.createDataFrame([("a/matrix_128_p3.json",), ("notes.txt",)], "file string")
    assert [tuple(r)[1:] for r in report.from_name(names, "file", r"matrix_(\d+)_p(\d+)", ["side", "digits"]).orderBy("file").collect()] == [(128, 3), (None, None)]


def test_previous_values_over_spans_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(stats, "SPAN", 3)
    rows = [(i, i // 4, float(i * i % 17)) for i in range(100) if i // 4 not in (2, 3, 4, 5, 6, 11)]
    df = spark.createDataFrame(rows, "row_id long, chunk_id long, value double").repartition(5)
    got = {r.row_id: r.before for r in stats.with_previous(df, "value", "before").collect()}
    assert got == {r[0]: p for r, p in zip(rows, [None, *(v for *_, v in rows)], strict=False)}


def test_positions_in_several_files(spark, tmp_path):
    spark.range(1000).selectExpr("id * 2.0 AS x").repartition(4).write.parquet(f"{tmp_path}/t")
    rows = ColumnFrame.parquet(spark, f"{tmp_path}/t", "x", 100).df.orderBy("row_id").collect()
    in_order = [x for f in sorted((tmp_path / "t").glob("*.parquet")) for x in spark.read.parquet(str(f)).toPandas().x.tolist()]
    assert [r.row_id for r in rows] == list(range(1000)) and [r.value for r in rows] == in_order


def test_iterate_in_order(spark):
    c = frame(spark, NORMAL, 7)
    c.df = c.df.repartition(5)
    assert list(c.iterate()) == list(enumerate(NORMAL)) and list(c.iterate(F.col("row_id") > 3, 1)) == list(enumerate(NORMAL))[7:14]
