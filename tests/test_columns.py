"""Column helpers against values written by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import windows as W


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


# Amounts as printed and what they mean.
@pytest.mark.parametrize("cell, want", [("45.535.942.846.453", 45535942846453.0), ("53,263,331,043", 53263331043.0), ("(265.267.561.842)", -265267561842.0), ("-", 0.0), ("", None), ("V.1", None), ("12.34.567", None), ("0", 0.0), ("-15", -15.0), ("1,5", 1.5), (None, None), ("(5", -5.0), ("5)", -5.0), ("_", 0.0), ("--", None), ("1.5.5", None), (" 1 000 ", 1000.0)])
def test_parse_amount(spark, cell, want):
    assert values(spark, [(cell,)], "c string", C.parse_amount(F.col("c"))) == [(want,)]


def test_division_needs_a_positive_denominator(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (None, 2.0), (1.0, None)]
    assert [x[0] for x in values(spark, rows, "a double, b double", C.safe_div(F.col("a"), F.col("b")))] == [0.5, None, None, None, None]


def test_clip_keeps_missing(spark):
    assert values(spark, [(None,), (9.0,), (-9.0,)], "a double", C.clip(F.col("a"), -1, 5)) == [(None,), (5.0,), (-1.0,)]


def test_fold(spark):
    rows = [("  Tổng CỘNG tài sản ",), ("Đường đi",), ("été",), ("a b",)]
    assert [x[0] for x in values(spark, rows, "a string", C.fold(F.col("a")))] == ["tong cong tai san", "duong di", "ete", "a b"]


# How figures of each unit are worded.
@pytest.mark.parametrize("value, unit, vi, en", [(62848794230018.0, "vnd", "62.849 tỷ đồng", "VND 62,849 bn"), (0.1943, "pct", "19,4%", "19.4%"), (0.876, "x", "0,88 lần", "0.88x"), (61.2, "days", "61 ngày", "61 days"), (-2.46, "score", "-2,46", "-2.46"), (0.612, "pctile", "phân vị 61", "percentile 61"), (1.0, "pctile", "phân vị 100", "percentile 100"), (0.0, "pp", "0,0 điểm %", "0.0 pp"), (0.05, "pp", "+5,0 điểm %", "+5.0 pp"), (-0.05, "pp", "-5,0 điểm %", "-5.0 pp"), (-2e9, "vnd", "-2 tỷ đồng", "VND -2 bn")])
def test_format(spark, value, unit, vi, en):
    assert values(spark, [(value, unit)], "v double, u string", C.format_metric(F.col("v"), F.col("u"), "vi"), C.format_metric(F.col("v"), F.col("u"), "en")) == [(vi, en)]


def test_average_ranks_of_ties(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", -3.0)]
    x = W.with_ranks(spark.createDataFrame(rows, "g string, v double"), "v", ["g"])
    assert sorted((r.g, r.pct, r.share_below, r.peers) for r in x.collect()) == [("a", 0.25, 0.25, 4), ("a", 0.625, 0.75, 4), ("a", 0.625, 0.75, 4), ("a", 1.0, 1.0, 4), ("b", 1.0, 1.0, 1)]


def test_quantiles_of_any_group(spark):
    import numpy as np

    r = np.random.default_rng(4)
    groups = {"spread": r.standard_normal(3000) * 10.0 ** r.integers(-8, 9, 3000), "ties": r.integers(-3, 4, 3000) / 2, "one": np.array([7.5]), "equal": np.full(500, -2.0), "zero": np.array([0.0, -0.0, 1e-300, -1e-300])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.1, 0.5, 0.8, 1.0]
    got = {x.g: x.quantiles for x in W.group_quantiles(df, "v", ["g"], shares).collect()}
    for g, x in groups.items():
        assert np.allclose(got[g], np.quantile(x, shares), rtol=1e-12), g
    radius = {x.g: x.radius for x in W.conformal_radius(df, "v", ["g"]).collect()}
    for g, x in groups.items():
        assert radius[g] == np.sort(x)[min(int(np.ceil((len(x) + 1) * 0.8)) - 1, len(x) - 1)], g


def test_group_without_calibration_takes_the_whole_radius(spark):
    seen = spark.createDataFrame([("a", float(k)) for k in range(1, 10)], "g string, e double")
    asked = spark.createDataFrame([("a", 1), ("new", 2)], "g string, id int")
    assert {r.g: r.radius for r in W.with_radius(asked, seen, "e", "g").collect()} == {"a": 8.0, "new": 8.0}


def test_rank_correlation_leaves_constants_out(spark):
    rows = [(1, float(k), float(k * k), 1.0) for k in range(5)] + [(2, float(k), float(-k), 1.0) for k in range(5)] + [(3, 1.0, float(k), 1.0) for k in range(5)]
    x = spark.createDataFrame(rows, "y int, a double, b double, c double")
    assert {r.y: round(r.ic, 9) for r in W.rank_correlation(x, "a", "b", "y").collect()} == {1: 1.0, 2: -1.0}
    assert W.rank_correlation(x, "a", "c", "y").count() == 0


def test_calendar_lag_skips_gaps(spark):
    x = spark.createDataFrame([("a", 2019, 1.0), ("a", 2021, 2.0), ("a", 2022, 3.0)], "entity string, year int, v double")
    assert [r.p for r in x.withColumn("p", W.lagged("v", -1)).orderBy("year").collect()] == [None, None, 2.0]


def test_chunks_overlap(spark):
    words = [str(k) for k in range(900)]
    (got,) = values(spark, [(words,)], "w array<string>", C.chunks(F.col("w")))[0]
    assert [len(x) for x in got] == [300, 350, 350] and got[1][0] == "250"
    (short,) = values(spark, [(words[:380],)], "w array<string>", C.chunks(F.col("w")))[0]
    assert len(short) == 1
