import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tagsmith.functions import labels as lb
from tagsmith.functions.numeric import (
    exact_total, finite_or_zero, or_default, parse_number, price_grid, real, round_to,
)
from tagsmith.functions.text import clean_query


def test_round_matches_numpy(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.uniform(-5000, 5000, 3000), rng.integers(0, 99999, 3000) / 1000])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "x": values}))
    got = df.select("i", round_to(F.col("x"), 2).alias("r")).orderBy("i").toPandas()["r"]
    assert (got.to_numpy() == np.round(values, 2)).all()


def test_grid_is_bit_equal_to_linspace(spark):
    prices = np.random.default_rng(3).uniform(0.5, 3000, 500)
    df = spark.createDataFrame(pd.DataFrame({"i": range(500), "p": prices}))
    for steps in (12, 15, 20):
        rows = df.select("i", price_grid(F.col("p"), steps, 0.7, 1.3).alias("g")).orderBy("i")
        got = np.array([r["g"] for r in rows.collect()])
        want = np.array([np.linspace(p * 0.7, p * 1.3, steps) for p in prices])
        assert (got == want).all()


def test_missing_numbers(spark):
    df = spark.createDataFrame(
        [(1, float("nan")), (2, float("inf")), (3, None), (4, 0.0), (5, 2.5)], "i int, x double")
    got = df.select(
        "i", real(F.col("x")).alias("real"), finite_or_zero(F.col("x")).alias("clean"),
        or_default(F.col("x"), F.lit(9.0)).alias("dflt")).orderBy("i").collect()
    assert [r["real"] for r in got] == [None, math.inf, None, 0.0, 2.5]
    assert [r["clean"] for r in got] == [0.0, 0.0, None, 0.0, 2.5]
    assert [r["dflt"] for r in got] == [9.0, math.inf, 9.0, 9.0, 2.5]


def test_number_text(spark):
    texts = ["12.5", "1,299", "", "nan", "inf", "abc", None, " 7 ", "0"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(parse_number(F.col("t"))).collect()]
    assert got == [12.5, None, None, None, None, None, None, 7.0, 0.0]


def test_exact_total_ignores_order(spark):
    values = np.random.default_rng(5).uniform(0, 1e6, 4000)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    totals = {df.repartition(n).agg(exact_total(F.col("x"))).first()[0] for n in (1, 3, 8)}
    assert len(totals) == 1
    assert abs(totals.pop() - values.sum()) < 1e-2


def test_band_edges(spark):
    df = spark.createDataFrame(
        [(v,) for v in (49.0, 50.0, 100.0, 101.0, 200.0, 400.0, 401.0, 500.0, 1000.0, 1001.0)],
        "q double")
    got = {r[0]: (r[1], r[2]) for r in df.select(
        "q", lb.stock_label(F.col("q")), lb.result_stock_label(F.col("q"))).collect()}
    assert got[100.0][0] == "LOW" and got[101.0][0] == "MED"
    assert got[400.0][0] == "MED" and got[401.0][0] == "HIGH"
    assert got[1000.0][0] == "HIGH" and got[1001.0][0] == "VERY_HIGH"
    assert got[49.0][1] == "LOW" and got[50.0][1] == "MED"
    assert got[200.0][1] == "HIGH" and got[500.0][1] == "VERY_HIGH"
    scores = spark.createDataFrame([(0.4,), (0.41,), (0.7,), (0.71,)], "s double")
    assert [r[0] for r in scores.orderBy("s").select(lb.demand_label(F.col("s"))).collect()] == [
        "LOW", "MED", "MED", "HIGH"]


def test_competitor_positions(spark):
    df = spark.createDataFrame(
        [(1, 100.0, None), (2, 100.0, 90.0), (3, 100.0, 110.0), (4, 100.0, 100.0),
         (5, None, 90.0), (6, 102.0, 100.0), (7, 97.0, 100.0), (8, 103.0, 100.0),
         (9, 100.0, 0.0)], "i int, p double, c double")
    got = df.orderBy("i").select(
        lb.competitor_label(F.col("p"), F.col("c")),
        lb.result_competitor_label(F.col("p"), F.col("c"))).collect()
    assert [r[0] for r in got] == [
        "NO_COMPETITOR", "COMPETITOR_CHEAPER", "WE_CHEAPER", "SAME", "SAME",
        "COMPETITOR_CHEAPER", "WE_CHEAPER", "COMPETITOR_CHEAPER", "COMPETITOR_CHEAPER"]
    assert [got[i][1] for i in (0, 5, 6, 7, 8)] == [
        "NO_COMPETITOR", "SAME", "WE_CHEAPER", "COMPETITOR_CHEAPER", "NO_COMPETITOR"]


def test_confidence(spark):
    df = spark.createDataFrame(
        [(1, 50.0, 60.0, 2.0, 1, 0, 3.0), (2, None, 10.0, 0.0, 0, 0, 50.0),
         (3, 50.0, 60.0, 0.0, 0, 0, -4.0)],
        "i int, c double, s double, d double, v int, a int, ch double")
    score = lb.confidence_score(*[F.col(c) for c in ("c", "s", "d", "v", "a", "ch")])
    got = df.orderBy("i").select(score, lb.confidence_label(score)).collect()
    assert [tuple(r) for r in got] == [(1.0, "HIGH"), (0.0, "LOW"), (0.65, "MEDIUM")]


def test_query_cleaning(spark):
    df = spark.createDataFrame(
        [(1, "TBH, personally I want\tin my opinion:  RED shoes!"),
         (2, "in my opinion in my opinion tbh tbh blue"), (3, "tbhx personallyx"), (4, "tbh"),
         (5, None)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(clean_query(F.col("t"))).collect()]
    assert got == ["i want red shoes", "blue", "tbhx personallyx", "", None]
