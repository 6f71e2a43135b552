"""Core operators against brute force, including hot keys and heavy ties."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slabmill.operators.asof import asof_join, even_pieces, first_by, latest_by, next_row, running_count
from slabmill.operators.concordance import concordance
from slabmill.operators.ordering import exact_quantiles, spread_row_number, tie_percent_rank


@pytest.fixture(scope="module")
def skewed():
    """One key with most rows, repeated values, negatives and zeros."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(4000) < 0.7, 1, rng.integers(2, 40, 4000))
    value = np.round(rng.normal(20, 60, 4000), 1)
    value[:900] = 7.5
    return pd.DataFrame({"k": key, "v": value, "id": np.arange(4000)})


def test_exact_quantiles_per_key(spark, skewed):
    out = exact_quantiles(spark.createDataFrame(skewed), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}, count_as="n").toPandas().set_index("k")
    want = skewed.groupby("k")["v"].quantile([0.1, 0.5, 0.9]).unstack()
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.9)):
        np.testing.assert_allclose(out[name].sort_index(), want[p].sort_index(), rtol=1e-12)
    assert out["n"].sum() == len(skewed)


def test_exact_quantiles_whole_table_and_weights(spark, skewed):
    counts = skewed.groupby("v").size().rename("n").reset_index()
    plain = exact_quantiles(spark.createDataFrame(skewed), [], "v", {"m": 0.5}).first()["m"]
    weighted = exact_quantiles(spark.createDataFrame(counts), [], "v", {"m": 0.5}, weight="n").first()["m"]
    assert plain == weighted == skewed["v"].median()


def test_tie_percent_rank(spark, skewed):
    with_null = pd.concat([skewed, pd.DataFrame({"k": [1], "v": [np.nan], "id": [9999]})])
    df = spark.createDataFrame(with_null.astype({"v": "float64"})).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = tie_percent_rank(df, "v", "pct", ["k"]).toPandas().set_index("id")["pct"].sort_index()
    want = with_null.astype({"v": "float64"}).set_index("id").groupby("k")["v"].rank(pct=True).sort_index()
    np.testing.assert_allclose(got.astype(float), want, rtol=1e-12)


def test_spread_row_number(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = spread_row_number(df, "r", "v", "id", ["k"], descending=True, count_as="n", tie_width=64.0).toPandas()
    want = skewed.sort_values(["v", "id"], ascending=[False, True]).groupby("k").cumcount() + 1
    assert (got.set_index("id")["r"].sort_index() == want.sort_index()).all()
    assert (got["n"] == got.groupby("k")["id"].transform("size")).all()


def test_asof_join_equals_merge_asof(spark):
    rng = np.random.default_rng(5)
    day = lambda n: pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 900 * 24, n), unit="h")
    left = pd.DataFrame({"k": rng.integers(0, 5, 600), "ts": day(600), "i": np.arange(600)})
    a = pd.DataFrame({"k": rng.integers(0, 5, 80), "at": day(80), "x": np.arange(80)}).drop_duplicates(["k", "at"])
    b = pd.DataFrame({"k": rng.integers(0, 3, 30), "at": day(30), "y": np.arange(30)}).drop_duplicates(["k", "at"])
    got = asof_join(
        spark.createDataFrame(left),
        [(spark.createDataFrame(a), "at", {"x": "x"}), (spark.createDataFrame(b), "at", {"y": "y", "y_at": "at"})],
        ["k"], "ts",
    ).toPandas().sort_values("i")
    for side, col in ((a, "x"), (b, "y")):
        want = pd.merge_asof(left.sort_values("ts"), side.sort_values("at"), left_on="ts", right_on="at", by="k").sort_values("i")
        np.testing.assert_array_equal(got[col].astype(float), want[col].astype(float))


@pytest.fixture(scope="module")
def hot(spark):
    """90 % of the rows on one key and one hour, half of them at one instant."""
    rng = np.random.default_rng(12)
    n = 12_000
    is_hot = rng.random(n) < 0.9
    key = np.where(is_hot, 7, rng.integers(0, 40, n))
    second = np.where(is_hot, np.where(rng.random(n) < 0.5, 1800, rng.integers(0, 3600, n)), rng.integers(0, 86_400 * 30, n))
    return pd.DataFrame({"k": key, "ts": pd.Timestamp("2022-03-01") + pd.to_timedelta(second, unit="s"), "i": rng.permutation(n)})


@pytest.fixture
def many_pieces(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    yield 24
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_pieces_are_even_whatever_the_keys(spark, hot, many_pieces):
    dealt = even_pieces(spark.createDataFrame(hot), ["k"], ["ts", "i"]).withColumn("task", F.spark_partition_id())
    sizes = dealt.groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("_piece").alias("pieces")).toPandas()
    assert sizes["n"].sum() == len(hot) and (sizes["pieces"] == 1).all()
    assert sizes["n"].max() <= 2 * len(hot) / many_pieces


def test_asof_join_of_a_hot_hour(spark, hot, many_pieces):
    rng = np.random.default_rng(13)
    right = pd.DataFrame({"k": [*rng.integers(0, 40, 300), *[7] * 300], "x": range(600)})
    right["at"] = pd.Timestamp("2022-03-01") + pd.to_timedelta([*rng.integers(0, 86_400 * 30, 300), *rng.integers(0, 3600, 300)], unit="s")
    early = pd.DataFrame({"k": [7, 7, 3], "y": [1, 2, 3], "at": pd.to_datetime(["2022-02-01", "2022-02-01", "2022-03-04"])})
    left = spark.createDataFrame(hot).unionAll(spark.createDataFrame([(None, None, -1), (7, None, -2)], "k long, ts timestamp, i long"))
    sides = [(spark.createDataFrame(right), "at", {"x": "x"}), (spark.createDataFrame(early), "at", {"y": "y"})]
    for row_id in (["i"], None):
        found = asof_join(left, sides, ["k"], "ts", row_id).toPandas().set_index("i").sort_index()
        assert len(found) == len(hot) + 2 and found.loc[[-1, -2], ["x", "y"]].isna().all().all()
        for side, col in ((right.groupby(["k", "at"], as_index=False)["x"].max(), "x"), (early.groupby(["k", "at"], as_index=False)["y"].max(), "y")):
            want = pd.merge_asof(hot.sort_values("ts"), side.sort_values("at"), left_on="ts", right_on="at", by="k").set_index("i")[col].sort_index()
            np.testing.assert_array_equal(found.loc[0:, col].astype(float), want.astype(float))


@pytest.mark.parametrize("back", [False, True])
def test_next_row_across_pieces(spark, hot, many_pieces, back):
    got = next_row(spark.createDataFrame(hot), ["k"], ["ts", "i"], {"other": "i"}, back=back).toPandas().set_index("i")["other"].sort_index()
    placed = hot.sort_values(["ts", "i"])
    want = placed.groupby("k")["i"].shift(1 if back else -1)
    want.index = placed["i"]
    np.testing.assert_array_equal(got.astype(float), want.sort_index().astype(float))


def test_running_count_across_pieces(spark, hot, many_pieces):
    got = running_count(spark.createDataFrame(hot), ["k"], ["ts", "i"], "n").toPandas().set_index("i")["n"].sort_index()
    placed = hot.sort_values(["ts", "i"])
    want = placed.groupby("k").cumcount() + 1
    want.index = placed["i"]
    assert (got == want.sort_index()).all()


def test_null_keys_are_one_key_for_neighbours(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 1, "c")], "k int, t int, v string")
    assert {(r.v, r.w) for r in next_row(df, ["k"], ["t"], {"w": "v"}).collect()} == {("a", "b"), ("b", None), ("c", None)}
    assert next_row(df.limit(0), ["k"], ["t"], {"w": "v"}).count() == 0


def test_latest_and_first(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {r.k: r.v for r in latest_by(df, ["k"], ["t"]).collect()} == {1: "b", 2: "c"}
    assert {r.k: r.v for r in first_by(df, ["k"], ["t"]).collect()} == {1: "a", 2: "c"}


def test_concordance_equals_pair_counting(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 240), "y": rng.integers(0, 25, 240).astype(float), "s": np.round(rng.normal(0, 2, 240), 1)})
    got = {r.g: (r.agree, r.comparable) for r in concordance(spark.createDataFrame(pdf), "y", "s", ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        dy = part["y"].to_numpy()[:, None] - part["y"].to_numpy()
        ds = part["s"].to_numpy()[:, None] - part["s"].to_numpy()
        upper = np.triu(np.ones_like(dy, bool), 1)
        assert got[g] == (int((upper & (dy * ds > 0)).sum()), int((upper & (dy != 0)).sum()))


def test_null_values_and_groups_are_numbered_and_grouped(spark):
    rows = [(1, "a", 3.0), (2, "a", None), (3, "a", 1.0), (4, None, 5.0), (5, None, None), (None, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = spread_row_number(df, "n", "v", "id", ["g"], descending=True, count_as="all")
    assert sorted((r.g or "", r.n, r.id, r.all) for r in got.collect()) == [("", 1, 4, 2), ("", 2, 5, 2), ("a", 1, 1, 4), ("a", 2, 3, 4), ("a", 3, 2, 4), ("a", 4, None, 4)]
    medians = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert medians == {"a": 2.0, None: 5.0}
