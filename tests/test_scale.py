import pytest
from pyspark.sql import functions as F

from fixtures import bar_rows, bars_of, scale_value
from seqcast.operators import scale, stats
from seqcast.operators.windows import make_windows
from seqcast.schema import FEATURES, VECTOR_FEATURES


def test_scaling_uses_the_own_range_of_every_feature(spark):
    rows = bar_rows("A", 30) + bar_rows("B", 12)
    got = {(r["symbol"], r["date"]): r for r in scale.minmax_scale(bars_of(spark, rows)).collect()}
    for symbol in "AB":
        mine = [r for r in rows if r[0] == symbol]
        for k, f in enumerate(FEATURES):
            values = [r[2 + k] for r in mine]
            for r in mine:
                assert got[symbol, r[1]][f] == scale_value(r[2 + k], min(values), max(values))


def test_constant_feature(spark):
    bars = bars_of(spark, bar_rows("A", 10, low=7.0))
    scaled = scale.minmax_scale(bars)
    assert {r["low"] for r in scaled.collect()} == {0.5}
    back = scale.inverse_scale(scaled.select("symbol", F.col("low").alias("prediction")), stats.feature_ranges(bars), "low")
    assert {r["prediction"] for r in back.collect()} == {7.0}


def test_negative_feature(spark):
    bars = bars_of(spark, bar_rows("A", 10, open=lambda i: -20.0 + i))
    ranges = stats.feature_ranges(bars).first()
    assert (ranges["min_open"], ranges["max_open"]) == (-20.0, -11.0)


def test_train_ranges_leave_the_test_part_out(spark):
    rows = bar_rows("A", 20, close=lambda i: float(i))
    bars = bars_of(spark, rows)
    got = [r["close"] for r in scale.minmax_scale(bars, stats_scope="train").orderBy("date").collect()]
    assert got == [i / 17 for i in range(20)]
    ranges = scale.training_ranges(bars, "train").first()
    assert (ranges["min_close"], ranges["max_close"]) == (0.0, 17.0)
    train, test = make_windows(bars, length=3, ratio=0.5, stats_scope="train")
    assert max(step[1] for r in train.collect() for step in r["x"]) <= 1.0
    assert max(step[1] for r in test.collect() for step in r["x"]) > 1.0
    with pytest.raises(ValueError):
        scale.minmax_scale(bars, stats_scope="test")


def test_inverse_of_scaling(spark):
    rows = bar_rows("A", 25) + bar_rows("B", 25)
    bars = bars_of(spark, rows)
    ranges = stats.feature_ranges(bars)
    arrays = scale.minmax_scale(bars).select("symbol", "date", F.array(*FEATURES).alias("prediction"))
    back = {(r["symbol"], r["date"]): r["prediction"] for r in scale.inverse_scale_all(arrays, ranges).collect()}
    for row in rows:
        assert back[row[0], row[1]] == pytest.approx(list(row[2:]))


def test_whole_table_scaler(spark):
    rows = bar_rows("A", 10) + bar_rows("B", 10, seed=5)
    bars = bars_of(spark, rows)
    out = scale.minmax_scale_global(bars)
    assert out.columns == ["symbol", "date", "features"]
    ranges = stats.feature_ranges(bars, by=None).first()
    for r in out.collect():
        row = next(b for b in rows if (b[0], b[1]) == (r["symbol"], r["date"]))
        want = [
            scale_value(row[2 + FEATURES.index(f)], ranges[f"min_{f}"], ranges[f"max_{f}"]) for f in VECTOR_FEATURES
        ]
        assert list(r["features"]) == pytest.approx(want)


def test_null_stays_null(spark):
    rows = bar_rows("A", 4) + [("A", None, None, 1.0, 1.0, 1.0, 1.0)]
    got = scale.minmax_scale(bars_of(spark, rows)).where("date is null").first()
    assert got["open"] is None and got["close"] is not None


@pytest.mark.parametrize("scope", ["all", "train"])
def test_scaling_moves_no_bars_for_small_ranges(spark, tmp_path, scope):
    path = str(tmp_path / "bars")
    bars_of(spark, bar_rows("A", 50) + bar_rows("B", 20)).write.parquet(path)
    plan = scale.minmax_scale(spark.read.parquet(path), stats_scope=scope)._jdf.queryExecution().executedPlan().toString()
    above_bars = plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in above_bars and "SortMergeJoin" not in above_bars
