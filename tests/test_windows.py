import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import bar_rows, bars_of, expected_windows
from seqcast.operators import series, stats, windows
from seqcast.operators.windows import assign_batches, make_windows, unfold_windows, window_blocks
from seqcast.schema import FEATURES


def _train(df):
    return {(r["symbol"], r["i"]): (r["x"], r["y"]) for r in df.collect()}


def _test(df):
    return {(r["symbol"], r["window"]): (r["date"], r["x"], r["y"]) for r in df.collect()}


@pytest.mark.parametrize("category", [*FEATURES, "all"])
def test_windows_equal_plain_loops(spark, category):
    rows = bar_rows("A", 47) + bar_rows("B", 9) + bar_rows("C", 120) + bar_rows("D", 1)
    bars = bars_of(spark, rows)
    want_train, want_test = expected_windows(rows, 3, 1, 0.6, category)
    train, test = make_windows(bars, length=3, ratio=0.6, category=category, block_size=5)
    assert _train(train) == want_train
    assert _test(test) == want_test


@pytest.mark.parametrize("block_size", [3, 4, 7, 64, 4096])
def test_blocks_do_not_change_windows(spark, block_size):
    rows = bar_rows("A", 100) + bar_rows("B", 31)
    want_train, want_test = expected_windows(rows, 3, 1, 0.5, "high")
    train, test = make_windows(bars_of(spark, rows), 3, 0.5, "high", block_size)
    assert _train(train) == want_train
    assert _test(test) == want_test


def test_default_sizes(spark):
    bars = bars_of(spark, bar_rows("A", 260) + bar_rows("B", 260))
    train, test = make_windows(bars)
    assert {r["symbol"]: r["count"] for r in train.groupBy("symbol").count().collect()} == {"A": 211, "B": 211}
    assert {r["symbol"]: r["count"] for r in test.groupBy("symbol").count().collect()} == {"A": 3, "B": 3}
    counts = stats.window_counts(bars).where("symbol = 'A'").first()
    assert (counts["n"], counts["split"], counts["train_windows"], counts["test_windows"]) == (260, 234, 211, 3)
    assert {len(r["x"]) for r in train.select("x").collect()} == {22}


@pytest.mark.parametrize("rows, windows", [(22, 0), (23, 0), (24, 1)])
def test_one_window_fewer_than_fits(spark, rows, windows):
    bars = bars_of(spark, bar_rows("A", rows))
    train, test = make_windows(bars, ratio=1.0)
    assert (train.count(), test.count()) == (windows, 0)
    assert stats.window_counts(bars, ratio=1.0).first()["train_windows"] == windows


@pytest.mark.parametrize("n, split", [(5, 5), (15, 14), (1, 1), (10, 9)])
def test_split_rounds_half_up(spark, n, split):
    parts = series.chronological_split(bars_of(spark, bar_rows("A", n))).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts}.get("train", 0) == split


def test_labels_are_the_next_step_and_no_test_window_sees_train(spark):
    bars = bars_of(spark, bar_rows("A", 90))
    train, _ = make_windows(bars, length=4, category="low", ratio=0.7)
    k = FEATURES.index("low")
    for row in train.collect():
        assert [step[k] for step in row["x"][1:]] == row["y"][:-1]
    first_test = series.chronological_split(bars, 0.7).where("part = 'test'").agg(F.min("date")).first()[0]
    blocks = window_blocks(bars, "test", length=4, ratio=0.7)
    assert blocks.select(F.min(F.get("date", F.lit(0)))).first()[0] == first_test


def test_order_is_by_date_whatever_the_file_order(spark):
    rows = bar_rows("A", 400, start=dt.date(2014, 6, 1))
    backwards = spark.createDataFrame(rows[::-1], bars_of(spark, rows).schema)
    got = series.index_bars(backwards).orderBy("i").collect()
    assert [r["date"] for r in got] == [row[1] for row in rows]
    assert [r["i"] for r in got] == list(range(400)) and {r["n"] for r in got} == {400}


def test_intraday_bars_and_equal_times(spark):
    start = dt.datetime(2020, 3, 1, 22, 0)
    rows = [("A", start + dt.timedelta(minutes=(i // 2) * 50), float(i), 1.0, 1.0, 1.0, 1.0) for i in range(200)]
    bars = spark.createDataFrame(rows, "symbol string, date timestamp, open double, close double, low double, high double, volume double")
    got = series.index_bars(bars.repartition(7)).orderBy("i").collect()
    assert [r["open"] for r in got] == [float(i) for i in range(200)]
    _, test = make_windows(bars, length=3)
    assert test.schema["date"].dataType.simpleString() == "timestamp"


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_undated_bars_come_first_and_stay(spark, kind):
    rows = bar_rows("A", 5, start=dt.date(1969, 12, 29))
    rows.append(("A", None, 1.0, 1.0, 1.0, 1.0, 1.0))
    bars = bars_of(spark, rows)
    got = series.index_bars(bars.withColumn("date", F.col("date").cast(kind))).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(6)) and got[0]["date"] is None
    assert [r["open"] for r in got[1:]] == [row[2] for row in rows[:5]]


def test_one_symbol_with_most_rows(spark):
    rows = bar_rows("HOT", 3000) + [r for k in range(20) for r in bar_rows(f"S{k}", 50)]
    bars = bars_of(spark, rows)
    want_train, want_test = expected_windows(rows, 22, 1, 0.9, "close")
    train, test = make_windows(bars, block_size=64)
    assert _train(train) == want_train
    assert _test(test) == want_test
    sizes = window_blocks(bars, "train", block_size=64).select(F.max(F.size("x")), F.max("m")).first()
    assert tuple(sizes) == (86, 64)


def test_batches_are_handed_out_in_order(spark):
    train, _ = make_windows(bars_of(spark, bar_rows("A", 40)), length=3, ratio=1.0)
    got = assign_batches(train, 8).collect()
    assert all(r["batch"] == r["i"] // 8 for r in got) and len(got) == 36


def test_unfolded_blocks_are_the_windows(spark):
    bars = bars_of(spark, bar_rows("A", 60))
    train, _ = make_windows(bars, length=5)
    assert _train(unfold_windows(window_blocks(bars, "train", length=5), 5)) == _train(train)


def test_bad_settings_are_refused(spark):
    bars = bars_of(spark, bar_rows("A", 5))
    with pytest.raises(ValueError):
        make_windows(bars, category="colour")
    with pytest.raises(ValueError):
        make_windows(bars, block_size=10)
    with pytest.raises(ValueError):
        window_blocks(bars, "validation")
    with pytest.raises(ValueError):
        make_windows(bars, length=0)


def test_bars_are_shuffled_once_for_numbering(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars_of(spark, bar_rows("A", 50)).write.parquet(path)
    plan = series.index_bars(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    # one exchange of the bars; two of the small table of facts, and one to bring it to the bars
    assert plan.count("Exchange hashpartitioning") == 4
    assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_bars_partitioned_by_symbol_are_spread_before_numbering(spark):
    bars = bars_of(spark, bar_rows("A", 50)).repartition(4, "symbol")
    plan = series.index_bars(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [symbol" in plan and "_bucket" in plan.split("RepartitionByExpression")[1][:60]


def test_both_parts_are_numbered_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars_of(spark, bar_rows("A", 200)).write.parquet(path)
    bars = spark.read.parquet(path)
    one = windows._cut(bars, ("train",), 5, 0.9, "close", 64, "all")._jdf.queryExecution().optimizedPlan().toString()
    both = windows._cut(bars, windows.PARTS, 5, 0.9, "close", 64, "all")._jdf.queryExecution().optimizedPlan().toString()
    assert both.count("row_number") == one.count("row_number") and both.count("Relation ") == one.count("Relation ")
    train, test = windows.both_blocks(bars, length=5, block_size=64)
    key = lambda r: r["start"]
    assert sorted(train.collect(), key=key) == sorted(window_blocks(bars, "train", length=5, block_size=64).collect(), key=key)
    assert sorted(test.collect(), key=key) == sorted(window_blocks(bars, "test", length=5, block_size=64).collect(), key=key)
