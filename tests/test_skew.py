"""Keys that hold much of the rows: joins, buckets and units."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fixtures import bar_rows, bars_of
from seqcast.operators import prep, scale, series, skew
from seqcast.operators.windows import window_blocks
from seqcast.session import bucketed_table
from seqcast.sources.readers import read_symbol_files, symbol_files
from seqcast.sources.writers import write_symbol_files
from seqcast.training import averaging
from seqcast.training.averaging import fit_averaged
from seqcast.training.kernels import LinearKernel


@pytest.fixture
def uneven(spark):
    """A third of all rows under one key."""
    rows = [("hot" if k % 3 == 0 else f"k{k % 2999}", k) for k in range(30_000)]
    return spark.createDataFrame(rows, "symbol string, date int")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_hot_keys_are_cut(uneven):
    counts = uneven.groupBy("symbol").agg(F.count("*").alias("n"))
    hot = {r["symbol"]: r["_salts"] for r in skew.hot_keys(counts, ["symbol"]).collect()}
    assert hot == {"hot": 342}  # a third of 1,024, rounded up


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins_join_as_plain_ones(spark, uneven, how):
    table = uneven.select("symbol").distinct().where("symbol = 'hot' or symbol > 'k15'").withColumn("fact", F.length("symbol"))
    extra = uneven.union(spark.createDataFrame([(None, 1)], uneven.schema))
    got = skew.join_on_symbol(extra, table, how)
    want = extra.join(table, "symbol", how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_task_gets_the_hot_key(spark, uneven, no_broadcast):
    table = uneven.select("symbol").distinct().withColumn("fact", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        joined = skew.join_on_symbol(uneven, table)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) == 40 and max(sizes) < 2 * 30_000 / 40


def test_extra_columns_may_have_the_helper_names(uneven):
    odd = uneven.withColumn("_salt", F.lit(7)).withColumn("_salts", F.lit(8))
    got = skew.join_on_symbol(odd, uneven.select("symbol").distinct())
    assert got.columns == ["symbol", "date", "_salt", "_salts"] and got.count() == 30_000


def test_long_lists_of_symbols(spark, uneven, monkeypatch):
    listed = spark.createDataFrame([("hot",), ("k1",), ("hot",), ("none",)], "symbol string")
    want = uneven.where("symbol in ('hot', 'k1')").count()
    assert prep.select_symbols(uneven, listed).count() == want
    monkeypatch.setattr(prep, "BROADCAST_SYMBOLS", 1)
    again = prep.select_symbols(uneven, listed)
    assert again.columns == uneven.columns and again.count() == want


def test_ranges_know_how_hot_a_symbol_is(spark, no_broadcast):
    bars = bars_of(spark, bar_rows("A", 300) + bar_rows("B", 5))
    ranges = scale.training_ranges(bars)
    assert {r["symbol"]: r["n"] for r in ranges.collect()} == {"A": 300, "B": 5}
    scaled = scale.minmax_scale(bars)
    back = scale.inverse_scale(scaled.select("symbol", "date", F.col("close").alias("prediction")), ranges, "close")
    want = {(r["symbol"], r["date"]): r["close"] for r in bars.collect()}
    assert {(r["symbol"], r["date"]): pytest.approx(r["prediction"]) for r in back.collect()} == want


# --- large buckets


def ticks(n, spread):
    rng, start = random.Random(3), datetime.datetime(2024, 5, 1, 12)
    rows = [("T", start + datetime.timedelta(microseconds=rng.randrange(spread)), rng.random()) for _ in range(n)]
    return rows + [("T", start + datetime.timedelta(hours=k), 0.5) for k in range(3)] + [("U", start, 1.0), ("T", None, 2.0)]


@pytest.mark.parametrize("spread", [3_000_000_000, 40, 1])
def test_a_bucket_with_many_bars_is_cut(spark, spread):
    rows = ticks(4000, spread)
    bars = spark.createDataFrame(rows, "symbol string, date timestamp, close double")
    placed = series.with_bucket(bars, 500)
    sizes = [r["n"] for r in placed.groupBy(*series.place_keys(placed)).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 500 and sum(sizes) == len(rows)
    got = [(r["date"], r["close"], r["i"], r["n"]) for r in series.index_bars(bars, 500).where("symbol = 'T'").orderBy("i").collect()]
    mine = sorted(((d, c) for s, d, c in rows if s == "T"), key=lambda x: (x[0] is not None, x[0] or datetime.datetime.min, x[1]))
    assert got == [(d, c, i, len(mine)) for i, (d, c) in enumerate(mine)]


def test_small_slices_need_no_partition_each(spark):
    rows = ticks(4000, 3_000_000_000)
    bars = spark.createDataFrame(rows, "symbol string, date timestamp, close double")
    placed = series.with_bucket(bars, 6)
    sizes = [r["n"] for r in placed.groupBy(*series.place_keys(placed)).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 6 and len(sizes) > 1000
    parts = placed.where(f"{series.SLICE} > 0").select(F.shiftright(series.SLICE, 32)).distinct().count()
    assert 1 < parts <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = [(r["date"], r["close"], r["i"]) for r in series.index_bars(bars, 6).where("symbol = 'T'").orderBy("i").collect()]
    mine = sorted(((d, c) for s, d, c in rows if s == "T"), key=lambda x: (x[0] is not None, x[0] or datetime.datetime.min, x[1]))
    assert got == [(d, c, i) for i, (d, c) in enumerate(mine)]


# --- files named by symbol


def test_a_long_list_opens_only_its_files(spark, tmp_path):
    rows = [r for k in range(120) for r in bar_rows(f"S{k}", 3, seed=k)]
    folder = str(tmp_path / "files")
    written = write_symbol_files(bars_of(spark, rows), folder)
    assert {(r["symbol"], r["bars"]) for r in written.collect()} == {(f"S{k}", 3) for k in range(120)}
    assert {r["symbol"] for r in symbol_files(spark, folder).collect()} == {f"S{k}" for k in range(120)}
    listed = spark.range(20_000).select(F.format_string("S%d", F.col("id") * 2).alias("symbol"))
    got = read_symbol_files(spark, folder, listed)
    assert len(got.inputFiles()) == 60
    want = {(r[0], r[1], *map(float, r[2:])) for r in rows if int(r[0][1:]) % 2 == 0}
    assert {(r["symbol"], r["date"], r["open"], r["close"], r["low"], r["high"], r["volume"]) for r in got.collect()} == want
    assert read_symbol_files(spark, folder, spark.createDataFrame([("none",)], "symbol string")).count() == 0


def test_a_long_list_needs_few_jobs_and_tasks(spark, tmp_path):
    rows = [r for k in range(120) for r in bar_rows(f"S{k}", 3, seed=k)]
    folder = str(tmp_path / "files")
    write_symbol_files(bars_of(spark, rows), folder)
    listed = spark.range(90).select(F.format_string("S%d", "id").alias("symbol"))
    context, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    kept = {k: spark.conf.get(k) for k in (name, "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file for each task
    context.setJobGroup("listed files", "")
    try:
        assert len(read_symbol_files(spark, folder, listed).inputFiles()) == 90
        jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("listed files")]
        last = context.statusTracker().getStageInfo(max(s for j in jobs for s in j.stageIds))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept["spark.sql.files.maxPartitionBytes"])
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 10 and last.numTasks <= 4 * context.defaultParallelism
    assert spark.conf.get(name) == kept[name]


# --- units of training


def test_a_round_moves_weights_but_no_units(spark, monkeypatch, no_broadcast):
    plans = []
    blocks = window_blocks(bars_of(spark, bar_rows("A", 400) + bar_rows("B", 60)), "train", length=6, block_size=8)
    real = averaging._average

    def average(updates):
        plans.append(updates._jdf.queryExecution().executedPlan().toString())
        return real(updates)

    monkeypatch.setattr(averaging, "_average", average)
    monkeypatch.setattr(averaging, "UNITS_PER_SHARE", 2)
    fit_averaged(blocks, LinearKernel(length=6), batch_size=8, max_epochs=2, broadcast_bytes=0)
    joined = plans[1]
    assert "SortMergeJoin" in joined
    units = joined.split("SortMergeJoin", 1)[1].split("Exchange", 1)[0]  # the first side of the join, down to its scan
    assert "FileScan" in units and "Bucketed: true" in units


def test_a_bucketed_table_joins_where_it_lies(spark, uneven, no_broadcast):
    table = bucketed_table(uneven, "uneven", "symbol", buckets=5)
    assert sorted(table.collect()) == sorted(uneven.collect())
    counted = table.groupBy("symbol").agg(F.count("*").alias("n"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert len(table.inputFiles()) == 5
