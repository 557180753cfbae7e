import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fixtures import bar_rows, bars_of
from seqcast import session
from seqcast.operators import prep, scale, stats
from seqcast.operators.windows import make_windows
from seqcast.session import new_table_folder
from seqcast.sources.readers import SYMBOL_FILE_COLUMNS, read_bars_csv, read_symbol_files, read_symbol_folders, read_symbols

HEADER = "Date,Open,High,Low,Close,Volume,Adj Close"


@pytest.fixture()
def folder(tmp_path):
    def write(name, lines):
        (tmp_path / "bars").mkdir(exist_ok=True)
        (tmp_path / "bars" / f"{name}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
        return str(tmp_path / "bars")

    return write


def _lines(n, start=dt.date(2016, 1, 1)):
    return [f"{start + dt.timedelta(days=i)},{i + 1},{i + 2},{i + 3},{i + 4},{i + 5},{i + 6}" for i in range(n)]


def test_positions_of_a_symbol_file(spark, folder):
    folder("AAA", _lines(3))
    got = read_symbol_files(spark, folder("BBB", _lines(2))).orderBy("symbol", "date").collect()
    assert [r["symbol"] for r in got] == ["AAA"] * 3 + ["BBB"] * 2
    first = got[0]
    assert (first["date"], first["open"], first["high"], first["low"]) == (dt.date(2016, 1, 1), 1.0, 2.0, 3.0)
    # the close is the adjusted one, in the last position
    assert (first["close"], first["volume"]) == (6.0, 5.0)


def test_listed_symbols_only(spark, folder, tmp_path):
    folder("AAA", _lines(3))
    base = folder("B.B", _lines(2))
    assert {r["symbol"] for r in read_symbol_files(spark, base, ["B.B"]).collect()} == {"B.B"}
    (tmp_path / "symbols.txt").write_text("AAA\n\n  B.B \nGONE\n")
    listed = read_symbols(spark, str(tmp_path / "symbols.txt"))
    assert sorted(r["symbol"] for r in listed.collect()) == ["AAA", "B.B", "GONE"]
    bars = read_symbol_files(spark, base, listed)
    assert bars.count() == 5
    assert [r["symbol"] for r in prep.missing_symbols(listed, bars).collect()] == ["GONE"]
    with pytest.raises(AnalysisException):
        read_symbol_files(spark, base, ["GONE"])
    with pytest.raises(AnalysisException):
        read_symbols(spark, str(tmp_path / "none.txt")).count()


def test_unreadable_rows(spark, folder):
    lines = _lines(4)
    lines[1] = "2016-01-02,null,null,null,null,null,null"
    lines[2] = "2016-01-03,1,2"
    base = folder("BAD", lines)
    assert read_symbol_files(spark, base).count() == 2
    kept = read_symbol_files(spark, base, on_bad="null").orderBy("date").collect()
    assert len(kept) == 4 and kept[1]["open"] is None
    with pytest.raises(Exception, match="cannot read"):
        read_symbol_files(spark, base, on_bad="fail").collect()
    with pytest.raises(ValueError):
        read_symbol_files(spark, base, on_bad="guess")


def test_empty_series(spark, folder):
    folder("AAA", _lines(30))
    base = folder("NONE", [])
    bars = read_symbol_files(spark, base)
    assert bars.count() == 30
    only = read_symbol_files(spark, base, ["NONE"])
    train, test = make_windows(only)
    assert (train.count(), test.count()) == (0, 0)
    assert stats.symbol_counts(only).count() == 0


def test_multi_symbol_file(spark, tmp_path):
    path = tmp_path / "multi.csv"
    path.write_text(
        "date,symbol,open,close,low,high,volume\n"
        "2016-01-05 00:00:00,WLTW,123.43,125.839996,122.309998,126.25,2163600.0\n"
        "2016-01-06 00:00:00,WLTW,125.239998,119.980003,119.940002,125.540001,2386400.0\n"
        "2016-01-05 00:00:00,AAL,41.33,oops,40.3,41.4,10.0\n"
        "2016-01-06 00:00:00,AAL,41.33,41.0,40.3,41.4,10.0\n"
    )
    bars = read_bars_csv(spark, str(path))
    assert bars.columns == ["symbol", "date", "open", "close", "low", "high", "volume"]
    assert dict(bars.dtypes) == {"symbol": "string", "date": "date", **{f: "double" for f in bars.columns[2:]}}
    assert {r["symbol"]: r["count"] for r in stats.symbol_counts(bars).collect()} == {"WLTW": 2, "AAL": 1}
    assert stats.symbol_total(bars).first()["symbols"] == 2
    assert len(prep.preview(bars, 2).collect()) == 2
    assert scale.minmax_scale_global(bars).count() == 3
    assert read_bars_csv(spark, str(path), date_type="timestamp").schema["date"].dataType.simpleString() == "timestamp"


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("volume,date,high,symbol,low,close,open\n5,2016-01-05,4,X,3,2,1\n")
    row = read_bars_csv(spark, str(tmp_path / "a.csv")).first()
    assert [row[c] for c in ("open", "close", "low", "high", "volume")] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_files_with_different_headers(spark, tmp_path):
    for name, header, row in (("a", "symbol,date,open,close,low,high,volume", "X,2016-01-05,1,2,3,4,5"), ("b", "symbol,date,volume,close,low,high,open", "X,2016-01-06,5,2,3,4,1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "bars.csv").write_text(f"{header}\n{row}\n")
    rows = read_bars_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert [(r["open"], r["volume"]) for r in rows] == [(1.0, 5.0), (1.0, 5.0)]
    with pytest.raises(Exception, match="(?i)header"):
        read_bars_csv(spark, str(tmp_path / "*")).collect()


@pytest.mark.parametrize("cell", ["Infinity", "-Infinity", "NaN", "1e999"])
def test_numbers_that_are_not_finite_are_unreadable(spark, tmp_path, cell):
    (tmp_path / "a.csv").write_text(f"symbol,date,open,close,low,high,volume\nX,2016-01-05,{cell},2,3,4,5\nX,2016-01-06,1,2,3,4,5\n,2016-01-07,1,2,3,4,5\n")
    path = str(tmp_path / "a.csv")
    assert read_bars_csv(spark, path).count() == 1
    assert [r["open"] for r in read_bars_csv(spark, path, on_bad="null").orderBy("date").collect()] == [None, 1.0]
    with pytest.raises(Exception, match="cannot read"):
        read_bars_csv(spark, path, on_bad="fail").collect()


def test_a_listed_symbol_reads_its_file_alone(spark, tmp_path):
    for name in "ABC":
        (tmp_path / f"{name}.csv").write_text("Date,Open,High,Low,Close,Volume,Adj\n2016-01-05,1,2,3,4,5,6\n")
    listed = spark.createDataFrame([("B",)], "symbol string")
    bars = read_symbol_files(spark, str(tmp_path), listed)
    assert [r["symbol"] for r in bars.collect()] == ["B"]
    scan = bars._jdf.queryExecution().executedPlan().toString()
    assert "file_name" in scan and "Join" not in scan
    (tmp_path / "A.csv").unlink()  # a file that isn't read may be missing by now
    assert bars.count() == 1


def test_folders_are_removed(spark):
    path = new_table_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    kept = list(session._FOLDERS)
    session._FOLDERS[:] = [path, f"{path}-never-written"]
    try:
        assert session.remove_folders() == 1 and not session._FOLDERS
        with pytest.raises(AnalysisException):
            spark.read.parquet(path)
    finally:
        session._FOLDERS[:] = [f for f in kept if f != path]


def test_folders_by_symbol(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = bars_of(spark, bar_rows("A", 3) + bar_rows("B/x", 2)).withColumn("unadjusted_close", F.lit(0.0))
    bars.select("symbol", *SYMBOL_FILE_COLUMNS).write.partitionBy("symbol").csv(path, header=True)
    assert {r["symbol"]: r["count"] for r in stats.symbol_counts(read_symbol_folders(spark, path)).collect()} == {"A": 3, "B/x": 2}
    listed = read_symbol_folders(spark, path, spark.createDataFrame([("B/x",)], "symbol string"))
    assert {r["symbol"] for r in listed.collect()} == {"B/x"}


def test_selecting_dropping_and_combining(spark):
    bars = bars_of(spark, bar_rows("A", 6) + bar_rows("B", 1) + bar_rows("C", 3))
    assert prep.select_symbols(bars, "A").count() == 6
    assert prep.select_symbols(bars, ["A", "C", "Z"]).count() == 9
    listed = spark.createDataFrame([("B",), ("B",), ("Z",)], "symbol string")
    assert prep.select_symbols(bars, listed).count() == 1
    assert [r["symbol"] for r in prep.missing_symbols(listed, bars).collect()] == ["Z"]
    left = prep.drop_last_bars(bars, 2)
    assert {r["symbol"]: r["count"] for r in stats.symbol_counts(left).collect()} == {"A": 4, "C": 1}
    assert left.agg(F.max("date")).first()[0] == dt.date(2015, 1, 4)
    assert prep.drop_last_bars(bars).count() == 10
    assert prep.union_bars(bars, bars.select(*reversed(bars.columns))).count() == 20


def test_minibatch_size(spark):
    bars = bars_of(spark, bar_rows("A", 11))
    assert stats.minibatch_size(bars).first()["batch_size"] == 11
    assert stats.minibatch_size(bars, batch_split=4).first()["batch_size"] == 2
    assert stats.minibatch_size(bars, size=6).first()["batch_size"] == 6


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars_of(spark, bar_rows("A", 5)).write.parquet(path)
    plan = stats.symbol_counts(prep.select_symbols(spark.read.parquet(path), "A"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<symbol:string,date:date>" in plan
    assert "EqualTo(symbol,A)" in plan
