"""Predictions, documents and models as files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seqcast.schema import SequenceConfig
from seqcast.session import make_folder, new_table_folder, open_folder, ship_package
from seqcast.sources.readers import SYMBOL_FILE_COLUMNS
from seqcast.training.averaging import AveragedModel
from seqcast.training.kernels import LinearKernel, LstmKernel

FORMATS = ("parquet", "csv", "json")
STATE_SCHEMA = "symbol string, epoch int, loss double, state array<double>"
KERNELS = {"linear": LinearKernel, "lstm": LstmKernel}


def with_run_label(df: DataFrame) -> DataFrame:
    """Adds ``run``, the time of the run in a form that may stand in a path."""
    return df.withColumn("run", F.date_format(F.current_timestamp(), "MM-dd_HH-mm-ss"))


def write_predictions(
    predictions: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", windows_per_file: int = 1_000_000
) -> None:
    """Predictions in one folder per symbol, in files of at most ``windows_per_file`` windows.

    Rows are gathered by symbol and stretch of windows, so a symbol does not
    leave a file in every task and a long one is not written by a single task.
    """
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}")
    if fmt == "csv":  # arrays as text
        arrays = [f.name for f in predictions.schema if isinstance(f.dataType, T.ArrayType)]
        predictions = predictions.withColumns({name: F.to_json(name) for name in arrays})
    stretch = F.expr(f"window div {int(windows_per_file)}")
    gathered = predictions.withColumn("_stretch", stretch).repartition("symbol", "_stretch").drop("_stretch")
    options = {"header": "true"} if fmt == "csv" else {}
    writer = gathered.write.mode(mode).partitionBy("symbol").option("maxRecordsPerFile", windows_per_file)
    writer.options(**options).format(fmt).save(path)


def write_symbol_files(bars: DataFrame, directory: str) -> DataFrame:
    """One CSV file per symbol, named by it, with a header and the columns of a per-symbol file, by date.

    A task writes the files of its symbols one after another, a batch of bars at
    a time. The close is written as the adjusted one and once more as it is
    unless the bars have ``unadjusted_close``. Gives ``symbol, path, bars``.
    """
    ship_package()
    columns = list(SYMBOL_FILE_COLUMNS)
    if "unadjusted_close" not in bars.columns:
        bars = bars.withColumn("unadjusted_close", F.col("close"))
    folder = directory.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, count, path = None, None, 0, None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([path]), pa.array([count])], names=["symbol", "path", "bars"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for symbol in pc.unique(table["symbol"]).to_pylist():
                rows = table.filter(pc.equal(table["symbol"], symbol)).select(columns)
                if symbol != now:
                    if now is not None:
                        yield done()
                    now, count, path = symbol, 0, f"{folder}/{symbol}.csv"
                    system, place = open_folder(path)
                    out = csv.CSVWriter(system.open_output_stream(place), rows.schema)
                out.write_table(rows)
                count += rows.num_rows
        if now is not None:
            yield done()

    make_folder(folder)
    ordered = bars.repartition("symbol").sortWithinPartitions("symbol", "date").select("symbol", *columns)
    path = new_table_folder(bars.sparkSession, "symbol-files")
    ordered.mapInArrow(write, "symbol string, path string, bars bigint").write.parquet(path)
    return bars.sparkSession.read.schema("symbol string, path string, bars bigint").parquet(path)


def predictions_as_documents(predictions: DataFrame, page_size: int = 10_000) -> DataFrame:
    """``symbol, page, document``: predicted and actual values as JSON.

    A page holds ``page_size`` windows in order, so a document has a bounded
    size; a symbol with more windows has more pages.
    """
    point = F.struct("window", "prediction", "actual")
    pages = predictions.groupBy("symbol", F.expr(f"window div {int(page_size)}").alias("page")).agg(
        F.sort_array(F.collect_list(point)).alias("points")
    )
    document = F.struct(
        "symbol",
        "page",
        F.col("points.window").alias("window"),
        F.create_map(
            F.lit("predict"), F.col("points.prediction"), F.lit("actual"), F.col("points.actual")
        ).alias("result"),
    )
    return pages.select("symbol", "page", F.to_json(document).alias("document"))


def save_model(model: PipelineModel | AveragedModel, path: str) -> None:
    """Saves a model, and beside it what kind it is; an averaged one with the running state of its kernel."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(f"{path}/pipeline")
        _write_about(SparkSession.builder.getOrCreate(), {"kernel": None}, path)
        return
    name = next(key for key, kind in KERNELS.items() if isinstance(model.kernel, kind))
    about = {
        "kernel": name,
        "settings": asdict(model.kernel),
        "length": model.length,
        "per_symbol": model.per_symbol,
        "models": model.models,
    }
    model.states.write.mode("overwrite").parquet(f"{path}/states")
    _write_about(model.states.sparkSession, about, path)


def _write_about(spark: SparkSession, about: dict, path: str) -> None:
    spark.range(1).select(F.lit(json.dumps(about)).alias("value")).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> PipelineModel | AveragedModel:
    """Loads what :func:`save_model` wrote."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    if about["kernel"] is None:
        return PipelineModel.load(f"{path}/pipeline")
    settings = dict(about["settings"])
    if "config" in settings:
        settings["config"] = SequenceConfig(**settings["config"])
    kernel = KERNELS[about["kernel"]](**settings)
    states = spark.read.schema(STATE_SCHEMA).parquet(f"{path}/states")
    return AveragedModel(kernel, about["length"], about["per_symbol"], about["models"], states)
