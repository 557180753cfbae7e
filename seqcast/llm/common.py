"""Reading tables, written intermediate tables and Arrow columns in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcast.session import new_table_folder, ship_package

#: Texts that an Arrow batch holds at most. Batches are cut again by bytes inside the tasks.
BATCH_ROWS = 512
#: Bytes of text that are worked on at a time inside a task, so that the arrays over them stay in a core's cache; a
#: longer text is worked on alone.
PIECE_BYTES = 128 << 10


def prepare(spark: SparkSession) -> None:
    """Sends the package with the jobs and keeps Arrow batches of whole texts small enough for a Python worker.

    Shuffle files go when the job that wrote them ends, so that an operator of several written steps needs the disk of
    its largest step and not of all; a frame that is run again shuffles again. Both are settings of the session and stay
    set, since frames run after the operator has returned.
    """
    ship_package()
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame's rows, written once as a table in the shared folder and read back: lineage ends there."""
    path = new_table_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """A string column without nulls (null: empty), in slices of about ``most`` bytes."""
    column = pc.fill_null(column, "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield column.slice(at, i - at)
            at, held = i, 0
        held += n
    yield column.slice(at)


def lower_ascii(c: Column) -> Column:
    """Only A-Z to a-z, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
