"""Session settings and the place for written intermediate tables."""

from __future__ import annotations

import re
import sys
import uuid

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "seqcast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; sizes are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables, shared by all executors.

    It is the one named in ``spark.checkpoint.dir``, or else a folder below the
    warehouse, which executors share as well; the same on every master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/seqcast-work"


# Folders handed out and not removed yet.
_FOLDERS: list[str] = []


def new_table_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    _FOLDERS.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def bucketed_table(df: DataFrame, name: str, *keys: str, sorted_by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """The rows, written once in the shared folder in buckets by ``keys`` and read back.

    A join or aggregate on the keys then moves only its other side. There are as
    many buckets as the session has shuffle partitions, if nothing else is
    said, and one file for each. The catalog of the session knows the table by
    the name of its folder.
    """
    spark = df.sparkSession
    path = new_table_folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*(sorted_by or keys))
    writer.saveAsTable(table)
    return spark.table(table)


def open_folder(path: str):
    """Arrow's file system for a path or address, and the place in it; the same in the driver and in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path if ":" in path else f"file://{path}"))


def make_folder(path: str) -> None:
    system, place = open_folder(path)
    system.create_dir(place)


def remove_folders() -> int:
    """Removes every folder this process has had from :func:`new_table_folder`, and says how many there were.

    For the end of a run, when no frame that reads them is needed any more.
    """
    from pyarrow import fs

    removed = 0
    while _FOLDERS:
        system, path = open_folder(_FOLDERS.pop())
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)
            removed += 1
    return removed


def ship_package() -> None:
    """Sends this package's functions to the Python workers with the job, where it need not be installed."""
    register_pickle_by_value(sys.modules[__package__])
