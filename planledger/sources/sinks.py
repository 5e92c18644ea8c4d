"""Report sinks, and rows as files of a tree."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folders that the files of a tree are dealt out to; rows that a task that writes them takes at a time.
FOLDERS, BATCH_ROWS = 256, 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def write_report(report: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Write report rows; every task writes its own part. Returns the folder."""
    if fmt not in ("parquet", "json", "csv", "orc"):
        raise ValueError(f"unknown report format: {fmt}")
    writer = report.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)
    return path


def write_files(rows: DataFrame, folder: str) -> str:
    """Write each ``name`` as one file ``name.txt`` below ``folder``, with a line for each ``value``. Returns the folder.

    Rows of a name meet in one task, so that a file is written as a whole and a repeated task writes it
    again. On a file system that is mounted the tasks write by themselves: Hadoop starts several processes
    for each file there, to set its permissions, one at a time in an executor. Elsewhere Spark's writer
    makes a folder of each name.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    own = rows.select(F.coalesce("name", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("name"), "value").repartition("name")
    if place.getScheme() != "file":
        own.write.partitionBy("name").option("lineSep", "\n").text(folder)
        return folder
    top, folders = place.getPath(), FOLDERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, files = None, None, 0

        def done() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{os.path.dirname(out.name)}/{name}.txt")

        for batch in batches:
            for own_name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if out is None or own_name != name:
                    done()
                    name, files = own_name, files + 1
                    inside = f"{top}/{zlib.crc32(name.encode()) % folders}"
                    os.makedirs(inside, exist_ok=True)
                    out = open(f"{inside}/.{uuid.uuid4().hex}", "wb")
                out.write((value or "").encode() + b"\n")
        done()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    batch_rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        own.sortWithinPartitions("name", "value").mapInArrow(run, "files bigint").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set(_BATCH, batch_rows)
    return folder
