"""Incremental corpus scan as a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.corpus import with_fingerprint


def scan_new_files(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    to_corpus: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    glob: str = "*",
    done: DataFrame | None = None,
    extract: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Extracts what is new in ``folder`` and appends it to the Parquet table ``out``.

    The file source remembers in ``checkpoint`` which files it has read, so a second run
    reads none of them again. ``done`` holds fingerprints whose results exist already; rows
    with such a fingerprint are left out. Runs over everything available, then stops.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    corpus = with_fingerprint(to_corpus(stream), "md5")
    if done is not None:
        corpus = corpus.join(done.select("fingerprint").distinct(), "fingerprint", "left_anti")
    rows = extract(corpus) if extract else corpus
    query = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def scan_text_files(
    spark: SparkSession, folder: str, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], glob: str = "*.java"
) -> DataFrame:
    """The same for source files: each new file is one row and goes through ``extract`` once."""
    stream = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )
    rows = extract(stream)
    query = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
