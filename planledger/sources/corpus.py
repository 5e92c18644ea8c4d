"""Source-file corpora: scan, roots, fingerprints, incremental scan, import filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def scan_corpus(
    spark: SparkSession,
    paths: Sequence[str],
    glob: str = "*.java",
    recursive: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """One row per file under the given folders and files, each path once.

    Repeated paths, and with ``recursive`` those inside another one, are dropped before the scan, so
    the listing has each file once and no content is shuffled. The tasks that read the files also
    decode them; a file is one row and is never split. ``limit`` of ``None`` or -1 means every file;
    else the first files by path, found by a listing without contents.
    """
    roots = outermost(paths) if recursive else list(dict.fromkeys(p.rstrip("/") for p in paths))
    if limit is not None and limit >= 0:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(roots).select("path").distinct()
        roots = [r.path for r in names.orderBy("path").limit(limit).collect()]  # no more than asked for
        if not roots:
            return with_class_names(spark.createDataFrame([], "path string, content string, size bigint"))
    files = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", glob)
        .load(roots)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("value").alias("content"),
            F.col("_metadata.file_size").alias("size"),
        )
    )
    return with_class_names(files)


def outermost(paths: Sequence[str]) -> list[str]:
    """The paths that are not inside another one, each once."""
    kept: list[str] = []
    for path in sorted({p.rstrip("/") or "/" for p in paths}):
        if not any(path.startswith(k.rstrip("/") + "/") for k in kept):
            kept.append(path)
    return kept


def with_class_names(files: DataFrame) -> DataFrame:
    """Adds the class name (file name without ending) and its package-qualified form."""
    name = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    package = F.regexp_extract(text.source_without_comments(F.col("content")), r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    return files.withColumn("class_name", name).withColumn(
        "qualified_class", F.concat_ws(".", F.nullif(package, F.lit("")), "class_name")
    )


def source_roots(corpus: DataFrame) -> DataFrame:
    """Distinct outermost ``src/main/java`` folders.

    A folder that owns such a root is not searched any deeper, so a root whose
    project folder lies inside another root's project folder is dropped.
    """
    project = F.regexp_extract("path", r"^(.*?)/src/main/java/", 1)
    found = (
        corpus.filter(F.contains("path", F.lit("/src/main/java/")))
        .select(project.alias("project"))
        .distinct()
    )
    steps = F.split("project", "/")
    outer = F.transform(
        F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), "/")
    )
    nested = (
        found.select("project", F.explode(outer).alias("outer"))
        .filter("outer <> project")
        .join(found.select(F.col("project").alias("outer")), "outer", "left_semi")
        .select("project")
        .distinct()
    )
    return found.join(nested, "project", "left_anti").select(
        F.concat("project", F.lit("/src/main/java")).alias("root")
    )


def with_fingerprint(corpus: DataFrame, checksum: str = "crc32") -> DataFrame:
    """Adds ``fingerprint``: checksum, size and class name.

    ``crc32`` gives the same key as the usual scan cache. ``md5`` has the same parts
    and is the better choice for very many files, where 32 bits would collide.
    """
    content = F.encode("content", "utf-8")
    sums = {
        "crc32": F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0"),
        "md5": F.md5(content),
    }
    key = F.concat(sums[checksum], F.lit("-"), F.octet_length("content").cast("string"), F.col("class_name"))
    return corpus.withColumn("fingerprint", key)


def incremental(corpus: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits a corpus into files not seen before and files whose results can be reused.

    ``done`` holds the stored ``fingerprint`` values. Contents take no part in the exact join: it has the
    fingerprints and the other columns only, and so have the reused files. The fingerprints found new
    make a filter of ``FILTER_LONGS`` longs that is applied where the corpus is read, so that contents
    of new files, and of few others, go on to be matched with the new fingerprints.
    """
    seen = done.select("fingerprint").distinct().withColumn("_seen", F.lit(True))
    matched = corpus.drop("content").join(seen, "fingerprint", "left")
    fresh = matched.filter("_seen is null").select("fingerprint").distinct()
    new = corpus.filter(_may_hold(key_filter(fresh, "fingerprint"), F.col("fingerprint"))).join(fresh, "fingerprint", "left_semi")
    return new, matched.filter("_seen").drop("_seen")


#: Size of the filter of new fingerprints: eight bytes each, sixty-four bits.
FILTER_LONGS = 1 << 14


def _place(key: Column) -> tuple[Column, Column]:
    """The long of a key in the filter, and its bit there."""
    hashed = F.xxhash64(key)
    return F.pmod(hashed, F.lit(FILTER_LONGS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(hashed, 58).cast("int"))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """One row, one array: the bits of all keys. Combined per task, then one value for each long."""
    slot, bit = _place(F.col(key))
    empty = keys.sparkSession.range(FILTER_LONGS).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("bigint").alias("bits"))
    bits = keys.select(slot.alias("slot"), bit.alias("bits")).unionByName(empty).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    return bits.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"]).alias("bits"))


def _may_hold(filled: DataFrame, key: Column) -> Column:
    slot, bit = _place(key)
    return F.get(filled.scalar(), slot).bitwiseAND(bit) != 0


def prefilter(corpus: DataFrame, marker: str = "javax.persistence") -> DataFrame:
    """Files with an import line that contains ``marker``."""
    literal = "\\Q" + marker + "\\E"
    return corpus.filter(F.col("content").rlike(rf"(?m)^[ \t]*import\s[^;\n]*{literal}"))
