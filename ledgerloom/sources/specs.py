"""Specification files and tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text
from ledgerloom.scratch import Scratch


# scheme, authority and path of a location; a plain path has neither of the first two.
LOCATION = r"^(?:([A-Za-z][A-Za-z0-9+.-]+):)?(?://([^/]*))?/*(.*)$"


def _part(path: Column, which: int) -> Column:
    return F.regexp_extract(path, LOCATION, which)


def spec_files(
    paths: DataFrame, root: str = "", environment: str | None = None, suffix: str = ".yaml"
) -> DataFrame:
    """Spec files among a table of paths: ``path, kind``.

    Target files lie directly in ``targets/``, task files anywhere below ``tasks/``, the
    environment file is ``environments/<environment>.yaml``; anything else is left out. Paths
    and ``root`` may be plain or URIs of any scheme: a file is below the root if its path is,
    and its scheme and authority are those that the root names, if it names any.
    """
    scheme, authority, below = re.match(LOCATION, root.replace("\\", "/")).groups("")
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    base = below.rstrip("/")
    base = f"{base}/" if base else ""
    plain = _part(path, 3)
    same = plain.startswith(base)
    if scheme:
        same &= F.lower(_part(path, 1)) == scheme.lower()
    if authority:
        same &= _part(path, 2) == authority
    if not root:
        # Paths that are relative to the project.
        plain, same = F.ltrim(path, F.lit("/")), F.lit(True)
    inside = F.when(same, F.substring(plain, F.lit(len(base) + 1), F.length(plain)))
    end = re.escape(suffix)
    kind = (
        F.when(inside.rlike(rf"^targets/[^/]*{end}$"), "target")
        .when(inside.rlike(rf"^tasks/(.*/)?[^/]*{end}$"), "task")
        .when(inside == F.lit(f"environments/{environment}{suffix}"), "environment")
    )
    return paths.select("path", kind.alias("kind")).filter("kind IS NOT NULL")


def list_spec_files(
    spark: SparkSession, root: str, environment: str | None = None, suffix: str = ".yaml"
) -> DataFrame:
    """The same over a real folder, on any file system: names only, contents are never read.

    The folder is listed once, by tasks if it is large; files without a byte are not listed. Files of the suffix none of which is a
    spec file are an error: most likely the root is not that of a project.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )
    scratch = Scratch(spark, "specs")
    listed, n = scratch.keep(listing, "listed")
    found, matched = scratch.keep(spec_files(listed, root, environment, suffix), "found")
    if n and not matched:
        raise ValueError(f"none of the {n} {suffix} files below {root} is a spec file")
    # Local files are named by their plain path.
    return found.withColumn("path", F.regexp_replace("path", r"^file:/+", "/"))


def files_per_kind(files: DataFrame) -> DataFrame:
    """Number of files of each kind."""
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"))


def spec_scan(
    spark: SparkSession, path: str, schema: T.StructType, source: str = "json"
) -> DataFrame:
    """Read specs into typed rows; unknown keys are ignored, absent ones become null.

    The file a row came from is kept in ``file_path``, from which ids can be taken with
    :func:`ledgerloom.functions.text.task_id_from_path`.
    """
    return (
        spark.read.format(source)
        .schema(schema)
        .load(path)
        .select("*", F.col("_metadata.file_path").alias("file_path"))
    )


def read_script_files(spark: SparkSession, path: str, id_pattern: str) -> DataFrame:
    """One row per file, ``script_id, script``: whole text, id cut from the path."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("script_id"),
            F.col("value").alias("script"),
        )
    )


# Separates the scripts of a bundle; scripts may hold any other text.
SEPARATOR = "\x1e\n"


def write_script_bundles(scripts: DataFrame, path: str) -> DataFrame:
    """Write many scripts a file, and ``index``: ``script_id, file, offset, length`` of each.

    ``scripts`` has ``script_id, script``. The task that writes a file lays its scripts out one after
    another; offset and length count characters of the file. A script of null is not written. The
    index lies beside the bundles, so that one script can be found without reading them all.
    """
    rows = scripts.select(F.col("script_id").cast("string").alias("script_id"), "script")
    scratch = Scratch(scripts.sparkSession, "bundles")
    held, _ = scratch.keep(
        rows.filter("script IS NOT NULL").withColumn("part", F.spark_partition_id()), "rows"
    )
    # Each record: the id on a line of its own, the text, the separator.
    head = F.length("script_id") + 1
    size = (head + F.length("script") + len(SEPARATOR)).cast("long")
    in_order = Window.partitionBy("part").orderBy("script_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = held.withColumn("size", size).withColumn("until", F.sum("size").over(in_order))
    laid, _ = scratch.keep(sized, "laid")
    record = F.concat("script_id", F.lit("\n"), "script")
    (
        laid.select("part", "until", record.alias("value"))
        .repartition("part")
        .sortWithinPartitions("part", "until")
        .select("value", "part")
        .write.option("lineSep", SEPARATOR)
        .partitionBy("part")
        .text(f"{path}/bundles")
    )
    index = laid.select(
        "script_id",
        F.concat(F.lit("part="), F.col("part").cast("string")).alias("file"),
        (F.col("until") - F.col("size") + head).alias("offset"),
        F.length("script").cast("long").alias("length"),
    )
    index.write.parquet(f"{path}/index")
    return scripts.sparkSession.read.schema(index.schema).parquet(f"{path}/index")


def read_script_bundles(spark: SparkSession, path: str) -> DataFrame:
    """``script_id, script`` of all scripts written by :func:`write_script_bundles`."""
    record = F.col("value")
    at = F.instr(record, "\n")
    return (
        spark.read.option("lineSep", SEPARATOR)
        .text(f"{path}/bundles")
        .select(
            F.substring(record, F.lit(1), at - 1).alias("script_id"),
            F.substring(record, at + 1, F.length(record)).alias("script"),
        )
    )


def with_script(specs: DataFrame, scripts: DataFrame, column: str = "up") -> DataFrame:
    """Put file text into ``column`` of the specs it belongs to (joined on task id)."""
    text_of = scripts.select(F.col("script_id").alias("task_id"), F.col("script").alias("_script"))
    return (
        specs.join(text_of, "task_id", "left")
        .withColumn(column, F.coalesce(F.col("_script"), F.col(column)))
        .drop("_script")
    )


def task_ids(files: DataFrame, root: str) -> DataFrame:
    """Task id of each task file; a file elsewhere is an error."""
    return files.select("path", text.task_id_from_path(F.col("path"), root).alias("task_id"))
