"""The append-only ledger of runs as a partitioned table.

A ledger is a folder with data and manifests: ``data/batch=<id>/environment_id=<id>/`` holds the
files, ``manifest/<version>.json`` lists the folders that are live. Appending and deleting write
new folders first and then one small manifest, which appears at once: whoever reads sees the
ledger before or after, never half of a change, also if the writer dies in between. Folders that no
manifest names are left-overs and harmless. A plain folder partitioned by environment is a ledger
too: its folders are listed in the first manifest that it gets.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas
from ledgerloom.operators import checks
from ledgerloom.scratch import Scratch
from ledgerloom.sources.files import Files


def history_scan(
    spark: SparkSession,
    path: str,
    source: str = "parquet",
    schema: T.StructType = schemas.HISTORY,
    **options: str,
) -> DataFrame:
    """Read the whole ledger; the schema is given, so nothing is inferred.

    Any Spark source works (``parquet``, ``orc``, ``json``, ``csv``; for ``jdbc`` pass the
    connection as options and no path). Of a ledger written by :func:`history_append` the live
    folders are read; filters on ``environment_id`` prune them.
    """
    reader = spark.read.format(source).options(**options)
    if source == "jdbc":
        return reader.load().select(*schema.fieldNames())
    if source == "parquet":
        _, live = _live(spark, path)
        if live is not None:
            return _read_folders(spark, path, live, schema, **options)
    return reader.schema(schema).load(path).select(*schema.fieldNames())


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def history_init(spark: SparkSession, table: str, location: str | None = None) -> None:
    """Create the ledger table if it is absent; an existing one is left alone.

    Required columns are NOT NULL. Catalogs of plain files forget that, so a comment says it as
    well, and :func:`history_insert` refuses rows that lack one. Partitioning by environment
    takes the place of an index on it.
    """
    columns = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL COMMENT 'required'")
        for f in schemas.HISTORY
    )
    place = f" LOCATION {_sql_text(location)}" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"PARTITIONED BY (environment_id){place}"
    )


def history_insert(records: DataFrame, table: str) -> None:
    """Insert records into a table made by :func:`history_init`, checked as a whole.

    A missing required value, a value outside its domain or an id that the batch repeats or the
    table has already refuses the batch.
    """
    spark = records.sparkSession
    staged, _ = Scratch(spark, "insert").keep(records, "batch")
    _refuse(staged, spark.table(table))
    staged.select(*spark.table(table).columns).write.insertInto(table)


def _refuse(staged: DataFrame, *ledgers: DataFrame | None) -> None:
    """Raise if a record is not sound, or its id is in one of the ledgers."""
    found = checks.validate_records(staged)
    for ledger in ledgers:
        if ledger is None:
            continue
        taken = ledger.select("id").join(staged.select("id"), "id", "left_semi").distinct()
        found = found.unionByName(
            checks.error_rows(
                taken, "record_pk", F.col("id"), F.lit("Record id already in the ledger")
            )
        )
    worst = found.limit(1).collect()
    if worst:
        raise ValueError(f"{worst[0]['message']}: {worst[0]['subject']}")


# -- manifests ----------------------------------------------------------------------------


def _live(spark: SparkSession, path: str) -> tuple[int, list[str] | None]:
    """Version and live folders of a ledger; ``(0, None)`` if it has no manifest."""
    versions = [n for n in Files(spark, path).names(f"{path}/manifest") if n.endswith(".json") and n[0] != "_"]
    if not versions:
        return 0, None
    text = spark.read.text(f"{path}/manifest/{versions[-1]}", wholetext=True).first()["value"]
    return int(versions[-1].removesuffix(".json")), json.loads(text)


def _publish(spark: SparkSession, path: str, version: int, live: list[str]) -> None:
    """Make ``live`` the ledger, if nobody else changed it since ``version`` was read."""
    if not Files(spark, path).put(json.dumps(live), f"{path}/manifest/{version + 1:012d}.json"):
        raise RuntimeError(f"the ledger at {path} was changed by another writer")


def _read_folders(
    spark: SparkSession,
    path: str,
    live: list[str],
    schema: T.StructType,
    with_file: bool = False,
    **options: str,
) -> DataFrame:
    """The rows of some folders, of a plain ledger and of batches; on request with ``_file``."""
    found = None
    for base, chosen in (
        (path, [f for f in live if not f.startswith("data/")]),
        (f"{path}/data", [f for f in live if f.startswith("data/")]),
    ):
        if chosen:
            reader = spark.read.options(**options).schema(schema).option("basePath", base)
            part = reader.parquet(*[f"{path}/{f}" for f in chosen])
            part = part.select(*schema.fieldNames(), F.col("_metadata.file_path").alias("_file"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema).withColumn("_file", F.lit(""))
    return found if with_file else found.drop("_file")


def _write_batch(rows: DataFrame, path: str) -> str:
    """Write a new batch, not live yet; its folder.

    Rows are sorted by node inside the files, so a look-up of one node skips row groups.
    """
    folder = f"data/batch={uuid.uuid4().hex}"
    in_order = rows.sortWithinPartitions("environment_id", "node_id")
    in_order.write.partitionBy("environment_id").parquet(f"{path}/{folder}")
    return folder


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The ledger at ``path``, or none if nothing was written there yet."""
    try:
        return history_scan(spark, path, schema=schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def history_append(
    records: DataFrame, path: str, existing: DataFrame | None = None
) -> None:
    """Append records after checking them; any violation refuses the whole batch.

    The batch is staged first, so what was checked is what is written, also when ids or
    times are made on the fly. Its ids must not be in the ledger at ``path`` yet, nor in
    ``existing`` (an archive, say). Only id columns are read for that, and against a small
    batch it is one map-side pass. Of two writers at a time one fails and may try again.
    """
    spark = records.sparkSession
    staged, n = Scratch(spark, "append").keep(records, "batch")
    version, live = _live(spark, path)
    if live is None:
        live = [name for name in Files(spark, path).names(path) if name.startswith("environment_id=")]
    _refuse(staged, _stored(spark, path, records.schema), existing)
    _publish(spark, path, version, [*live, _write_batch(staged, path)] if n else live)


def history_delete(history: DataFrame, condition: Column) -> DataFrame:
    """The ledger without the records that meet the condition (null counts as not met)."""
    return history.filter(~F.coalesce(condition, F.lit(False)))


def history_delete_stored(
    spark: SparkSession, path: str, condition: Column, schema: T.StructType = schemas.HISTORY
) -> int:
    """Delete records from the ledger at ``path``; returns how many.

    Only folders that hold such records are written again, as a new batch, and the manifest
    that names it in their place makes the deletion happen. The driver sees one row for each
    folder.
    """
    version, live = _live(spark, path)
    if live is None:
        live = [name for name in Files(spark, path).names(path) if name.startswith("environment_id=")]
    folder = F.regexp_extract("_file", r"(data/batch=[^/]+/environment_id=[^/]+|environment_id=[^/]+)/[^/]+$", 1)
    doomed = F.coalesce(condition, F.lit(False))
    seen = (
        _read_folders(spark, path, live, schema, with_file=True)
        .groupBy(folder.alias("folder"))
        .agg(F.count_if(doomed).alias("gone"), F.count_if(~doomed).alias("kept"))
        .collect()
    )
    by_folder = {unquote(r["folder"]): r for r in seen}
    concerned = sorted(f for f, r in by_folder.items() if r["gone"])
    if not concerned:
        return 0
    # A batch that some folders leave is listed by its others from now on.
    split = {f.rpartition("/")[0] for f in concerned}
    stay = [f for f in live if f not in concerned and f not in split]
    stay += sorted(f for f in by_folder if f.rpartition("/")[0] in split & set(live) and f not in concerned)
    if any(by_folder[f]["kept"] for f in concerned):
        kept = history_delete(_read_folders(spark, path, concerned, schema), condition)
        stay.append(_write_batch(kept, path))
    _publish(spark, path, version, stay)
    return sum(by_folder[f]["gone"] for f in concerned)

