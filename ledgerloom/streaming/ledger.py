"""The ledger and the calls of a run's listener as streams.

Sinks are tables written batch by batch: ``<path>/batch_id=<n>``, overwritten when a batch
is replayed, so results survive a restart and never pass through the driver. A table of current
rows folds its batches into a snapshot from time to time; the ledger is kept by day, so that a
batch is compared with its own days only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import NumericType, StructType

from ledgerloom.operators import checks
from ledgerloom.operators.ledger import KEYS, applied
from ledgerloom.scratch import Scratch
from ledgerloom.sources.files import Files


def drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Run a stream over all that is there now, then stop."""
    query = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _falling(records: DataFrame, column: str) -> Column:
    """A value that is largest where the column is smallest."""
    if isinstance(records.schema[column].dataType, NumericType):
        return -F.col(column)
    turned = F.translate(F.hex(column), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(turned, F.lit("G"))


def latest_status_stream(records: DataFrame) -> DataFrame:
    """Latest record and executed flag per (node, environment), kept up to date.

    State is one row per key, and a late record is harmless because a maximum is kept.
    Ties on time go to the smallest ``seq``, then ``id``, as in the batch operator.
    """
    ties = [c for c in ("seq", "id") if c in records.columns]
    order = F.struct(F.col("executed_at"), *[_falling(records, c).alias(f"_{c}") for c in ties])
    value = F.struct("executed_at", "id", "direction", "status")
    return (
        records.groupBy(*KEYS)
        .agg(F.max_by(value, order).alias("top"))
        .select(
            *KEYS,
            F.col("top.executed_at").alias("executed_at"),
            F.col("top.id").alias("id"),
            applied(F.col("top.direction"), F.col("top.status")).alias("executed"),
        )
    )


def changes_to_table(updates: DataFrame, path: str) -> DataStreamWriter:
    """Write the changed rows of every batch; read them with :func:`current_rows`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return updates.writeStream.outputMode("update").foreachBatch(write)


def current_rows(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of its last batch."""
    last = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return (
        changes.withColumn("_rank", F.row_number().over(last))
        .filter("_rank = 1")
        .drop("_rank", "batch_id")
    )


# Batches after which the log of a table of current rows is folded.
FOLD_EVERY = 16


def _numbered(files: Files, path: str, name: str) -> list[int]:
    """The numbers of the folders ``<name>=<number>`` below ``path`` that were written whole."""
    marked = [n for n in files.names(path) if n.startswith(f"{name}=")]
    whole = [n for n in marked if files.exists(f"{path}/{n}/_SUCCESS")]
    return sorted(int(n.partition("=")[2]) for n in whole)


def keep_current(
    updates: DataFrame, path: str, keys: list[str], fold_every: int = FOLD_EVERY
) -> DataStreamWriter:
    """Keep the last row of each key; read them with :func:`read_current`.

    A batch is one folder of ``log``. When ``fold_every`` of them lie there, the rows that are
    current become ``snapshot/upto=<batch>``, and then older folders go. A reader takes the last
    whole snapshot and the batches after it, so a crash in between leaves nothing wrong: what was
    not cleaned up is not read, and goes with the next fold.
    """
    spark = updates.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")
        fold_current(spark, path, keys, fold_every)

    return updates.writeStream.outputMode("update").foreachBatch(write)


def _parts(files: Files, path: str) -> tuple[int, list[int]]:
    """The last whole snapshot (-1: none), and the batches after it."""
    upto = max(_numbered(files, f"{path}/snapshot", "upto"), default=-1)
    return upto, [n for n in _numbered(files, f"{path}/log", "batch_id") if n > upto]


def fold_current(spark: SparkSession, path: str, keys: list[str], fold_every: int) -> None:
    """Fold the log into a new snapshot if it is long enough, and clean up behind it."""
    files = Files(spark, path)
    upto, later = _parts(files, path)
    if len(later) >= fold_every:
        upto = later[-1]
        read_current(spark, path, keys).write.mode("overwrite").parquet(f"{path}/snapshot/upto={upto}")
    for folder, name in (("snapshot", "upto"), ("log", "batch_id")):
        for found in files.names(f"{path}/{folder}"):
            kind, _, number = found.partition("=")
            old = kind == name and (int(number) < upto if name == "upto" else int(number) <= upto)
            if old:
                files.remove(f"{path}/{folder}/{found}")


def read_current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key of a table written by :func:`keep_current`."""
    upto, later = _parts(Files(spark, path), path)
    folders = [(upto, f"snapshot/upto={upto}")] if upto >= 0 else []
    folders += [(n, f"log/batch_id={n}") for n in later]
    if not folders:
        raise FileNotFoundError(f"no batch was written to {path} yet")
    schema = spark.read.parquet(f"{path}/{folders[-1][1]}").schema
    reader = spark.read.schema(schema)
    number = F.regexp_extract("_metadata.file_path", r"(?:upto|batch_id)=(\d+)/", 1).cast("long")
    rows = reader.parquet(*[f"{path}/{folder}" for _, folder in folders])
    return current_rows(rows.select("*", number.alias("batch_id")), keys)


def outcome_counts_stream(
    events: DataFrame, window: str = "1 day", lateness: str | None = None
) -> DataFrame:
    """Successes, skips and failures per tumbling window and direction.

    ``events`` has ``event_time, direction, event``. State is one row per window and
    direction, and every event counts, however late. ``lateness`` sets a watermark, which
    append mode needs: a window then comes out once, when it has passed, without later rows.
    """

    def tally(event: str):
        return F.count_if(F.col("event") == event).alias(event)

    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    if lateness is not None:
        timed = timed.withWatermark("event_time", lateness)
    return (
        timed.groupBy(F.window("event_time", window).alias("w"), "direction")
        .agg(tally("succeeded"), tally("skipped"), tally("failed"))
        .select(
            F.col("w.start").alias("window_start"), "direction", "succeeded", "skipped", "failed"
        )
    )


def days_of_ledger(
    spark: SparkSession, path: str, days: list, schema: StructType
) -> DataFrame | None:
    """The ledger's rows of some days; other folders are not even listed. None: no such day."""
    files = Files(spark, path)
    there = [f"{path}/day={day}" for day in days if files.exists(f"{path}/day={day}")]
    if not there:
        return None
    return spark.read.schema(schema).option("basePath", path).parquet(*there)


def history_append_stream(records: DataFrame, path: str) -> DataStreamWriter:
    """Append a stream of records to a ledger by day and environment, each id of a day once.

    Every batch is checked, made distinct by id and compared with the ids of the days that its
    records fall on, so what a batch reads does not grow with the ledger. A record that is sent
    again carries its own time, hence its own day: a replayed batch adds nothing, and no record
    is lost to a watermark, however late it comes. The state is the ledger itself. An id that
    returns on another day is another record; :func:`checks.check_record_pk` tells of it.
    """
    schema = records.schema
    day = F.to_date("executed_at")

    def append(batch: DataFrame, batch_id: int) -> None:
        spark, scratch = batch.sparkSession, Scratch(batch.sparkSession, "append")
        days = scratch.write(batch, "batch", days=F.collect_set(day))["days"]
        staged = scratch.read(schema, "batch")
        invalid = checks.check_record_invariants(staged).unionByName(
            checks.check_record_domains(staged)
        )
        worst = invalid.limit(1).collect()
        if worst:
            raise ValueError(f"{worst[0]['message']}: {worst[0]['subject']}")
        first = Window.partitionBy("id", "day").orderBy("executed_at", "node_id")
        ranked = staged.withColumn("day", day).withColumn("_rank", F.row_number().over(first))
        fresh = ranked.filter("_rank = 1").drop("_rank")
        written = days_of_ledger(spark, path, sorted(days or []), schema)
        if written is not None:
            fresh = fresh.join(written.select("id", "day"), ["id", "day"], "left_anti")
        fresh.select(*schema.fieldNames(), "day").write.mode("append").partitionBy(
            "day", "environment_id"
        ).parquet(path)

    return records.writeStream.foreachBatch(append)
