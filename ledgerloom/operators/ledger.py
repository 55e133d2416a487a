"""Questions to the ledger: latest record, executed or not, logs.

The latest record alone decides: a node is executed when its newest record in its
environment is a successful UP. Ties on time go to ``seq`` (if the ledger has that column)
and then to ``id``, both ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.schemas import DOWN, FAILURE, SUCCESS, UP
from ledgerloom.scratch import Scratch

KEYS = ["node_id", "environment_id"]


def records_for_env(history: DataFrame, environment_id: str) -> DataFrame:
    return history.filter(F.col("environment_id") == environment_id)


def records_for_node(history: DataFrame, node_id) -> DataFrame:
    return history.filter(F.col("node_id") == node_id)


def failure_messages(history: DataFrame, node_id=None) -> DataFrame:
    """Error text of failed records, of one node or of all."""
    failed = history.filter(F.col("status") == FAILURE)
    if node_id is not None:
        failed = records_for_node(failed, node_id)
    return failed.select("id", "node_id", "environment_id", "error_message")


def is_up(direction: Column) -> Column:
    return direction == UP


def is_down(direction: Column) -> Column:
    return direction == DOWN


def latest_record(history: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Newest record per (node, environment), of the given keys or of all.

    ``row_number() = 1`` is planned with a group limit before the shuffle: each task sends
    at most one row per key, so a key that holds much of the ledger does not pile up. Given
    keys are matched before the sort. They are written first, a row each, so that they are
    broadcast only if they are few. Their hash is a part of the join's key: the sort then needs
    a shuffle of its own, and adaptive execution may split a key that piles up in the join.
    """
    if keys is not None:
        wanted, _ = Scratch(keys.sparkSession, "wanted").keep(keys.select(*KEYS).distinct(), "keys")
        mixed = F.xxhash64(*KEYS)
        history = (
            history.withColumn("_hash", mixed)
            .join(wanted.withColumn("_hash", mixed), [*KEYS, "_hash"], "left_semi")
            .select(*history.columns)
        )
    order = [F.col("executed_at").desc()]
    if "seq" in history.columns:
        order.append(F.col("seq").asc())
    order.append(F.col("id").asc())
    newest = Window.partitionBy(*KEYS).orderBy(*order)
    return (
        history.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def applied(direction: Column, status: Column) -> Column:
    """Whether a latest record means *executed*."""
    return F.coalesce((direction == UP) & (status == SUCCESS), F.lit(False))


def executed_pairs(history: DataFrame) -> DataFrame:
    """(node, environment) pairs that are executed."""
    narrow = history.select(
        *KEYS, "direction", "status", "executed_at", "id",
        *(["seq"] if "seq" in history.columns else []),
    )
    return (
        latest_record(narrow)
        .filter(applied(F.col("direction"), F.col("status")))
        .select(*KEYS)
    )


def was_executed(keys: DataFrame, history: DataFrame) -> DataFrame:
    """The keys with ``executed``; a key without records is not executed."""
    done = executed_pairs(history).withColumn("_done", F.lit(True))
    return keys.join(done, KEYS, "left").select(
        *keys.columns, F.col("_done").isNotNull().alias("executed")
    )


def executed_nodes(history: DataFrame, environment_id: str | None = None) -> DataFrame:
    """Executed nodes of one environment or of each, ordered."""
    if environment_id is not None:
        history = records_for_env(history, environment_id)
    return executed_pairs(history).orderBy("environment_id", "node_id")


def history_log(history: DataFrame, environment_id: str | None = None) -> DataFrame:
    """Records in time order: a range-partitioned sort, no single task holds the log."""
    if environment_id is not None:
        history = records_for_env(history, environment_id)
    return history.orderBy("executed_at", "id")


def recent_records(history: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` records (top-n per task, merged)."""
    return (
        history.select("id", "node_id", "status", "executed_at", "duration_ms", "error_message")
        .orderBy(F.col("executed_at").desc(), F.col("id").asc())
        .limit(n)
        .drop("id")
    )


# -- nodes against the ledger -------------------------------------------------------------


def status_by_node(nodes: DataFrame, history: DataFrame) -> DataFrame:
    """Every node with its executed flag and, only if executed, its latest record."""
    done = (
        latest_record(history)
        .filter(applied(F.col("direction"), F.col("status")))
        .select(
            *KEYS,
            F.col("id").alias("record_id"),
            "executed_at",
            "duration_ms",
            F.col("description").alias("record_description"),
        )
    )
    return nodes.select("node_id", "name", "environment_id").join(done, KEYS, "left").select(
        "node_id",
        "name",
        "environment_id",
        F.col("record_id").isNotNull().alias("executed"),
        "record_id",
        "executed_at",
        "duration_ms",
        "record_description",
    )


def executed_in_graph(nodes: DataFrame, history: DataFrame) -> DataFrame:
    """Nodes that are executed in their own environment."""
    return nodes.join(executed_pairs(history), KEYS, "left_semi")


def pending_nodes(nodes: DataFrame, history: DataFrame) -> DataFrame:
    """Nodes that are not executed in their own environment."""
    return nodes.join(executed_pairs(history), KEYS, "left_anti")


def _status_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if("executed").alias("executed"),
        F.count_if(~F.col("executed")).alias("pending"),
    ]


def status_summary(nodes: DataFrame, history: DataFrame) -> DataFrame:
    """One row: total, executed, pending."""
    return was_executed(nodes.select(*KEYS), history).agg(*_status_counts())


def status_summary_by_env(nodes: DataFrame, history: DataFrame, total: bool = False) -> DataFrame:
    """The same per environment; ``total=True`` adds a row with a null environment."""
    flagged = was_executed(nodes.select(*KEYS), history)
    grouped = flagged.rollup("environment_id") if total else flagged.groupBy("environment_id")
    return grouped.agg(*_status_counts())
