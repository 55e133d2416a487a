"""How a run went, from what its workers reported.

Nodes are visited in (level, id) order and the first failure ends the run. No window over
the plan is needed for that: the judged plan is written once, the place of the first
failure is one value observed during that write, and each row is compared with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schemas import FAILURE, SKIPPED, SUCCESS, UP
from ledgerloom.scratch import Scratch

# Fixed texts.
ALREADY_EXECUTED = "already executed"
NOT_EXECUTED = "not executed"
NO_DOWN_TASK = "no down task"
UNKNOWN_ERROR = "Unknown error"


def _visit(
    plan: DataFrame, nodes: DataFrame, outcomes: DataFrame, skip_reason: Column
) -> DataFrame:
    reported = outcomes.select(
        "node_id", "ok", "duration_ms", F.col("error").alias("_error"), "serialized_down_task"
    )
    joined = plan.join(nodes, "node_id").join(reported, "node_id", "left")
    judged = joined.select(
        "level",
        "node_id",
        "name",
        "environment_id",
        "duration_ms",
        "_error",
        "serialized_down_task",
        skip_reason.alias("reason"),
        F.when(skip_reason.isNotNull(), "SKIP")
        .when(F.col("ok"), "OK")
        .when(~F.col("ok"), "FAIL")
        .alias("_would"),
    )
    place = F.struct("level", "node_id")
    scratch = Scratch(plan.sparkSession, "run")
    seen = scratch.write(
        judged,
        "judged",
        failure=F.min(F.when(F.col("_would") == "FAIL", place)),
        unreported=F.min(F.when(F.col("_would").isNull(), place)),
        # A run stops at its first failure, so nobody reports the nodes behind it.
        ahead=F.min(F.when(F.coalesce(F.col("_would") == "FAIL", F.col("_would").isNull()), place)),
    )
    if seen["unreported"] is not None and seen["ahead"] == seen["unreported"]:
        raise ValueError(f"No outcome for node {seen['unreported']['node_id']}")
    judged, reached = scratch.read(judged.schema, "judged"), F.lit(True)
    if seen["failure"] is not None:
        level, node_id = seen["failure"]
        id_type = judged.schema["node_id"].dataType
        reached = place <= F.struct(F.lit(level), F.lit(node_id).cast(id_type))
    outcome = F.when(reached, F.col("_would")).otherwise("NOT_REACHED")
    return judged.withColumn("outcome", outcome).select(
        "level",
        "node_id",
        "name",
        "environment_id",
        "outcome",
        F.when(F.col("outcome") == "OK", F.col("duration_ms")).alias("duration_ms"),
        F.when(F.col("outcome") == "SKIP", F.col("reason")).alias("reason"),
        F.when(
            F.col("outcome") == "FAIL", F.coalesce("_error", F.lit(UNKNOWN_ERROR))
        ).alias("error_message"),
        F.when(F.col("outcome") == "OK", F.col("serialized_down_task")).alias(
            "serialized_down_task"
        ),
    )


def up_outcomes(plan: DataFrame, nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per node of an up plan: OK, SKIP, FAIL or NOT_REACHED.

    ``plan`` is the table of ``up_plan``; ``outcomes`` must have a row for each plan node
    that would run, else ``ValueError``.
    """
    named = nodes.select("node_id", "name", "environment_id")
    reason = F.when(F.col("executed"), F.lit(ALREADY_EXECUTED))
    return _visit(plan, named, outcomes, reason)


def rollback_outcomes(plan: DataFrame, nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The same for a rollback plan; a node without a down script is skipped.

    The node's current down script counts, not one stored in the ledger.
    """
    named = nodes.select("node_id", "name", "environment_id", "down")
    reason = F.when(~F.col("executed"), F.lit(NOT_EXECUTED)).when(
        F.col("down").isNull(), F.lit(NO_DOWN_TASK)
    )
    return _visit(plan, named, outcomes, reason)


def run_summary(visited: DataFrame, direction: str) -> DataFrame:
    """One row: direction, total, executed, skipped, failed, success."""

    def tally(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return visited.agg(
        F.lit(direction).alias("direction"),
        F.count(F.lit(1)).alias("total"),
        tally("OK").alias("executed"),
        tally("SKIP").alias("skipped"),
        tally("FAIL").alias("failed"),
        (tally("FAIL") == 0).alias("success"),
    )


def _records(
    visited: DataFrame,
    direction: Column,
    status: Column,
    error: Column,
    record_id: Column | None,
    executed_at: Column | None,
) -> DataFrame:
    """Ledger rows. Ids and times may be given, else they are made while writing."""
    kept = F.when((status == SUCCESS) & (direction == UP), F.col("serialized_down_task"))
    return visited.select(
        (F.uuid() if record_id is None else record_id).alias("id"),
        "node_id",
        "environment_id",
        direction.alias("direction"),
        status.alias("status"),
        (F.current_timestamp() if executed_at is None else executed_at).alias("executed_at"),
        F.col("name").alias("description"),
        kept.alias("serialized_down_task"),
        F.when(status == SUCCESS, F.col("duration_ms"))
        .otherwise(F.lit(0).cast("long"))
        .alias("duration_ms"),
        error.alias("error_message"),
    )


def outcome_records(
    visited: DataFrame,
    direction: str,
    record_id: Column | None = None,
    executed_at: Column | None = None,
) -> DataFrame:
    """Ledger rows of the nodes that ran; skips are not recorded."""
    status = F.when(F.col("outcome") == "OK", SUCCESS).otherwise(FAILURE)
    ran = visited.filter(F.col("outcome").isin("OK", "FAIL"))
    return _records(
        ran, F.lit(direction), status, F.col("error_message"), record_id, executed_at
    )


def skipped_records(
    visited: DataFrame, record_id: Column | None = None, executed_at: Column | None = None
) -> DataFrame:
    """Ledger rows of skips, for those who want them; their direction is always UP."""
    skips = visited.filter(F.col("outcome") == "SKIP")
    return _records(
        skips, F.lit(UP), F.lit(SKIPPED), F.col("reason"), record_id, executed_at
    )


def run_events_from_outcomes(
    visited: DataFrame,
    direction: str,
    nodes: DataFrame,
    run_id: Column | None = None,
    event_time: Column | None = None,
) -> DataFrame:
    """What a listener of the run would have heard, one row per call.

    ``plan`` opens the run and ``completed`` closes it, both without a node. A failure carries
    the script that failed, the node's ``up`` or ``down`` by direction. The id of the run is
    made up if none is given, the time is the current one.
    """
    nothing = F.lit(None)
    outcome = F.col("outcome")

    def event(name: str, took=nothing, reason=nothing, error=nothing, script=nothing) -> Column:
        return F.struct(
            F.lit(name).alias("event"),
            took.cast("long").alias("duration_ms"),
            reason.cast("string").alias("reason"),
            error.cast("string").alias("error_message"),
            script.cast("string").alias("script"),
        )

    ran = visited.filter(outcome != "NOT_REACHED").select(
        "node_id",
        F.explode(
            F.when(outcome == "SKIP", F.array(event("skipped", reason=F.col("reason"))))
            .when(
                outcome == "OK",
                F.array(event("started"), event("succeeded", took=F.col("duration_ms"))),
            )
            .otherwise(F.array(event("started")))
        ).alias("e"),
    )
    scripts = nodes.select("node_id", F.col("up" if direction == UP else "down").alias("_script"))
    failed = (
        visited.filter(outcome == "FAIL")
        .join(scripts, "node_id", "left")
        .select(
            "node_id",
            event("failed", error=F.col("error_message"), script=F.col("_script")).alias("e"),
        )
    )
    ends = visited.sparkSession.range(1).select(
        nothing.cast(visited.schema["node_id"].dataType).alias("node_id"),
        F.explode(F.array(event("plan"), event("completed"))).alias("e"),
    )
    return ran.unionByName(failed).unionByName(ends).select(
        (F.lit(uuid.uuid4().hex) if run_id is None else run_id).alias("run_id"),
        (F.current_timestamp() if event_time is None else event_time).alias("event_time"),
        F.lit(direction).alias("direction"),
        "node_id",
        "e.*",
    )
