"""Which nodes a run touches, and in which levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.closure import target_closure, transitive_dependents
from ledgerloom.operators.graph import direct_dependents
from ledgerloom.operators.ledger import executed_in_graph, pending_nodes
from ledgerloom.operators.levels import plan_levels_for, reverse_plan_levels_for
from ledgerloom.schemas import UnknownNodeError
from ledgerloom.scratch import Scratch

# Fixed texts.
UNKNOWN_TARGET = "Target not found"
UNKNOWN_VERSION = "Target version not found"


def _require_known(nodes: DataFrame, targets: DataFrame, text: str) -> None:
    unknown = targets.join(nodes, "node_id", "left_anti").select("node_id").limit(1).collect()
    if unknown:
        raise UnknownNodeError(f"{text}: {unknown[0]['node_id']}")


def up_targets(nodes: DataFrame, history: DataFrame) -> DataFrame:
    """Everything that is not executed yet."""
    return pending_nodes(nodes, history).select("node_id")


def up_targets_for(
    nodes: DataFrame, edges: DataFrame, history: DataFrame, targets: DataFrame
) -> DataFrame:
    """The targets and all they need, as far as not executed."""
    _require_known(nodes, targets, UNKNOWN_TARGET)
    wanted = nodes.join(target_closure(targets, edges), "node_id", "left_semi")
    return up_targets(wanted, history)


def executed_once(nodes: DataFrame, history: DataFrame) -> DataFrame:
    """``node_id`` of the executed nodes as a written table: the ledger is read once for it.

    Targets and plans both need it; pass it to the plans as ``executed``.
    """
    done = executed_in_graph(nodes, history).select("node_id")
    return Scratch(nodes.sparkSession, "plan").keep(done, "executed")[0]


def up_plan(
    nodes: DataFrame,
    edges: DataFrame,
    history: DataFrame,
    targets: DataFrame,
    executed: DataFrame | None = None,
) -> DataFrame:
    """``level, node_id, executed`` of the targets. A dry run is just this table."""
    plan = plan_levels_for(nodes, edges, targets)
    return _with_executed(plan, nodes, history, executed)


def _with_executed(
    plan: DataFrame, nodes: DataFrame, history: DataFrame, executed: DataFrame | None
) -> DataFrame:
    done = executed_in_graph(nodes, history) if executed is None else executed
    done = done.select("node_id", F.lit(True).alias("_done"))
    return plan.join(done, "node_id", "left").select(
        "level", "node_id", F.col("_done").isNotNull().alias("executed")
    )


def plan_pending(plan: DataFrame, nodes: DataFrame, history: DataFrame) -> DataFrame:
    """One row ``pending``: nodes of the plan minus executed nodes of the whole graph.

    This is the figure a plan reports about itself; it may be negative. For the number of
    nodes still to do use ``status_summary``.
    """
    done = executed_in_graph(nodes, history).agg(F.count(F.lit(1)).alias("n"))
    return plan.agg(F.count(F.lit(1)).alias("n")).select(
        (F.col("n") - done.scalar()).alias("pending")
    )


def rollback_targets_all(nodes: DataFrame, history: DataFrame) -> DataFrame:
    """Every executed node."""
    return executed_in_graph(nodes, history).select("node_id")


def rollback_candidates(
    targets: DataFrame, edges: DataFrame, transitive: bool = False
) -> DataFrame:
    """The targets and what needs them: directly, or with ``transitive`` at any distance."""
    dependents = transitive_dependents if transitive else direct_dependents
    return targets.select("node_id").unionByName(
        dependents(targets, edges).select("node_id")
    ).distinct()


def rollback_targets_for(
    nodes: DataFrame,
    edges: DataFrame,
    history: DataFrame,
    targets: DataFrame,
    transitive: bool = False,
) -> DataFrame:
    """The candidates that are executed."""
    _require_known(nodes, targets, UNKNOWN_VERSION)
    wanted = nodes.join(rollback_candidates(targets, edges, transitive), "node_id", "left_semi")
    return rollback_targets_all(wanted, history)


def rollback_plan(
    nodes: DataFrame,
    edges: DataFrame,
    history: DataFrame,
    targets: DataFrame,
    executed: DataFrame | None = None,
) -> DataFrame:
    """``level, node_id, executed``, dependents first."""
    plan = reverse_plan_levels_for(nodes, edges, targets)
    return _with_executed(plan, nodes, history, executed)
