import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import outcomes as runs
from ledgerloom.plans import targets as plans
from ledgerloom.schemas import DOWN, UP, UnknownNodeError
from tests.helpers import by_level, graph_of, nodes_df, rows, values
from tests.test_ledger import records

OUTCOME = "node_id string, ok boolean, duration_ms long, error string, serialized_down_task string"


def applied(spark, *ids):
    return records(spark, *[f"r{i} {i} test UP SUCCESS" for i in ids])


def reported(spark, **ok):
    made = [(i, good, 7, None, f"undo {i}") for i, good in ok.items()]
    return spark.createDataFrame(made, OUTCOME).coalesce(1)


def test_up_targets(spark):
    nodes, edges = graph_of(spark, "b>a c>b d")
    c = nodes_df(spark, ["c"])
    none = applied(spark)
    assert values(plans.up_targets(nodes, none), "node_id") == list("abcd")
    assert values(plans.up_targets_for(nodes, edges, none, c), "node_id") == list("abc")
    done = applied(spark, "a")
    assert values(plans.up_targets_for(nodes, edges, done, c), "node_id") == ["b", "c"]
    with pytest.raises(UnknownNodeError, match="Target not found: nope"):
        plans.up_targets_for(nodes, edges, none, nodes_df(spark, ["nope"]))
    plan = plans.up_plan(nodes, edges, done, plans.up_targets(nodes, done))
    assert by_level(plan) == [{"b", "d"}, {"c"}]
    assert plans.plan_pending(plan, nodes, done).first()["pending"] == 2


def test_rollback_targets(spark):
    nodes, edges = graph_of(spark, "V2>V1 V3>V2 V4>V1")
    done = applied(spark, "V1", "V2", "V3", "V4")

    def targets(node, transitive=False):
        seed = nodes_df(spark, [node])
        return values(plans.rollback_targets_for(nodes, edges, done, seed, transitive), "node_id")

    assert targets("V2") == ["V2", "V3"]
    assert targets("V1") == ["V1", "V2", "V4"]
    assert targets("V1", transitive=True) == ["V1", "V2", "V3", "V4"]
    with pytest.raises(UnknownNodeError, match="Target version not found: V9"):
        targets("V9")
    every = plans.rollback_targets_all(nodes, applied(spark, "V1", "V2"))
    assert values(every, "node_id") == ["V1", "V2"]
    assert by_level(plans.rollback_plan(nodes, edges, done, every)) == [{"V2"}, {"V1"}]


def test_first_failure_ends_an_up_run(spark):
    nodes, edges = graph_of(spark, "b>a c>a d>b,c e>d")
    history = applied(spark, "a", "e")
    plan = plans.up_plan(nodes, edges, history, nodes)
    visited = runs.up_outcomes(plan, nodes, reported(spark, b=True, c=False, d=True))
    assert rows(visited, "node_id", "outcome", "reason", "duration_ms", "error_message") == {
        ("a", "SKIP", "already executed", None, None),
        ("b", "OK", None, 7, None),
        ("c", "FAIL", None, None, "Unknown error"),
        ("d", "NOT_REACHED", None, None, None),
        ("e", "NOT_REACHED", None, None, None),
    }
    assert runs.run_summary(visited, UP).first().asDict() == {
        "direction": "UP", "total": 5, "executed": 1, "skipped": 1, "failed": 1, "success": False,
    }
    made = runs.outcome_records(visited, UP)
    assert rows(
        made, "node_id", "status", "duration_ms", "error_message", "serialized_down_task", "description"
    ) == {
        ("b", "SUCCESS", 7, None, "undo b", "task b"),
        ("c", "FAILURE", 0, "Unknown error", None, "task c"),
    }
    assert made.select("id").distinct().count() == 2
    assert rows(runs.skipped_records(visited), "node_id", "direction", "status", "error_message") == {
        ("a", "UP", "SKIPPED", "already executed"),
    }
    scripts = nodes.select("node_id", F.concat(F.lit("do "), "node_id").alias("up"))
    events = runs.run_events_from_outcomes(visited, UP, scripts)
    heard = rows(events, "node_id", "event", "reason", "error_message", "script")
    assert heard == {
        ("a", "skipped", "already executed", None, None),
        ("b", "started", None, None, None), ("b", "succeeded", None, None, None),
        ("c", "started", None, None, None), ("c", "failed", None, "Unknown error", "do c"),
        (None, "plan", None, None, None), (None, "completed", None, None, None),
    }
    assert events.select("run_id").distinct().count() == 1
    assert events.filter("event_time IS NULL").isEmpty()


def test_whole_run_and_missing_outcome(spark):
    nodes, edges = graph_of(spark, "b>a")
    plan = plans.up_plan(nodes, edges, applied(spark), nodes)
    good = runs.run_summary(runs.up_outcomes(plan, nodes, reported(spark, a=True, b=True)), UP)
    assert good.first()["success"] is True and good.first()["executed"] == 2
    with pytest.raises(ValueError, match="No outcome for node b"):
        runs.up_outcomes(plan, nodes, reported(spark, a=True))


def test_rollback_skips(spark):
    nodes, edges = graph_of(spark, "b>a c>b")
    nodes = nodes.selectExpr(
        "node_id", "name", "environment_id", "CASE WHEN node_id <> 'b' THEN down END AS down"
    )
    plan = plans.rollback_plan(nodes, edges, applied(spark, "a", "b"), nodes)
    visited = runs.rollback_outcomes(plan, nodes, reported(spark, a=True))
    assert rows(visited, "node_id", "outcome", "reason") == {
        ("c", "SKIP", "not executed"), ("b", "SKIP", "no down task"), ("a", "OK", None),
    }
    made = runs.outcome_records(visited, DOWN)
    assert rows(made, "node_id", "direction", "serialized_down_task") == {("a", "DOWN", None)}


def test_nobody_reports_nodes_behind_the_first_failure(spark):
    nodes, edges = graph_of(spark, "b>a c>a,b d>b,c")
    done = applied(spark, "a")
    plan = plans.up_plan(nodes, edges, done, plans.up_targets(nodes, done))
    run = runs.up_outcomes(plan, nodes, reported(spark, b=True, c=False))
    assert rows(run, "node_id", "outcome") == {("b", "OK"), ("c", "FAIL"), ("d", "NOT_REACHED")}
    with pytest.raises(ValueError, match="node b"):
        runs.up_outcomes(plan, nodes, reported(spark, c=False)).collect()


def test_executed_is_read_once(spark):
    nodes, edges = graph_of(spark, "b>a c>b")
    done = plans.executed_once(nodes, applied(spark, "a"))
    plan = plans.up_plan(nodes, edges, applied(spark, "a"), nodes, done)
    assert rows(plan, "node_id", "executed") == {("a", True), ("b", False), ("c", False)}
    # The plan takes the written table, not the ledger and its window.
    assert "Window" not in plan._jdf.queryExecution().toString()
