from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import checks, ledger
from ledgerloom.sources import ledger as source
from ledgerloom.sources.files import Files
from tests.helpers import nodes_df, rows, values

START = datetime(2024, 1, 1)


def records(spark, *items):
    """Items ``id node env direction status``, one minute apart."""
    made = []
    for i, item in enumerate(items):
        id_, node, env, direction, status = item.split()
        error = "boom" if status == "FAILURE" else None
        made.append(
            (id_, node, env, direction, status, START + timedelta(minutes=i), f"task {node}", None, 5, error)
        )
    return spark.createDataFrame(made, schemas.HISTORY).coalesce(1)


@pytest.mark.parametrize(
    "items, executed",
    [
        (["1 n dev UP SUCCESS"], True),
        (["1 n dev UP FAILURE"], False),
        (["1 n dev UP SKIPPED"], False),
        (["1 n dev UP SUCCESS", "2 n dev DOWN SUCCESS"], False),
        (["1 n dev UP SUCCESS", "2 n dev DOWN SUCCESS", "3 n dev UP SUCCESS"], True),
        (["1 n dev UP SUCCESS", "2 n dev DOWN FAILURE"], False),
        (["1 n dev UP SUCCESS", "2 n dev UP FAILURE"], False),
        (["1 n other UP SUCCESS"], False),
        ([], False),
    ],
)
def test_latest_record_alone_decides(spark, items, executed):
    history = records(spark, *items)
    keys = nodes_df(spark, ["n"], "dev").select("node_id", "environment_id")
    assert ledger.was_executed(keys, history).first()["executed"] is executed


def test_environments_are_apart(spark):
    history = records(spark, "1 n1 dev UP SUCCESS", "2 n2 staging UP SUCCESS")
    assert values(ledger.executed_nodes(history, "dev"), "node_id") == ["n1"]
    assert values(ledger.executed_nodes(history, "staging"), "node_id") == ["n2"]
    nodes = nodes_df(spark, ["n1", "n2"], "dev")
    assert values(ledger.executed_in_graph(nodes, history), "node_id") == ["n1"]
    assert values(ledger.pending_nodes(nodes, history), "node_id") == ["n2"]


def test_ties_go_to_seq_then_id(spark):
    tied = records(spark, "b n dev UP SUCCESS", "a n dev UP FAILURE").selectExpr(
        "*", "timestamp '2024-01-01' AS t"
    ).drop("executed_at").withColumnRenamed("t", "executed_at")
    assert ledger.latest_record(tied).first()["id"] == "a"
    with_seq = tied.selectExpr("*", "CASE id WHEN 'b' THEN 1 ELSE 2 END AS seq")
    assert ledger.latest_record(with_seq).first()["id"] == "b"


def test_a_hot_key_is_cut_down_before_the_shuffle(spark):
    plan = ledger.latest_record(records(spark, "1 n dev UP SUCCESS").repartition(4))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_status(spark):
    history = records(spark, "1 a dev UP SUCCESS", "2 b dev UP FAILURE")
    nodes = nodes_df(spark, ["a", "b", "c"], "dev")
    status = ledger.status_by_node(nodes, history)
    assert rows(status, "node_id", "executed", "record_id") == {
        ("a", True, "1"), ("b", False, None), ("c", False, None),
    }
    assert ledger.status_summary(nodes, history).first().asDict() == {
        "total": 3, "executed": 1, "pending": 2,
    }
    by_env = ledger.status_summary_by_env(nodes, history, total=True)
    assert rows(by_env, "environment_id", "total", "executed", "pending") == {
        ("dev", 3, 1, 2), (None, 3, 1, 2),
    }
    empty = ledger.status_summary(nodes_df(spark, []), history)
    assert empty.first().asDict() == {"total": 0, "executed": 0, "pending": 0}


def test_logs(spark):
    history = records(spark, "2 a dev UP SUCCESS", "1 b dev UP FAILURE", "3 a qa UP SUCCESS")
    assert [r["id"] for r in ledger.history_log(history, "dev").collect()] == ["2", "1"]
    assert [r["node_id"] for r in ledger.recent_records(history, 2).collect()] == ["a", "b"]
    assert values(ledger.records_for_node(history, "a"), "id") == ["2", "3"]
    assert rows(ledger.failure_messages(history, "b"), "error_message") == {("boom",)}


def test_latest_record_matches_keys_before_the_sort(spark):
    history = records(spark, "1 a dev UP SUCCESS", "2 a dev UP FAILURE", "3 b dev UP SUCCESS", "4 a qa UP SUCCESS")
    keys = history.filter("id in ('1', '4', '2')").select("node_id", "environment_id")
    found = ledger.latest_record(history, keys)
    assert found.columns == history.columns and values(found, "id") == ["2", "4"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [") < plan.index("Join LeftSemi")


def test_given_keys_are_not_multiplied_and_a_hot_one_may_be_split(spark):
    items = [f"{i:02d} a dev UP SUCCESS" for i in range(40)] + ["90 b qa UP FAILURE", "91 c qa UP SUCCESS"]
    history = records(spark, *items).repartition(4)
    keys = history.filter("node_id <> 'c'").select("node_id", "environment_id")
    keys = keys.unionByName(keys.limit(1).selectExpr("node_id", "string(null) AS environment_id"))
    broadcast = ledger.latest_record(history, keys)
    assert "Generate" not in broadcast._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ledger.latest_record(history, keys)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert values(found, "id") == values(broadcast, "id") == ["39", "90"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    between = plan[plan.index("WindowGroupLimit"):plan.index("SortMergeJoin")]
    assert between.count("Exchange hashpartitioning(node_id") == 1


def test_append_scan_init_delete(spark, out):
    history = records(spark, "1 a dev UP SUCCESS", "2 b qa UP FAILURE")
    path = f"{out}/ledger"
    source.history_append(history, path)
    source.history_append(records(spark, "3 a dev DOWN SUCCESS"), path)
    stored = source.history_scan(spark, path)
    assert values(stored, "id") == ["1", "2", "3"]
    pruned = ledger.records_for_env(stored, "qa")
    assert "PartitionFilters: [isnotnull(environment_id" in pruned._jdf.queryExecution().toString()
    assert values(source.history_delete(stored, stored["error_message"] == "boom"), "id") == ["1", "3"]
    with pytest.raises(ValueError, match="already in the ledger"):
        source.history_append(records(spark, "3 c dev UP SUCCESS", "4 c dev UP SUCCESS"), path)
    with pytest.raises(ValueError, match="already in the ledger"):
        source.history_append(records(spark, "9 c dev UP SUCCESS"), path, records(spark, "9 a dev UP SUCCESS"))
    assert source.history_scan(spark, path).count() == 3

    changed = f"{out}/changed"
    source.history_append(
        records(spark, "1 a dev UP SUCCESS", "2 b q%a UP FAILURE", "3 a dev UP FAILURE", "4 c x UP SUCCESS"),
        changed,
    )
    failed = F.col("status") == "FAILURE"
    assert source.history_delete_stored(spark, changed, failed) == 2
    assert values(source.history_scan(spark, changed), "id") == ["1", "4"]
    assert source.history_delete_stored(spark, changed, failed) == 0

    source.history_init(spark, "ledger_under_test", f"{out}/table")
    assert spark.table("ledger_under_test").count() == 0
    stored.select(*spark.table("ledger_under_test").columns).write.insertInto("ledger_under_test")
    source.history_init(spark, "ledger_under_test", f"{out}/table")
    assert spark.table("ledger_under_test").count() == 3
    spark.sql("DROP TABLE ledger_under_test")


@pytest.mark.parametrize("kind", ["json", "orc", "csv"])
def test_scan_other_formats(spark, out, kind):
    history = records(spark, "1 a dev UP SUCCESS", "2 b qa UP FAILURE")
    history.write.format(kind).save(f"{out}/{kind}")
    back = source.history_scan(spark, f"{out}/{kind}", kind)
    assert rows(back, *back.columns) == rows(history, *history.columns)


def test_record_checks(spark):
    good = records(spark, "1 a dev UP SUCCESS", "2 b dev DOWN FAILURE")
    assert checks.validate_records(good).count() == 0
    when = START
    bad = spark.createDataFrame(
        [
            ("1", "a", "dev", "UP", "FAILURE", when, "d", None, 1, None),
            ("2", "a", "dev", "DOWN", "SUCCESS", when, "d", "undo", 1, None),
            ("3", "a", "dev", "LEFT", "DONE", when, None, None, 1, None),
            ("3", "a", "dev", "UP", "SUCCESS", when, "d", None, 1, None),
        ],
        schemas.HISTORY,
    )
    assert rows(checks.validate_records(bad), "category", "subject", "message") == {
        ("record_invariant", "1", "Failure status requires error message"),
        ("record_invariant", "2", "DOWN execution should not have serialized_down_task"),
        ("record_invariant", "3", "description must not be null"),
        ("record_domain", "3", "direction out of domain: LEFT"),
        ("record_domain", "3", "status out of domain: DONE"),
        ("record_pk", "3", "Duplicate record id"),
    }
    with pytest.raises(ValueError):
        source.history_append(bad, "/nowhere")


def test_a_change_happens_at_once_or_not_at_all(spark, out, monkeypatch):
    path = f"{out}/it's a ledger"
    history = records(spark, "1 a dev UP SUCCESS", "2 a dev UP FAILURE", "3 b prod UP FAILURE", "4 b prod UP SUCCESS")
    source.history_append(history, path)
    failed = F.col("status") == "FAILURE"

    def crash(self, text, path):
        raise OSError("lost between the two writes")

    monkeypatch.setattr(Files, "put", crash)
    with pytest.raises(OSError):
        source.history_delete_stored(spark, path, failed)
    with pytest.raises(OSError):
        source.history_append(records(spark, "5 a dev UP SUCCESS"), path)
    monkeypatch.undo()
    assert values(source.history_scan(spark, path), "id") == ["1", "2", "3", "4"]
    # What a reader holds stays readable while another deletes.
    held = source.history_scan(spark, path)
    assert source.history_delete_stored(spark, path, failed & (F.col("environment_id") == "dev")) == 1
    assert values(held, "id") == ["1", "2", "3", "4"]
    assert values(source.history_scan(spark, path), "id") == ["1", "3", "4"]
    source.history_append(records(spark, "5 a dev UP SUCCESS"), path)
    assert source.history_delete_stored(spark, path, F.col("environment_id") == "prod") == 2
    assert values(source.history_scan(spark, path), "id") == ["1", "5"]
    pruned = source.history_scan(spark, path).filter("environment_id = 'dev'")
    assert values(pruned, "id") == ["1", "5"]
    # Another writer in between: one of the two fails, nothing is lost.
    version, live = source._live(spark, path)
    source._publish(spark, path, version, live)
    with pytest.raises(RuntimeError, match="another writer"):
        source._publish(spark, path, version, [])
    assert values(source.history_scan(spark, path), "id") == ["1", "5"]


def test_a_plain_folder_becomes_a_ledger(spark, out):
    records(spark, "1 a dev UP SUCCESS", "2 a a%20b/c UP FAILURE").write.partitionBy("environment_id").parquet(out + "/plain")
    path = out + "/plain"
    assert values(source.history_scan(spark, path), "id") == ["1", "2"]
    source.history_append(records(spark, "3 a dev UP SUCCESS"), path)
    assert values(source.history_scan(spark, path), "id") == ["1", "2", "3"]
    assert source.history_delete_stored(spark, path, F.col("id") == "2") == 1
    assert values(source.history_scan(spark, path), "id") == ["1", "3"]


def test_init_keeps_not_null_and_odd_locations(spark, out):
    source.history_init(spark, "ledger_not_null", f"{out}/o'dd \\ place")
    listed = spark.sql("SHOW CREATE TABLE ledger_not_null").first()[0]
    for field in schemas.HISTORY:
        column = next(line for line in listed.splitlines() if line.strip().startswith(f"{field.name} "))
        assert ("required" in column) is not field.nullable
    source.history_insert(records(spark, "1 a dev UP SUCCESS"), "ledger_not_null")
    lacking = records(spark, "2 a dev UP SUCCESS").withColumn("node_id", F.lit(None).cast("string"))
    for bad in (lacking, records(spark, "1 a dev UP SUCCESS"), records(spark, "3 a dev SIDEWAYS SUCCESS")):
        with pytest.raises(ValueError):
            source.history_insert(bad, "ledger_not_null")
    assert values(spark.table("ledger_not_null"), "id") == ["1"]
    spark.sql("DROP TABLE ledger_not_null")
