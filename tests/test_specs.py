import os

import pytest

from ledgerloom.functions import text
from ledgerloom.operators import checks, graph, props
from ledgerloom.schemas import TASK_SPECS
from ledgerloom.sources import specs
from tests.helpers import nodes_df, rows, values


@pytest.fixture
def known(spark):
    return spark.createDataFrame([("postgresql",)], "type string")


def targets(spark, *items):
    return spark.createDataFrame(list(items), "target_id string, type string").coalesce(1)


def tasks(spark, *items):
    return spark.createDataFrame(
        list(items), "task_id string, name string, target string, dependencies array<string>, up string"
    ).coalesce(1)


def project(spark, there=True):
    return spark.createDataFrame([("p",)] if there else [], "project string")


CASES = [
    ([("db", "postgresql")], [("a", "A", "db", None, "x"), ("b", "B", "db", ["a"], "x")], set()),
    ([("db", None)], [], {("target", "targets/db.yaml: Missing required property 'type'")}),
    ([("db", "oracle")], [], {("target", "targets/db.yaml: Unknown plugin type 'oracle'")}),
    (
        [("db", "postgresql")],
        [("a", None, "db", None, "x")],
        {("task", "tasks/a.yaml: Missing required property 'name'")},
    ),
    (
        [("db", "postgresql")],
        [("a", "A", "nope", None, "x"), ("b", "B", None, None, "x"), ("c", "C", "db", None, None)],
        {
            ("task", "tasks/a.yaml: Target 'nope' not found"),
            ("task", "tasks/b.yaml: Missing required property 'target'"),
            ("task", "tasks/c.yaml: Missing required property 'up'"),
        },
    ),
    (
        [("db", "postgresql")],
        [("a", "A", "db", ["gone"], "x")],
        {("dependency", "tasks/a.yaml: Dependency 'gone' not found")},
    ),
    (
        [("db", "postgresql")],
        [("a", "A", "db", ["b"], "x"), ("b", "B", "db", ["a"], "x")],
        {("cycle", "Circular dependency detected: a -> b -> a")},
    ),
    # A target that is not valid does not exist for tasks, nor a bad task for others.
    (
        [("db", None), ("ok", "postgresql")],
        [("a", "A", "db", None, "x"), ("b", "B", "ok", ["a"], "x")],
        {
            ("target", "targets/db.yaml: Missing required property 'type'"),
            ("task", "tasks/a.yaml: Target 'db' not found"),
            ("dependency", "tasks/b.yaml: Dependency 'a' not found"),
        },
    ),
]


@pytest.mark.parametrize("target_rows, task_rows, expected", CASES)
def test_validate_specs(spark, known, target_rows, task_rows, expected):
    found = checks.validate_specs(
        project(spark), targets(spark, *target_rows), tasks(spark, *task_rows), known
    )
    assert rows(found, "category", "message") == expected


def test_missing_project_stops_everything(spark, known):
    found = checks.validate_specs(
        project(spark, False), targets(spark, ("db", None)), tasks(spark), known, "main.yaml"
    )
    assert rows(found, "message") == {("main.yaml: Project configuration file not found",)}
    assert rows(checks.error_counts(found), "category", "n_errors", "result") == {
        ("project", 1, "FAIL")
    }


def test_error_counts(spark):
    found = spark.createDataFrame(
        [("task", "a", "m"), ("task", "b", "m"), ("cycle", None, "m")],
        "category string, subject string, message string",
    )
    assert rows(checks.error_counts(found), "category", "n_errors", "result") == {
        ("project", 0, "OK"), ("target", 0, "OK"), ("task", 2, "FAIL"),
        ("dependency", 0, "OK"), ("cycle", 1, "FAIL"),
    }


def test_node_checks(spark):
    nodes = nodes_df(spark, ["a", "a", " ", "b"])
    assert rows(graph.duplicate_nodes(nodes), "node_id", "n_rows") == {("a", 2)}
    assert values(checks.duplicate_errors(nodes), "message") == ["Node already exists: a"]
    assert values(checks.blank_ids(nodes), "subject") == [" "]


def test_spec_files_and_scripts(spark, out):
    for path in (
        "targets/db.yaml", "targets/old/x.yaml", "tasks/a.yaml", "tasks/db/1/b.yaml",
        "tasks/c.yml", "environments/dev.yaml", "environments/qa.yaml",
    ):
        full = f"{out}/project/{path}"
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as file:
            file.write(f"line of {path}\nend")
    root = f"{out}/project"
    files = specs.list_spec_files(spark, root, "dev")
    assert {(p.removeprefix(root + "/"), k) for p, k in rows(files, "path", "kind")} == {
        ("targets/db.yaml", "target"), ("tasks/a.yaml", "task"), ("tasks/db/1/b.yaml", "task"),
        ("environments/dev.yaml", "environment"),
    }
    assert rows(specs.files_per_kind(files), "kind", "n_files") == {
        ("target", 1), ("task", 2), ("environment", 1),
    }
    found = specs.task_ids(files.filter("kind = 'task'"), root)
    assert values(found, "task_id") == ["a", "db/1/b"]
    with pytest.raises(Exception, match="Task file must be under tasks/ directory"):
        specs.task_ids(files, root).collect()
    scripts = specs.read_script_files(spark, f"{root}/tasks", r"/tasks/(.*)\.ya?ml$")
    assert rows(scripts, "script_id", "script") == {
        ("a", "line of tasks/a.yaml\nend"), ("db/1/b", "line of tasks/db/1/b.yaml\nend"),
        ("c", "line of tasks/c.yml\nend"),
    }
    filled = specs.with_script(tasks(spark, ("a", "A", "db", None, None), ("z", "Z", "db", None, "own")), scripts)
    assert rows(filled, "task_id", "up") == {("a", "line of tasks/a.yaml\nend"), ("z", "own")}


def test_spec_scan_ignores_unknown_keys(spark, out):
    os.makedirs(f"{out}/specs")
    with open(f"{out}/specs/one.json", "w") as file:
        file.write('{"task_id": "a", "name": "A", "dependencies": ["b"], "colour": "red"}\n')
    row = specs.spec_scan(spark, f"{out}/specs", TASK_SPECS).first()
    assert (row["task_id"], row["dependencies"], row["up"]) == ("a", ["b"], None)
    assert row["file_path"].endswith("/one.json")


def test_props(spark):
    base = spark.createDataFrame(
        [
            ("files", 100, "target.db.type", "postgresql"),
            ("files", 100, "target.db.username", "me"),
            ("files", 100, 'task."a/b".name', "Ab"),
            ("files", 100, 'task."a/b".dependencies[10]', "k"),
            ("files", 100, 'task."a/b".dependencies[2]', "j"),
            ("files", 100, 'task."a/b".autocommit', "true"),
            ("env", 500, "target.db.username", "you"),
            ("env", 500, "target.other", "x"),
        ],
        "source string, ordinal int, key string, value string",
    )
    top = props.overlay_props(base)
    assert rows(top.filter("key LIKE '%username'"), "value", "ordinal") == {("you", 500)}
    assert rows(props.strip_prefix(top, "target.db."), "key", "value") == {
        ("type", "postgresql"), ("username", "you"),
    }
    assert values(props.target_ids(top), "target_id") == ["db", "other"]
    owned = top.select(props.split_key(top["key"]).alias("k"), "value").select("k.*", "value")
    task = props.pivot_props(
        owned.filter("kind = 'task'"), {"name": "string", "autocommit": "boolean", "up": "string"}
    )
    assert rows(task, "owner", "name", "autocommit", "up") == {("a/b", "Ab", True, None)}
    listed = props.collect_list_props(owned.filter("kind = 'task'"))
    assert rows(listed, "owner", "position", "value") == {("a/b", 10, "k"), ("a/b", 2, "j")}
    made = props.prefix_keys(
        spark.createDataFrame([("a/b", "name", "v")], "owner string, key string, value string"), "task"
    )
    assert values(made, "key") == ['task."a/b".name']


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


def test_statements(spark):
    from pyspark.sql import functions as F

    script = "a;\nb -- c;\nd; -- note\r\n;\n\t\n e ;;\nf;\x00 ;"
    assert one(spark, text.statements(F.col("v")), script) == ["a", "b -- c", "d", "e", "f;"]
    frame = spark.createDataFrame([("s", "x;\ny")], "script_id string, script string")
    assert rows(text.split_statements(frame), "script_id", "statement_no", "statement") == {
        ("s", 1, "x"), ("s", 2, "y"),
    }
    assert one(spark, text.statements(F.col("v")), "  \n") == []


def test_line_numbers(spark):
    frame = spark.createDataFrame([("s", "x\n\n")], "script_id string, script string")
    assert values(text.number_lines(frame), "line") == ["    1 | x", "    2 | ", "    3 | "]
    many = spark.createDataFrame([("s", "\n" * 1000)], "script_id string, script string")
    assert "  1001 | " in values(text.number_lines(many), "line")


@pytest.mark.parametrize(
    "ms, shown", [(0, "0ms"), (999, "999ms"), (1000, "1.0s"), (1250, "1.3s"), (1449, "1.4s"), (61049, "61.0s")]
)
def test_durations(spark, ms, shown):
    from pyspark.sql import functions as F

    assert one(spark, text.format_duration(F.col("v")), ms, "long") == shown


def test_lines_and_messages(spark):
    from pyspark.sql import functions as F

    row = spark.sql(
        "SELECT 'a' AS id, 'A' AS name, 1500L AS ms, timestamp '2024-01-02 03:04:05.6' AS t"
    )
    args = [F.col(c) for c in ("id", "name", "ms", "t")]
    assert row.select(text.status_line(F.lit(True), *args)).first()[0] == "[✓] a - A (1.5s, 2024-01-02 03:04:05)"
    assert row.select(text.status_line(F.lit(False), *args)).first()[0] == "[ ] a - A"

    def line(outcome, reason=None):
        return row.select(
            text.result_line(F.lit(outcome), F.col("id"), F.col("name"), F.col("ms"), F.lit(reason))
        ).first()[0]

    assert line("OK") == "[OK]    a - A (1500ms)"
    assert line("SKIP", "no down task") == "[SKIP]  a - A (no down task)"
    assert line("FAIL") == "[FAIL]  a - A"
    n = F.col("v")
    assert one(spark, text.count_message(n), 1, "long") == "1 migration will be executed."
    assert one(spark, text.count_message(n, "DOWN", True), 2, "long") == "2 migrations would be rolled back."
    done = text.completion_message(F.lit("DOWN"), n, F.lit(True))
    assert one(spark, done, 1, "long") == "Rollback completed successfully. 1 migration rolled back."
    assert one(spark, done, 0, "long") == text.NOTHING_DONE
    assert one(spark, text.target_id_from_path(n), "/p/targets/db1.yaml") == "db1"
    assert one(spark, text.task_id_from_path(n, "/p"), "/p\\tasks\\x\\y.yaml") == "x/y"
    assert one(spark, text.strip_ansi(n), "\x1b[1;31mred\x1b[0m plain") == "red plain"


@pytest.mark.parametrize("root", ["/p", "/p/", "file:/p", "file:///p", "hdfs://nn:8020/p", "hdfs:/p", ""])
def test_roots_of_any_scheme(spark, root):
    tails = ["targets/db.yaml", "targets/old/x.yaml", "tasks/a/b.yaml", "environments/qa.yaml", "environments/dev.yaml"]
    heads = {"": ["", "/"]}.get(root, ["/p/", "file:/p/", "file:///p/", "hdfs://nn:8020/p/", "hdfs://other/p/", "/pp/"])
    paths = spark.createDataFrame([(h + t,) for h in heads for t in tails], "path string")
    below = {
        "/p": heads[:5], "/p/": heads[:5], "file:/p": heads[1:3], "file:///p": heads[1:3],
        "hdfs://nn:8020/p": heads[3:4], "hdfs:/p": heads[3:5], "": heads,
    }[root]
    kinds = {"targets/db.yaml": "target", "tasks/a/b.yaml": "task", "environments/dev.yaml": "environment"}
    got = rows(specs.spec_files(paths, root, "dev"), "path", "kind")
    assert got == {(h + t, k) for h in below for t, k in kinds.items()}


def test_a_uri_root_lists_the_same_files_and_a_wrong_one_is_loud(spark, out):
    os.makedirs(f"{out}/p q/tasks")
    os.makedirs(f"{out}/none")
    for name in ("tasks/a.yaml", "other.yaml"):
        with open(f"{out}/p q/{name}", "w") as file:
            file.write("name: x")
    for root in (f"{out}/p q", f"file:{out}/p q", f"file://{out}/p q"):
        assert rows(specs.list_spec_files(spark, root), "path", "kind") == {(f"{out}/p q/tasks/a.yaml", "task")}
    with pytest.raises(ValueError, match="none of the 1 .yaml files"):
        specs.list_spec_files(spark, f"{out}/p q/tasks")
    assert specs.list_spec_files(spark, f"{out}/none").count() == 0


def test_script_bundles_hold_many_scripts(spark, out):
    texts = {f"db/{i}": f"SELECT {i};\n-- é\n" * (i % 5) for i in range(60)} | {"none": None}
    table = spark.createDataFrame(list(texts.items()), "script_id string, script string").repartition(3)
    index = specs.write_script_bundles(table, out)
    assert rows(specs.read_script_bundles(spark, out), "script_id", "script") == {
        (k, v) for k, v in texts.items() if v is not None
    }
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/bundles")
    text_of = {r["path"].split("/")[-2]: bytes(r["content"]).decode() for r in files.collect()}
    assert len(text_of) <= 3
    for r in index.collect():
        assert text_of[r["file"]][r["offset"] : r["offset"] + r["length"]] == texts[r["script_id"]]
