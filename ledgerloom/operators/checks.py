"""Integrity checks. Each yields ``errors(category, subject, message)``; nothing stops early."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import graph
from ledgerloom.operators.cycles import cycle_path
from ledgerloom.operators.levels import has_cycle
from ledgerloom.schemas import DIRECTIONS, DOWN, FAILURE, STATUSES
from ledgerloom.scratch import Scratch

# Categories of the report, in its order, and message texts.
CATEGORIES = ("project", "target", "task", "dependency", "cycle")
NO_PROJECT = "Project configuration file not found"
GRAPH_CYCLE = "Graph contains a cycle (circular dependency)"
CYCLE_PREFIX = "Circular dependency detected: "
NODE_EXISTS = "Node already exists: "
NODE, NEEDS_UNKNOWN = "Node ", " depends on non-existent node: "
MISSING_TYPE = "Missing required property 'type'"
MISSING_NAME = "Missing required property 'name'"
MISSING_TARGET = "Missing required property 'target'"
MISSING_UP = "Missing required property 'up'"
UNKNOWN_TYPE = "Unknown plugin type '%s'"
UNKNOWN_TARGET = "Target '%s' not found"
UNKNOWN_DEPENDENCY = "Dependency '%s' not found"
FAILURE_NEEDS_MESSAGE = "Failure status requires error message"
DOWN_HAS_SCRIPT = "DOWN execution should not have serialized_down_task"
REQUIRED = (
    "id", "node_id", "environment_id", "direction", "status", "executed_at", "description",
)


def error_rows(df: DataFrame, category: str, subject: Column, message: Column) -> DataFrame:
    return df.select(
        F.lit(category).alias("category"),
        subject.cast("string").alias("subject"),
        message.alias("message"),
    )


def accumulate_errors(*tables: DataFrame) -> DataFrame:
    """All errors of all checks."""
    return reduce(DataFrame.unionByName, tables)


def _rows_of(df: DataFrame, category: str, subject: Column, *messages: Column) -> DataFrame:
    """One error per message that is not null: one pass however many rules there are."""
    told = df.select(subject.alias("_subject"), F.explode(F.array(*messages)).alias("_message"))
    return error_rows(
        told.filter("_message IS NOT NULL"), category, F.col("_subject"), F.col("_message")
    )


# -- nodes and edges ----------------------------------------------------------------------


def blank_ids(nodes: DataFrame) -> DataFrame:
    """Ids of nodes or environments that are null or blank."""

    def rule(column: str) -> Column:
        value = F.col(column).cast("string")
        return F.when(
            value.isNull() | value.rlike(r"\A\s*\z"), F.lit(f"{column} must not be null or blank")
        )

    return _rows_of(nodes, "blank", F.col("node_id"), rule("node_id"), rule("environment_id"))


def duplicate_errors(nodes: DataFrame) -> DataFrame:
    twice = graph.duplicate_nodes(nodes)
    text = F.concat(F.lit(NODE_EXISTS), F.col("node_id").cast("string"))
    return error_rows(twice, "duplicate", F.col("node_id"), text)


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cycle and dangling edges of a graph."""
    cyclic = error_rows(
        has_cycle(nodes, edges).filter("has_cycle"), "cycle", F.lit(None), F.lit(GRAPH_CYCLE)
    )
    text = F.concat(
        F.lit(NODE),
        F.col("node_id").cast("string"),
        F.lit(NEEDS_UNKNOWN),
        F.col("depends_on").cast("string"),
    )
    dangling = graph.dangling_dependencies(nodes, edges)
    return accumulate_errors(cyclic, error_rows(dangling, "dangling", F.col("node_id"), text))


# -- ledger records -----------------------------------------------------------------------


def check_record_invariants(history: DataFrame) -> DataFrame:
    """Required fields, failure needs a message, DOWN must not carry a down script."""
    rules = [
        F.when(F.col(c).isNull(), F.lit(f"{c} must not be null")) for c in REQUIRED
    ]
    rules.append(
        F.when(
            (F.col("status") == FAILURE) & F.col("error_message").isNull(),
            F.lit(FAILURE_NEEDS_MESSAGE),
        )
    )
    rules.append(
        F.when(
            (F.col("direction") == DOWN) & F.col("serialized_down_task").isNotNull(),
            F.lit(DOWN_HAS_SCRIPT),
        )
    )
    return _rows_of(history, "record_invariant", F.col("id"), *rules)


def check_record_domains(history: DataFrame) -> DataFrame:
    """Direction and status outside their domains (null is for the invariants)."""

    def rule(column: str, domain: tuple[str, ...]) -> Column:
        text = F.concat(F.lit(f"{column} out of domain: "), F.col(column))
        return F.when(~F.col(column).isin(*domain), text)

    return _rows_of(
        history,
        "record_domain",
        F.col("id"),
        rule("status", STATUSES),
        rule("direction", DIRECTIONS),
    )


def check_record_pk(history: DataFrame) -> DataFrame:
    """Record ids that occur more than once."""
    twice = history.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return error_rows(twice, "record_pk", F.col("id"), F.lit("Duplicate record id"))


def validate_records(history: DataFrame) -> DataFrame:
    return accumulate_errors(
        check_record_invariants(history), check_record_domains(history), check_record_pk(history)
    )


# -- specifications -----------------------------------------------------------------------


def _path(folder: str, id_column: str, text: Column) -> Column:
    return F.concat(F.lit(f"{folder}/"), F.col(id_column).cast("string"), F.lit(".yaml: "), text)


def check_project(project: DataFrame, project_file: str = "project.yaml") -> DataFrame:
    """One error if there is no project row."""
    counted = project.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
    text = F.lit(f"{project_file}: {NO_PROJECT}")
    return error_rows(counted, "project", F.lit(project_file), text)


def _known(types: DataFrame) -> DataFrame:
    """Known types, written: a type that most targets share meets a table of true size."""
    names, _ = Scratch(types.sparkSession, "types").keep(types.select("type").distinct(), "known")
    return names.withColumn("_known", F.lit(True))


def _judged(table: DataFrame, category: str, id_column: str, *problems: Column) -> DataFrame:
    """``table`` with ``_problems``: a short list of its errors' texts, empty if it is sound."""
    folder = f"{category}s"
    told = F.array_compact(F.array(*[_path(folder, id_column, p) for p in problems]))
    return table.withColumn("_problems", told)


def _problem_rows(judged: DataFrame, category: str, id_column: str) -> DataFrame:
    told = judged.select(id_column, F.explode("_problems").alias("_message"))
    return error_rows(told, category, F.col(id_column), F.col("_message"))


def judged_targets(targets: DataFrame, known_types: DataFrame) -> DataFrame:
    """Targets with their problems: the type is missing, or not among the known ones."""
    joined = targets.join(_known(known_types), "type", "left")
    problem = F.when(F.col("type").isNull(), F.lit(MISSING_TYPE)).when(
        F.col("_known").isNull(), F.format_string(UNKNOWN_TYPE, "type")
    )
    return _judged(joined, "target", "target_id", problem)


def check_targets(targets: DataFrame, known_types: DataFrame) -> DataFrame:
    """Type missing, or not among the known types."""
    return _problem_rows(judged_targets(targets, known_types), "target", "target_id")


def _sound_targets(judged: DataFrame) -> DataFrame:
    """Ids of sound targets, written, as tasks may share one target."""
    sound = judged.filter("size(_problems) = 0").select("target_id").distinct()
    return Scratch(judged.sparkSession, "targets").keep(sound, "valid")[0]


def valid_targets(targets: DataFrame, known_types: DataFrame) -> DataFrame:
    return _sound_targets(judged_targets(targets, known_types))


def judged_tasks(tasks: DataFrame, targets_ok: DataFrame) -> DataFrame:
    """Tasks with their problems: name, target or up missing, target not a valid one."""
    joined = tasks.join(
        targets_ok.select(F.col("target_id").alias("target"), F.lit(True).alias("_known")),
        "target",
        "left",
    )
    known = F.col("_known").isNotNull()
    name = F.when(F.col("name").isNull(), F.lit(MISSING_NAME))
    target = F.when(F.col("target").isNull(), F.lit(MISSING_TARGET)).when(
        ~known, F.format_string(UNKNOWN_TARGET, F.col("target").cast("string"))
    )
    script = F.when(known & F.col("up").isNull(), F.lit(MISSING_UP))
    return _judged(joined, "task", "task_id", name, target, script)


def check_tasks(tasks: DataFrame, targets_ok: DataFrame) -> DataFrame:
    """Name, target or up missing; target not among the valid ones."""
    return _problem_rows(judged_tasks(tasks, targets_ok), "task", "task_id")


def valid_tasks(tasks: DataFrame, targets_ok: DataFrame) -> DataFrame:
    return judged_tasks(tasks, targets_ok).filter("size(_problems) = 0").drop("_problems")


def _task_edges(tasks_ok: DataFrame) -> DataFrame:
    return graph.explode_dependencies(
        tasks_ok.select(F.col("task_id").alias("node_id"), "dependencies")
    )


def check_dependencies(tasks_ok: DataFrame) -> DataFrame:
    """Dependencies of valid tasks that are not themselves valid tasks."""
    dangling = graph.dangling_dependencies(
        tasks_ok.select(F.col("task_id").alias("node_id")), _task_edges(tasks_ok)
    )
    problem = F.format_string(UNKNOWN_DEPENDENCY, F.col("depends_on").cast("string"))
    return error_rows(
        dangling, "dependency", F.col("node_id"), _path("tasks", "node_id", problem)
    )


def check_cycles(tasks_ok: DataFrame) -> DataFrame:
    """One cycle among valid tasks, if there is any."""
    ids = tasks_ok.select(F.col("task_id").alias("node_id"))
    found = cycle_path(graph.induced_subgraph(_task_edges(tasks_ok), ids))
    return error_rows(found, "cycle", F.lit(None), F.concat(F.lit(CYCLE_PREFIX), "cycle"))


def validate_specs(
    project: DataFrame,
    targets: DataFrame,
    tasks: DataFrame,
    known_types: DataFrame,
    project_file: str = "project.yaml",
) -> DataFrame:
    """All checks. Without a project nothing else is looked at; only valid targets and
    tasks count as existing, so one bad task may cause errors in those that need it."""
    no_project = check_project(project, project_file)
    if project.isEmpty():
        return no_project
    # Targets and tasks are judged once, to problems and validity, and read back for each check.
    scratch = Scratch(tasks.sparkSession, "specs")
    seen_targets, _ = scratch.keep(
        judged_targets(targets, known_types).select("target_id", "_problems"), "targets"
    )
    judged = judged_tasks(tasks, _sound_targets(seen_targets))
    seen_tasks, _ = scratch.keep(judged.select("task_id", "dependencies", "_problems"), "tasks")
    tasks_ok = seen_tasks.filter("size(_problems) = 0").select("task_id", "dependencies")
    return accumulate_errors(
        no_project,
        _problem_rows(seen_targets, "target", "target_id"),
        _problem_rows(seen_tasks, "task", "task_id"),
        check_dependencies(tasks_ok),
        check_cycles(tasks_ok),
    )


def error_counts(errors: DataFrame) -> DataFrame:
    """``category, n_errors, result`` of the five checks, one pass over the errors.

    When the project is missing the other checks did not run and are not listed.
    """
    counted = errors.agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(c).alias("n_errors")) for c in CATEGORIES]
    )
    listed = counted.select("project", F.explode(rows).alias("r")).filter(
        "project = 0 OR r.category = 'project'"
    )
    return listed.select(
        "r.category",
        "r.n_errors",
        F.when(F.col("r.n_errors") == 0, "OK").otherwise("FAIL").alias("result"),
    )
