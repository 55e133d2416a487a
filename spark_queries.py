"""One query per operator, each over whole tables; registered in ``__spark_entry__``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import text
from ledgerloom.operators import (
    checks,
    closure,
    cycles,
    graph,
    ledger,
    levels,
    props,
    reach,
    reduction,
)
from ledgerloom.plans import outcomes as runs
from ledgerloom.plans import targets as plans
from ledgerloom.scratch import Scratch
from ledgerloom.sources import derived as d
from ledgerloom.sources import ledger as ledger_source
from ledgerloom.sources import specs
from ledgerloom.sources.edge_store import EdgeStore
from ledgerloom.streaming import ledger as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


# -- sources and sinks --------------------------------------------------------------------


def _fresh(spark: SparkSession, label: str) -> str:
    return Scratch(spark, label).path


@query
def history_scan(spark, sf):
    records = d.history(spark, sf)
    path = _fresh(spark, "scan")
    records.write.orc(path)
    return ledger_source.history_scan(spark, path, "orc", records.schema)


@query
def history_init(spark, sf):
    """Creating the table again must leave the records in it alone."""
    table = f"ledger_{uuid.uuid4().hex}"
    location = _fresh(spark, "init")
    ledger_source.history_init(spark, table, location)
    columns = spark.table(table).columns
    records = d.history(spark, sf)
    strings = ("id", "node_id")
    records.select(
        *[F.col(c).cast("string").alias(c) if c in strings else F.col(c) for c in columns]
    ).write.insertInto(table)
    ledger_source.history_init(spark, table, location)
    stored = spark.table(table)
    return stored.groupBy("environment_id").agg(F.count(F.lit(1)).alias("n_records"))


@query
def history_append(spark, sf):
    records = d.history(spark, sf)
    path = _fresh(spark, "append")
    # A batch that overlaps the first one is refused as a whole; its new half is not.
    first = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    ledger_source.history_append(records.filter(first), path)
    try:
        ledger_source.history_append(records, path)
    except ValueError:
        ledger_source.history_append(records.filter(~first), path)
    return ledger_source.history_scan(spark, path, "parquet", records.schema)


@query
def history_delete(spark, sf):
    """Written, deleted from and read back."""
    records = d.history(spark, sf)
    path = _fresh(spark, "delete")
    ledger_source.history_append(records, path)
    failed = F.col("status") == schemas.FAILURE
    ledger_source.history_delete_stored(spark, path, failed, records.schema)
    return ledger_source.history_scan(spark, path, "parquet", records.schema)


@query
def spec_files(spark, sf):
    return specs.spec_files(d.paths(spark, sf), "/project", "e7")


@query
def files_per_kind(spark, sf):
    return specs.files_per_kind(specs.spec_files(d.paths(spark, sf), "/project", "e7"))


@query
def spec_scan(spark, sf):
    path = _fresh(spark, "specs")
    tasks = d.task_specs(spark, sf)
    tasks.write.json(path)
    return specs.spec_scan(spark, path, tasks.schema).select(
        "task_id",
        "name",
        "target",
        F.array_join(F.array_sort("dependencies").cast("array<string>"), ",").alias("dependencies"),
        "up",
    )


@query
def spec_files_listed(spark, sf):
    """Over real folders: those that hold spec files, by kind."""
    root = _fresh(spark, "project")
    specs_of = d.table(spark, sf, "documents").select("lang", F.col("doc_id").alias("task_id"))
    specs_of.write.partitionBy("lang").json(f"{root}/tasks")
    d.target_specs(spark, sf).write.json(f"{root}/targets")
    d.target_specs(spark, sf).write.json(f"{root}/elsewhere")
    found = specs.list_spec_files(spark, f"file:{root}" if root.startswith("/") else root, suffix=".json")
    folder = F.regexp_extract("path", r"/(tasks/lang=[^/]*|targets)/[^/]*$", 1)
    return found.select("kind", folder.alias("folder")).distinct()


@query
def read_script_files(spark, sf):
    """Many scripts a file, found again by the index that lies beside them."""
    path = _fresh(spark, "scripts")
    index = specs.write_script_bundles(d.scripts(spark, sf), path)
    found = specs.read_script_bundles(spark, path).join(index, "script_id")
    same = F.length("script") == F.col("length")
    return found.filter(same).select(F.col("script_id").cast("long").alias("script_id"), "script")


# -- projections and filters --------------------------------------------------------------


@query
def explode_dependencies(spark, sf):
    return graph.explode_dependencies(d.nodes_with_dependencies(spark, sf))


@query
def node_lookup(spark, sf):
    return graph.node_lookup(d.nodes(spark, sf), d.targets(spark, sf))


@query
def all_nodes(spark, sf):
    return graph.all_nodes(d.nodes(spark, sf))


@query
def graph_size(spark, sf):
    return graph.graph_size(d.nodes(spark, sf))


@query
def has_no_dependencies(spark, sf):
    needs = F.col("dependencies")
    return d.nodes_with_dependencies(spark, sf).select(
        "node_id", graph.has_no_dependencies(needs).alias("has_no_dependencies")
    )


@query
def depends_on(spark, sf):
    needs = F.col("dependencies")
    return d.nodes_with_dependencies(spark, sf).select(
        "node_id", graph.depends_on(needs, 7).alias("depends_on_7")
    )


@query
def records_for_env(spark, sf):
    return ledger.records_for_env(d.history(spark, sf), "env1")


@query
def records_for_node(spark, sf):
    return ledger.records_for_node(d.history(spark, sf), 7)


@query
def failure_messages(spark, sf):
    return ledger.failure_messages(d.history(spark, sf))


@query
def is_up(spark, sf):
    return d.history(spark, sf).select("id", ledger.is_up(F.col("direction")).alias("is_up"))


@query
def is_down(spark, sf):
    return d.history(spark, sf).select("id", ledger.is_down(F.col("direction")).alias("is_down"))


@query
def blank_ids(spark, sf):
    number = F.col("node_id")
    some_blank = d.nodes(spark, sf).select(
        F.when(number % 100 == 3, F.lit(" \t"))
        .when(number % 100 != 4, number.cast("string"))
        .alias("node_id"),
        F.when(number % 50 == 9, F.lit("")).otherwise(F.col("environment_id")).alias("environment_id"),
    )
    return checks.blank_ids(some_blank)


# -- joins --------------------------------------------------------------------------------


@query
def status_by_node_query(spark, sf):
    return ledger.status_by_node(d.nodes(spark, sf), d.history(spark, sf))


QUERIES["status_by_node"] = QUERIES.pop("status_by_node_query")


@query
def direct_dependencies(spark, sf):
    return graph.direct_dependencies(d.targets(spark, sf), d.edges(spark, sf))


@query
def direct_dependents(spark, sf):
    return graph.direct_dependents(d.targets(spark, sf), d.edges(spark, sf))


@query
def executed_in_graph(spark, sf):
    return ledger.executed_in_graph(d.nodes(spark, sf), d.history(spark, sf)).select(
        "node_id", "environment_id"
    )


@query
def pending_nodes(spark, sf):
    return ledger.pending_nodes(d.nodes(spark, sf), d.history(spark, sf)).select(
        "node_id", "environment_id"
    )


@query
def induced_subgraph(spark, sf):
    pending = plans.up_targets(d.nodes(spark, sf), d.history(spark, sf))
    return graph.induced_subgraph(d.edges(spark, sf), pending)


@query
def dangling_dependencies(spark, sf):
    return graph.dangling_dependencies(d.nodes(spark, sf), d.edges_dangling(spark, sf))


@query
def add_edges(spark, sf):
    """Accepted edges; the refused ones are counted by ``add_edges_refused``."""
    made, _ = graph.add_edges(
        d.nodes(spark, sf), d.edges(spark, sf), _offered(spark, sf)
    )
    return made


@query
def add_edges_refused(spark, sf):
    _, refused = graph.add_edges(
        d.nodes(spark, sf), d.edges(spark, sf), _offered(spark, sf)
    )
    return refused


def _offered(spark, sf):
    """The implied edges to k div 4, and those to nodes that do not exist."""
    return d.denser_edges(spark, sf).unionByName(d.edges_dangling(spark, sf))


# -- aggregations -------------------------------------------------------------------------


@query
def status_summary(spark, sf):
    return ledger.status_summary(d.nodes(spark, sf), d.history(spark, sf))


@query
def status_summary_by_env(spark, sf):
    return ledger.status_summary_by_env(d.nodes(spark, sf), d.history(spark, sf), total=True)


@query
def nodes_per_environment(spark, sf):
    return graph.nodes_per_environment(d.nodes(spark, sf))


@query
def graph_header(spark, sf):
    return graph.graph_header(d.nodes(spark, sf), d.edges(spark, sf))


@query
def degrees(spark, sf):
    return graph.degrees(d.nodes(spark, sf), d.edges(spark, sf))


@query
def degrees_within(spark, sf):
    nodes = d.nodes(spark, sf)
    pending = plans.up_targets(nodes, d.history(spark, sf))
    return graph.degrees(nodes, d.edges(spark, sf), pending)


@query
def plan_stats(spark, sf):
    return levels.plan_stats(levels.plan_levels(d.nodes(spark, sf), d.edges(spark, sf)))


@query
def level_sizes(spark, sf):
    return levels.level_sizes(levels.plan_levels(d.nodes(spark, sf), d.edges(spark, sf)))


@query
def plan_pending(spark, sf):
    nodes, history = d.nodes(spark, sf), d.history(spark, sf)
    plan = levels.plan_levels_for(nodes, d.edges(spark, sf), plans.up_targets(nodes, history))
    return plans.plan_pending(plan, nodes, history)


@query
def run_summary(spark, sf):
    return runs.run_summary(_up_visit(spark, sf), schemas.UP)


@query
def rollback_summary(spark, sf):
    return runs.run_summary(_rollback_visit(spark, sf), schemas.DOWN)


@query
def duplicate_nodes(spark, sf):
    return graph.duplicate_nodes(d.nodes_dup(spark, sf))


@query
def duplicate_errors(spark, sf):
    return checks.duplicate_errors(d.nodes_dup(spark, sf))


@query
def adjacency_listing(spark, sf):
    return graph.adjacency_listing(d.nodes(spark, sf), d.edges(spark, sf))


@query
def error_counts(spark, sf):
    return checks.error_counts(_spec_errors(spark, sf))


# -- windows, sorts -----------------------------------------------------------------------


@query
def latest_record(spark, sf):
    return ledger.latest_record(d.history(spark, sf))


@query
def latest_record_for(spark, sf):
    keys = d.nodes(spark, sf).select("node_id", "environment_id")
    return ledger.latest_record(d.history(spark, sf), keys)


@query
def was_executed(spark, sf):
    keys = d.nodes(spark, sf).select("node_id", "environment_id")
    return ledger.was_executed(keys, d.history(spark, sf))


@query
def executed_nodes(spark, sf):
    return ledger.executed_nodes(d.history(spark, sf))


@query
def plan_positions(spark, sf):
    return levels.plan_positions(levels.plan_levels(d.nodes(spark, sf), d.edges(spark, sf)))


@query
def history_log(spark, sf):
    return ledger.history_log(d.history(spark, sf))


@query
def recent_records(spark, sf):
    return ledger.recent_records(d.history(spark, sf))


@query
def topological_order(spark, sf):
    return levels.topological_order(d.nodes(spark, sf), d.edges(spark, sf))


# -- sets ---------------------------------------------------------------------------------


@query
def target_closure(spark, sf):
    return closure.target_closure(d.targets(spark, sf), d.edges(spark, sf))


@query
def rollback_candidates(spark, sf):
    return plans.rollback_candidates(d.targets(spark, sf), d.edges(spark, sf))


@query
def accumulate_errors(spark, sf):
    nodes = d.nodes_dup(spark, sf)
    return checks.accumulate_errors(
        checks.duplicate_errors(nodes),
        checks.blank_ids(nodes),
        checks.validate_records(d.broken_history(spark, sf)),
    )


# -- graph --------------------------------------------------------------------------------


@query
def roots(spark, sf):
    return graph.roots(d.nodes(spark, sf), d.edges(spark, sf)).select("node_id", "name")


@query
def transitive_dependencies(spark, sf):
    return closure.transitive_dependencies(d.targets(spark, sf), d.edges(spark, sf))


@query
def transitive_dependents(spark, sf):
    return closure.transitive_dependents(d.targets(spark, sf), d.edges(spark, sf))


@query
def transitive_dependents_stored(spark, sf):
    """Over edges stored in folders: a hop reads the folders that its frontier falls into."""
    store = EdgeStore.write(d.edges(spark, sf), _fresh(spark, "edges"))
    return closure.transitive_dependents(d.targets(spark, sf), store)


@query
def plan_levels_stored(spark, sf):
    store = EdgeStore.write(d.edges(spark, sf), _fresh(spark, "edges"))
    return levels.plan_levels(d.nodes(spark, sf), store)


@query
def plan_levels_deep(spark, sf):
    """A chain as long as there are customers: its rounds are the logarithm of that."""
    return levels.plan_levels(d.deep_nodes(spark, sf), d.deep_edges(spark, sf))


@query
def reaches(spark, sf):
    """Given pairs, by an index whose size is linear in nodes and edges."""
    index = reach.build_index(d.nodes(spark, sf), d.edges(spark, sf), _fresh(spark, "index"))
    return reach.reaches(d.reach_pairs(spark, sf), index)


@query
def reachability(spark, sf):
    return closure.reachability(d.edges(spark, sf))


@query
def has_cycle(spark, sf):
    return levels.has_cycle(d.nodes(spark, sf), d.edges_cyclic(spark, sf))


@query
def has_no_cycle(spark, sf):
    return levels.has_cycle(d.nodes(spark, sf), d.edges(spark, sf))


@query
def cycle_nodes(spark, sf):
    return cycles.cycle_nodes(d.edges_cyclic(spark, sf))


@query
def cycle_path(spark, sf):
    return cycles.cycle_path(d.edges_cyclic(spark, sf))


@query
def cycle_path_rows(spark, sf):
    return cycles.cycle_rows(d.edges_cyclic(spark, sf))


@query
def cycle_nodes_many(spark, sf):
    """Many components at once, each named by its smallest node."""
    found = cycles.cycle_components(d.edges_many_cycles(spark, sf))
    names = found.groupBy("component").agg(F.min("node_id").alias("least"))
    return found.join(names, "component").select("node_id", F.col("least").alias("component"))


@query
def plan_levels(spark, sf):
    return levels.plan_levels(d.nodes(spark, sf), d.edges(spark, sf))


@query
def plan_levels_for(spark, sf):
    nodes = d.nodes(spark, sf)
    pending = plans.up_targets(nodes, d.history(spark, sf))
    return levels.plan_levels_for(nodes, d.edges(spark, sf), pending)


@query
def reverse_plan_levels_for(spark, sf):
    nodes = d.nodes(spark, sf)
    pending = plans.up_targets(nodes, d.history(spark, sf))
    return levels.reverse_plan_levels_for(nodes, d.edges(spark, sf), pending)


@query
def transitive_reduction(spark, sf):
    return reduction.transitive_reduction(d.nodes(spark, sf), d.denser_edges(spark, sf))


@query
def redundant_edges(spark, sf):
    return reduction.redundant_edges(d.nodes(spark, sf), d.denser_edges(spark, sf))


@query
def validate_graph(spark, sf):
    broken = d.edges_dangling(spark, sf).unionByName(d.edges_cyclic(spark, sf)).distinct()
    return checks.validate_graph(d.nodes(spark, sf), broken)


# -- targets, plans, outcomes -------------------------------------------------------------


@query
def up_targets(spark, sf):
    return plans.up_targets(d.nodes(spark, sf), d.history(spark, sf))


@query
def up_targets_for(spark, sf):
    return plans.up_targets_for(
        d.nodes(spark, sf), d.edges(spark, sf), d.history(spark, sf), d.targets(spark, sf)
    )


@query
def up_plan(spark, sf):
    nodes, history = d.nodes(spark, sf), d.history(spark, sf)
    done = plans.executed_once(nodes, history)
    todo = nodes.join(done, "node_id", "left_anti").select("node_id")
    return plans.up_plan(nodes, d.edges(spark, sf), history, todo, done)


@query
def rollback_targets_all(spark, sf):
    return plans.rollback_targets_all(d.nodes(spark, sf), d.history(spark, sf))


@query
def rollback_targets_for(spark, sf):
    return plans.rollback_targets_for(
        d.nodes(spark, sf), d.edges(spark, sf), d.history(spark, sf), d.targets(spark, sf)
    )


@query
def rollback_targets_for_transitive(spark, sf):
    return plans.rollback_targets_for(
        d.nodes(spark, sf),
        d.edges(spark, sf),
        d.history(spark, sf),
        d.targets(spark, sf),
        transitive=True,
    )


@query
def rollback_plan(spark, sf):
    nodes, history = d.nodes(spark, sf), d.history(spark, sf)
    done = plans.executed_once(nodes, history)
    return plans.rollback_plan(nodes, d.edges(spark, sf), history, done, done)


def _up_visit(spark, sf):
    """A run over all nodes, so that executed ones are visited and skipped too."""
    nodes, history = d.nodes(spark, sf), d.history(spark, sf)
    plan = plans.up_plan(nodes, d.edges(spark, sf), history, nodes)
    return runs.up_outcomes(plan, nodes, d.outcomes(spark, sf))


def _rollback_visit(spark, sf):
    nodes, history = d.nodes(spark, sf), d.history(spark, sf)
    plan = plans.rollback_plan(nodes, d.edges(spark, sf), history, nodes)
    return runs.rollback_outcomes(plan, nodes, d.outcomes(spark, sf))


@query
def up_outcomes(spark, sf):
    return _up_visit(spark, sf)


@query
def rollback_outcomes(spark, sf):
    return _rollback_visit(spark, sf)


def _record_id():
    return F.concat(F.lit("run-"), F.col("node_id").cast("string"))


def _run_time():
    return F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))


@query
def outcome_records(spark, sf):
    return runs.outcome_records(_up_visit(spark, sf), schemas.UP, _record_id(), _run_time())


@query
def rollback_records(spark, sf):
    return runs.outcome_records(_rollback_visit(spark, sf), schemas.DOWN, _record_id(), _run_time())


@query
def skipped_records(spark, sf):
    return runs.skipped_records(_rollback_visit(spark, sf), _record_id(), _run_time())


@query
def run_events_from_outcomes(spark, sf):
    return runs.run_events_from_outcomes(
        _up_visit(spark, sf),
        schemas.UP,
        d.nodes(spark, sf),
        run_id=F.lit("run-1"),
        event_time=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
    )


# -- checks -------------------------------------------------------------------------------


@query
def check_project(spark, sf):
    """The table of projects is not empty, so there is nothing to report."""
    return checks.check_project(d.projects(spark, sf))


@query
def check_project_missing(spark, sf):
    """A project table without rows: none of the regions has a negative key."""
    return checks.check_project(d.projects(spark, sf).limit(0))


@query
def check_targets(spark, sf):
    return checks.check_targets(d.target_specs(spark, sf), d.known_types(spark, sf))


def _targets_ok(spark, sf):
    return checks.valid_targets(d.target_specs(spark, sf), d.known_types(spark, sf))


@query
def check_tasks(spark, sf):
    return checks.check_tasks(d.task_specs(spark, sf), _targets_ok(spark, sf))


def _tasks_ok(spark, sf):
    return checks.valid_tasks(d.task_specs(spark, sf), _targets_ok(spark, sf))


@query
def check_dependencies(spark, sf):
    return checks.check_dependencies(_tasks_ok(spark, sf))


@query
def check_cycles(spark, sf):
    return checks.check_cycles(_tasks_ok(spark, sf))


@query
def check_record_invariants(spark, sf):
    return checks.check_record_invariants(d.broken_history(spark, sf))


@query
def check_record_domains(spark, sf):
    return checks.check_record_domains(d.broken_history(spark, sf))


@query
def check_record_pk(spark, sf):
    return checks.check_record_pk(d.broken_history(spark, sf))


def _spec_errors(spark, sf):
    return checks.validate_specs(
        d.projects(spark, sf),
        d.target_specs(spark, sf),
        d.task_specs(spark, sf),
        d.known_types(spark, sf),
    )


@query
def validate_specs(spark, sf):
    return _spec_errors(spark, sf)


# -- properties ---------------------------------------------------------------------------


@query
def prefix_keys(spark, sf):
    base = d.props(spark, sf)
    return props.prefix_keys(base, "target").unionByName(props.prefix_keys(base, "task"))


@query
def overlay_props(spark, sf):
    return props.overlay_props(d.keyed_props(spark, sf))


@query
def strip_prefix(spark, sf):
    return props.strip_prefix(d.keyed_props(spark, sf), "target.")


@query
def target_ids(spark, sf):
    return props.target_ids(d.keyed_props(spark, sf))


@query
def pivot_props(spark, sf):
    top = props.overlay_props(d.keyed_props(spark, sf))
    owned = top.select(props.split_key(F.col("key")).alias("k"), "value").select("k.*", "value")
    fields = {"name": "string", "type": "string", "balance": "bigint"}
    return props.pivot_props(owned, fields).drop("kind")


@query
def collect_list_props(spark, sf):
    return props.collect_list_props(d.list_props(spark, sf))


# -- text ---------------------------------------------------------------------------------


@query
def split_statements(spark, sf):
    return text.split_statements(d.scripts(spark, sf))


@query
def number_lines(spark, sf):
    return text.number_lines(d.scripts(spark, sf))


@query
def format_duration(spark, sf):
    return d.history(spark, sf).select(
        "id", text.format_duration(F.col("duration_ms")).alias("duration")
    )


@query
def format_datetime(spark, sf):
    return d.history(spark, sf).select(
        "id", text.format_datetime(F.col("executed_at")).alias("moment")
    )


def _status(spark, sf):
    return ledger.status_by_node(d.nodes(spark, sf), d.history(spark, sf))


@query
def status_marker(spark, sf):
    return _status(spark, sf).select(
        "node_id", text.status_marker(F.col("executed")).alias("marker")
    )


@query
def status_line(spark, sf):
    line = text.status_line(
        *[F.col(c) for c in ("executed", "node_id", "name", "duration_ms", "executed_at")]
    )
    return _status(spark, sf).select("node_id", line.alias("line"))


@query
def result_line(spark, sf):
    visited = _rollback_visit(spark, sf).filter("outcome <> 'NOT_REACHED'")
    line = text.result_line(
        *[F.col(c) for c in ("outcome", "node_id", "name", "duration_ms", "reason")]
    )
    return visited.select("node_id", line.alias("line"))


@query
def count_message(spark, sf):
    counts = ledger.status_summary_by_env(d.nodes(spark, sf), d.history(spark, sf))
    return counts.select(
        "environment_id",
        text.count_message(F.col("pending")).alias("up_message"),
        text.count_message(F.col("executed"), schemas.DOWN, dry_run=True).alias("down_message"),
    )


@query
def completion_message(spark, sf):
    """Closing sentences of runs that did as much as each environment has executed."""
    counts = ledger.status_summary_by_env(d.nodes(spark, sf), d.history(spark, sf))
    return counts.select(
        "environment_id",
        text.completion_message(F.lit("UP"), F.col("executed"), F.lit(True)).alias("up_message"),
        text.completion_message(
            F.lit("DOWN"), F.col("executed"), F.col("executed") > 0
        ).alias("down_message"),
    )


@query
def task_id_from_path(spark, sf):
    tasks = specs.spec_files(d.paths(spark, sf), "/project").filter("kind = 'task'")
    return specs.task_ids(tasks, "/project")


@query
def target_id_from_path(spark, sf):
    return d.paths(spark, sf).select(
        "path", text.target_id_from_path(F.col("path")).alias("target_id")
    )


@query
def strip_ansi(spark, sf):
    escape = F.char(F.lit(27))
    coloured = F.concat(escape, F.lit("[1;32m"), F.col("text"), escape, F.lit("[0m"))
    return d.table(spark, sf, "documents").select(
        "doc_id", text.strip_ansi(coloured).alias("plain")
    )


# -- streams ------------------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = d.table(spark, sf, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )


def _changes(spark, stream, keys):
    path = _fresh(spark, "stream")
    streams.drain(streams.changes_to_table(stream, f"{path}/rows"), f"{path}/checkpoint")
    changes = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return streams.current_rows(changes, keys)


@query
def latest_status_stream(spark, sf):
    """Kept as a snapshot and the batches after it."""
    stream = streams.latest_status_stream(d.from_events(_event_stream(spark, sf)))
    path, keys = _fresh(spark, "stream"), ["node_id", "environment_id"]
    sink = streams.keep_current(stream, f"{path}/rows", keys, fold_every=1)
    streams.drain(sink, f"{path}/checkpoint")
    return streams.read_current(spark, f"{path}/rows", keys)


@query
def outcome_counts_stream(spark, sf):
    events = d.run_events(_event_stream(spark, sf))
    counts = streams.outcome_counts_stream(events)
    last = _changes(spark, counts, ["window_start", "direction"])
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def history_append_stream(spark, sf):
    path = _fresh(spark, "stream")
    records = d.from_events(_event_stream(spark, sf))
    # Every record arrives twice.
    twice = records.unionByName(records)
    streams.drain(
        streams.history_append_stream(twice, f"{path}/ledger"), f"{path}/checkpoint"
    )
    return ledger_source.history_scan(spark, f"{path}/ledger", "parquet", records.schema)
