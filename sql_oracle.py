"""The same results as ``spark_queries``, in SQL over the given tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Named subqueries; each lists the ones it builds on.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = (body, needs)


def sql(name: str, body: str, *needs: str) -> None:
    """Register a query, with the named subqueries it needs in front."""
    ordered: list[str] = []

    def visit(key: str) -> None:
        if key in ordered:
            return
        for below in PARTS[key][1]:
            visit(below)
        ordered.append(key)

    for key in needs:
        visit(key)
    head = ",\n".join(f"{key.split('@')[0]} AS ({PARTS[key][0]})" for key in ordered)
    recursive = "WITH RECURSIVE " if ordered else ""
    ORACLE[name] = f"{recursive}{head}\n{body}"


# -- derived tables -----------------------------------------------------------------------

part(
    "nodes",
    "SELECT c_custkey AS node_id, c_name AS name, c_mktsegment AS description,"
    " 'env' || (c_custkey % 3) AS environment_id, 'apply ' || c_name AS up,"
    " CASE WHEN c_custkey % 5 <> 0 THEN 'revert ' || c_name END AS down FROM customer",
)
part(
    "edges",
    "SELECT DISTINCT c_custkey AS node_id, unnest([c_custkey // 2, c_custkey // 3]) AS depends_on"
    " FROM customer WHERE c_custkey > 0",
)
part(
    "dense",
    "SELECT DISTINCT c_custkey AS node_id,"
    " unnest([c_custkey // 2, c_custkey // 3, c_custkey // 4]) AS depends_on"
    " FROM customer WHERE c_custkey > 0",
)
part("cyclic", "SELECT * FROM edges UNION SELECT 2, 149", "edges")
part(
    "dangling",
    "SELECT * FROM edges UNION SELECT c_custkey, c_custkey + 1000000 FROM customer"
    " WHERE c_custkey % 100 = 0",
    "edges",
)
part(
    "nodes_dup",
    "SELECT * FROM nodes UNION ALL SELECT * FROM nodes WHERE node_id % 200 = 0",
    "nodes",
)
part("targets", "SELECT s_suppkey * 14 + 7 AS node_id FROM supplier")
part(
    "history",
    """SELECT event_id AS id, user_id AS node_id,
  'env' || (CASE WHEN event_id % 10 = 0 THEN (user_id + 1) % 3 ELSE user_id % 3 END)
    AS environment_id,
  CASE WHEN event_type = 'signup' THEN 'DOWN' ELSE 'UP' END AS direction,
  CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
  ts AS executed_at, event_type AS description,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN props END AS serialized_down_task,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms,
  CASE WHEN event_type = 'error' THEN props END AS error_message
FROM events""",
)
part(
    "broken_once",
    """SELECT id, node_id, environment_id,
  CASE WHEN id % 50 = 1 THEN 'SIDEWAYS' ELSE direction END AS direction,
  CASE WHEN id % 50 = 2 THEN 'DONE' ELSE status END AS status, executed_at,
  CASE WHEN id % 50 <> 3 THEN description END AS description,
  CASE WHEN id % 50 = 4 THEN 'undo' ELSE serialized_down_task END AS serialized_down_task,
  duration_ms, CASE WHEN id % 4 <> 0 THEN error_message END AS error_message
FROM history""",
    "history",
)
part(
    "broken",
    "SELECT * FROM broken_once UNION ALL SELECT * FROM broken_once WHERE id % 250 = 7",
    "broken_once",
)
part(
    "latest",
    "SELECT * FROM history QUALIFY row_number() OVER"
    " (PARTITION BY node_id, environment_id ORDER BY executed_at DESC, id) = 1",
    "history",
)
part(
    "done_pairs",
    "SELECT * FROM latest WHERE direction = 'UP' AND status = 'SUCCESS'",
    "latest",
)
part(
    "status",
    """SELECT n.node_id, n.name, n.environment_id, p.id IS NOT NULL AS executed,
  p.id AS record_id, p.executed_at, p.duration_ms, p.description AS record_description
FROM nodes n LEFT JOIN done_pairs p USING (node_id, environment_id)""",
    "nodes",
    "done_pairs",
)
part("pending", "SELECT node_id FROM status WHERE NOT executed", "status")
part("executed", "SELECT node_id FROM status WHERE executed", "status")
part(
    "outcomes",
    """SELECT node_id, node_id % 97 <> 13 AS ok, node_id % 5000 AS duration_ms,
  CASE WHEN node_id % 97 = 13 THEN 'bad ' || node_id END AS error,
  CASE WHEN node_id % 97 <> 13 THEN down END AS serialized_down_task
FROM nodes""",
    "nodes",
)
part(
    "run_events",
    """SELECT executed_at AS event_time, node_id, direction,
  CASE WHEN description = 'purchase' THEN 'skipped' WHEN status = 'FAILURE' THEN 'failed'
       ELSE 'succeeded' END AS event, duration_ms
FROM history""",
    "history",
)
part(
    "scripts",
    "SELECT doc_id AS script_id, replace(text, '. ', ';' || chr(10)) AS script FROM documents",
)
part(
    "paths",
    """SELECT doc_id, unnest([
  '/project/tasks/' || lang || '/' || doc_id || '.yaml',
  '/project/targets/t' || doc_id || '.yaml',
  '/project/targets/old/t' || doc_id || '.yaml',
  '/project/environments/e' || doc_id || '.yaml',
  '/project/tasks/' || doc_id || '.yml']) AS path
FROM documents""",
)
part(
    "spec_paths",
    """SELECT path, CASE
  WHEN path LIKE '/project/tasks/%.yaml' THEN 'task'
  WHEN path LIKE '/project/targets/%.yaml' AND path NOT LIKE '/project/targets/%/%' THEN 'target'
  WHEN path = '/project/environments/e7.yaml' THEN 'environment' END AS kind
FROM paths""",
    "paths",
)
part(
    "props",
    """SELECT c_custkey AS owner, 'base' AS source, 100 AS ordinal, 'name' AS key, c_name AS value
  FROM customer
UNION ALL SELECT c_custkey, 'base', 100, 'type', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'base', 100, 'balance', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'environment', 500, 'name', upper(c_name) FROM customer
  WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'environment', 500, 'type', lower(c_mktsegment) FROM customer
  WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'environment', 500, 'balance', CAST(c_nationkey + 100 AS VARCHAR)
  FROM customer WHERE c_custkey % 7 = 0""",
)
part(
    "keyed",
    """SELECT source, ordinal, CASE WHEN owner % 2 = 0 THEN 'target.' || owner || '.' || key
  ELSE 'task."' || owner || '".' || key END AS key, value, owner, key AS plain
FROM props""",
    "props",
)
part(
    "top",
    "SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal DESC) = 1",
    "keyed",
)
part(
    "target_specs",
    """SELECT s_suppkey AS target_id, CASE WHEN s_suppkey % 9 = 1 THEN NULL
  WHEN s_suppkey % 9 = 7 THEN 'abacus' ELSE 'postgresql' END AS type FROM supplier""",
)
part(
    "task_specs",
    """SELECT c_custkey AS task_id, CASE WHEN c_custkey % 41 <> 40 THEN c_name END AS name,
  CASE WHEN c_custkey % 31 <> 5
    THEN c_custkey % (SELECT count(*) FROM supplier) END AS target,
  CASE WHEN c_custkey = 2 THEN [149, 1, 0]
    WHEN c_custkey > 0 THEN list_distinct([c_custkey // 2, c_custkey // 3]) END AS dependencies,
  CASE WHEN c_custkey % 43 <> 42 THEN 'apply' END AS up
FROM customer""",
)
part("targets_ok", "SELECT target_id FROM target_specs WHERE type = 'postgresql'", "target_specs")
part(
    "target_errors",
    """SELECT 'target' AS category, CAST(target_id AS VARCHAR) AS subject,
  'targets/' || target_id || '.yaml: ' || CASE WHEN type IS NULL
    THEN 'Missing required property ''type''' ELSE 'Unknown plugin type ''' || type || '''' END
  AS message
FROM target_specs WHERE type IS NULL OR type <> 'postgresql'""",
    "target_specs",
)
part(
    "task_errors",
    """SELECT 'task' AS category, CAST(task_id AS VARCHAR) AS subject,
  'tasks/' || task_id || '.yaml: ' || problem AS message
FROM (
  SELECT task_id, 'Missing required property ''name''' AS problem FROM task_specs
    WHERE name IS NULL
  UNION ALL SELECT task_id, 'Missing required property ''target''' FROM task_specs
    WHERE target IS NULL
  UNION ALL SELECT task_id, 'Target ''' || target || ''' not found' FROM task_specs
    WHERE target NOT IN (SELECT target_id FROM targets_ok)
  UNION ALL SELECT task_id, 'Missing required property ''up''' FROM task_specs
    WHERE up IS NULL AND target IN (SELECT target_id FROM targets_ok))""",
    "task_specs",
    "targets_ok",
)
part(
    "tasks_ok",
    "SELECT * FROM task_specs"
    " WHERE CAST(task_id AS VARCHAR) NOT IN (SELECT subject FROM task_errors)",
    "task_specs",
    "task_errors",
)
part(
    "task_edges",
    "SELECT DISTINCT task_id AS node_id, unnest(dependencies) AS depends_on FROM tasks_ok",
    "tasks_ok",
)
part(
    "dependency_errors",
    """SELECT 'dependency' AS category, CAST(node_id AS VARCHAR) AS subject,
  'tasks/' || node_id || '.yaml: Dependency ''' || depends_on || ''' not found' AS message
FROM task_edges WHERE depends_on NOT IN (SELECT task_id FROM tasks_ok)""",
    "task_edges",
)


def cycle_parts(prefix: str, edges: str) -> None:
    """Pairs, nodes on cycles, and the best cycle of an edge set."""
    part(
        f"{prefix}_pairs",
        f"SELECT node_id AS a, depends_on AS b FROM {edges}"
        f" UNION SELECT p.a, e.depends_on FROM {prefix}_pairs p JOIN {edges} e ON e.node_id = p.b",
        edges,
    )
    part(f"{prefix}_on", f"SELECT a AS node_id FROM {prefix}_pairs WHERE a = b", f"{prefix}_pairs")
    part(
        f"{prefix}_core",
        f"SELECT * FROM {edges} WHERE node_id IN (SELECT node_id FROM {prefix}_on)"
        f" AND depends_on IN (SELECT node_id FROM {prefix}_on)",
        f"{prefix}_on",
    )
    part(
        f"{prefix}_walk",
        f"""SELECT node_id, [node_id] AS path FROM (SELECT min(node_id) AS node_id FROM {prefix}_on)
  WHERE node_id IS NOT NULL
UNION ALL SELECT e.depends_on, list_append(w.path, e.depends_on)
  FROM {prefix}_walk w JOIN {prefix}_core e ON e.node_id = w.node_id
  WHERE (len(w.path) = 1 OR w.node_id <> w.path[1])
    AND (e.depends_on = w.path[1] OR NOT list_contains(w.path, e.depends_on))""",
        f"{prefix}_core",
    )
    part(
        f"{prefix}_best",
        f"""SELECT array_to_string(path, ' -> ') AS cycle FROM {prefix}_walk
WHERE len(path) > 1 AND node_id = path[1] ORDER BY len(path), path LIMIT 1""",
        f"{prefix}_walk",
    )


cycle_parts("ring", "cyclic")
part(
    "task_inner",
    "SELECT * FROM task_edges WHERE depends_on IN (SELECT task_id FROM tasks_ok)",
    "task_edges",
)
cycle_parts("task", "task_inner")
part(
    "cycle_errors",
    "SELECT 'cycle' AS category, CAST(NULL AS VARCHAR) AS subject,"
    " 'Circular dependency detected: ' || cycle AS message FROM task_best",
    "task_best",
)
part(
    "spec_errors",
    "SELECT * FROM target_errors UNION ALL SELECT * FROM task_errors"
    " UNION ALL SELECT * FROM dependency_errors UNION ALL SELECT * FROM cycle_errors",
    "target_errors",
    "task_errors",
    "dependency_errors",
    "cycle_errors",
)


def closure_part(name: str, seeds: str, edges: str, source: str, goal: str) -> None:
    """Paths from seeds by length; the shortest counts."""
    part(
        f"{name}_all",
        f"""SELECT s.node_id AS seed, e.{goal} AS node_id, 1 AS distance
  FROM {seeds} s JOIN {edges} e ON e.{source} = s.node_id
UNION SELECT c.seed, e.{goal}, c.distance + 1
  FROM {name}_all c JOIN {edges} e ON e.{source} = c.node_id""",
        seeds,
        edges,
    )
    part(
        name,
        f"SELECT seed, node_id, CAST(min(distance) AS INTEGER) AS distance"
        f" FROM {name}_all GROUP BY ALL",
        f"{name}_all",
    )


closure_part("below", "targets", "edges", "node_id", "depends_on")
closure_part("above", "targets", "edges", "depends_on", "node_id")
closure_part("reach", "nodes", "edges", "node_id", "depends_on")


def levels_part(name: str, members: str, edges: str, source: str, goal: str) -> None:
    """Longest chain among the members: the longest path that ends in a node."""
    part(
        f"{name}_paths",
        f"""SELECT node_id, 0 AS level FROM {members}
UNION SELECT e.{goal}, p.level + 1 FROM {name}_paths p JOIN {edges} e ON e.{source} = p.node_id
  WHERE e.{goal} IN (SELECT node_id FROM {members})""",
        members,
        edges,
    )
    part(
        name,
        f"SELECT CAST(max(level) AS INTEGER) AS level, node_id FROM {name}_paths GROUP BY node_id",
        f"{name}_paths",
    )


levels_part("plan", "nodes", "edges", "depends_on", "node_id")
levels_part("back_plan", "nodes", "edges", "node_id", "depends_on")
levels_part("todo_plan", "pending", "edges", "depends_on", "node_id")
levels_part("todo_back", "pending", "edges", "node_id", "depends_on")
levels_part("undo_plan", "executed", "edges", "node_id", "depends_on")


def visit_part(name: str, plan: str, skip_reason: str) -> None:
    part(
        f"{name}_judged",
        f"""SELECT p.level, s.node_id, s.name, s.environment_id, o.*  EXCLUDE (node_id),
  {skip_reason} AS why, CASE WHEN why IS NOT NULL THEN 'SKIP' WHEN o.ok THEN 'OK' ELSE 'FAIL' END
    AS would
FROM {plan} p JOIN status s USING (node_id) JOIN nodes n USING (node_id)
  JOIN outcomes o USING (node_id)""",
        plan,
        "status",
        "outcomes",
    )
    part(
        f"{name}_reached",
        f"""SELECT *, CASE WHEN (level, node_id) > (
    SELECT (level, node_id) FROM {name}_judged WHERE would = 'FAIL' ORDER BY level, node_id LIMIT 1)
    THEN 'NOT_REACHED' ELSE would END AS outcome
FROM {name}_judged""",
        f"{name}_judged",
    )
    part(
        name,
        f"""SELECT level, node_id, name, environment_id, outcome,
  CASE WHEN outcome = 'OK' THEN duration_ms END AS duration_ms,
  CASE WHEN outcome = 'SKIP' THEN why END AS reason,
  CASE WHEN outcome = 'FAIL' THEN coalesce(error, 'Unknown error') END AS error_message,
  CASE WHEN outcome = 'OK' THEN serialized_down_task END AS serialized_down_task
FROM {name}_reached""",
        f"{name}_reached",
    )


visit_part("up_run", "plan", "CASE WHEN s.executed THEN 'already executed' END")
visit_part(
    "down_run",
    "back_plan",
    "CASE WHEN NOT s.executed THEN 'not executed' WHEN n.down IS NULL THEN 'no down task' END",
)

# -- sources and sinks --------------------------------------------------------------------

WHOLE_LEDGER = "SELECT * FROM history"
sql("history_scan", WHOLE_LEDGER, "history")
sql(
    "history_init",
    "SELECT environment_id, count(*) AS n_records FROM history GROUP BY ALL",
    "history",
)
sql("history_append", WHOLE_LEDGER, "history")
sql("history_delete", "SELECT * FROM history WHERE status <> 'FAILURE'", "history")
sql("spec_files", "SELECT path, kind FROM spec_paths WHERE kind IS NOT NULL", "spec_paths")
sql(
    "files_per_kind",
    "SELECT kind, count(*) AS n_files FROM spec_paths WHERE kind IS NOT NULL GROUP BY ALL",
    "spec_paths",
)
sql(
    "spec_scan",
    "SELECT task_id, name, target, array_to_string(list_sort(dependencies), ',') AS dependencies,"
    " up FROM task_specs",
    "task_specs",
)
sql(
    "spec_files_listed",
    "SELECT DISTINCT 'task' AS kind, 'tasks/lang=' || lang AS folder FROM documents"
    " UNION ALL SELECT 'target', 'targets' WHERE (SELECT count(*) FROM supplier) > 0",
)
sql("read_script_files", "SELECT script_id, script FROM scripts", "scripts")

# -- projections and filters --------------------------------------------------------------

sql("explode_dependencies", "SELECT node_id, depends_on FROM edges", "edges")
sql("node_lookup", "SELECT * FROM nodes WHERE node_id IN (SELECT node_id FROM targets)",
    "nodes", "targets")
sql("all_nodes", "SELECT * FROM nodes", "nodes")
sql("graph_size", "SELECT count(*) AS size FROM nodes", "nodes")
sql(
    "has_no_dependencies",
    "SELECT node_id, node_id NOT IN (SELECT node_id FROM edges) AS has_no_dependencies FROM nodes",
    "nodes",
    "edges",
)
sql(
    "depends_on",
    "SELECT node_id, node_id IN (SELECT node_id FROM edges WHERE depends_on = 7) AS depends_on_7"
    " FROM nodes",
    "nodes",
    "edges",
)
sql("records_for_env", "SELECT * FROM history WHERE environment_id = 'env1'", "history")
sql("records_for_node", "SELECT * FROM history WHERE node_id = 7", "history")
sql(
    "failure_messages",
    "SELECT id, node_id, environment_id, error_message FROM history WHERE status = 'FAILURE'",
    "history",
)
sql("is_up", "SELECT id, direction = 'UP' AS is_up FROM history", "history")
sql("is_down", "SELECT id, direction = 'DOWN' AS is_down FROM history", "history")
sql(
    "blank_ids",
    """SELECT 'blank' AS category, CASE WHEN node_id % 100 = 3 THEN ' ' || chr(9)
    WHEN node_id % 100 <> 4 THEN CAST(node_id AS VARCHAR) END AS subject, column_name
    || ' must not be null or blank' AS message
FROM (SELECT node_id, 'node_id' AS column_name FROM nodes WHERE node_id % 100 IN (3, 4)
  UNION ALL SELECT node_id, 'environment_id' FROM nodes WHERE node_id % 50 = 9)""",
    "nodes",
)

# -- joins --------------------------------------------------------------------------------

sql("status_by_node", "SELECT * FROM status", "status")
sql(
    "direct_dependencies",
    "SELECT t.node_id AS seed, e.depends_on AS node_id FROM targets t JOIN edges e USING (node_id)",
    "targets",
    "edges",
)
sql(
    "direct_dependents",
    "SELECT t.node_id AS seed, e.node_id FROM targets t JOIN edges e ON e.depends_on = t.node_id",
    "targets",
    "edges",
)
sql("executed_in_graph", "SELECT node_id, environment_id FROM status WHERE executed", "status")
sql("pending_nodes", "SELECT node_id, environment_id FROM status WHERE NOT executed", "status")
INNER = (
    "SELECT * FROM edges WHERE node_id IN (SELECT node_id FROM pending)"
    " AND depends_on IN (SELECT node_id FROM pending)"
)
part("inner_edges", INNER, "edges", "pending")
sql("induced_subgraph", "SELECT * FROM inner_edges", "inner_edges")
sql(
    "dangling_dependencies",
    "SELECT * FROM dangling WHERE depends_on NOT IN (SELECT node_id FROM nodes)",
    "dangling",
    "nodes",
)
sql("add_edges", "SELECT * FROM edges UNION SELECT * FROM dense", "edges", "dense")
sql(
    "add_edges_refused",
    "SELECT 'dangling' AS category, node_id || ' -> ' || depends_on AS subject,"
    " 'Both nodes must exist in the graph' AS message FROM dangling"
    " WHERE depends_on NOT IN (SELECT node_id FROM nodes)",
    "dangling",
    "nodes",
)

# -- aggregations -------------------------------------------------------------------------

COUNTS = (
    "count(*) AS total, count(*) FILTER (executed) AS executed,"
    " count(*) FILTER (NOT executed) AS pending"
)
sql("status_summary", f"SELECT {COUNTS} FROM status", "status")
sql(
    "status_summary_by_env",
    f"SELECT environment_id, {COUNTS} FROM status GROUP BY ROLLUP (environment_id)",
    "status",
)
sql(
    "nodes_per_environment",
    "SELECT environment_id, count(*) AS n_nodes FROM nodes GROUP BY ALL",
    "nodes",
)
part("root_nodes", "SELECT * FROM nodes WHERE node_id NOT IN (SELECT node_id FROM edges)",
     "nodes", "edges")
sql(
    "graph_header",
    "SELECT (SELECT count(*) FROM nodes) AS total_nodes,"
    " (SELECT count(*) FROM root_nodes) AS root_nodes",
    "root_nodes",
)
DEGREES = """SELECT node_id, (SELECT count(*) FROM {e} e WHERE e.node_id = n.node_id) AS in_degree,
  (SELECT count(*) FROM {e} e WHERE e.depends_on = n.node_id) AS out_degree FROM {n} n"""
sql("degrees", DEGREES.format(e="edges", n="nodes"), "edges", "nodes")
sql("degrees_within", DEGREES.format(e="inner_edges", n="pending"), "inner_edges")
SIZES = "SELECT level, count(*) AS n_nodes FROM plan GROUP BY level"
sql(
    "plan_stats",
    f"SELECT CAST(sum(n_nodes) AS BIGINT) AS total_nodes, max(n_nodes) AS max_parallelism,"
    f" count(*) AS level_count FROM ({SIZES})",
    "plan",
)
sql("level_sizes", SIZES, "plan")
sql(
    "plan_pending",
    "SELECT (SELECT count(*) FROM pending) - (SELECT count(*) FROM executed) AS pending",
    "pending",
    "executed",
)
SUMMARY = """SELECT '{d}' AS direction, count(*) AS total,
  count(*) FILTER (outcome = 'OK') AS executed, count(*) FILTER (outcome = 'SKIP') AS skipped,
  count(*) FILTER (outcome = 'FAIL') AS failed, count(*) FILTER (outcome = 'FAIL') = 0 AS success
FROM {run}"""
sql("run_summary", SUMMARY.format(d="UP", run="up_run"), "up_run")
sql("rollback_summary", SUMMARY.format(d="DOWN", run="down_run"), "down_run")
TWICE = "SELECT node_id, count(*) AS n_rows FROM nodes_dup GROUP BY ALL HAVING count(*) > 1"
sql("duplicate_nodes", TWICE, "nodes_dup")
part(
    "dup_errors",
    "SELECT 'duplicate' AS category, CAST(node_id AS VARCHAR) AS subject,"
    f" 'Node already exists: ' || node_id AS message FROM ({TWICE})",
    "nodes_dup",
)
sql("duplicate_errors", "SELECT * FROM dup_errors", "dup_errors")
sql(
    "adjacency_listing",
    """SELECT node_id, 1 AS section, CAST(NULL AS BIGINT) AS neighbour,
  '[' || node_id || '] ' || name AS text FROM nodes
UNION ALL SELECT node_id, 2, NULL, 'Env: ' || environment_id FROM nodes
UNION ALL SELECT node_id, 3, NULL, 'Desc: ' || description FROM nodes
  WHERE trim(description) <> ''
UNION ALL SELECT node_id, 4, NULL, 'Dependencies: (none - root node)' FROM root_nodes
UNION ALL SELECT node_id, 4, depends_on, 'Dependencies: ' || depends_on FROM edges
UNION ALL SELECT depends_on, 5, node_id, 'Dependents: ' || node_id FROM edges""",
    "root_nodes",
)
sql(
    "error_counts",
    """SELECT category, count(message) AS n_errors,
  CASE WHEN count(message) = 0 THEN 'OK' ELSE 'FAIL' END AS result
FROM (SELECT unnest(['project', 'target', 'task', 'dependency', 'cycle']) AS category)
  LEFT JOIN spec_errors USING (category)
GROUP BY category""",
    "spec_errors",
)

# -- windows, sorts -----------------------------------------------------------------------

sql("latest_record", "SELECT * FROM latest", "latest")
sql("latest_record_for", "SELECT l.* FROM latest l JOIN nodes USING (node_id, environment_id)",
    "latest", "nodes")
sql("was_executed", "SELECT node_id, environment_id, executed FROM status", "status")
sql("executed_nodes", "SELECT node_id, environment_id FROM done_pairs", "done_pairs")
sql(
    "plan_positions",
    "SELECT row_number() OVER (ORDER BY level, node_id) AS position, level, node_id FROM plan",
    "plan",
)
sql("history_log", WHOLE_LEDGER, "history")
sql(
    "recent_records",
    "SELECT node_id, status, executed_at, duration_ms, error_message FROM history"
    " ORDER BY executed_at DESC, id LIMIT 10",
    "history",
)
sql("topological_order", "SELECT * FROM plan", "plan")

# -- sets ---------------------------------------------------------------------------------

sql("target_closure", "SELECT node_id FROM targets UNION SELECT node_id FROM below", "below")
sql(
    "rollback_candidates",
    "SELECT node_id FROM targets UNION SELECT e.node_id FROM targets t"
    " JOIN edges e ON e.depends_on = t.node_id",
    "targets",
    "edges",
)
part(
    "invariants",
    """SELECT 'record_invariant' AS category, CAST(id AS VARCHAR) AS subject,
  'description must not be null' AS message FROM broken WHERE description IS NULL
UNION ALL SELECT 'record_invariant', CAST(id AS VARCHAR), 'Failure status requires error message'
  FROM broken WHERE status = 'FAILURE' AND error_message IS NULL
UNION ALL SELECT 'record_invariant', CAST(id AS VARCHAR),
  'DOWN execution should not have serialized_down_task'
  FROM broken WHERE direction = 'DOWN' AND serialized_down_task IS NOT NULL""",
    "broken",
)
part(
    "domains",
    """SELECT 'record_domain' AS category, CAST(id AS VARCHAR) AS subject,
  'status out of domain: ' || status AS message FROM broken
  WHERE status NOT IN ('SUCCESS', 'FAILURE', 'SKIPPED')
UNION ALL SELECT 'record_domain', CAST(id AS VARCHAR), 'direction out of domain: ' || direction
  FROM broken WHERE direction NOT IN ('UP', 'DOWN')""",
    "broken",
)
part(
    "repeated",
    "SELECT 'record_pk' AS category, CAST(id AS VARCHAR) AS subject,"
    " 'Duplicate record id' AS message FROM broken GROUP BY id HAVING count(*) > 1",
    "broken",
)
sql(
    "accumulate_errors",
    "SELECT * FROM dup_errors UNION ALL SELECT * FROM invariants UNION ALL SELECT * FROM domains"
    " UNION ALL SELECT * FROM repeated",
    "dup_errors",
    "invariants",
    "domains",
    "repeated",
)

# -- graph --------------------------------------------------------------------------------

sql("roots", "SELECT node_id, name FROM root_nodes", "root_nodes")
sql("transitive_dependencies", "SELECT * FROM below", "below")
sql("transitive_dependents", "SELECT * FROM above", "above")
sql(
    "reachability",
    "SELECT seed AS node_id, node_id AS ancestor, distance FROM reach",
    "reach",
)
sql("has_cycle", "SELECT count(*) > 0 AS has_cycle FROM ring_on", "ring_on")
sql(
    "has_no_cycle",
    "SELECT count(*) > 0 AS has_cycle FROM reach WHERE seed = node_id",
    "reach",
)
sql("cycle_nodes", "SELECT * FROM ring_on", "ring_on")
sql("cycle_path", "SELECT cycle FROM ring_best", "ring_best")
sql(
    "cycle_path_rows",
    """SELECT unnest(range(1, len(path) + 1)) AS position, unnest(path) AS node_id FROM (
  SELECT path FROM ring_walk WHERE len(path) > 1 AND node_id = path[1] ORDER BY len(path), path LIMIT 1)""",
    "ring_walk",
)
part(
    "grouped",
    "SELECT DISTINCT c_custkey AS node_id, unnest([CASE WHEN c_custkey > 0 THEN c_custkey // 2 END,"
    " CASE WHEN c_custkey // 5 % 3 <> 0 THEN c_custkey // 5 * 5 + (c_custkey + 1) % 5 END]) AS depends_on"
    " FROM customer",
)
part(
    "grouped_pairs",
    "SELECT node_id AS a, depends_on AS b FROM grouped WHERE depends_on IS NOT NULL"
    " UNION SELECT p.a, e.depends_on FROM grouped_pairs p JOIN grouped e ON e.node_id = p.b"
    " WHERE e.depends_on IS NOT NULL",
    "grouped",
)
sql(
    "cycle_nodes_many",
    "SELECT p.a AS node_id, min(p.b) AS component FROM grouped_pairs p"
    " JOIN grouped_pairs q ON q.a = p.b AND q.b = p.a GROUP BY p.a",
    "grouped_pairs",
)
sql("transitive_dependents_stored", "SELECT * FROM above", "above")
sql("plan_levels_stored", "SELECT * FROM plan", "plan")
# A node of the chain: as far above each customer that it or a node below it needs as there are
# steps to that node, and one more.
sql(
    "plan_levels_deep",
    """SELECT level, node_id FROM plan
UNION ALL
SELECT CAST(1 + c_custkey + max(CASE WHEN c_custkey = 0 THEN (SELECT level FROM plan WHERE node_id = 7)
    WHEN c_custkey % 7 = 0 THEN p.level - c_custkey END) OVER (ORDER BY c_custkey) AS INTEGER), -1 - c_custkey
FROM customer JOIN plan p ON p.node_id = c_custkey""",
    "plan",
)
part(
    "reach_asked",
    "SELECT DISTINCT c_custkey AS node_id, unnest([c_custkey // 6, c_custkey // 5, (c_custkey * 31 + 7) % 1000])"
    " AS ancestor FROM customer",
)
sql(
    "reaches",
    "SELECT node_id, ancestor, (node_id, ancestor) IN (SELECT (seed, node_id) FROM reach) AS reaches"
    " FROM reach_asked",
    "reach_asked",
    "reach",
)
sql("plan_levels", "SELECT * FROM plan", "plan")
sql("plan_levels_for", "SELECT * FROM todo_plan", "todo_plan")
sql("reverse_plan_levels_for", "SELECT * FROM todo_back", "todo_back")
part(
    "redundant",
    "SELECT node_id, depends_on FROM dense d WHERE EXISTS (SELECT 1 FROM dense o JOIN reach r"
    " ON r.seed = o.depends_on WHERE o.node_id = d.node_id AND r.node_id = d.depends_on)",
    "dense",
    "reach",
)
sql("redundant_edges", "SELECT * FROM redundant", "redundant")
sql(
    "transitive_reduction",
    "SELECT * FROM dense EXCEPT SELECT * FROM redundant",
    "redundant",
)
sql(
    "validate_graph",
    """SELECT 'cycle' AS category, CAST(NULL AS VARCHAR) AS subject,
  'Graph contains a cycle (circular dependency)' AS message
  WHERE EXISTS (SELECT 1 FROM ring_on)
UNION ALL SELECT 'dangling', CAST(node_id AS VARCHAR),
  'Node ' || node_id || ' depends on non-existent node: ' || depends_on
  FROM dangling WHERE depends_on NOT IN (SELECT node_id FROM nodes)""",
    "ring_on",
    "dangling",
    "nodes",
)

# -- targets, plans, outcomes -------------------------------------------------------------

sql("up_targets", "SELECT node_id FROM pending", "pending")
sql(
    "up_targets_for",
    "SELECT node_id FROM pending WHERE node_id IN"
    " (SELECT node_id FROM targets UNION SELECT node_id FROM below)",
    "pending",
    "below",
)
sql("up_plan", "SELECT level, node_id, false AS executed FROM todo_plan", "todo_plan")
sql("rollback_targets_all", "SELECT node_id FROM executed", "executed")
sql(
    "rollback_targets_for",
    "SELECT node_id FROM executed WHERE node_id IN (SELECT node_id FROM targets UNION"
    " SELECT e.node_id FROM targets t JOIN edges e ON e.depends_on = t.node_id)",
    "executed",
    "targets",
    "edges",
)
sql(
    "rollback_targets_for_transitive",
    "SELECT node_id FROM executed WHERE node_id IN"
    " (SELECT node_id FROM targets UNION SELECT node_id FROM above)",
    "executed",
    "above",
)
sql("rollback_plan", "SELECT level, node_id, true AS executed FROM undo_plan", "undo_plan")
sql("up_outcomes", "SELECT * FROM up_run", "up_run")
sql("rollback_outcomes", "SELECT * FROM down_run", "down_run")
RECORDS = """SELECT 'run-' || node_id AS id, node_id, environment_id, '{d}' AS direction,
  CASE outcome WHEN 'OK' THEN 'SUCCESS' WHEN 'FAIL' THEN 'FAILURE' ELSE 'SKIPPED' END AS status,
  TIMESTAMP '2024-02-01 00:00:00' AS executed_at, name AS description,
  {script} AS serialized_down_task,
  CASE WHEN outcome = 'OK' THEN duration_ms ELSE 0 END AS duration_ms,
  coalesce(error_message, reason) AS error_message
FROM {run} WHERE outcome IN ({kinds})"""
sql(
    "outcome_records",
    RECORDS.format(d="UP", script="serialized_down_task", run="up_run", kinds="'OK', 'FAIL'"),
    "up_run",
)
sql(
    "rollback_records",
    RECORDS.format(d="DOWN", script="CAST(NULL AS VARCHAR)", run="down_run", kinds="'OK', 'FAIL'"),
    "down_run",
)
sql(
    "skipped_records",
    RECORDS.format(d="UP", script="CAST(NULL AS VARCHAR)", run="down_run", kinds="'SKIP'"),
    "down_run",
)
sql(
    "run_events_from_outcomes",
    """SELECT 'run-1' AS run_id, TIMESTAMP '2024-01-01 00:00:00' AS event_time,
  'UP' AS direction, node_id, event, duration_ms, reason, error_message, script FROM (
  SELECT node_id, 'started' AS event, CAST(NULL AS BIGINT) AS duration_ms,
    CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS error_message,
    CAST(NULL AS VARCHAR) AS script
    FROM up_run WHERE outcome IN ('OK', 'FAIL')
  UNION ALL SELECT node_id, 'succeeded', duration_ms, NULL, NULL, NULL
    FROM up_run WHERE outcome = 'OK'
  UNION ALL SELECT node_id, 'skipped', NULL, reason, NULL, NULL
    FROM up_run WHERE outcome = 'SKIP'
  UNION ALL SELECT node_id, 'failed', NULL, NULL, r.error_message, n.up
    FROM up_run r JOIN nodes n USING (node_id) WHERE outcome = 'FAIL'
  UNION ALL SELECT NULL, 'plan', NULL, NULL, NULL, NULL
  UNION ALL SELECT NULL, 'completed', NULL, NULL, NULL, NULL)""",
    "nodes",
    "up_run",
)

# -- checks -------------------------------------------------------------------------------

sql(
    "check_project",
    "SELECT 'project' AS category, 'project.yaml' AS subject,"
    " 'project.yaml: Project configuration file not found' AS message"
    " WHERE (SELECT count(*) FROM region) = 0",
)
sql(
    "check_project_missing",
    "SELECT 'project' AS category, 'project.yaml' AS subject,"
    " 'project.yaml: Project configuration file not found' AS message"
    " WHERE (SELECT count(*) FROM region WHERE false) = 0",
)
sql("check_targets", "SELECT * FROM target_errors", "target_errors")
sql("check_tasks", "SELECT * FROM task_errors", "task_errors")
sql("check_dependencies", "SELECT * FROM dependency_errors", "dependency_errors")
sql("check_cycles", "SELECT * FROM cycle_errors", "cycle_errors")
sql("check_record_invariants", "SELECT * FROM invariants", "invariants")
sql("check_record_domains", "SELECT * FROM domains", "domains")
sql("check_record_pk", "SELECT * FROM repeated", "repeated")
sql("validate_specs", "SELECT * FROM spec_errors", "spec_errors")

# -- properties ---------------------------------------------------------------------------

sql(
    "prefix_keys",
    "SELECT source, ordinal, 'target.' || owner || '.' || key AS key, value FROM props"
    " UNION ALL SELECT source, ordinal, 'task.\"' || owner || '\".' || key, value FROM props",
    "props",
)
sql("overlay_props", "SELECT key, value, source, ordinal FROM top", "top")
sql(
    "strip_prefix",
    "SELECT source, ordinal, owner || '.' || plain AS key, value FROM keyed WHERE owner % 2 = 0",
    "keyed",
)
sql(
    "target_ids",
    "SELECT DISTINCT CAST(owner AS VARCHAR) AS target_id FROM keyed WHERE owner % 2 = 0",
    "keyed",
)
sql(
    "pivot_props",
    """SELECT CAST(owner AS VARCHAR) AS owner, max(value) FILTER (plain = 'name') AS name,
  max(value) FILTER (plain = 'type') AS type,
  CAST(max(value) FILTER (plain = 'balance') AS BIGINT) AS balance
FROM top GROUP BY owner""",
    "top",
)
sql(
    "collect_list_props",
    """SELECT c_custkey AS owner, CAST(c_custkey // 2 AS VARCHAR) AS value, 0 AS position
  FROM customer WHERE c_custkey > 0
UNION ALL SELECT c_custkey, CAST(c_custkey // 3 AS VARCHAR), 1 FROM customer
  WHERE c_custkey > 0 AND c_custkey // 3 <> c_custkey // 2""",
)

# -- text ---------------------------------------------------------------------------------

EDGE = r"'^[\x00-\x20]+|[\x00-\x20]+$'"
sql(
    "split_statements",
    rf"""SELECT script_id, CAST(generate_subscripts(parts, 1) AS INTEGER) AS statement_no,
  unnest(parts) AS statement
FROM (SELECT script_id, list_filter(list_transform(list_transform(
    string_split_regex(script, ';\s*?(?:--[^\n]*)?\r?\n'),
    lambda x: regexp_replace(x, {EDGE}, '', 'g')),
    lambda x: CASE WHEN x LIKE '%;' THEN regexp_replace(x[:-2], {EDGE}, '', 'g') ELSE x END),
    lambda x: x <> '') AS parts
  FROM scripts)""",
    "scripts",
)
sql(
    "number_lines",
    """SELECT script_id, CAST(n AS INTEGER) AS line_no,
  '  ' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, ' ') ELSE CAST(n AS VARCHAR) END
  || ' | ' || t AS line
FROM (SELECT script_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS t
  FROM (SELECT script_id, string_split(script, chr(10)) AS parts FROM scripts))""",
    "scripts",
)
DURATION = (
    "CASE WHEN duration_ms >= 1000 THEN ((duration_ms + 50) // 100 // 10) || '.'"
    " || ((duration_ms + 50) // 100 % 10) || 's' ELSE duration_ms || 'ms' END"
)
MOMENT = "strftime(executed_at, '%Y-%m-%d %H:%M:%S')"
sql("format_duration", f"SELECT id, {DURATION} AS duration FROM history", "history")
sql("format_datetime", f"SELECT id, {MOMENT} AS moment FROM history", "history")
MARKER = "CASE WHEN executed THEN '[✓]' ELSE '[ ]' END"
sql("status_marker", f"SELECT node_id, {MARKER} AS marker FROM status", "status")
sql(
    "status_line",
    f"SELECT node_id, {MARKER} || ' ' || node_id || ' - ' || name || CASE WHEN executed"
    f" THEN ' (' || {DURATION} || ', ' || {MOMENT} || ')' ELSE '' END AS line FROM status",
    "status",
)
sql(
    "result_line",
    """SELECT node_id, CASE outcome WHEN 'OK' THEN '[OK]   ' WHEN 'SKIP' THEN '[SKIP] '
    ELSE '[FAIL] ' END || ' ' || node_id || ' - ' || name || CASE outcome
    WHEN 'OK' THEN ' (' || duration_ms || 'ms)' WHEN 'SKIP' THEN ' (' || reason || ')'
    ELSE '' END AS line
FROM down_run WHERE outcome <> 'NOT_REACHED'""",
    "down_run",
)
part("env_counts", f"SELECT environment_id, {COUNTS} FROM status GROUP BY environment_id", "status")
SOME = "{n} || ' migration' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"
sql(
    "count_message",
    f"SELECT environment_id, {SOME.format(n='pending')} || ' will be executed.' AS up_message,"
    f" {SOME.format(n='executed')} || ' would be rolled back.' AS down_message FROM env_counts",
    "env_counts",
)
sql(
    "completion_message",
    f"""SELECT environment_id, CASE WHEN executed = 0
    THEN 'No migrations executed. All migrations are up to date.'
    ELSE 'Migration completed successfully. ' || {SOME.format(n='executed')} || ' executed.' END
    AS up_message,
  CASE WHEN executed > 0 THEN 'Rollback completed successfully. '
    || {SOME.format(n='executed')} || ' rolled back.' END AS down_message
FROM env_counts""",
    "env_counts",
)
sql(
    "task_id_from_path",
    "SELECT path, replace(substr(path, 16), '.yaml', '') AS task_id FROM spec_paths"
    " WHERE kind = 'task'",
    "spec_paths",
)
sql(
    "target_id_from_path",
    "SELECT path, regexp_replace(string_split(path, '/')[-1], '\\.yaml$', '') AS target_id"
    " FROM paths",
    "paths",
)
sql("strip_ansi", "SELECT doc_id, text AS plain FROM documents")

# -- streams ------------------------------------------------------------------------------

sql(
    "latest_status_stream",
    "SELECT node_id, environment_id, executed_at, id, direction = 'UP' AND status = 'SUCCESS'"
    " AS executed FROM latest",
    "latest",
)
sql(
    "outcome_counts_stream",
    """SELECT date_trunc('day', event_time) AS window_start, direction,
  count(*) FILTER (event = 'succeeded') AS succeeded,
  count(*) FILTER (event = 'skipped') AS skipped, count(*) FILTER (event = 'failed') AS failed
FROM run_events GROUP BY ALL""",
    "run_events",
)
sql("history_append_stream", WHOLE_LEDGER, "history")
