"""Small literal graphs and plain-Python answers to check the operators against."""

from __future__ import annotations

from itertools import product

NODE_FIELDS = "node_id string, name string, description string, environment_id string, up string, down string"
EDGE_FIELDS = "node_id string, depends_on string"


def nodes_df(spark, ids, env="test"):
    rows = [(i, f"task {i}", None, env, f"up {i}", f"down {i}") for i in ids]
    return spark.createDataFrame(rows, NODE_FIELDS).coalesce(1)


def edges_df(spark, pairs):
    return spark.createDataFrame(list(pairs), EDGE_FIELDS).coalesce(1)


def graph_of(spark, text):
    """``"b>a c>a,b d"`` as nodes and edges: b needs a, c needs a and b, d stands alone."""
    ids, pairs = set(), []
    for item in text.split():
        node, _, needs = item.partition(">")
        ids.add(node)
        for need in filter(None, needs.split(",")):
            ids.add(need)
            pairs.append((node, need))
    return nodes_df(spark, sorted(ids)), edges_df(spark, pairs)


def rows(df, *columns):
    return {tuple(row) for row in df.select(*columns).collect()}


def values(df, column):
    return sorted(row[0] for row in df.select(column).collect())


def by_level(plan):
    levels = {}
    for row in plan.collect():
        levels.setdefault(row["level"], set()).add(row["node_id"])
    return [levels[i] for i in sorted(levels)]


def py_closure(pairs):
    """All pairs with their shortest distance (closed walks included)."""
    nexts = {}
    for a, b in pairs:
        nexts.setdefault(a, set()).add(b)
    found = {}
    for start in nexts:
        frontier, distance = nexts[start], 1
        while frontier:
            fresh = {n for n in frontier if (start, n) not in found}
            for n in fresh:
                found[start, n] = distance
            frontier = set().union(*(nexts.get(n, set()) for n in fresh)) if fresh else set()
            distance += 1
    return found


def py_levels(ids, pairs):
    """Longest chain below each node, or None on a cycle."""
    level, rest = dict.fromkeys(ids, 0), len(ids) + 1
    for _ in range(rest):
        changed = False
        for a, b in pairs:
            if level[a] < level[b] + 1:
                level[a], changed = level[b] + 1, True
        if not changed:
            return level
    return None


def py_redundant(pairs):
    reach = py_closure(pairs)
    return {
        (n, d)
        for (n, d), (m, c) in product(set(pairs), set(pairs))
        if n == m and c != d and (c, d) in reach
    }
