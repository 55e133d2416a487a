"""Transitive reduction of an acyclic graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.levels import plan_levels
from ledgerloom.scratch import Scratch


def redundant_edges(
    nodes: DataFrame, edges: DataFrame, levels: DataFrame | None = None
) -> DataFrame:
    """Edges (n, d) where another dependency of n already leads to d.

    Along a dependency the level falls by one at least, so only an edge that falls by two
    or more can be redundant, and a walk from n may stop at the lowest level of its
    candidates. This touches the part of the graph between such edges' ends instead of the
    closure of every node.

    All seeds walk at once, each in the order of falling level: what lies ``k`` levels below its
    seed is expanded in turn ``k``, after everything that could lead to it, and steps that jump
    further wait in the folder of their turn. So each pair of seed and node is expanded once and
    no turn looks at what was visited before; there are as many turns as the longest candidate
    falls. ``levels`` may be passed if a plan is at hand; a cyclic graph raises.
    """
    scratch = Scratch(edges.sparkSession, "reduction")
    if levels is None:
        levels = plan_levels(nodes, edges)
    # Sides that many edges may meet in one key are written first, so that the joins shuffle
    # plain tables, whose hot keys adaptive execution may split.
    levels, _ = scratch.keep(levels.select("node_id", "level"), "levels")
    low = levels.select(F.col("node_id").alias("depends_on"), F.col("level").alias("low"))
    high = levels.select("node_id", F.col("level").alias("high"))
    graded, _ = scratch.keep(
        edges.select("node_id", "depends_on").distinct().join(low, "depends_on").join(high, "node_id"),
        "graded",
    )
    falls = F.col("high") - F.col("low")
    candidates = graded.filter(falls >= 2)
    # A seed's reach: how far below it its lowest candidate lies.
    reach = candidates.groupBy(F.col("node_id").alias("seed")).agg(F.max(falls).alias("reach"))
    reach, n_seeds = scratch.keep(reach, "reach")
    id_type = edges.schema["node_id"].dataType
    schema = T.StructType(
        [
            T.StructField("seed", id_type),
            T.StructField("node_id", id_type),
            T.StructField("reach", T.IntegerType()),
        ]
    )
    # By turn, the folders with steps that wait for it.
    waiting: dict[int, list[str]] = {}
    came_to: list[str] = []

    def send(rows: DataFrame, name: str) -> list[str]:
        """Write steps in folders by the turn they wait for."""
        seen = scratch.write(rows, name, by=["turn"], turns=F.collect_set("turn"))["turns"]
        for turn in seen or []:
            waiting.setdefault(turn, []).append(f"{name}/turn={turn}")
        return [f"{name}/turn={turn}" for turn in seen or []]

    if n_seeds:
        hops = graded.select("node_id", "depends_on", falls.alias("fall"))
        start = hops.withColumnRenamed("node_id", "seed").join(reach, "seed").filter("fall < reach")
        send(
            start.select("seed", F.col("depends_on").alias("node_id"), "reach", F.col("fall").alias("turn")),
            "start",
        )
    turn = 0
    while waiting:
        turn += 1
        if turn not in waiting:
            continue
        here = scratch.read(schema, *waiting.pop(turn)).distinct()
        further = here.join(hops, "node_id").select(
            "seed", F.col("depends_on").alias("node_id"), "reach", (F.col("fall") + turn).alias("turn")
        )
        came_to += send(further.filter("turn <= reach"), f"turn-{turn}")
    # What a turn came to is led to by another dependency; the start's steps are the edges.
    hit = scratch.read(schema, *came_to).select(
        F.col("seed").alias("node_id"), F.col("node_id").alias("depends_on")
    )
    return candidates.join(hit, ["node_id", "depends_on"], "left_semi").select(
        "node_id", "depends_on"
    )


def transitive_reduction(
    nodes: DataFrame, edges: DataFrame, levels: DataFrame | None = None
) -> DataFrame:
    """The edges that remain when redundant ones are dropped."""
    dropped = redundant_edges(nodes, edges, levels)
    return (
        edges.select("node_id", "depends_on")
        .distinct()
        .join(dropped, ["node_id", "depends_on"], "left_anti")
    )
