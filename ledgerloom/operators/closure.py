"""Closures: what nodes need, or what needs them, directly or not.

Two loops, one for each shape of question. From given seeds a breadth-first walk touches
only what the seeds reach, one round per hop. For all pairs the known pairs are composed
with themselves, so the number of rounds grows with the logarithm of the depth; the result is
quadratic in the worst case, so ask :mod:`ledgerloom.operators.reach` when pairs are given.

A walk reads the edges where they are: a table is scanned once per hop and never copied, an
:class:`~ledgerloom.sources.edge_store.EdgeStore` only in the folders that the frontier's nodes
fall into. Hand over a stored table, not one with work before it.

Candidates are made distinct with a combine step before the shuffle and the result of a
round goes to a written table, so a hot id only makes a join partition that adaptive
execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.scratch import Scratch
from ledgerloom.sources.edge_store import EdgeStore

#: Ids that are sure to be broadcast: as many longs take a megabyte.
FEW = 1 << 17


def _pairs(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("seed", id_type),
            T.StructField("node_id", id_type),
            T.StructField("distance", T.IntegerType()),
        ]
    )


def _walk(seeds: DataFrame, edges: DataFrame | EdgeStore, near: str, far: str) -> DataFrame:
    """``seed, node_id, distance`` along edges from their ``near`` end to their ``far`` one."""
    store = edges if isinstance(edges, EdgeStore) else None
    scratch = Scratch(seeds.sparkSession, "closure")
    id_type = store.id_type if store else edges.schema["node_id"].dataType
    schema = _pairs(id_type)
    seen = {"folders": F.collect_set(store.folder(F.col("node_id")))} if store else {}
    start = seeds.select(
        F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("distance")
    ).distinct()
    counts = scratch.write(start, "hop-0", **seen)
    rounds: list[str] = []
    while counts["n"]:
        last = f"hop-{len(rounds)}"
        table = store.by(near, counts["folders"]) if store else edges
        hops = table.select(F.col(near).alias("node_id"), F.col(far).alias("_next"))
        step = (
            scratch.read(schema, last)
            .join(hops, "node_id")
            .select("seed", F.col("_next").alias("node_id"))
            .distinct()
        )
        if rounds:
            step = step.join(scratch.read(schema, *rounds), ["seed", "node_id"], "left_anti")
        distance = len(rounds) + 1
        counts = scratch.write(
            step.select("seed", "node_id", F.lit(distance).alias("distance")), f"hop-{distance}", **seen
        )
        if counts["n"]:
            rounds.append(f"hop-{distance}")
    return scratch.read(schema, *rounds)


def transitive_dependencies(seeds: DataFrame, edges: DataFrame | EdgeStore) -> DataFrame:
    """``seed, node_id, distance`` for everything a seed needs.

    The seed itself appears only when it lies on a cycle.
    """
    return _walk(seeds, edges, "node_id", "depends_on")


def transitive_dependents(seeds: DataFrame, edges: DataFrame | EdgeStore) -> DataFrame:
    """``seed, node_id, distance`` for everything that needs a seed."""
    return _walk(seeds, edges, "depends_on", "node_id")


def reachability(edges: DataFrame) -> DataFrame:
    """``node_id, ancestor, distance`` for all pairs.

    Every shortest path longer than ``span`` has exactly one node at distance ``span``, so
    joining the pairs at that distance with all known pairs finds each path of up to twice
    the length once per middle node. Once no pair is at that distance, none is further.

    The known pairs are most of the data and are not shuffled whole where few ids are asked
    of them: only those that start at a middle node go on, and a path found is compared only
    with known ones to an end that they have. Both sets of ids are written, so that the
    planner sees how small they are.
    """
    scratch = Scratch(edges.sparkSession, "reachability")
    schema = _pairs(edges.schema["node_id"].dataType)
    first = edges.select(
        F.col("node_id").alias("seed"), F.col("depends_on").alias("node_id")
    ).distinct()
    span, rounds = 1, ["span-1"]
    furthest = scratch.write(first.withColumn("distance", F.lit(1)), rounds[0])["n"]
    while furthest:
        known = scratch.read(schema, *rounds)
        outer = (
            scratch.read(schema, rounds[-1])
            .filter(F.col("distance") == span)
            .select("seed", F.col("node_id").alias("middle"))
        )
        middles, _ = scratch.keep(outer.select("middle").distinct(), f"middles-{span}")
        inner, _ = scratch.keep(
            known.select(F.col("seed").alias("middle"), "node_id", "distance").join(
                middles, "middle", "left_semi"
            ),
            f"inner-{span}",
        )
        ends, n_ends = scratch.keep(inner.select("node_id").distinct(), f"ends-{span}")
        before = known.select("seed", "node_id")
        # More ids would be shuffled, and the known pairs by them once more.
        if n_ends <= FEW:
            before = before.join(ends, "node_id", "left_semi")
        step = (
            outer.join(inner, "middle")
            .groupBy("seed", "node_id")
            .agg((F.min("distance") + span).cast("int").alias("distance"))
            .join(before, ["seed", "node_id"], "left_anti")
        )
        span *= 2
        name = f"span-{span}"
        counts = scratch.write(step, name, furthest=F.count_if(F.col("distance") == span))
        furthest = counts["furthest"]
        if counts["n"]:
            rounds.append(name)
    return scratch.read(schema, *rounds).select(
        F.col("seed").alias("node_id"), F.col("node_id").alias("ancestor"), "distance"
    )


def target_closure(seeds: DataFrame, edges: DataFrame | EdgeStore) -> DataFrame:
    """Distinct ids: the targets and everything they need."""
    needed = transitive_dependencies(seeds, edges).select("node_id")
    return seeds.select("node_id").unionByName(needed).distinct()
