"""Levels: the longest chain of dependencies below a node, and plans made of them.

Peeling logs hits. A round takes the nodes settled last, finds the edges that need them and
writes for each needing node how many of its edges are still open and the largest level that
arrived; a node is settled once none is open. So a round is one pass over the edges and one over
the log, and the next frontier is a plain filter of what it wrote: a written side can be
broadcast by its true size or, beyond that, be shuffled in a join whose hot keys adaptive
execution may split.

Depth costs rounds, so chains are contracted. Every ``patience`` rounds the open edges are
written anew, and each waiting node with a single open edge becomes a pointer: its level is
its dependency's plus one, or what arrived already if that is more. Pointer doubling finds
where the chains (and trees) of such nodes end, in rounds logarithmic in their length; edges to
them become weighted edges to that end, parallel ones fold to the heaviest, and their levels
follow from it when all else is settled. A chain of any length thus costs its logarithm; a graph
whose nodes keep two open edges each is peeled level by level.

Edges that were met are read in vain from then on. Once these wasted reads add up to twice the
edge table, the open edges are written anew as well, so waste stays below what the rewriting
saves at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.graph import ends, induced_subgraph, reversed_edges
from ledgerloom.operators.pointers import follow
from ledgerloom.schemas import CycleError
from ledgerloom.scratch import Scratch
from ledgerloom.sources.edge_store import EdgeStore

# Fixed texts.
CYCLE_TEXT = "Cannot create execution plan: graph contains a cycle"
INVALID_TEXT = "Graph contains a cycle or invalid dependencies"


# Logs are folded when they lie in this many folders: a read that names more of them starts
# a listing job of its own.
FOLDERS = 32
# Rounds of peeling before chains are contracted, and again after as many.
PATIENCE = 16


class Peeled:
    """``levels`` of the settled nodes, and ``stuck``: the edges that are never met, or ``None``.

    Stuck edges have both ends among the nodes. With edges to unknown nodes only, ``stuck``
    may be an empty table. ``rounds`` counts those of peeling and of pointer doubling.
    """

    def __init__(self, levels: DataFrame, stuck: DataFrame | None, rounds: int):
        self.levels = levels
        self.stuck = stuck
        self.rounds = rounds


class _Peeling:
    """The tables of one peel.

    ``left``: edges that may be open, with weights. ``log``: folders whose rows give, folded by
    node, the open edges and the level so far. ``done``: folders with the rows of settled
    nodes, of which the last one's edges were not met yet. ``folded``: per contraction the table
    of pointers that took their nodes out of the graph.
    """

    def __init__(self, nodes: DataFrame | None, edges: DataFrame | EdgeStore):
        self.store = edges if isinstance(edges, EdgeStore) else None
        spark = self.store.spark if self.store else edges.sparkSession
        self.scratch = Scratch(spark, "levels")
        if self.store:
            self.first = self.store.edges()
        else:
            self.first, _ = self.scratch.keep(edges.select("node_id", "depends_on"), "edges-0")
        self.left = self.first.withColumn("weight", F.lit(1).cast("long"))
        self.tally = T.StructType(
            [
                T.StructField("node_id", self.first.schema["node_id"].dataType),
                T.StructField("open", T.LongType()),
                T.StructField("level", T.LongType()),
            ]
        )
        ids = ends(self.first) if nodes is None else nodes.select("node_id")
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        waits = (
            self.first.select("node_id", one.alias("open"))
            .unionByName(ids.select("node_id", zero.alias("open")))
            .groupBy("node_id")
            .agg(F.sum("open").alias("open"))
            .withColumn("level", zero)
        )
        counts = self.scratch.write(waits, "open-0", edges=F.sum("open"), **self._folders())
        self.nodes = nodes
        self.rounds = 0
        self.log, self.done, self.folded = ["open-0"], ["open-0"], []
        self.n_left = self.open_edges = counts["edges"] or 0
        self.touched = counts.get("folders")
        self.wasted = 0

    def _folders(self) -> dict:
        """What to observe of a write so that the next round reads only some folders."""
        if not self.store:
            return {}
        settled = F.when(F.col("open") == 0, self.store.folder(F.col("node_id")))
        return {"folders": F.collect_set(settled)}

    def settled(self, *names: str) -> DataFrame:
        return self.scratch.read(self.tally, *names).filter("open = 0").select("node_id", "level")

    def waiting(self) -> DataFrame:
        """Nodes with open edges."""
        now = self.scratch.read(self.tally, *self.log).groupBy("node_id")
        return now.agg(F.min("open").alias("open"), F.max("level").alias("level")).filter("open > 0")

    def meet(self) -> bool:
        """One round: edges to the nodes settled last are met. False if there were none."""
        left = self.left
        if self.store and self.touched is not None:
            met_in = self.store.by("depends_on", self.touched)
            left = met_in.withColumn("weight", F.lit(1).cast("long"))
        just = self.settled(self.done[-1]).select(
            F.col("node_id").alias("depends_on"), F.col("level").alias("_level")
        )
        none = F.lit(None).cast("long")
        met = left.join(just, "depends_on").select(
            "node_id",
            none.alias("open"),
            (F.col("_level") + F.col("weight")).alias("level"),
            F.lit(1).alias("hits"),
        )
        known = self.scratch.read(self.tally, *self.log).withColumn("hits", F.lit(0))
        hit = (
            met.unionByName(known)
            .groupBy("node_id")
            .agg(F.min("open").alias("open"), F.max("level").alias("level"), F.sum("hits").alias("hits"))
            .filter("hits > 0")
            .select("node_id", (F.col("open") - F.col("hits")).alias("open"), "level", "hits")
        )
        name = f"hits-{self.rounds + 1}"
        counts = self.scratch.write(hit, name, hits=F.sum("hits"), **self._folders())
        if not counts["n"]:
            return False
        self.rounds += 1
        self.open_edges -= counts["hits"]
        self.wasted += self.n_left - self.open_edges
        self.log.append(name)
        self.done.append(name)
        if self.touched is not None:
            self.touched = counts["folders"]
        return True

    def fold_log(self) -> int:
        """Write the log as one folder; returns how many nodes wait for a single edge."""
        name = f"open-{self.rounds}"
        counts = self.scratch.write(
            self.waiting(), name, single=F.count_if(F.col("open") == 1)
        )
        self.log = [name]
        return counts["single"]

    def rewrite(self) -> None:
        """Keep only edges that may still be met: not those to nodes settled before the last."""
        met = self.settled(*self.done[:-1]).select(F.col("node_id").alias("depends_on"))
        waiting = self.scratch.read(self.tally, *self.log).select("node_id")
        rest = self.left.join(waiting, "node_id", "left_semi").join(met, "depends_on", "left_anti")
        self.left, self.n_left = self.scratch.keep(
            rest.select("node_id", "depends_on", "weight"), f"edges-{self.rounds}"
        )
        self.wasted, self.touched = 0, None

    def contract(self) -> None:
        """Take the nodes with one open edge out of the graph; the log has just been folded."""
        scratch, mark = self.scratch, self.rounds
        waiting = scratch.read(self.tally, *self.log)
        single = waiting.filter("open = 1").select("node_id", F.col("level").alias("floor"))
        pointers, _ = scratch.keep(
            self.left.join(single, "node_id").select(
                "node_id", F.col("depends_on").alias("to"), "weight", "floor"
            ),
            f"pointers-{mark}",
        )
        followed = follow(scratch, pointers, f"jump-{mark}")
        self.rounds += followed.rounds
        gone, n_gone = scratch.keep(followed.ends, f"gone-{mark}")
        if not n_gone:
            return
        self.folded.append(gone)
        ahead = gone.select(
            F.col("node_id").alias("depends_on"),
            "to",
            F.col("weight").alias("_weight"),
            F.col("floor").alias("_floor"),
        )
        moved = (
            self.left.join(gone, "node_id", "left_anti")
            .join(ahead, "depends_on", "left")
            .select(
                "node_id",
                F.coalesce("to", "depends_on").alias("depends_on"),
                (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"),
                (F.col("weight") + F.col("_floor")).alias("floor"),
            )
            .groupBy("node_id", "depends_on")
            .agg(F.max("weight").alias("weight"), F.max("floor").alias("floor"))
        )
        moved, self.n_left = scratch.keep(moved, f"edges-{mark}-contracted")
        self.left, self.open_edges = moved.drop("floor"), self.n_left
        counted = moved.groupBy("node_id").agg(
            F.count(F.lit(1)).alias("_open"), F.max("floor").alias("floor")
        )
        name = f"open-{mark}-contracted"
        scratch.write(
            waiting.join(counted, "node_id").select(
                "node_id",
                F.col("_open").alias("open"),
                F.greatest("level", "floor").alias("level"),
            ),
            name,
        )
        self.log = [name]

    def levels(self) -> DataFrame:
        """Settled nodes with their levels, those taken out included, the latest first."""
        names = list(self.done)
        for k, gone in enumerate(reversed(self.folded)):
            known = self.settled(*names).select(F.col("node_id").alias("to"), "level")
            level = F.greatest("floor", F.col("level") + F.col("weight"))
            found = gone.join(known, "to").select(
                "node_id", F.lit(0).cast("long").alias("open"), level.alias("level")
            )
            names.append(f"levels-{k}")
            self.scratch.write(found, names[-1])
        found = self.settled(*names).withColumn("level", F.col("level").cast("int"))
        if self.nodes is not None:
            found = found.join(self.nodes.select("node_id"), "node_id", "left_semi")
        return found

    def stuck(self, levels: DataFrame) -> DataFrame:
        """Of the first edges those to nodes that were never settled."""
        blocked = self.waiting().select("node_id")
        for gone in self.folded:
            blocked = blocked.unionByName(gone.select("node_id"))
        blocked = blocked.join(levels, "node_id", "left_anti")
        return self.first.join(
            blocked.select(F.col("node_id").alias("depends_on")), "depends_on", "left_semi"
        ).select("node_id", "depends_on")


def peel(
    nodes: DataFrame | None,
    edges: DataFrame | EdgeStore,
    folders: int = FOLDERS,
    patience: int = PATIENCE,
) -> Peeled:
    """Settle nodes from the bottom up.

    Without ``nodes`` the ends of the edges are the nodes. Repeated edges do no harm: they
    are counted the same when waited for and when hit. A stored graph is read by the folders
    of the nodes settled last, until its open edges are written anew.
    """
    state = _Peeling(nodes, edges)
    since = 0
    while state.open_edges and state.meet():
        since += 1
        if not state.open_edges:
            break
        if since >= patience:
            single, since = state.fold_log(), 0
            state.rewrite()
            if single:
                state.contract()
        elif state.wasted >= 2 * state.n_left:
            state.fold_log()
            state.rewrite()
        elif len(state.log) >= folders:
            state.fold_log()
    levels = state.levels()
    return Peeled(levels, state.stuck(levels) if state.open_edges else None, state.rounds)


def _existing_edges(nodes: DataFrame, edges: DataFrame | EdgeStore) -> DataFrame:
    return induced_subgraph(edges.edges() if isinstance(edges, EdgeStore) else edges, nodes)


def has_cycle(nodes: DataFrame, edges: DataFrame | EdgeStore) -> DataFrame:
    """One row ``has_cycle``; edges to unknown nodes are ignored, self-loops count."""
    stuck = peel(nodes, _existing_edges(nodes, edges)).stuck
    return nodes.sparkSession.range(1).select(F.lit(stuck is not None).alias("has_cycle"))


def plan_levels(nodes: DataFrame, edges: DataFrame | EdgeStore) -> DataFrame:
    """``level, node_id`` of the whole graph; raises on a cycle or a dangling edge."""
    peeled = peel(nodes, edges)
    if peeled.stuck is not None:
        cyclic = peel(nodes, _existing_edges(nodes, peeled.stuck)).stuck
        raise CycleError(INVALID_TEXT if cyclic is None else CYCLE_TEXT)
    return peeled.levels.select("level", "node_id")


def plan_levels_for(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The same within a target set: only dependencies inside the set count.

    Unknown ids in the set are dropped; an empty set gives an empty plan.
    """
    known = nodes.select("node_id").join(targets.select("node_id"), "node_id", "left_semi")
    members, _ = Scratch(nodes.sparkSession, "targets").keep(known.distinct(), "members")
    return plan_levels(members, induced_subgraph(edges, members))


def reverse_plan_levels_for(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Dependents first."""
    return plan_levels_for(nodes, reversed_edges(edges), targets)


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies before dependents; within a level by id."""
    return plan_levels(nodes, edges).orderBy("level", "node_id")


def level_sizes(plan: DataFrame) -> DataFrame:
    return plan.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))


def plan_stats(plan: DataFrame) -> DataFrame:
    """One row: nodes, widest level, number of levels; zeros for an empty plan."""
    zero = F.lit(0).cast("long")
    return level_sizes(plan).agg(
        F.coalesce(F.sum("n_nodes"), zero).alias("total_nodes"),
        F.coalesce(F.max("n_nodes"), zero).alias("max_parallelism"),
        F.count(F.lit(1)).alias("level_count"),
    )


def plan_positions(plan: DataFrame) -> DataFrame:
    """``position, level, node_id``: place of each node in the plan, from 1.

    A level may hold most of the nodes, so no window runs over one: the plan is range
    partitioned and sorted, rows are numbered within their partition, and each partition
    is shifted by the rows before it. The only unpartitioned window runs over the shift
    table, which has one row per shuffle partition.
    """
    scratch = Scratch(plan.sparkSession, "positions")
    row_bits = F.lit((1 << 33) - 1)
    numbered = (
        plan.select("level", "node_id")
        .repartitionByRange("level", "node_id")
        .sortWithinPartitions("level", "node_id")
        .select(
            "level",
            "node_id",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(row_bits).alias("_row"),
        )
    )
    stored, _ = scratch.keep(numbered, "numbered")
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift")
    )
    return stored.join(shift, "_part").select(
        (F.col("_shift") + F.col("_row") + 1).alias("position"), "level", "node_id"
    )
