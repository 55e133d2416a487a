"""Does one node need another? An interval index for given pairs, linear in the graph.

All pairs are too many to keep. Instead every node has a few numbers from several random
depth-first-like orders: each dependency picks, at random, one of the nodes that need it as its
parent, which makes a forest, and the forest is numbered from the top down, so that what hangs
below a node has the numbers ``rank`` to ``last``. Over all edges, ``low`` and ``high`` are the
smallest and the largest rank of whatever the node needs, itself included. Then

* a node can only need another if the other's ``low`` to ``high`` lies in its own, in every
  order, and its level is higher: all else is refuted without looking at an edge;
* it surely does if the other's rank lies between its own ``rank`` and ``last`` in any order;
* what is left is walked, and the walk steps only to nodes that still pass the first test.

The index has one row a node and one an edge, of ``4 * orders + 1`` numbers each. It is built
level by level; a round sends what a level knows to the folders of the levels above, so every
edge carries one message, and ranks come from pointer doubling in the forest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.levels import plan_levels
from ledgerloom.operators.pointers import follow
from ledgerloom.operators.sums import running_sum
from ledgerloom.scratch import Scratch

ORDERS = 3


def _numbers(orders: int, *names: str) -> list[str]:
    return [f"{name}{k}" for k in range(orders) for name in names]


class ReachIndex:
    """The index below ``path``; made by :func:`build_index`, opened again by the constructor."""

    def __init__(self, spark: SparkSession, path: str, orders: int = ORDERS):
        self.spark, self.path, self.orders = spark, path, orders
        self.columns = ["level", *_numbers(orders, "low", "high", "rank", "last")]

    def nodes(self) -> DataFrame:
        """``node_id``, its level and its numbers."""
        return self.spark.read.parquet(f"{self.path}/nodes")

    def hops(self) -> DataFrame:
        """``node_id, depends_on``, and the level and numbers of ``depends_on``."""
        return self.spark.read.parquet(f"{self.path}/hops")


class _Post:
    """Messages in folders by the level of the node that they are for."""

    def __init__(self, scratch: Scratch, name: str):
        self.scratch, self.name = scratch, name
        self.folders: dict[int, list[str]] = {}
        self.all: list[str] = []

    def send(self, rows: DataFrame, sender: int) -> None:
        """Rows with a column ``at``, the level to send them to."""
        name = f"{self.name}-{sender}"
        seen = self.scratch.write(rows, name, by=["at"], levels=F.collect_set("at"))["levels"]
        for level in seen or []:
            self.folders.setdefault(level, []).append(f"{name}/at={level}")
            self.all.append(f"{name}/at={level}")

    def for_level(self, schema: T.StructType, level: int) -> DataFrame:
        return self.scratch.read(schema, *self.folders.get(level, []))


def _forest(graded: DataFrame, levels: DataFrame, orders: int) -> DataFrame:
    """``turn, node_id, level, parent, at``: the parent, and its level, in each order."""
    picks = [
        F.min_by(
            F.struct(F.col("node_id").alias("parent"), F.col("high").alias("at")),
            F.struct(F.xxhash64(F.lit(k), "node_id", "depends_on"), "node_id"),
        ).alias(f"p{k}")
        for k in range(orders)
    ]
    picked = graded.groupBy(F.col("depends_on").alias("_child")).agg(*picks)
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), F.col(f"p{k}").alias("p")) for k in range(orders)]))
    rows = levels.join(picked, F.col("node_id") == F.col("_child"), "left").select("node_id", "level", turns.alias("t"))
    return rows.select(
        "t.turn", "node_id", "level", F.col("t.p.parent").alias("parent"),
        F.coalesce("t.p.at", F.lit(-1)).alias("at"),
    )


def _ranks(scratch: Scratch, forest: DataFrame, n_levels: int) -> DataFrame:
    """``turn, node_id, rank, last`` of the forest numbered from the top down."""
    scratch.write(forest, "forest", by=["level"])
    post = _Post(scratch, "size")
    base = T.StructType([f for f in forest.schema if f.name != "level"])
    message = T.StructType(
        [forest.schema["turn"], forest.schema["node_id"], forest.schema["parent"], T.StructField("size", T.LongType())]
    )
    one = F.lit(1).cast("long")
    for level in range(n_levels):
        here = scratch.read(base, f"forest/level={level}")
        below = post.for_level(message, level)
        below = below.select("turn", F.col("parent").alias("node_id"), "size")
        # A node without a parent is for no one: level -1.
        sized = (
            here.select("turn", "node_id", "parent", "at", one.alias("size"))
            .unionByName(below, allowMissingColumns=True)
            .groupBy("turn", "node_id")
            .agg(F.max("parent").alias("parent"), F.max("at").alias("at"), F.sum("size").alias("size"))
        )
        post.send(sized, level)
    sizes = scratch.read(message, *post.all)
    order = F.xxhash64(F.lit("order"), "turn", "node_id")
    placed = running_sum(
        scratch, sizes.withColumn("order", order), "siblings", ["turn", "parent"], ["order", "node_id"], "size"
    )
    placed, _ = scratch.keep(placed, "placed")
    pointers, _ = scratch.keep(
        placed.filter("parent IS NOT NULL").select(
            F.struct("turn", "node_id").alias("node_id"),
            F.struct("turn", F.col("parent").alias("node_id")).alias("to"),
            (F.col("before") + 1).alias("weight"),
            F.lit(0).alias("floor"),
        ),
        "upwards",
    )
    ways = follow(scratch, pointers, "path").ends.select(
        "node_id.turn", "node_id.node_id", F.col("to.node_id").alias("root"), "weight"
    )
    tops = placed.filter("parent IS NULL").select("turn", F.col("node_id").alias("root"), F.col("before").alias("rank"))
    below = ways.join(tops, ["turn", "root"]).select("turn", "node_id", (F.col("rank") + F.col("weight")).alias("rank"))
    ranks = below.unionByName(tops.withColumnRenamed("root", "node_id"))
    return ranks.join(placed.select("turn", "node_id", "size"), ["turn", "node_id"]).select(
        "turn", "node_id", "rank", (F.col("rank") + F.col("size") - 1).alias("last")
    )


def build_index(
    nodes: DataFrame,
    edges: DataFrame,
    path: str,
    levels: DataFrame | None = None,
    orders: int = ORDERS,
) -> ReachIndex:
    """Write the index of an acyclic graph; a cyclic one raises. ``levels``: a plan at hand."""
    spark = nodes.sparkSession
    scratch = Scratch(spark, "reach")
    levels = plan_levels(nodes, edges) if levels is None else levels
    levels, _ = scratch.keep(levels.select("node_id", "level"), "levels")
    n_levels = (levels.agg(F.max("level")).first()[0] or 0) + 1
    low = levels.select(F.col("node_id").alias("depends_on"), F.col("level").alias("low"))
    high = levels.select("node_id", F.col("level").alias("high"))
    graded = edges.select("node_id", "depends_on").distinct().join(low, "depends_on").join(high, "node_id")
    scratch.write(graded, "graded", by=["low"])
    graded_by = T.StructType([f for f in graded.schema if f.name != "low"])
    graded = scratch.read(graded.schema, "graded")
    ranks = _ranks(scratch, _forest(graded, levels, orders), n_levels)
    by_turn = [
        F.max(F.when(F.col("turn") == k, F.col(c))).alias(f"{c}{k}") for k in range(orders) for c in ("rank", "last")
    ]
    own = ranks.groupBy("node_id").agg(*by_turn).join(levels, "node_id")
    scratch.write(own, "own", by=["level"])
    own_by = T.StructType([f for f in own.schema if f.name != "level"])
    bounds = _numbers(orders, "low", "high")
    message = T.StructType([own.schema["node_id"], *[T.StructField(c, T.LongType()) for c in bounds]])
    post = _Post(scratch, "bounds")

    def hull(rows: DataFrame) -> DataFrame:
        widest = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in bounds]
        return rows.groupBy("node_id").agg(*widest)

    def as_bounds(rows: DataFrame) -> DataFrame:
        both = [F.col(f"rank{k}").alias(f"{c}{k}") for k in range(orders) for c in ("low", "high")]
        return rows.select("node_id", *both)

    # Each level but the highest has edges to tell of.
    for level in range(n_levels - 1):
        here = as_bounds(scratch.read(own_by, f"own/level={level}"))
        known = hull(here.unionByName(post.for_level(message, level)))
        up = scratch.read(graded_by, f"graded/low={level}")
        told = known.withColumnRenamed("node_id", "depends_on").join(up, "depends_on")
        post.send(told.select("node_id", F.col("high").alias("at"), *bounds), level)
    own = scratch.read(own.schema, "own")
    hulls = hull(as_bounds(own).unionByName(scratch.read(message, *post.all)))
    index = ReachIndex(spark, path, orders)
    own.join(hulls, "node_id").select("node_id", *index.columns).write.parquet(f"{path}/nodes")
    ahead = index.nodes().withColumnRenamed("node_id", "depends_on")
    graded.select("node_id", "depends_on").join(ahead, "depends_on").write.parquet(f"{path}/hops")
    return index


def _may(orders: int) -> Column:
    """Whether the goal's numbers (``goal_*``) leave open that the node needs it."""
    passed = F.col("level") > F.col("goal_level")
    for k in range(orders):
        passed &= (F.col(f"low{k}") <= F.col(f"goal_low{k}")) & (F.col(f"goal_high{k}") <= F.col(f"high{k}"))
    return passed


def _surely(orders: int) -> Column:
    """Whether the goal hangs below the node in one of the forests."""
    found = F.lit(False)
    for k in range(orders):
        found |= (F.col(f"rank{k}") < F.col(f"goal_rank{k}")) & (F.col(f"goal_rank{k}") <= F.col(f"last{k}"))
    return found


def reaches(pairs: DataFrame, index: ReachIndex) -> DataFrame:
    """``node_id, ancestor, reaches`` for each distinct pair: whether the node needs the ancestor.

    A node does not need itself; unknown ids need nothing. Of the pairs that the numbers leave
    open the walk goes down in the order of falling level, as the reduction does: what lies
    ``k`` levels below its pair's node is expanded in turn ``k``, once.
    """
    orders, scratch = index.orders, Scratch(index.spark, "reaches")
    asked, _ = scratch.keep(pairs.select("node_id", "ancestor").distinct(), "asked")
    numbers = ["level", *_numbers(orders, "low", "high", "rank")]
    goal = index.nodes().select(F.col("node_id").alias("ancestor"), *[F.col(c).alias(f"goal_{c}") for c in numbers])
    goals = [f"goal_{c}" for c in numbers]
    known = asked.join(index.nodes(), "node_id").join(goal, "ancestor").filter(_may(orders))
    judged, _ = scratch.keep(known.withColumn("sure", _surely(orders)), "judged")
    found = [judged.filter("sure").select("node_id", "ancestor")]
    start = judged.filter("NOT sure").select(
        F.col("node_id").alias("seed"), "ancestor", "node_id", F.col("level").alias("top"), *goals, F.lit(0).alias("turn")
    )
    schema = T.StructType([f for f in start.schema if f.name != "turn"])
    waiting: dict[int, list[str]] = {}
    arrived: list[str] = []

    def send(rows: DataFrame, name: str) -> None:
        """Steps in folders by the turn they wait for; -1 are those that came to their goal."""
        seen = scratch.write(rows, name, by=["turn"], turns=F.collect_set("turn"))["turns"]
        for turn in seen or []:
            where = arrived if turn < 0 else waiting.setdefault(turn, [])
            where.append(f"{name}/turn={turn}")

    send(start, "start")
    turn = -1
    while waiting:
        turn += 1
        if turn not in waiting:
            continue
        here = scratch.read(schema, *waiting.pop(turn)).distinct()
        there = F.col("depends_on") == F.col("ancestor")
        step = here.join(index.hops(), "node_id").filter(there | _may(orders))
        later = F.when(there | _surely(orders), F.lit(-1)).otherwise(F.col("top") - F.col("level"))
        send(
            step.select("seed", "ancestor", F.col("depends_on").alias("node_id"), "top", *goals, later.alias("turn")),
            f"turn-{turn}",
        )
    found.append(scratch.read(schema, *arrived).select(F.col("seed").alias("node_id"), "ancestor"))
    yes = found[0].unionByName(found[1]).distinct().withColumn("_yes", F.lit(True))
    return asked.join(yes, ["node_id", "ancestor"], "left").select(
        "node_id", "ancestor", F.col("_yes").isNotNull().alias("reaches")
    )
