"""Where the cycles are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.levels import FOLDERS
from ledgerloom.operators.pointers import follow
from ledgerloom.scratch import Scratch

# Sides of an edge: forwards from a node to what it needs, backwards to what needs it.
FORWARD, BACK = 0, 1


def _arcs(edges: DataFrame) -> DataFrame:
    """``key, other, side``: each edge from either end."""
    ends = F.array(
        F.struct(F.col("node_id").alias("key"), F.col("depends_on").alias("other"), F.lit(FORWARD).alias("side")),
        F.struct(F.col("depends_on").alias("key"), F.col("node_id").alias("other"), F.lit(BACK).alias("side")),
    )
    return edges.select(F.explode(ends).alias("a")).select("a.*")


def _side(which: int) -> Column:
    return F.col("side") == which


# -- trimming -----------------------------------------------------------------------------

#: Rounds of trimming: what hangs deeper is left to the labels.
PATIENCE = 16
#: A round of trimming is followed by another if it peels off one in so many nodes.
WORTH = 100


def _trim(scratch: Scratch, arcs: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The arcs that remain when nodes without needs, or that nothing needs, are peeled off.

    Both ends are peeled in the same round: one log holds how many edges of a node are open on
    either side, and a node goes once one side has none. What is left lies on cycles, on paths
    between them, or deep in a tail: trimming only saves work, so it stops after ``PATIENCE``
    rounds, or once a round peels off few. Returns the arcs, written, and their number.
    """
    arcs, n_arcs = scratch.keep(arcs, f"{label}-arcs")
    if not n_arcs:
        return arcs, 0
    one = F.lit(1).cast("long")
    first = arcs.groupBy(F.col("key").alias("node_id")).agg(
        F.sum(F.when(_side(FORWARD), one).otherwise(0)).alias("ins"),
        F.sum(F.when(_side(BACK), one).otherwise(0)).alias("outs"),
    )
    schema, over = first.schema, "ins <= 0 OR outs <= 0"
    names = [f"{label}-0"]
    counts = scratch.write(first, names[0], gone=F.count_if(F.expr(over)))
    fresh, n_nodes = counts["gone"], counts["n"]
    if not fresh:
        return arcs, n_arcs
    while fresh * WORTH >= n_nodes and len(names) <= PATIENCE:
        gone = scratch.read(schema, names[-1]).filter(over).select(F.col("node_id").alias("key"))
        none = F.lit(None).cast("long")
        # A node that goes closes one edge of what needs it and of what it needs.
        hits = arcs.join(gone, "key", "left_semi").select(
            F.col("other").alias("node_id"),
            none.alias("ins"),
            none.alias("outs"),
            F.when(_side(BACK), 1).otherwise(0).alias("in_hits"),
            F.when(_side(FORWARD), 1).otherwise(0).alias("out_hits"),
        )
        zero = F.lit(0)
        known = scratch.read(schema, *names).select(
            "*", zero.alias("in_hits"), zero.alias("out_hits")
        )
        least = [F.min(c).alias(c) for c in ("ins", "outs")]
        total = [F.sum(c).alias(c) for c in ("in_hits", "out_hits")]
        step = (
            hits.unionByName(known)
            .groupBy("node_id")
            .agg(*least, *total)
            .filter("in_hits + out_hits > 0 AND ins > 0 AND outs > 0")
            .select(
                "node_id",
                (F.col("ins") - F.col("in_hits")).alias("ins"),
                (F.col("outs") - F.col("out_hits")).alias("outs"),
            )
        )
        names.append(f"{label}-{len(names)}")
        fresh = scratch.write(step, names[-1], gone=F.count_if(F.expr(over)))["gone"]
    now = scratch.read(schema, *names).groupBy("node_id")
    now = now.agg(F.min("ins").alias("ins"), F.min("outs").alias("outs"))
    left, n = scratch.keep(now.filter("ins > 0 AND outs > 0").select("node_id"), f"{label}-alive")
    if not n:
        return arcs.limit(0), 0
    core = arcs.join(left.select(F.col("node_id").alias("key")), "key", "left_semi").join(
        left.select(F.col("node_id").alias("other")), "other", "left_semi"
    )
    return scratch.keep(core.select("key", "other", "side"), f"{label}-core")


# -- runs of nodes with one edge on either side ---------------------------------------------


def _runs(scratch: Scratch, core: DataFrame, start: DataFrame) -> DataFrame | None:
    """``node_id, below, weight``: nodes with one edge on either side, the node where their run
    ends, and the steps to it. ``start`` is none of them; ``core`` is one component with it, so no
    run is a ring."""
    degrees = _arcs(core).groupBy(F.col("key").alias("node_id")).agg(
        F.count_if(_side(FORWARD)).alias("ins"), F.count_if(_side(BACK)).alias("outs")
    )
    inner = degrees.filter("ins = 1 AND outs = 1").select("node_id").join(start, "node_id", "left_anti")
    pointers, n = scratch.keep(
        core.join(inner, "node_id", "left_semi").select(
            "node_id", F.col("depends_on").alias("to"), F.lit(1).alias("weight"), F.lit(0).alias("floor")
        ),
        "run-pointers",
    )
    if not n:
        return None
    ends = follow(scratch, pointers, "run-jump").ends
    return ends.select("node_id", F.col("to").alias("below"), "weight")


# -- components -----------------------------------------------------------------------------


def _labels(scratch: Scratch, arcs: DataFrame, label: str) -> DataFrame:
    """``node_id, first, last``: the first node, by hash, that reaches it, and that it reaches.

    Every node is a head at first. Both directions run in one loop of tagged frontiers, and a
    round writes only the labels that changed. A label takes two ways: along an edge, and from
    the node that is one's label so far, whose label is good for oneself too. The second way
    makes the rounds logarithmic on long chains and rings. The hash decides, so that components
    in a row do not settle one by one when their ids rise along it.
    """

    def rank(column: str) -> Column:
        return F.struct(F.xxhash64(column).alias("rank"), F.col(column).alias("node_id"))

    # The first round needs no frontier: one's own hash against the neighbours'.
    start = arcs.groupBy(F.col("other").alias("node_id"), "side").agg(F.min(rank("key")).alias("_near"))
    start = start.select("node_id", "side", F.least("_near", rank("node_id")).alias("label"))
    schema, none = start.schema, F.lit(None).cast(start.schema["label"].dataType)
    name, turn = f"{label}-0", 0
    fresh, log = scratch.write(start, name)["n"], [name]

    def settled(heads: DataFrame | None = None) -> DataFrame:
        rows = scratch.read(schema, *log)
        if heads is not None:
            rows = rows.join(heads, ["node_id", "side"], "left_semi")
        return rows.groupBy("node_id", "side").agg(F.min("label").alias("label"))

    while fresh:
        changed = scratch.read(schema, name)
        along = (
            changed.withColumnRenamed("node_id", "key")
            .join(arcs, ["key", "side"])
            .select(F.col("other").alias("node_id"), "side", F.col("label").alias("_offer"))
        )
        # Of those that are a changed label only, so that late rounds shuffle few labels of others.
        theirs = settled(changed.select(F.col("label.node_id").alias("node_id"), "side")).select(
            F.col("node_id").alias("_of"), F.col("side").alias("_side"), F.col("label").alias("_offer")
        )
        across = changed.join(
            theirs, (F.col("label.node_id") == F.col("_of")) & (F.col("side") == F.col("_side"))
        ).select("node_id", "side", "_offer")
        offers = along.unionByName(across).select("node_id", "side", none.alias("label"), "_offer")
        known = scratch.read(schema, *log).withColumn("_offer", none)
        better = (
            offers.unionByName(known)
            .groupBy("node_id", "side")
            .agg(F.min("label").alias("label"), F.min("_offer").alias("_offer"))
            .filter("_offer < label")
            .select("node_id", "side", F.col("_offer").alias("label"))
        )
        turn, name = turn + 1, f"{label}-{turn + 1}"
        fresh = scratch.write(better, name)["n"]
        log.append(name)
        if len(log) >= FOLDERS:
            scratch.write(settled(), f"{label}-until-{turn}")
            log = [f"{label}-until-{turn}"]
    both = settled().groupBy("node_id").agg(
        F.min(F.when(_side(FORWARD), F.col("label.node_id"))).alias("first"),
        F.min(F.when(_side(BACK), F.col("label.node_id"))).alias("last"),
    )
    # A node with edges on one side only has no label on the other: it is its own.
    own = [F.coalesce(c, "node_id").alias(c) for c in ("first", "last")]
    return scratch.keep(both.select("node_id", *own), f"{label}-found")[0]


def cycle_components(edges: DataFrame) -> DataFrame:
    """``node_id, component`` of the nodes on cycles: two with the same are on one together.

    What hangs before or behind cycles is trimmed first. In each turn every node learns the
    first node, by hash, of those that reach it and of those that it reaches; where both are
    the same, it is in that node's component. Edges between nodes that differ in either lie on no
    cycle: they go, the rest is trimmed, and the next turn has a head for each part that is
    left. Space stays linear in the edges, whatever the core's size.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    id_type = edges.schema["node_id"].dataType
    schema = T.StructType([T.StructField(c, id_type) for c in ("node_id", "component")])
    loop = F.col("node_id") == F.col("depends_on")
    arcs, n = _trim(scratch, _arcs(edges.select("node_id", "depends_on").filter(~loop).distinct()), "trim0")
    found: list[str] = []
    turn = 0
    while n:
        labels = _labels(scratch, arcs, f"labels{turn}")
        same = labels.filter(F.col("first") == F.col("last")).select("node_id", F.col("first").alias("component"))
        shared = same.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        name = f"found-{turn}"
        scratch.write(same.join(shared, "component", "left_semi").select("node_id", "component"), name)
        found.append(name)
        # Of one component and not found yet: both labels alike at either end, but not each other.
        near = labels.filter(F.col("first") != F.col("last")).withColumnRenamed("node_id", "key")
        far = near.select(F.col("key").alias("other"), F.col("first").alias("_first"), F.col("last").alias("_last"))
        rest = arcs.join(near, "key").join(far, "other").filter("first = _first AND last = _last")
        turn += 1
        arcs, n = _trim(scratch, rest.select("key", "other", "side"), f"trim{turn}")
    known = scratch.read(schema, *found)
    alone = edges.filter(loop).select("node_id").distinct().join(known, "node_id", "left_anti")
    return known.unionByName(alone.select("node_id", F.col("node_id").alias("component")))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle (a self-loop is one)."""
    return cycle_components(edges).select("node_id")


# -- one cycle --------------------------------------------------------------------------------


def _distances(scratch: Scratch, steps: DataFrame, start: DataFrame) -> DataFrame:
    """``node_id, distance``: steps from each node of ``steps(node_id, to, weight)`` to ``start``.

    A round writes the nodes that a shorter way was found for; the start stays at 0.
    """
    first = start.select("node_id", F.lit(0).cast("long").alias("distance"))
    schema = first.schema
    names = ["distance-0"]
    fresh = scratch.write(first, names[0])["n"]
    while fresh:
        just = scratch.read(schema, names[-1]).select(F.col("node_id").alias("to"), "distance")
        offers = steps.join(just, "to").select(
            "node_id", (F.col("distance") + F.col("weight")).alias("_offer")
        )
        none = F.lit(None).cast("long")
        known = scratch.read(schema, *names).withColumn("_offer", none)
        better = (
            offers.withColumn("distance", none)
            .unionByName(known)
            .groupBy("node_id")
            .agg(F.min("distance").alias("distance"), F.min("_offer").alias("_offer"))
            .filter("_offer IS NOT NULL AND (distance IS NULL OR _offer < distance)")
            .select("node_id", F.col("_offer").alias("distance"))
        )
        names.append(f"distance-{len(names)}")
        fresh = scratch.write(better, names[-1])["n"]
    return scratch.read(schema, *names).groupBy("node_id").agg(F.min("distance").alias("distance"))


def cycle_rows(edges: DataFrame) -> DataFrame:
    """One cycle as rows ``position, node_id``, from 1, its first node again at the end; or none.

    It starts at the smallest id on any cycle, is as short as possible, and among those the
    first by ids. Runs of nodes with one edge on either side are stepped over at once when
    distances to the start are found. Of each node's dependencies the smallest one that is a
    step nearer becomes its pointer, and doubled pointers lay the walk out: after each round
    twice as many positions are known. No row holds more than one node.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "cycle")
    id_type = edges.schema["node_id"].dataType
    schema = T.StructType(
        [T.StructField("position", T.LongType()), T.StructField("node_id", id_type)]
    )
    parts = cycle_components(edges)
    least = parts.agg(F.min_by(F.struct("node_id", "component"), "node_id").alias("s")).first()["s"]
    if least is None:
        return scratch.read(schema)
    origin = spark.range(1).select(F.lit(least["node_id"]).cast(id_type).alias("node_id"))
    members = parts.filter(F.col("component") == F.lit(least["component"])).select("node_id")
    ahead = members.select(F.col("node_id").alias("depends_on"))
    inner = edges.join(members, "node_id", "left_semi").join(ahead, "depends_on", "left_semi")
    inner, _ = scratch.keep(inner.select("node_id", "depends_on").distinct(), "edges")
    runs = _runs(scratch, inner, origin)
    steps = inner.select("node_id", F.col("depends_on").alias("to"), F.lit(1).cast("long").alias("weight"))
    if runs is not None:
        over = runs.select(
            F.col("node_id").alias("to"), "below", F.col("weight").alias("_weight")
        )
        steps = (
            steps.join(runs.select("node_id"), "node_id", "left_anti")
            .join(over, "to", "left")
            .select(
                "node_id",
                F.coalesce("below", "to").alias("to"),
                (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"),
            )
        )
    steps, _ = scratch.keep(steps, "steps")
    away = _distances(scratch, steps, origin)
    if runs is not None:
        low = away.select(F.col("node_id").alias("below"), "distance")
        inside = runs.join(low, "below").select(
            "node_id", (F.col("distance") + F.col("weight")).alias("distance")
        )
        away = away.unionByName(inside)
    # From the start the shortest way round, from any other node one step nearer.
    near = away.select(F.col("node_id").alias("depends_on"), F.col("distance").alias("_rest"))
    near = inner.join(near, "depends_on")
    round_trip = near.join(origin, "node_id", "left_semi").agg(F.min("_rest") + 1).first()[0]
    goal = F.when(F.col("_start").isNull(), F.col("distance")).otherwise(F.lit(round_trip))
    pointer = (
        near.join(away, "node_id")
        .join(origin.withColumn("_start", F.lit(True)), "node_id", "left")
        .filter(F.col("_rest") + 1 == goal)
        .groupBy("node_id")
        .agg(F.min("depends_on").alias("to"))
    )
    pointer, _ = scratch.keep(pointer, "pointer-1")
    names, reached = ["walk-1"], 1
    scratch.write(origin.select(F.lit(1).cast("long").alias("position"), "node_id"), names[0])
    while reached < round_trip + 1:
        further = (
            scratch.read(schema, *names)
            .join(pointer, "node_id")
            .select((F.col("position") + reached).alias("position"), F.col("to").alias("node_id"))
            .filter(F.col("position") <= round_trip + 1)
        )
        reached *= 2
        names.append(f"walk-{reached}")
        scratch.write(further, names[-1])
        if reached < round_trip + 1:
            twice = pointer.select(F.col("node_id").alias("to"), F.col("to").alias("_to"))
            pointer, _ = scratch.keep(
                pointer.join(twice, "to").select("node_id", F.col("_to").alias("to")), f"pointer-{reached}"
            )
    return scratch.read(schema, *names)


#: Nodes that a cycle may have to be spelled out in one cell.
SPELLED = 1_000


def cycle_path(edges: DataFrame) -> DataFrame:
    """One row ``cycle`` as ``a -> b -> a``, or none: the text of :func:`cycle_rows`.

    A cycle of more than ``SPELLED`` nodes is told by its first two nodes, its length and its
    last step, so that the cell stays bounded; its rows are in :func:`cycle_rows`.
    """
    rows = cycle_rows(edges)
    length = rows.agg(F.max("position")).first()[0] or 0
    shown = F.col("position") > 0
    if length > SPELLED + 1:
        shown = (F.col("position") <= 2) | (F.col("position") >= length - 1)
    listed = F.array_sort(F.collect_list(F.struct("position", F.col("node_id").cast("string").alias("id"))))
    told = rows.filter(shown).agg(listed.alias("listed")).filter("size(listed) > 0")
    ids = F.transform("listed", lambda r: r["id"])
    if length > SPELLED + 1:
        missing = F.array(F.lit(f"... ({length - 4} more) ..."))
        ids = F.concat(F.slice(ids, 1, 2), missing, F.slice(ids, 3, 2))
    return told.select(F.array_join(ids, " -> ").alias("cycle"))
