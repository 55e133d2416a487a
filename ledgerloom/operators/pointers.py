"""Pointer doubling: where chains of single steps end, in rounds logarithmic in their length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch


@dataclass
class Followed:
    """``ends``: ``node_id, to, weight, floor`` of pointers that lead to a node without one.

    ``endless``: ``node_id, least`` of those that run into a ring, or ``None``; ``least`` is the
    smallest id on the way, the same for all nodes of a ring.
    """

    ends: DataFrame
    endless: DataFrame | None
    rounds: int


def follow(scratch: Scratch, pointers: DataFrame, name: str) -> Followed:
    """Follow ``pointers(node_id, to, weight, floor)``, one row a node, to their ends.

    A step composes two pointers: weights add up, and the floor is the larger of one's own and
    the other's moved by one's weight, so that ``max(floor, value of to + weight)`` is the value
    of a node. Each round doubles the steps that a row stands for and writes only rows that
    had not arrived. When a round neither lets a row arrive nor finds a smaller id, the rest
    runs in rings.
    """
    first = pointers.select(
        "node_id",
        "to",
        F.col("weight").cast("long").alias("weight"),
        F.col("floor").cast("long").alias("floor"),
        F.least("node_id", "to").alias("least"),
    )
    sources = pointers.select(F.col("node_id").alias("to"), F.lit(True).alias("_on"))
    first = first.join(sources, "to", "left").select(
        *first.columns, F.col("_on").isNull().alias("done"), F.lit(True).alias("moved")
    )
    schema = first.schema
    files = [f"{name}-0"]
    still = scratch.write(first, files[0], still=F.count_if(~F.col("done")))["still"]
    while still:
        under_way = scratch.read(schema, files[-1]).filter("NOT done")
        ahead = scratch.read(schema, *files).filter("done").unionByName(under_way)
        ahead = ahead.select(*[F.col(c).alias(f"_{c}") for c in ahead.columns])
        step = under_way.join(ahead, F.col("to") == F.col("_node_id")).select(
            "node_id",
            F.col("_to").alias("to"),
            (F.col("weight") + F.col("_weight")).alias("weight"),
            F.greatest("floor", F.col("_floor") + F.col("weight")).alias("floor"),
            F.least("least", "_least").alias("least"),
            F.col("_done").alias("done"),
            (F.col("_least") < F.col("least")).alias("moved"),
        )
        files.append(f"{name}-{len(files)}")
        counts = scratch.write(
            step,
            files[-1],
            still=F.count_if(~F.col("done")),
            moved=F.count_if(~F.col("done") & F.col("moved")),
        )
        before, still = still, counts["still"]
        if still == before and not counts["moved"]:
            break
    rows = scratch.read(schema, *files)
    ends = rows.filter("done").select("node_id", "to", "weight", "floor")
    endless = None
    if still:
        endless = scratch.read(schema, files[-1]).filter("NOT done").select("node_id", "least")
    return Followed(ends, endless, len(files))
