"""Distributed helpers of several operators: running sums, components, written steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch

#: A word of the query contracts: a longest run without the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> dict[str, str]:
    """Each name as it is, or with underscores behind it where ``df`` has it already."""
    taken, found = {c.lower() for c in df.columns}, {}
    for name in names:
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        found[name] = free
    return found


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: each word with its spaces shrinks to one character."""
    shrunk = F.regexp_replace(text, f"{SPACE}*{WORD}{SPACE}*", "x")
    return F.coalesce(
        F.when(text.rlike(WORD), F.length(shrunk)).otherwise(0), F.lit(0)
    ).cast("long")


def running_sum(
    scratch: Scratch, df: DataFrame, name: str, group: str, order: list[Column], value: str
) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over earlier rows of ``group``.

    ``order`` sorts within the group. Rows are dealt by range, so a group of any size spreads
    over many tasks; a range's rows are summed on their own and take the total of the ranges
    before it. ``value`` must not be null.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, F.col(group), *order)
    dealt, _ = scratch.keep(dealt.withColumn("_range", F.spark_partition_id()), name)
    totals = dealt.groupBy(group, "_range").agg(F.sum(value).alias("_total"))
    ahead = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(group).alias("_group"),
        F.col("_range").alias("_part"),
        F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(group, "_range").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        summed.join(
            starts,
            (F.col("_range") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")),
        )
        .withColumn("before", F.col("_start") + F.col("_inside"))
        .drop("_range", "_part", "_group", "_start", "_inside")
    )


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges(a, b)``: the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of
    that label, which halves long paths. A round is one written table.
    """
    both, n = scratch.keep(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct(),
        f"{name}-edges",
    )
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    labels, _ = scratch.keep(
        least.select("node", F.least("node", "least").alias("component")), f"{name}-0"
    )
    turn, changed = 0, n
    while changed:
        turn += 1
        seen = both.join(
            labels.select(F.col("node").alias("other"), F.col("component").alias("theirs")),
            "other",
        )
        offered = seen.groupBy("node").agg(F.min("theirs").alias("offer"))
        lower = labels.join(offered, "node").select(
            "node", "component", F.least("component", "offer").alias("lower")
        )
        target = labels.select(F.col("node").alias("lower"), F.col("component").alias("jump"))
        stepped = lower.join(target, "lower").select(
            "node", F.least("lower", "jump").alias("component"), F.col("component").alias("was")
        )
        file = f"{name}-{turn}"
        moved = F.count(F.when(F.col("component") != F.col("was"), 1))
        changed = scratch.write(stepped, file, moved=moved)["moved"]
        labels = scratch.read(stepped.schema, file).select("node", "component")
    return labels
