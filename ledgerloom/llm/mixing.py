"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a size in words and a target in words. A source is taken as many whole times
as fit into its target (complete epochs); the rest of the target is filled with single
documents in the order of their keys, which is weighted sampling without replacement: with
``u`` uniform from a hash of doc_id and ``q`` the document's quality weight, the key is
``-ln(u) / q``, and the smallest keys come first. Prefix sums over this order are compared
with the rest. The document that the rest ends in is taken if at least half of it fits.

Targets share the words of all documents by weight. No target exceeds ``most`` times its
source's size: the level ``x`` with ``sum(min(most * size, x * weight)) = all words`` is found by
resharing the excess until none is above.

Defined cases: null texts have size 0 and quality weight 1. A null source is a source of its
own and comes last. Sources of no words have target 0. Rows are drawn each on their own, also
repeated ones; ties of keys go by doc_id (null first), then size. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import running_sum, unused, word_count
from ledgerloom.scratch import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = "mix-1"


def quality_weight(text: Column) -> Column:
    """Share of ASCII small letters, from near 0 to 1."""
    small = F.length(F.regexp_replace(text, "[^a-z]+", ""))
    return F.coalesce((small + 1) / (F.length(text) + 1), F.lit(1.0))


def sampling_key(doc_id: Column, quality: Column, seed: str = SEED) -> Column:
    """Exponential key of rate ``quality``; the same for the same id and seed."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return -F.log(uniform) / quality


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, weight, target)`` of written ``sources(source, source_size)``.

    Weights repeat in the order of source. The driver holds two sums of a round.
    """
    scratch = Scratch(sources.sparkSession, "targets")
    ordered = sources.select(
        "source", "source_size", F.lit(0).alias("all"), F.lit(1).cast("long").alias("one")
    )
    ranked = running_sum(
        scratch, ordered, "ranks", "all", [F.col("source").asc_nulls_last()], "one"
    )
    cycle = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int")
    )
    weighted, _ = scratch.keep(
        ranked.select(
            "source",
            "source_size",
            cycle.alias("weight"),
            (F.col("source_size") * F.lit(float(most))).alias("ceiling"),
        ),
        "weighted",
    )
    level, above = 0.0, True
    while above:
        capped = F.col("ceiling") <= F.lit(level) * F.col("weight")
        sums = weighted.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(capped, F.col("ceiling")).otherwise(0.0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not sums["words"] or not sums["open"]:
            break
        risen = (sums["words"] - sums["held"]) / sums["open"]
        above, level = risen > level, max(level, risen)
    return weighted.select(
        "source",
        "source_size",
        "weight",
        F.least("ceiling", F.lit(level) * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
    row: str | None = None,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, repeats, taken)`` for each row of ``docs``.

    ``row`` names a column to carry along, so that a caller finds its rows again.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    carried = [F.col(row).alias("row")] if row else []
    sized = docs.select(
        *carried,
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        sampling_key(F.col("doc_id"), quality_weight(F.col("text")), seed).alias("key"),
    )
    sized, _ = scratch.keep(sized, "sized")
    sources, _ = scratch.keep(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"
    )
    aims, _ = scratch.keep(targets(sources, weights, most).drop("weight"), "aims")
    order = [F.col(c) for c in ("key", "doc_id", "size", *(["row"] if row else []))]
    placed = running_sum(scratch, sized, "sorted", "source", order, "size")
    aims = aims.withColumnRenamed("source", "aimed")
    joined = placed.join(aims, placed["source"].eqNullSafe(aims["aimed"])).drop("aimed")
    epochs = F.when(
        F.col("source_size") > 0,
        F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)),
    ).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size") - F.col("before")
    partly = (F.col("epochs") < most) & (F.col("size") > 0) & (2 * rest >= F.col("size"))
    return (
        joined.withColumn("epochs", epochs.cast("long"))
        .withColumn("repeats", F.col("epochs") + F.when(partly, 1).otherwise(0).cast("long"))
        .withColumn(
            "repeats", F.when(F.col("size") > 0, F.col("repeats")).otherwise(0).cast("long")
        )
        .select(
            *(["row"] if row else []),
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "repeats",
            (F.col("size") * F.col("repeats")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them."""
    scratch = Scratch(docs.sparkSession, "mixed")
    names = unused(docs, "row", "times", "turn")
    row = names["row"]
    numbered, _ = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = (
        mix(numbered, row=row, **options)
        .filter("repeats > 0")
        .select(F.col("row").alias(row), F.col("repeats").alias(names["times"]))
    )
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["times"])))
    return numbered.join(taken, row).withColumn(names["turn"], times).select(*docs.columns)
