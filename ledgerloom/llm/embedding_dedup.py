"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector the signs of its projections on 64 random directions, as one word of
bits, and sorts the vectors of a label by it. A vector is compared with the next ``window``
in that order by cosine in double precision. Pairs that reach the threshold are united over
all passes. Vectors are projected without their label's mean, as a direction that a label has
in common splits nothing; cosines are of the vectors as they are.

The number of passes follows from the recall asked for. Two vectors at the threshold share
their first b bits, which brings them into one window, with probability ``agree ** b``. The
first passes take b from the size of the largest label, as if each bit halved it, and measure
the b that each vector really needs: one bit more than it shares with the unlinked vectors a
window away. A label whose densest place needs more passes gets them; where these would
compare more pairs than the label has, all of its pairs are compared.

A window bounds the neighbours, not the links. Vectors of a dense group find their component
through near ones; then all pairs inside each component are compared in blocks, which counts
every link of it. Equal vectors are one vector with a multiplicity throughout.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows
without label or vec_id, link with nothing: n_links 0, component_id = vec_id, kept. Vectors of
different lengths do not link. Each row gives a row; repeated rows link with each other. Extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, running_sum
from ledgerloom.scratch import Scratch

THRESHOLD = 0.93
WINDOW = 64
RECALL = 0.999
BLOCK = 1024
MEMBERS = 512
BITS = 64


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes that bring a pair at the threshold into one window with the given probability."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(0.0, math.log2(max(1.0, n / window)))
    once = min(agree**bits, 1 - 1e-9)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = rows.reshape(len(column), -1)
    # Scaled first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by cell, one for each batch."""
    for frame in frames:
        sizes = np.asarray(frame.column("size"))
        for size in np.unique(sizes):
            part = frame.take(pa.array(np.flatnonzero(sizes == size)))
            cells, inverse = np.unique(np.asarray(part.column("cell")), return_inverse=True)
            total = np.zeros((len(cells), size))
            np.add.at(total, inverse, unit_rows(part.column("embedding")))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cells),
                    pa.array(np.bincount(inverse).astype(np.int64)),
                    pa.array(list(total), pa.list_(pa.float64())),
                ],
                names=["cell", "n", "total"],
            )


def _mean(table: pa.Table) -> pa.Table:
    total = np.array(table.column("total").to_pylist()).sum(axis=0)
    n = int(np.asarray(table.column("n")).sum())
    return pa.table(
        {
            "cell": table.column("cell").slice(0, 1),
            "n": pa.array([n]),
            "mean": pa.array([total / n], pa.list_(pa.float64())),
        }
    )


def _project(threshold: float) -> Callable:
    """The bits of passes ``since`` to ``until``, and how often a bit agrees at the threshold."""
    apart = math.sqrt(max(0.0, 2 - 2 * threshold))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))[None, :]
        for frame in frames:
            sizes = np.asarray(frame.column("size"))
            for size in np.unique(sizes):
                chosen = np.flatnonzero(sizes == size)
                for lo in range(0, len(chosen), 1000):
                    part = frame.take(pa.array(chosen[lo : lo + 1000]))
                    rows = unit_rows(part.column("embedding"))
                    rows -= np.asarray(part.column("mean").flatten()).reshape(rows.shape)
                    radius = np.maximum(np.sqrt((rows * rows).sum(axis=1)), apart / 2)
                    radius = np.maximum(radius, 1e-12)
                    agree = 1 - 2 * np.arcsin(apart / (2 * radius)) / math.pi
                    until = np.asarray(part.column("until"))
                    for turn in range(int(np.asarray(part.column("since")).min()), int(until.max())):
                        draw = np.random.default_rng((int(size), turn))
                        at = np.flatnonzero(turn < until)
                        signs = rows[at] @ draw.standard_normal((size, BITS)) >= 0
                        words = (signs * weights).sum(1, dtype=np.uint64)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(at), turn), pa.int32()),
                                part.column("cell").take(pa.array(at)),
                                pa.array((words ^ np.uint64(1 << 63)).view(np.int64)),
                                part.column("key").take(pa.array(at)),
                                pa.array(agree[at]),
                            ],
                            names=["pass", "cell", "bits", "key", "agree"],
                        )

    return run


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """As many of the links as keep the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a, b):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            kept.append((x, y))
    return kept


def shared_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many of their first bits two words have in common."""
    rest = left.view(np.uint64) ^ right.view(np.uint64)
    # Halves are exact as doubles; frexp gives the length of a whole number.
    high, low = (rest >> np.uint64(32)).astype(float), (rest & np.uint64(0xFFFFFFFF)).astype(float)
    length = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    return BITS - length


def _window_links(threshold: float, window: int) -> Callable:
    """Links ``(a, b)``; and for a vector ``a`` the bits that it shares with an unlinked one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        key, cell = np.asarray(table.column("key")), np.asarray(table.column("cell"))
        own = np.asarray(table.column("own"))
        bits, agree = np.asarray(table.column("bits")), np.asarray(table.column("agree"))
        links: list[tuple[int, int]] = []
        crowd: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = np.asarray(table.column("size"))
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            rows = unit_rows(table.column("embedding").take(pa.array(at)).combine_chunks())
            a: list[int] = []
            b: list[int] = []
            for step in range(1, min(window, len(at) - 1) + 1):
                cosine = np.einsum("ij,ij->i", rows[:-step], rows[step:])
                i, j = at[:-step], at[step:]
                hit = (cosine >= threshold) & (cell[i] == cell[j]) & own[i] & (j - i <= window)
                a += key[i[hit]].tolist()
                b += key[j[hit]].tolist()
                if step == window:
                    far = (cosine < threshold) & (cell[i] == cell[j]) & own[i] & (j - i == window)
                    shared = shared_bits(bits[i[far]], bits[j[far]])
                    crowd += [(key[x[far]], shared, agree[x[far]]) for x in (i, j)]
            links += _forest(a, b)
        n = sum(len(x) for x, _, _ in crowd)
        return pa.table(
            {
                "a": pa.array(
                    np.concatenate(
                        [np.array([x for x, _ in links], np.int64), *[k for k, _, _ in crowd]]
                    )
                ),
                "b": pa.array([y for _, y in links] + [None] * n, pa.int64()),
                "pass": pa.array([table.column("pass")[0].as_py()] * (len(links) + n), pa.int32()),
                "shared": pa.array(
                    np.concatenate([np.zeros(len(links)), *[s for _, s, _ in crowd]]).astype(np.int32)
                ),
                "agree": pa.array(
                    np.concatenate([np.ones(len(links)), *[g for _, _, g in crowd]])
                ),
            }
        )

    return run


def _block_links(threshold: float) -> Callable:
    """Links between two blocks of a label, as many as keep the same components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, key = np.asarray(table.column("side")), np.asarray(table.column("key"))
        rows = unit_rows(table.column("embedding").combine_chunks())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        i, j = np.nonzero(rows[left] @ rows[right].T >= threshold)
        a, b = key[left[i]], key[right[j]]
        links = _forest(a[a != b].tolist(), b[a != b].tolist())
        return pa.table(
            {
                "a": pa.array([x for x, _ in links], pa.int64()),
                "b": pa.array([y for _, y in links], pa.int64()),
            }
        )

    return run


def _paired(scratch: Scratch, rows: DataFrame, group: str, name: str, *columns: str) -> DataFrame:
    """Every pair ``(lo, hi)`` of blocks of a group; side 2: both blocks are the same."""
    ranked = running_sum(
        scratch,
        rows.withColumn("one", F.lit(1).cast("long")),
        name,
        group,
        [F.col("key")],
        "one",
    ).withColumn("block", F.floor(F.col("before") / MEMBERS))
    ranked, _ = scratch.keep(ranked, f"{name}-ranked")
    last = ranked.groupBy(group).agg(F.max("block").alias("last"))
    paired = ranked.join(last, group).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    )
    return paired.select(
        group,
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
        F.when(F.col("block") == F.col("other"), 2)
        .when(F.col("block") < F.col("other"), 0)
        .otherwise(1)
        .alias("side"),
        "key",
        *columns,
        "embedding",
    )


def _count_links(threshold: float) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = np.asarray(table.column("side"))
        key, times = np.asarray(table.column("key")), np.asarray(table.column("times"))
        rows = unit_rows(table.column("embedding").combine_chunks())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        linked = rows[left] @ rows[right].T >= threshold
        linked &= key[left][:, None] != key[right][None, :]
        counts = linked @ times[right]
        keys = key[left]
        if (side == 1).any():  # two different blocks: the other way round as well
            counts = np.concatenate((counts, linked.T @ times[left]))
            keys = np.concatenate((keys, key[right]))
        return pa.table({"key": keys, "links": pa.array(counts.astype(np.int64))})

    return run


def _passes(
    scratch: Scratch, distinct: DataFrame, cells: DataFrame, name: str, threshold: float, window: int
) -> DataFrame:
    """What ``_window_links`` finds in the passes of ``cells(cell, mean, since, until)``."""
    projected = (
        distinct.join(cells.select("cell", "mean", "since", "until"), "cell")
        .select("cell", "size", "key", "embedding", "mean", "since", "until")
        .mapInArrow(
            _project(threshold), "pass int, cell long, bits long, key long, agree double"
        )
    )
    ordered = running_sum(
        scratch,
        projected.withColumn("one", F.lit(1).cast("long")),
        f"sorted-{name}",
        "pass",
        [F.col("cell"), F.col("bits"), F.col("key")],
        "one",
    ).withColumnRenamed("before", "place")
    block = F.floor(F.col("place") / BLOCK)
    # A block also gets the first rows of the next, as neighbours of its own last ones.
    seats = F.when(
        (F.col("place") % BLOCK < window) & (block > 0), F.array(block, block - 1)
    ).otherwise(F.array(block))
    seated = ordered.select(
        "pass", "cell", "key", "bits", "agree", "place", F.explode(seats).alias("block")
    )
    filled = seated.join(distinct.select("key", "size", "embedding"), "key").withColumn(
        "own", F.floor(F.col("place") / BLOCK) == F.col("block")
    )
    found = filled.groupBy("pass", "block").applyInArrow(
        _window_links(threshold, window), "a long, b long, pass int, shared int, agree double"
    )
    return scratch.keep(found, f"found-{name}")[0]


def _needed(crowd: DataFrame, n_passes: int, recall: float) -> DataFrame:
    """``(key, needed)``: passes that find a partner at the threshold with the given probability.

    A pass in which nothing unlinked stands a window away finds all partners.
    """
    once = crowd.groupBy(F.col("a").alias("key"), "pass").agg(
        F.pow(F.max("agree"), F.max("shared") + 1).alias("once")
    )
    mean = once.groupBy("key").agg(
        ((F.sum("once") + n_passes - F.count(F.lit(1))) / n_passes).alias("once")
    )
    held = F.least(F.greatest("once", F.lit(1e-8)), F.lit(1 - 1e-9))
    return mean.select(
        "key", F.ceil(F.lit(math.log(1 - recall)) / F.log1p(-held)).alias("needed")
    )


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    window: int = WINDOW,
    recall: float = RECALL,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(
            F.forall(
                "embedding",
                lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
            )
            & F.exists("embedding", lambda x: x != 0),
            F.lit(False),
        )
    )
    rows = vectors.select("vec_id", "label", "embedding")
    distinct = (
        rows.filter(usable)
        .groupBy("label", "embedding")
        .agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least_id"))
        .select(
            F.monotonically_increasing_id().alias("key"),
            F.xxhash64(F.col("label"), F.size("embedding")).alias("cell"),
            F.size("embedding").alias("size"),
            "*",
        )
    )
    distinct, _ = scratch.keep(distinct, "distinct")
    means = distinct.select("cell", "size", "embedding").mapInArrow(
        _sums, "cell long, n long, total array<double>"
    )
    cells, _ = scratch.keep(
        means.groupBy("cell").applyInArrow(_mean, "cell long, n long, mean array<double>"), "cells"
    )
    largest = cells.agg(F.max("n")).first()[0] or 1
    n_passes = passes_for(largest, threshold, window, recall)
    first = cells.select(
        "cell", "mean", F.lit(0).alias("since"), F.lit(n_passes).alias("until")
    )
    found = _passes(scratch, distinct, first, "first", threshold, window)
    links = found.filter("b is not null").select("a", "b")
    links, _ = scratch.keep(links.distinct(), "links-first")

    needs = _needed(found.filter("b is null"), n_passes, recall)
    needs = needs.join(distinct.select("key", "cell"), "key")
    needs = needs.groupBy("cell").agg(F.max("needed").alias("needed"))
    crowded, n_crowded = scratch.keep(
        cells.join(needs, "cell")
        .filter(F.col("needed") > n_passes)
        .select(
            "cell",
            "mean",
            F.lit(n_passes).alias("since"),
            F.col("needed").cast("int").alias("until"),
            (F.col("needed") * (2 * window) >= F.col("n")).alias("all_pairs"),
        ),
        "crowded",
    )
    if n_crowded:
        more = _passes(scratch, distinct, crowded.filter("not all_pairs"), "more", threshold, window)
        whole = distinct.join(crowded.filter("all_pairs").select("cell"), "cell")
        blocks = _paired(scratch, whole.select("cell", "key", "embedding"), "cell", "whole")
        blocks = blocks.repartition("cell", "lo", "hi")
        compared = blocks.groupBy("cell", "lo", "hi").applyInArrow(
            _block_links(threshold), "a long, b long"
        )
        links = links.unionByName(more.filter("b is not null").select("a", "b"))
        links, _ = scratch.keep(links.unionByName(compared).distinct(), "links")
    labels = components(scratch, links, "components")

    grouped = distinct.join(
        labels.withColumnRenamed("node", "key"), "key"
    ).select("key", "component", "times", "embedding")
    paired = _paired(scratch, grouped, "component", "members", "times")
    paired = paired.repartition("component", "lo", "hi")
    counted = paired.groupBy("component", "lo", "hi").applyInArrow(
        _count_links(threshold), "key long, links long"
    )
    sums = counted.groupBy("key").agg(F.sum("links").alias("links"))
    of_key = (
        distinct.select("key", "label", "embedding", "times", "least_id")
        .join(labels.withColumnRenamed("node", "key"), "key", "left")
        .join(sums, "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    of_key, _ = scratch.keep(of_key, "of_key")
    least = of_key.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = of_key.join(least, "component").select(
        F.col("label").alias("own_label"),
        F.col("embedding").alias("own_embedding"),
        (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id",
    )
    joined = rows.filter(usable).join(
        found,
        (F.col("label") == F.col("own_label")) & (F.col("embedding") == F.col("own_embedding")),
    )
    alone = rows.filter(~usable).select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    return joined.select(
        "vec_id",
        "n_links",
        "component_id",
        (F.col("vec_id") == F.col("component_id")).alias("kept"),
    ).unionByName(alone)
