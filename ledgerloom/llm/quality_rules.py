"""Quality rules: fixed bounds, then robust multivariate outliers for each language and source.

Statistics of whole texts are turned into a vector of logarithms of shares. For each group
of language and source, for each language and for the corpus, the minimum covariance
determinant estimate of location and scatter is found by concentration steps from three starts
around the coordinate-wise medians: plain deviations, the correlations of the rows' directions,
and those of their squashed coordinates. In each step the ``inside`` part of rows nearest by
Mahalanobis distance gives the next mean and covariance; after ``steps`` of them the start whose
scatter has the least determinant is taken. Every step is two aggregations over the written
statistics; a group of any size is combined in each task first, and the driver sees none of it.

A group of n rows has weight n / (n + ``pull``) in its verdict, its language the rest; a language
is mixed with the corpus in the same way. Mean and scatter are those of the mixture, so groups
of every size are judged by one formula.

Scatter gets ``FLOORS`` added on its diagonal, for determinants too, so that a statistic which
most rows share exactly, like no symbols at all, does not reject a row for a trace of it. A row
is rejected whose squared distance passes the chi-square quantile ``tail``.

Defined cases: null text is no words, and fails the base rules. Null language or source is a
value of its own. Repeated rows are judged each. Carried columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import unused
from ledgerloom.llm.textbytes import WordHasher, Words, batches, mix64, salted, utf8
from ledgerloom.scratch import Scratch

#: Bounds of the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_capitals", "n_marks")
#: Coordinates of the vectors, and the least standard deviation of each.
FLOORS = {
    "length": 0.30,
    "word_length": 0.10,
    "symbols": 0.45,
    "dup_lines": 1.20,
    "repeats": 1.00,
    "capitals": 0.25,
    "marks": 0.25,
}
INSIDE = 0.6
STEPS = 4
PULL = 100
#: Probability of a larger distance for a normal row.
TAIL = 1e-5


def statistics(texts: list[bytes], hasher: WordHasher) -> np.ndarray:
    """COUNTS and MORE_COUNTS of each text, a row each."""
    words = Words(hasher, texts)
    data, offsets, n = words.data, words.offsets, len(texts)

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flag)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    chars = per_text(~hasher.space[data] & ((data & 0xC0) != 0x80))
    symbols = np.isin(np.arange(256), list(b"#*$%&|<>"))
    capitals = np.isin(np.arange(256), range(65, 91))
    marks = np.isin(np.arange(256), list(b"!\"'()+,-./:;=?@[\\]^_`{}~"))
    repeated = np.zeros(len(words.hash), dtype=bool)
    if len(words.hash) >= 3:
        factors = salted(3, 21)
        runs = sum(words.hash[k : len(words.hash) - 2 + k] * factors[k] for k in range(3))
        at = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        key = mix64(mix64(runs[at]) + words.doc[at].astype(np.uint64) * salted(1, 22)[0])
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        for k in range(3):
            repeated[again + k] = True
    lines, dup_lines = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts):
        worded = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[i], dup_lines[i] = len(worded), len(worded) - len(set(worded))
    return np.column_stack(
        [
            np.diff(words.first),
            chars,
            per_text(symbols[data]),
            dup_lines,
            np.bincount(words.doc[repeated], minlength=n),
            lines,
            per_text(capitals[data]),
            per_text(marks[data]),
        ]
    ).astype(np.int64)


def vectors(counts: np.ndarray) -> np.ndarray:
    """The transformed statistics of rows of counts."""
    n_words, chars, symbols, dup, repeats, lines, capitals, marks = counts.T.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.column_stack(
            [
                np.log1p(n_words),
                np.log((chars + 1) / (n_words + 1)),
                np.log1p(100 * symbols / np.maximum(chars, 1)),
                np.log1p(100 * dup / np.maximum(lines, 1)),
                np.log1p(100 * repeats / np.maximum(n_words, 1)),
                np.log1p(100 * capitals / np.maximum(chars, 1)),
                np.log1p(100 * marks / np.maximum(chars, 1)),
            ]
        )
    return found


def _measure(carry: Sequence[str], name: str) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for frame in frames:
            texts = utf8(frame.column("text"))
            parts = [statistics(texts[lo:hi], hasher) for lo, hi in batches(texts)]
            counts = np.concatenate(parts) if parts else np.zeros((0, 8), dtype=np.int64)
            coordinates = vectors(counts)
            fields = dict(zip((*COUNTS, *MORE_COUNTS), counts.T)) | dict(zip(FLOORS, coordinates.T))
            stats = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(x)) for x in fields.values()], names=list(fields)
            )
            yield pa.RecordBatch.from_arrays(
                [*[frame.column(c) for c in carry], stats], names=[*carry, name]
            )

    return run


def chi_square_tail(x: float, freedom: int) -> float:
    """Probability that a chi-square variable passes ``x``."""
    a, half = freedom / 2, x / 2
    if half <= 0:
        return 1.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return max(0.0, 1 - total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_square_quantile(tail: float, freedom: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_tail(mid, freedom) > tail else (lo, mid)
    return hi


def _group(*columns: str) -> Column:
    """Number of a group by language and source, by language, or of the corpus."""
    told = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(len(columns)), *told)


def _distance(values: list[Column], mean: str, inverse: str) -> Column:
    """Squared Mahalanobis distance to arrays ``mean`` and, by rows, ``inverse``."""
    off = [x - F.col(mean)[i] for i, x in enumerate(values)]
    p, total = len(off), F.lit(0.0)
    for i in range(p):
        for j in range(i + 1):
            factor = 1.0 if i == j else 2.0
            total = total + off[i] * off[j] * F.col(inverse)[i * p + j] * factor
    return total


TRIANGLE = [(i, j) for i in range(len(FLOORS)) for j in range(i + 1)]


def _square(triangle: np.ndarray) -> np.ndarray:
    """The symmetric matrix of its lower half."""
    p = len(FLOORS)
    full = np.zeros((p, p))
    full[np.tril_indices(p)] = triangle
    return full + np.tril(full, -1).T


def _floored(scatter: np.ndarray) -> np.ndarray:
    return scatter + np.diag(np.array(list(FLOORS.values())) ** 2)


def _estimate(group: int, start: int, mean: np.ndarray, scatter: np.ndarray) -> tuple:
    """A row of ESTIMATE; the determinant is rounded, so that equal ends are ties."""
    full = _floored(scatter)
    least = round(float(np.linalg.slogdet(full)[1]), 9)
    lower = scatter[np.tril_indices(len(mean))]
    return group, start, mean, lower, np.linalg.inv(full).ravel(), least


def _correlation(moments: np.ndarray) -> np.ndarray:
    """Correlations of a covariance, none where a coordinate has no spread."""
    spread = np.sqrt(np.maximum(np.diag(moments), 0))
    scale = np.outer(spread, spread)
    found = np.divide(moments, scale, out=np.zeros_like(moments), where=scale > 1e-12)
    np.fill_diagonal(found, 1.0)
    return found


def starts(
    deviation: np.ndarray, directions: np.ndarray, squashed: np.ndarray, centre: np.ndarray
) -> list[np.ndarray]:
    """Scatters to start from: second moments of directions and squashed rows, their mean."""
    scale = np.outer(deviation, deviation)
    return [
        np.diag(deviation**2),
        scale * _correlation(_square(directions)),
        scale * _correlation(_square(squashed) - np.outer(centre, centre)),
    ]


def _begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            found = starts(row.deviation, row.directions, row.squashed, row.centre)
            rows += [_estimate(row.grp, k, row.mean, s) for k, s in enumerate(found)]
        yield pd.DataFrame(rows, columns=ESTIMATED)


def _invert(scale: float) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                _estimate(row.grp, row.start, row.mean, _square(row.scatter) * scale)
                for row in frame.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=ESTIMATED)

    return run


ESTIMATED = ["grp", "start", "mean", "scatter", "inverse", "least"]
ESTIMATE = (
    "grp long, start int, mean array<double>, scatter array<double>, inverse array<double>, "
    "least double"
)


def inner_scale(inside: float) -> float:
    """What sets the covariance of the inner part of a normal sample right."""
    radius = chi_square_quantile(1 - inside, len(FLOORS))
    return inside / (1 - chi_square_tail(radius, len(FLOORS) + 2))


def _placed(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Rows as offsets ``o0, o1, ...`` from the estimates of their group, with ``distance``.

    Offsets are columns of their own: generated code stays short enough to be compiled.
    """
    more = [c for c in estimate.columns if c not in ("grp", "mean")]
    off = [(F.col(c) - F.col("mean")[i]).alias(f"o{i}") for i, c in enumerate(FLOORS)]
    joined = rows.join(estimate, F.col("group") == F.col("grp")).select("group", *more, *off)
    names = [f"o{i}" for i in range(len(off))]
    total = F.lit(0.0)
    for i, x in enumerate(names):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(names[j]) * F.col("inverse")[i * len(off) + j] * (2 - (i == j))
        total = total + F.col(x) * part
    return joined.withColumn("distance", total).drop("inverse")


def _sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of the offsets within the radius, by group and start.

    The radius is judged here: as a filter it would be pushed into the join, all terms written out.
    """
    rows, columns = np.tril_indices(len(FLOORS))
    for frame in frames:
        near = np.asarray(frame.column("distance")) <= np.asarray(frame.column("radius"))
        if not near.any():
            continue
        group, begun = np.asarray(frame.column("group")), np.asarray(frame.column("start"))
        off = np.column_stack([np.asarray(frame.column(f"o{i}")) for i in range(len(FLOORS))])
        order = np.flatnonzero(near)
        order = order[np.lexsort((begun[order], group[order]))]
        group, begun, off = group[order], begun[order], off[order]
        fresh = (group[1:] != group[:-1]) | (begun[1:] != begun[:-1])
        first = np.concatenate(([0], np.flatnonzero(fresh) + 1))
        each = np.column_stack([np.ones(len(off)), off, off[:, rows] * off[:, columns]])
        totals = np.add.reduceat(each, first)
        arrays = [pa.array(group[first]), pa.array(begun[first], pa.int32())]
        arrays += [pa.array(np.ascontiguousarray(c)) for c in totals.T]
        names = ["group", "start", "inner", *[f"a{i}" for i in range(len(FLOORS))]]
        names += [f"b{i}_{j}" for i, j in TRIANGLE]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def mcd_estimates(
    rows: DataFrame, scratch: Scratch, inside: float = INSIDE, steps: int = STEPS
) -> DataFrame:
    """``(grp, n, mean, scatter)`` for each group of written ``rows(group, *FLOORS)``.

    Rows are joined to their group's estimate and then aggregated by a key that is not the
    join's: where that join shuffles, a hot group's partition can be split.
    """
    names, p = list(FLOORS), len(FLOORS)
    middle = rows.groupBy("group").agg(
        *[F.percentile_approx(c, 0.5, 1000).alias(f"mid_{c}") for c in names],
        F.count(F.lit(1)).alias("n"),
    )
    middle, _ = scratch.keep(middle.withColumnRenamed("group", "grp"), "middle")
    key = F.struct("group").alias("key")
    wide = rows.join(middle, F.col("group") == F.col("grp")).groupBy(key).agg(
        *[
            F.percentile_approx(F.abs(F.col(c) - F.col(f"mid_{c}")), 0.5, 1000).alias(f"dev_{c}")
            for c in names
        ],
    )
    wide = middle.join(wide, F.col("grp") == F.col("key.group")).select(
        "grp",
        F.array(*[f"mid_{c}" for c in names]).alias("mean"),
        F.array(
            *[F.greatest(F.col(f"dev_{c}") * 1.4826, F.lit(FLOORS[c])) for c in names]
        ).alias("deviation"),
    )
    wide, _ = scratch.keep(wide, "spread")
    off = [(F.col(c) - F.col("mean")[i]) / F.col("deviation")[i] for i, c in enumerate(names)]
    apart = rows.join(wide, F.col("group") == F.col("grp")).select(
        "group", *[x.alias(f"z{i}") for i, x in enumerate(off)]
    )
    z = [F.col(f"z{i}") for i in range(p)]
    length = sum((x * x for x in z), F.lit(0.0))
    apart = apart.withColumn("length", length).select(
        "group",
        "length",
        *z,
        *[F.tanh(x).alias(f"t{i}") for i, x in enumerate(z)],
    )
    unit = {
        (i, j): F.when(F.col("length") > 0, z[i] * z[j] / F.col("length")).otherwise(0.0)
        for i, j in TRIANGLE
    }
    begun = apart.groupBy(key).agg(
        F.array(*[F.avg(unit[at]) for at in TRIANGLE]).alias("directions"),
        F.array(*[F.avg(F.col(f"t{i}") * F.col(f"t{j}")) for i, j in TRIANGLE]).alias("squashed"),
        F.array(*[F.avg(f"t{i}") for i in range(p)]).alias("centre"),
    )
    begun = begun.join(wide, F.col("key.group") == F.col("grp")).drop("key")
    estimate, _ = scratch.keep(begun.mapInPandas(_begin, ESTIMATE), "estimate-0")
    for step in range(1, steps + 1):
        last = estimate.select("grp", "start", "mean", "inverse")
        key = F.struct("group", "start").alias("key")
        near = _placed(rows, last).groupBy(key).agg(
            F.percentile_approx("distance", inside, 1000).alias("radius")
        )
        near, _ = scratch.keep(near, f"radius-{step}")
        last = last.join(near, F.struct("grp", "start") == F.col("key")).drop("key")
        # Moments around the last mean, which keeps them small.
        sums = ["inner", *[f"a{i}" for i in range(p)], *[f"b{i}_{j}" for i, j in TRIANGLE]]
        moments = (
            _placed(rows, last)
            .mapInArrow(_sums, "group long, start int, " + ", ".join(f"{c} double" for c in sums))
            .groupBy(key)
            .agg(*[F.sum(c).alias(c) for c in sums])
        )
        first = [F.col(f"a{i}") / F.col("inner") for i in range(p)]
        scatter = last.join(moments, F.struct("grp", "start") == F.col("key")).select(
            "grp",
            "start",
            F.array(*[F.col("mean")[i] + x for i, x in enumerate(first)]).alias("mean"),
            F.array(
                *[F.col(f"b{i}_{j}") / F.col("inner") - first[i] * first[j] for i, j in TRIANGLE]
            ).alias("scatter"),
        )
        estimate, _ = scratch.keep(
            scatter.mapInPandas(_invert(inner_scale(inside)), ESTIMATE), f"estimate-{step}"
        )
    best = estimate.groupBy("grp").agg(
        F.min_by(F.struct("mean", "scatter"), F.struct("least", "start")).alias("best")
    )
    return best.join(middle.select("grp", "n"), "grp").select("grp", "n", "best.*")


def mixture(
    weight: float, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter of ``weight`` parts of one and the rest of the other."""
    apart = one[0] - other[0]
    mean = other[0] + weight * apart
    scatter = weight * one[1] + (1 - weight) * other[1]
    return mean, scatter + weight * (1 - weight) * np.outer(apart, apart)


def _mix(pull: float) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            means, inverses = [], []
            for row in frame.itertuples(index=False):
                own = row.own_mean, _square(row.own_scatter)
                whole = row.whole_mean, _square(row.whole_scatter)
                every = row.every_mean, _square(row.every_scatter)
                whole = mixture(row.whole_n / (row.whole_n + pull), whole, every)
                mean, scatter = mixture(row.own_n / (row.own_n + pull), own, whole)
                means.append(mean)
                inverses.append(np.linalg.inv(_floored(scatter)).ravel())
            yield pd.DataFrame(
                {
                    "g_lang": frame["g_lang"],
                    "g_source": frame["g_source"],
                    "mean": means,
                    "inverse": inverses,
                }
            )

    return run


def judge(
    docs: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    inside: float = INSIDE,
    pull: float = PULL,
    tail: float = TAIL,
) -> DataFrame:
    """Each row's ``carry`` columns, then COUNTS, ``base_failed``, ``distance`` and ``kept``.

    Where a carried column has one of these names, the new one gets underscores behind it.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    own = ("group", "lang", "source", *COUNTS, *FLOORS, "base_failed", "distance", "kept")
    names = unused(docs.select(*carry), *own, "stats", "grp", "mean", "inverse")
    needed = list(dict.fromkeys([*carry, "text", "lang", "source"]))
    out = [f for f in docs.select(*needed).schema if f.name in carry or f.name in ("lang", "source")]
    kinds = {c: T.LongType() for c in (*COUNTS, *MORE_COUNTS)} | {c: T.DoubleType() for c in FLOORS}
    stats = T.StructType([T.StructField(c, k) for c, k in kinds.items()])
    schema = T.StructType([*out, T.StructField(names["stats"], stats)])
    measured, _ = scratch.keep(
        docs.select(*needed).mapInArrow(
            _measure([f.name for f in out], names["stats"]), schema
        ),
        "stats",
    )
    s = F.col(names["stats"])
    failed = (s["n_words"] < LEAST_WORDS) | (
        100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"]
    )
    sound = measured.filter(~failed).select(
        "lang", "source", *[s[c].alias(c) for c in FLOORS]
    )
    ways = {"own": ("lang", "source"), "whole": ("lang",), "every": ()}
    rows = sound.select(
        F.explode(F.array(*[_group(*w) for w in ways.values()])).alias("group"), *FLOORS
    )
    rows, _ = scratch.keep(rows, "vectors")
    estimate, _ = scratch.keep(mcd_estimates(rows, scratch, inside), "estimates")
    mixed = sound.select("lang", "source").distinct()
    for name, way in ways.items():
        found = estimate.select(
            *[F.col(c).alias(f"{name}_{c}") for c in ("grp", "n", "mean", "scatter")]
        )
        mixed = mixed.join(found, _group(*way) == F.col(f"{name}_grp")).drop(f"{name}_grp")
    mixed = mixed.withColumnsRenamed({c: f"g_{c}" for c in ("lang", "source")})
    kinds = {f.name: f.dataType.simpleString() for f in sound.schema}
    verdicts, _ = scratch.keep(
        mixed.mapInPandas(
            _mix(pull),
            f"g_lang {kinds['lang']}, g_source {kinds['source']}, "
            "mean array<double>, inverse array<double>",
        ),
        "verdicts",
    )
    verdicts = verdicts.select(
        *[F.col(c).alias(f"_rules_{c}") for c in ("g_lang", "g_source", "mean", "inverse")]
    )
    judged = measured.join(
        verdicts,
        measured["lang"].eqNullSafe(F.col("_rules_g_lang"))
        & measured["source"].eqNullSafe(F.col("_rules_g_source")),
        "left",
    )
    limit = chi_square_quantile(tail, len(FLOORS))
    distance = _distance([s[c] for c in FLOORS], "_rules_mean", "_rules_inverse")
    return judged.select(
        *carry,
        *[s[c].alias(names[c]) for c in COUNTS],
        failed.alias(names["base_failed"]),
        distance.alias(names["distance"]),
        (~failed & F.coalesce(distance <= limit, F.lit(True))).alias(names["kept"]),
    )


def passing_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    kept = unused(docs, "kept")["kept"]
    return judge(docs, docs.columns, **options).filter(kept).select(*docs.columns)
