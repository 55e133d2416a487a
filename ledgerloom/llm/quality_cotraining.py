"""Quality scores by co-training of a text view and a metadata view.

The text view reads how a text is written: shares of its bytes, of repeated words, lengths.
The metadata view reads language, source and length. Both start from labelled rows. In each
of ``ROUNDS`` rounds all unlabelled rows are scored, and each view gives the other those that it is
surest of, at most ``SHARE`` of them and ``GIVEN`` rows for either answer, with its own answer as
their label; ties go by hash of doc_id. Then each view is
calibrated on labelled rows that it did not see (out-of-fold), and a last model of both
calibrated log-odds scores all documents, whole.

Bound: at most ``SAMPLE`` labelled rows of either answer, those of the smallest hash of doc_id. A sampled labelled row counts as many times as rows of its answer stand
for it, so that the answers have their shares of all labelled rows.

Defined cases: null text is the empty text; null metadata are values of their own. A doc_id
with several labels counts as good only if all are; null labels do not count. Without labels
of both kinds the score is the prior. Repeated rows give a row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.linear import (
    fit_logistic,
    hashed_fold,
    label_counts,
    logit,
    predict,
    row_times,
    sample_rows,
    texts_of,
)
from ledgerloom.llm.textbytes import WordHasher, Words, batches, mix64, utf8
from ledgerloom.scratch import Scratch

SAMPLE = 3000
GIVEN = 80
ROUNDS = 3
SHARE = 0.02
FOLDS = 2
BUCKETS = 48
WIDTHS = {"content": 260, "metadata": 2 * BUCKETS + 24}
COLUMNS = ("text", "lang", "source", "n_chars")


class Views:
    """Content and metadata vectors of a batch."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def content(self, texts: list[bytes]) -> np.ndarray:
        words = Words(self.hasher, texts)
        n = len(texts)
        owner = np.repeat(np.arange(n), np.diff(words.offsets))
        cells = np.bincount(owner * 256 + words.data, minlength=n * 256).reshape(n, 256)
        size = np.maximum(1, cells.sum(axis=1, keepdims=True))
        n_words = np.diff(words.first)
        mixed = mix64(words.hash) ^ (words.doc.astype(np.uint64) << np.uint64(40))
        _, first = np.unique(mixed, return_index=True)
        distinct = np.bincount(words.doc[first], minlength=n)
        shape = np.column_stack(
            [
                np.log1p(n_words) / 5,
                distinct / np.maximum(1, n_words),
                size[:, 0] / np.maximum(1, n_words) / 10,
                np.minimum(cells[:, 10] / np.maximum(1, n_words), 1),
            ]
        )
        return np.column_stack([np.sqrt(cells / size) * 4, shape])

    @staticmethod
    def metadata(lang: list, source: list, n_chars: list) -> np.ndarray:
        x = np.zeros((len(lang), 2 * BUCKETS + 24))
        for column, (values, base) in enumerate(((lang, 0), (source, BUCKETS))):
            codes = [sum(ord(c) * 131**i for i, c in enumerate(v or "\0")) for v in values]
            spread = mix64(np.array([c % 2**61 for c in codes], dtype=np.uint64))
            x[np.arange(len(lang)), base + (spread % np.uint64(BUCKETS)).astype(int)] = 1
        length = [0 if v is None else 1 + min(22, max(0, int(v)).bit_length()) for v in n_chars]
        x[np.arange(len(lang)), 2 * BUCKETS + np.array(length, dtype=int)] = 1
        return x

    def __call__(self, frame: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        texts = utf8(frame.column("text"))
        others = [frame.column(c).to_pylist() for c in COLUMNS[1:]]
        for lo, hi in batches(texts):
            yield lo, hi, self.content(texts[lo:hi]), self.metadata(*[o[lo:hi] for o in others])


def _sampled(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    views = Views()
    for frame in frames:
        for lo, hi, content, metadata in views(frame):
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column("doc_id").slice(lo, hi - lo),
                    frame.column("good").slice(lo, hi - lo),
                    pa.array(list(content.astype(np.float32)), pa.list_(pa.float32())),
                    pa.array(list(metadata.astype(np.float32)), pa.list_(pa.float32())),
                ],
                names=["doc_id", "good", "content", "metadata"],
            )


class Training:
    """Co-training of both views from some labelled rows."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, times: np.ndarray):
        self.taught = [(v, y, times) for v in views]
        #: For each view the rows that the other gave it.
        self.given: list[set[int]] = [set(), set()]
        self.open = len(y) > 0 and 0 < y.mean() < 1
        self.fit()

    def fit(self) -> None:
        self.models = [fit_logistic(x, t, times=n) for x, t, n in self.taught]

    def take(self, view: int, ids: list[int], x: np.ndarray, answers: np.ndarray) -> None:
        """Rows for a view, with the other's answers."""
        old, t, n = self.taught[view]
        self.given[view].update(ids)
        self.taught[view] = (
            np.concatenate([old, x]),
            np.concatenate([t, answers]),
            np.concatenate([n, np.ones(len(ids))]),
        )


def _surest(trainings: list[tuple[list[np.ndarray], list[list[int]]]], most: int) -> Callable:
    """A task's ``most`` surest rows for each training, view and answer; group tells which."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, ...]] = {}
        for frame in frames:
            ids, order = np.asarray(frame.column("doc_id")), np.asarray(frame.column("at"))
            x = [
                np.asarray(frame.column(c).flatten(), dtype=np.float32).reshape(len(ids), w)
                for c, w in WIDTHS.items()
            ]
            for g, (models, given) in enumerate(trainings):
                for k in range(2):
                    p = predict(models[k], x[k])
                    free = ~np.isin(ids, given[1 - k])
                    for answer, sure in ((0, 1 - p), (1, p)):
                        able = np.flatnonzero(free & (sure > 0.95))
                        if not len(able):
                            continue
                        group = 4 * g + 2 * k + answer
                        found = (sure[able], order[able], ids[able], x[1 - k][able])
                        if group in held:
                            found = tuple(map(np.concatenate, zip(held[group], found)))
                        best = np.lexsort((found[2], found[1], -found[0]))
                        # Rows of one doc_id are one: the surest of them.
                        best = best[np.sort(np.unique(found[2][best], return_index=True)[1])]
                        held[group] = tuple(f[best[:most]] for f in found)
        for group, (sure, order, ids, x) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), group), pa.int32()),
                    pa.array(sure),
                    pa.array(order),
                    pa.array(ids),
                    pa.array(list(x), pa.list_(pa.float32())),
                ],
                names=["group", "sure", "at", "doc_id", "x"],
            )

    return run


def surest_rows(
    scratch: Scratch, pool: DataFrame, trainings: list[Training], most: int, name: str
) -> pa.Table:
    """``(group, doc_id, x)``: the ``most`` surest rows of the whole pool in each group, in order."""
    known = [(t.models, [sorted(g) for g in t.given]) for t in trainings]
    found, _ = scratch.keep(
        pool.mapInArrow(
            _surest(known, most),
            "group int, sure double, at long, doc_id long, x array<float>",
        ),
        name,
    )
    # Vectors stay behind until the rows are chosen.
    once = found.groupBy("group", "doc_id").agg(
        F.max(F.struct("sure", (-F.col("at").cast("double")).alias("minus"))).alias("top")
    )
    place = Window.partitionBy("group").orderBy(F.desc("top.sure"), F.desc("top.minus"), "doc_id")
    chosen = once.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)
    chosen = chosen.select("group", "doc_id", "place", F.col("top.sure").alias("sure"))
    rows = found.join(F.broadcast(chosen), ["group", "doc_id", "sure"])
    rows = rows.groupBy("group", "place", "doc_id").agg(F.min("x").alias("x"))
    gathered = rows.toArrow()
    return gathered.sort_by([("group", "ascending"), ("place", "ascending")]).combine_chunks()


def co_train(scratch: Scratch, pool: DataFrame, n_pool: int, trainings: list[Training]) -> None:
    """The exchange between the views of each training, over all rows of the pool."""
    most = min(GIVEN, math.ceil(SHARE * n_pool))
    open_ones = [t for t in trainings if t.open]
    for turn in range(ROUNDS if open_ones and most else 0):
        rows = surest_rows(scratch, pool, open_ones, most, f"surest-{turn}")
        group, ids = np.asarray(rows.column("group")), np.asarray(rows.column("doc_id"))
        vectors = rows.column("x").to_pylist()
        for g, training in enumerate(open_ones):
            for k in range(2):
                at = np.flatnonzero(group // 2 == 2 * g + k)
                if len(at):
                    x = np.array([vectors[i] for i in at], dtype=np.float64)
                    training.take(1 - k, ids[at].tolist(), x, (group[at] % 2).astype(float))
            training.fit()


def fit(
    scratch: Scratch,
    pool: DataFrame,
    n_pool: int,
    ids: np.ndarray,
    views: tuple[np.ndarray, np.ndarray],
    y: np.ndarray,
    times: np.ndarray,
) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Models of the views, their calibrations, and the model that combines them."""
    fold = hashed_fold(ids, FOLDS)
    parts = [np.ones(len(y), dtype=bool), *[fold != f for f in range(FOLDS)]]
    trainings = [Training(tuple(v[p] for v in views), y[p], times[p]) for p in parts]
    co_train(scratch, pool, n_pool, trainings)
    outside = np.zeros((len(y), 2))
    for f in range(FOLDS):
        held = fold == f
        for k in range(2):
            outside[held, k] = logit(predict(trainings[f + 1].models[k], views[k][held]))
    calibrations = [fit_logistic(outside[:, [k]], y, 0.1, times=times) for k in range(2)]
    calibrated = np.column_stack(
        [logit(predict(c, outside[:, [k]])) for k, c in enumerate(calibrations)]
    )
    return trainings[0].models, calibrations, fit_logistic(calibrated, y, 0.1, times=times)


def combined(fitted, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Columns: calibrated text view, calibrated metadata view, both."""
    models, calibrations, last = fitted
    each = [
        predict(c, logit(predict(m, v))[:, None]) for m, c, v in zip(models, calibrations, views)
    ]
    both = predict(last, np.column_stack([logit(p) for p in each]))
    return np.column_stack([*each, both])


def _score(fitted, threshold: float) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Views()
        for frame in frames:
            parts = [np.zeros((0, 3))]
            for _, _, content, metadata in extract(frame):
                parts.append(combined(fitted, (content, metadata)))
            p = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column("doc_id"),
                    *[pa.array(np.ascontiguousarray(c)) for c in p.T],
                    pa.array(p[:, 2] >= threshold),
                ],
                names=["doc_id", "p_text", "p_metadata", "quality", "kept"],
            )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, p_text, p_metadata, quality, kept)`` for each row of ``docs``."""
    known = labels.filter("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min(F.col("quality") > 0).alias("good"))
    counts = label_counts(known, "good")
    labelled = sample_rows(known, SAMPLE, "quality", F.col("good"), ~F.col("good"))
    features = "doc_id long, good boolean, content array<float>, metadata array<float>"
    gathered = texts_of(docs, labelled, *COLUMNS).mapInArrow(_sampled, features).toArrow()
    order = np.argsort(np.asarray(gathered.column("doc_id")), kind="stable")
    gathered = gathered.take(pa.array(order, pa.int64())).combine_chunks()
    good = np.array(gathered.column("good").to_pylist(), int)
    ids = np.asarray(gathered.column("doc_id"))
    views = tuple(
        np.array(gathered.column(c).to_pylist(), dtype=np.float64).reshape(len(ids), w)
        for c, w in WIDTHS.items()
    )
    times = row_times(good, counts, SAMPLE)

    # Vectors of all unlabelled rows, written once and read in each round. Labelled rows leave
    # after the vectors are made: a shuffle carries those, never whole texts.
    scratch = Scratch(docs.sparkSession, "quality")
    every = docs.select("doc_id", *COLUMNS).filter("doc_id is not null")
    every = every.withColumn("good", F.lit(None).cast("boolean")).mapInArrow(_sampled, features)
    unknown = every.join(known.select("doc_id"), "doc_id", "left_anti")
    pool, n_pool = scratch.keep(unknown, "pool")
    pool = pool.select(
        "doc_id", F.xxhash64(F.lit("pool"), "doc_id").alias("at"), "content", "metadata"
    )
    fitted = fit(scratch, pool, n_pool, ids, views, good.astype(float), times)
    return docs.select("doc_id", *COLUMNS).mapInArrow(
        _score(fitted, threshold),
        "doc_id long, p_text double, p_metadata double, quality double, kept boolean",
    )
