"""Toxicity by a classifier chain.

The categories of ``CATEGORIES`` come first: a labelled text belongs to one if its label is
toxic and a word of the category's list stands in it. The label itself, ``toxic``, comes last. Each is a
linear model on hashed words and word beginnings; a later model also reads the earlier
categories' log-odds. In training these come from models that did not see the row
(out-of-fold), so that a later model learns how far an earlier one can be trusted.

The chain is fitted on at most ``SAMPLE`` labelled rows of either label, those of the smallest hash of
doc_id; ``FEATURES`` features of the largest difference between the labels are kept. A sampled row
counts as many times as rows of its label stand for it, so that the labels have their shares of all
labelled rows. All documents are scored, whole.

Defined cases: null text has no words. A doc_id labelled more than once is toxic if any of
its labels is; null labels do not count. Without labels of both kinds every probability is
the prior. Repeated rows give a row each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
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
from ledgerloom.llm.textbytes import WordHasher, Words, batches, mix64, salted, utf8

SAMPLE = 3000
FEATURES = 200
PENALTY = 0.3
SPACE_BITS = 20
FOLDS = 3
#: Word lists of the categories; a chosen parameter.
CATEGORIES = {
    "insult": ("clown", "idiot", "loser", "moron", "stupid"),
    "contempt": ("disgusting", "pathetic", "scum", "trash", "worthless"),
}


class Features:
    """Hashed words, folded and without marks at their ends, and beginnings of 4 and 5 bytes."""

    def __init__(self) -> None:
        self.hasher = WordHasher(fold=True)
        self.mark = np.zeros(256, dtype=bool)
        self.mark[list(b".,;:!?\"'()[]{}<>*_-")] = True
        self.mask = np.uint64((1 << SPACE_BITS) - 1)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(text, feature)``, repeats included."""
        words = Words(self.hasher, texts)
        start, end, doc = words.start.copy(), words.end.copy(), words.doc
        for _ in range(3):
            end -= (end - start > 1) & self.mark[words.data[end - 1]]
            start += (end - start > 1) & self.mark[words.data[start]]
        docs, ids = [doc], [self.hasher.hashes(words.data, start, end)]
        tags, codes = salted(2, 31), self.hasher.code
        for k, size in enumerate((4, 5)):
            at = np.flatnonzero(end - start > size)
            value = np.zeros(len(at), dtype=np.uint64)
            for i in range(size):
                value = value * np.uint64(0x100000001B3) + codes[words.data[start[at] + i]]
            docs.append(doc[at])
            ids.append(mix64(value ^ tags[k]))
        return np.concatenate(docs), (np.concatenate(ids) & self.mask).astype(np.int64)


def _sampled(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    extract = Features()
    for frame in frames:
        texts = utf8(frame.column("text"))
        rows, held = [], []
        for lo, hi in batches(texts):
            doc, feature = extract(texts[lo:hi])
            both = np.unique((doc << SPACE_BITS) | feature)
            cuts = np.searchsorted(both >> SPACE_BITS, np.arange(1, hi - lo))
            rows += [x.astype(np.int32) for x in np.split(both & ((1 << SPACE_BITS) - 1), cuts)]
        for text in texts:
            words = {w.strip(b".,;:!?\"'()") for w in text.lower().split()}
            held.append([any(w.encode() in words for w in ws) for ws in CATEGORIES.values()])
        yield pa.RecordBatch.from_arrays(
            [
                frame.column("doc_id"),
                frame.column("toxic"),
                pa.array(held, pa.list_(pa.bool_())),
                pa.array(rows, pa.list_(pa.int32())),
            ],
            names=["doc_id", "toxic", "held", "features"],
        )


def select_features(rows: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """Features whose share differs most between the labels, in order of id."""
    total = np.zeros(1 << SPACE_BITS)
    of_true = np.zeros(1 << SPACE_BITS)
    for row, label in zip(rows, y):
        total[row] += 1
        if label:
            of_true[row] += 1
    n, n_true = max(1, len(y)), max(1, int(y.sum()))
    rest = total - of_true
    p = (total + 1) / (n + 2)
    z = (of_true / n_true - rest / max(1, n - n_true)) / np.sqrt(
        p * (1 - p) * (1 / n_true + 1 / max(1, n - n_true))
    )
    z[total < 3] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:most]
    return np.sort(best[z[best] != 0])


def fit_chain(
    ids: np.ndarray,
    x: np.ndarray,
    targets: np.ndarray,
    folds: int = FOLDS,
    times: np.ndarray | None = None,
) -> list[np.ndarray]:
    """A model for each column of ``targets``; later ones read earlier log-odds."""
    fold = hashed_fold(ids, folds)
    times = np.ones(len(targets)) if times is None else times
    models, seen = [], x
    for k in range(targets.shape[1]):
        y = targets[:, k]
        models.append(fit_logistic(seen, y, PENALTY, times=times))
        outside = np.zeros(len(y))
        for f in range(folds):
            held = fold == f
            inner = fit_logistic(seen[~held], y[~held], PENALTY, times=times[~held])
            outside[held] = predict(inner, seen[held])
        seen = np.column_stack([seen, logit(outside) / 5])
    return models


def chain_probabilities(models: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    seen, found = x, []
    for model in models:
        found.append(predict(model, seen))
        seen = np.column_stack([seen, logit(found[-1]) / 5])
    return np.column_stack(found)


def _score(chosen: np.ndarray, models: list[np.ndarray], threshold: float) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Features()
        place = np.full(1 << SPACE_BITS, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen))
        for frame in frames:
            texts = utf8(frame.column("text"))
            parts = [np.zeros((0, len(models)))]
            for lo, hi in batches(texts):
                doc, feature = extract(texts[lo:hi])
                column = place[feature]
                hit = column >= 0
                x = np.zeros((hi - lo, len(chosen)), dtype=np.float32)
                x[doc[hit], column[hit]] = 1
                parts.append(chain_probabilities(models, x))
            p = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column("doc_id"),
                    *[pa.array(np.ascontiguousarray(c)) for c in p.T],
                    pa.array(p[:, -1] >= threshold),
                ],
                names=["doc_id", *[f"p_{c}" for c in (*CATEGORIES, "toxic")], "toxic"],
            )

    return run


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    features: int = FEATURES,
    threshold: float = 0.5,
) -> DataFrame:
    """``(doc_id, p_<category>..., p_toxic, toxic)`` for each row of ``docs(doc_id, text)``."""
    known = labels.filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic"))
    counts = label_counts(known, "toxic")
    ids = sample_rows(known, sample, "toxicity", F.col("toxic"), ~F.col("toxic"))
    rows = texts_of(docs, ids, "text").mapInArrow(
        _sampled, "doc_id long, toxic boolean, held array<boolean>, features array<int>"
    )
    gathered = rows.toArrow()
    order = np.argsort(np.asarray(gathered.column("doc_id")), kind="stable")
    gathered = gathered.take(pa.array(order, pa.int64())).combine_chunks()
    toxic = np.array(gathered.column("toxic").to_pylist(), dtype=bool)
    held = np.array(gathered.column("held").to_pylist(), dtype=bool).reshape(len(toxic), len(CATEGORIES))
    rows_of = [np.asarray(r.values) for r in gathered.column("features")]
    chosen = select_features(rows_of, toxic, features)
    x = np.zeros((len(toxic), len(chosen)), dtype=np.float32)
    for i, row in enumerate(rows_of):
        x[i] = np.isin(chosen, row, assume_unique=True)
    targets = np.column_stack([held & toxic[:, None], toxic])
    times = row_times(toxic.astype(int), counts, sample)
    models = fit_chain(
        np.asarray(gathered.column("doc_id")), x, targets.astype(float), times=times
    )
    columns = ", ".join(f"p_{c} double" for c in (*CATEGORIES, "toxic"))
    return docs.select("doc_id", "text").mapInArrow(
        _score(chosen, models, threshold), f"doc_id long, {columns}, toxic boolean"
    )
