"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are the 1- to 3-grams of letters (runs of other characters are one space), hashed to
65,536 places and weighted by ``(1 + log tf) * idf``, rows of length one. The model is trained
with follow-the-regularised-leader, coordinate by coordinate, with elastic-net penalties: the
absolute one keeps most weights at exactly zero. A part of the sample is kept back, on which one
temperature is fitted, so that scores are probabilities.

Documents whose ``crc32(doc_id) mod 3`` is 1 are held out: neither their text nor their lang is
ever learnt from, not even for the document frequencies. Frequencies count all other labelled
documents; the model is fitted on ``SAMPLE`` of them at most, drawn by hash with the same
expected number for each language and weighted back to the languages' shares. The driver holds
the sample's features and one weight for each place and language.

Defined cases: a text that is null or without letters is ``und`` with score 0, as is every text
if there is nothing to learn from. Rows without lang or doc_id are not learnt from, and are
predicted as any other. Repeated rows count as often as they occur; equal scores go to the first
language by code points. Texts are used whole, some characters at a time; extra columns are not
read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch

#: Documents that the model is fitted on, at most; their share that is kept back.
SAMPLE = 3_000
KEPT_BACK = 5
PLACES = 1 << 16
UNKNOWN = "und"
#: Code points from here on hold no letters.
CODES = 0x32000
SLICE = 1 << 20
# Odd multipliers of the hash.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


# -- features -----------------------------------------------------------------------------


@dataclass
class Letters:
    """By code point: whether it is a letter, and whether it belongs to a word."""

    letter: np.ndarray
    inside: np.ndarray


def letters() -> Letters:
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(CODES)] + ["-"])
    return Letters(kinds == "L", (kinds == "L") | (kinds == "M"))


def gram_counts(text: str, table: Letters) -> np.ndarray | None:
    """How often each place occurs, or none if the text has no letter."""
    f1, f2, f3, fold = (np.uint64(f) for f in FACTORS)
    shift = np.uint64(48)
    counts = np.zeros(PLACES, dtype=np.int64)
    small, any_letter = text.lower(), False
    tail = np.zeros(1, dtype=np.uint64)  # the space before the text
    for at in range(0, len(small) + 1, SLICE):
        codes = np.frombuffer(small[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.minimum(codes, CODES)
        any_letter = any_letter or bool(table.letter[codes].any())
        codes = np.where(table.inside[codes], codes, 0).astype(np.uint64)
        if at + SLICE > len(small):
            codes = np.append(codes, np.uint64(0))  # the space behind it
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        if len(codes):
            keep[0] |= tail[-1] != 0
        run = np.concatenate([tail, codes[keep]])
        new = len(run) - len(tail)
        if new:
            one = run[-new:]
            found = [one[one != 0] * f1 * fold >> shift]
            two = run[-new - 1 :]
            found.append((two[:-1] * f1 + two[1:] * f2 + np.uint64(1)) * fold >> shift)
            if len(run) > 2:
                found.append((run[:-2] * f1 + run[1:-1] * f2 + run[2:] * f3 + np.uint64(2)) * fold >> shift)
            counts += np.bincount(np.concatenate(found).astype(np.int64), minlength=PLACES)
        tail = run[-2:]
    return counts if any_letter else None


def weighted(place: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of a document's places, of length one."""
    value = (1 + np.log(count)) * idf[place]
    return value / max(float(np.sqrt(value @ value)), 1e-12)


# -- training -----------------------------------------------------------------------------


class Leader:
    """Follow-the-regularised-leader with elastic net, for several classes at once.

    ``z`` sums gradients, shifted so that the closed form of the next weights holds; ``n`` sums
    their squares. The last row is the intercept, without the absolute penalty.
    """

    def __init__(
        self, classes: int, rate: float = 1.0, damp: float = 1.0, l1: float = 0.1, l2: float = 0.02
    ):
        self.rate, self.damp, self.l1, self.l2 = rate, damp, l1, l2
        self.z = np.zeros((PLACES + 1, classes))
        self.n = np.zeros((PLACES + 1, classes))

    def weights(self, place: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[place], self.n[place]
        l1 = np.full(len(z), self.l1)
        l1[np.arange(len(self.z))[place] == PLACES] = 0
        over = np.maximum(np.abs(z) - l1[:, None], 0)
        return -np.sign(z) * over / ((self.damp + np.sqrt(n)) / self.rate + self.l2)

    def learn(self, place: np.ndarray, value: np.ndarray, answer: int, times: float) -> None:
        place, value = np.append(place, PLACES), np.append(value, 1.0)
        weights = self.weights(place)
        error = softmax(value @ weights)
        error[answer] -= 1
        gradient = value[:, None] * (times * error)
        n = self.n[place]
        more = n + gradient * gradient
        self.z[place] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.rate * weights
        self.n[place] = more


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, answers: np.ndarray, times: np.ndarray) -> float:
    """The divisor of the scores with the least weighted log loss, by golden section."""
    if not len(answers):
        return 1.0

    def loss(log_t: float) -> float:
        chosen = softmax(scores / np.exp(log_t))[np.arange(len(answers)), answers]
        return float(-(times * np.log(np.maximum(chosen, 1e-300))).sum())

    lo, hi, golden = -4.0, 4.0, (5**0.5 - 1) / 2
    a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
    loss_a, loss_b = loss(a), loss(b)
    for _ in range(40):
        if loss_a <= loss_b:
            hi, b, loss_b = b, a, loss_a
            a = hi - golden * (hi - lo)
            loss_a = loss(a)
        else:
            lo, a, loss_a = a, b, loss_b
            b = lo + golden * (hi - lo)
            loss_b = loss(b)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    """Languages in order, weights by place (the last is the intercept), temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        if counts is None or not self.langs:
            return UNKNOWN, 0.0
        place = np.flatnonzero(counts)
        chances = softmax(self.scores(place, counts[place]) / self.temperature)
        best = int(chances.argmax())
        return self.langs[best], float(min(chances[best], 1.0))

    def scores(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        return weighted(place, count, self.idf) @ self.weights[place] + self.weights[-1]


@dataclass
class Sampled:
    """One document of the sample: its language, its weight, its places and their counts."""

    lang: str
    times: float
    place: np.ndarray
    count: np.ndarray


def fit(sample: list[Sampled], idf: np.ndarray, turns: int = 3, **options: float) -> Model:
    """The model of a sample in an order that does not depend on its languages."""
    langs = sorted({s.lang for s in sample})
    if not langs:
        return Model([], idf, np.zeros((PLACES + 1, 0)), 1.0)
    code = {lang: k for k, lang in enumerate(langs)}
    kept_back = sample[::KEPT_BACK] if len(sample) >= 2 * KEPT_BACK else []
    learnt = [s for k, s in enumerate(sample) if k % KEPT_BACK] if kept_back else sample
    leader = Leader(len(langs), **options)
    rows = [(s.place, weighted(s.place, s.count, idf), code[s.lang], s.times) for s in learnt]
    for _ in range(turns):
        for row in rows:
            leader.learn(*row)
    model = Model(langs, idf, leader.weights(slice(None)), 1.0)
    if kept_back:
        model.temperature = temperature(
            np.array([model.scores(s.place, s.count) for s in kept_back]),
            np.array([code[s.lang] for s in kept_back]),
            np.array([s.times for s in kept_back]),
        )
    return model


# -- over the corpus ----------------------------------------------------------------------

FOUND = "place int, n long, lang string, turn long, places binary, counts binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each place occurs (``PLACES``: number of texts), and sampled rows."""
    table = letters()
    seen = np.zeros(PLACES + 1, dtype=np.int64)

    def rows(place, n, lang, turn, places, counts) -> pa.RecordBatch:
        arrays = [
            pa.array(place, pa.int32()), pa.array(n, pa.int64()), pa.array(lang, pa.string()),
            pa.array(turn, pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["place", "n", "lang", "turn", "places", "counts"])

    for batch in batches:
        langs, turns = batch.column("lang").to_pylist(), batch.column("turn").to_pylist()
        for k, text in enumerate(batch.column("text")):
            counts = gram_counts(text.as_py(), table)
            if counts is None:
                continue
            place = np.flatnonzero(counts)
            seen[place] += 1
            seen[PLACES] += 1
            if turns[k] is not None:
                packed = place.astype("<i4").tobytes(), counts[place].astype("<i8").tobytes()
                yield rows([None], [None], [langs[k]], [turns[k]], [packed[0]], [packed[1]])
    place = np.flatnonzero(seen)
    none = [None] * len(place)
    yield rows(place, seen[place], none, none, none, none)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, **options: float) -> Model:
    """Document frequencies of all learnable rows, and the model of a sample of them."""
    scratch = Scratch(docs.sparkSession, "languages")
    known = docs.filter(
        "doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"
    ).filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A row is drawn if its hash falls below its language's rate; the order is another hash.
    rates = {lang: min(1.0, sample / len(sizes) / n) for lang, n in sizes.items()}
    rate = F.lit(0.0)
    if rates:
        pairs = [F.lit(x) for pair in rates.items() for x in pair]
        rate = F.element_at(F.create_map(*pairs), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), "doc_id", "text"), F.lit(1 << 30)) < rate * (1 << 30)
    turn = F.when(drawn, F.xxhash64(F.lit("turn"), "doc_id", "text"))
    found, _ = scratch.keep(
        known.select("text", "lang", turn.alias("turn")).mapInArrow(_gathered, FOUND), "found"
    )
    seen = found.filter("place IS NOT NULL").groupBy("place").agg(F.sum("n").alias("n")).collect()
    n_texts = next((r["n"] for r in seen if r["place"] == PLACES), 0)
    idf = np.zeros(PLACES)
    for r in seen:
        if r["place"] < PLACES:
            idf[r["place"]] = np.log((1 + n_texts) / (1 + r["n"])) + 1
    chosen = found.filter("turn IS NOT NULL").orderBy("turn", "lang", "places").limit(sample)
    rows = [
        Sampled(
            r["lang"],
            1 / rates[r["lang"]],
            np.frombuffer(r["places"], "<i4").astype(np.int64),
            np.frombuffer(r["counts"], "<i8"),
        )
        for r in chosen.select("lang", "places", "counts").collect()
    ]
    mean = sum(s.times for s in rows) / max(len(rows), 1)
    for s in rows:
        s.times /= mean
    return fit(rows, idf, **options)


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def _predictor(model: Model) -> Callable:
    # Places of no weight in any language still count for a row's length.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for batch in batches:
            texts = (x.as_py() for x in batch.column("text"))
            told = [model.predict(None if t is None else gram_counts(t, table)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([lang for lang, _ in told], pa.string()),
                    pa.array([score for _, score in told], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, a row for each row of ``docs``."""
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "text",
    )
    return known.mapInArrow(_predictor(model), PREDICTED)


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trained on the rows that are not held out, for all rows."""
    return predict(docs, train(docs, sample))
