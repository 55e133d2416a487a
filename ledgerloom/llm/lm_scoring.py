"""Masked pseudo-likelihood scores from a bidirectional window network.

The network reads the ``SIDE`` words before and after a place, never the word itself, and
predicts that word: embeddings of the neighbours, a hidden layer, and a softmax over classes
of words; within its class a word has its share of the corpus counts. The score of a text is
the sum of log-probabilities of all of its words, each given both sides.

1. Words of the whole corpus are counted. The ``VOCABULARY`` most frequent are tokens; others
   fall into ``RARE`` buckets by hash. Classes cut the tokens, in order of frequency, into about
   equal shares.
2. Training covers all words of all documents: each place belongs to one of ``ROUNDS`` rounds.
   In its round a task masks it, and takes gradient steps from the common weights. The tasks' weights are averaged, weighted by their steps, embeddings row by
   row, in groups of bounded size, level by level.
3. All texts are scored, whole. Tokens and weights, of bounded size, go to the tasks.

Defined cases: null text has no words; such texts score 0 and have no mean. A corpus without
words trains nothing. Repeated rows give a row each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textbytes import WordHasher, Words, batches, mix64, utf8
from ledgerloom.scratch import Scratch

VOCABULARY = 8192
RARE = 256
CLASSES = 64
SIDE = 2
WIDTH = 16
HIDDEN = 32
ROUNDS = 2
RATE = 0.5
STEP = 256
#: Shards whose weights are averaged in one group.
FAN_IN = 32


class Vocabulary:
    """Tokens by word hash, their classes and their log shares within them."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rare_count: int, rare_words: int):
        order = np.argsort(hashes)
        self.hashes, counts = hashes[order], counts[order].astype(np.float64)
        self.pad = len(hashes) + RARE
        rare = np.full(RARE, max(1.0, rare_count / RARE))
        every = np.concatenate([counts, rare])
        by_count = np.argsort(-every, kind="stable")
        mass = np.cumsum(every[by_count])
        self.classes = np.empty(len(every), dtype=np.int64)
        self.classes[by_count] = np.minimum(
            CLASSES - 1, ((mass - every[by_count]) / mass[-1] * CLASSES).astype(np.int64)
        )
        total = np.bincount(self.classes, weights=every, minlength=CLASSES)
        share = np.log(every / total[self.classes])
        # A bucket's words share its part evenly.
        share[len(counts) :] -= np.log(max(1.0, rare_words / RARE))
        self.share = share.astype(np.float32)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        rare = len(self.hashes) + (hashes % np.uint64(RARE)).astype(np.int64)
        return np.where(known, at, rare)


def initial_weights(tokens: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(17)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    return {
        "embedding": normal(tokens, WIDTH, scale=0.3),
        "hidden": normal(2 * SIDE * WIDTH + 1, HIDDEN, scale=0.15),
        "out": normal(HIDDEN + 1, CLASSES, scale=0.05),
    }


def neighbours(words: Words, tokens: np.ndarray, at: np.ndarray, pad: int) -> np.ndarray:
    """Tokens on both sides of places, ``pad`` beyond a text's ends."""
    found = np.empty((len(at), 2 * SIDE), dtype=np.int64)
    lo, hi = words.first[words.doc[at]], words.first[words.doc[at] + 1]
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        place = at + step
        inside = (place >= lo) & (place < hi)
        found[:, k] = np.where(inside, tokens[np.where(inside, place, 0)], pad)
    return found


def forward(weights: dict[str, np.ndarray], around: np.ndarray):
    """Inputs, hidden layer and log-probabilities of classes."""
    x = weights["embedding"][around].reshape(len(around), -1)
    h = np.tanh(x @ weights["hidden"][:-1] + weights["hidden"][-1])
    z = h @ weights["out"][:-1] + weights["out"][-1]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return x, h, z


def train_step(weights: dict[str, np.ndarray], around: np.ndarray, classes: np.ndarray, rate: float):
    x, h, z = forward(weights, around)
    n = len(around)
    slope = np.exp(z)
    slope[np.arange(n), classes] -= 1
    slope /= n
    back = (slope @ weights["out"][:-1].T) * (1 - h * h)
    into = (back @ weights["hidden"][:-1].T).reshape(n * 2 * SIDE, WIDTH)
    weights["out"][:-1] -= rate * (h.T @ slope)
    weights["out"][-1] -= rate * slope.sum(axis=0)
    weights["hidden"][:-1] -= rate * (x.T @ back)
    weights["hidden"][-1] -= rate * back.sum(axis=0)
    # A row is moved by its own mean slope, so that rare words learn as well.
    order = np.argsort(around.ravel(), kind="stable")
    rows, first, times = np.unique(around.ravel()[order], return_index=True, return_counts=True)
    total = np.add.reduceat(into[order], first, axis=0)
    weights["embedding"][rows] -= rate * n / np.sqrt(times * float(n))[:, None] * total
    return rows, times


def _corpus_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(fold=True)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate([h for h, _ in held])
        unique, inverse = np.unique(words, return_inverse=True)
        counts = np.concatenate([c for _, c in held])
        return unique, np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)

    def rows(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(part[0].view(np.int64)), pa.array(part[1])], names=["word", "n"]
        )

    for frame in frames:
        texts = utf8(frame.column("text"))
        for lo, hi in batches(texts, 1 << 22, 4096):
            found = np.unique(Words(hasher, texts[lo:hi]).hash, return_counts=True)
            held.append(found)
            if sum(len(h) for h, _ in held) > 1_000_000:
                held = [merged()]
                if len(held[0][0]) > 700_000:
                    yield rows(held[0])
                    held = []
    if held:
        yield rows(merged())


SHARD = "shard long, part int, weights binary, steps array<double>"
ROWS_PER_PART = 256


def _parts(weights: dict[str, np.ndarray], steps: dict[str, np.ndarray]):
    """Weights as parts of bounded size, with how often each row was moved."""
    number = 0
    for name in sorted(weights):
        for lo in range(0, len(weights[name]), ROWS_PER_PART):
            hi = lo + ROWS_PER_PART
            yield number, weights[name][lo:hi], steps[name][lo:hi]
            number += 1


def targets(words: Words, turn: int, rounds: int) -> np.ndarray:
    """Places predicted in round ``turn``; each place is in one of the rounds."""
    place = np.arange(len(words.hash)) - words.first[words.doc]
    spread = mix64(words.hash[words.first[words.doc]] ^ place.astype(np.uint64))
    return np.flatnonzero(spread % np.uint64(rounds) == np.uint64(turn))


def _train(
    vocabulary: Vocabulary, start: dict[str, np.ndarray], turn: int, rounds: int
) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=True)
        weights = {k: v.copy() for k, v in start.items()}
        steps = {k: np.zeros(len(v)) for k, v in weights.items()}
        for frame in frames:
            texts = utf8(frame.column("text"))
            for lo, hi in batches(texts, 1 << 22, 4096):
                words = Words(hasher, texts[lo:hi])
                tokens = vocabulary.tokens(words.hash)
                at = targets(words, turn, rounds)
                around = neighbours(words, tokens, at, vocabulary.pad)
                classes = vocabulary.classes[tokens[at]]
                for first in range(0, len(at), STEP):
                    part = slice(first, first + STEP)
                    rows, times = train_step(weights, around[part], classes[part], RATE)
                    steps["embedding"][rows] += times
                    for name in ("hidden", "out"):
                        steps[name] += len(classes[part])
        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        for number, part, moved in _parts(weights, steps):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([number], pa.int32()),
                    pa.array([part.astype(np.float32).tobytes()], pa.binary()),
                    pa.array([moved.tolist()], pa.list_(pa.float64())),
                ],
                names=["shard", "part", "weights", "steps"],
            )

    return run


def _average(table: pa.Table) -> pa.Table:
    """The mean of a part over shards, row by row, by steps; rows never moved stay."""
    order = np.argsort(np.asarray(table.column("shard")), kind="stable")
    total = moved = plain = None
    for i in order:
        steps = np.array(table.column("steps")[int(i)].as_py())
        part = np.frombuffer(table.column("weights")[int(i)].as_py(), dtype=np.float32)
        part = part.reshape(len(steps), -1).astype(np.float64)
        if total is None:
            total, moved, plain = np.zeros_like(part), np.zeros(len(steps)), part
        total += part * steps[:, None]
        moved += steps
    mean = np.where(moved[:, None] > 0, total / np.maximum(moved, 1)[:, None], plain)
    return pa.table(
        {
            "shard": pa.array([int(np.asarray(table.column("shard")).min()) // FAN_IN], pa.int64()),
            "part": pa.array([table.column("part")[0].as_py()], pa.int32()),
            "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary()),
            "steps": pa.array([moved.tolist()], pa.list_(pa.float64())),
        }
    )


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    weights = initial_weights(vocabulary.pad + 1)
    shards = texts.rdd.getNumPartitions()
    for turn in range(rounds):
        parts = texts.select("text").mapInArrow(_train(vocabulary, weights, turn, rounds), SHARD)
        left = shards
        while left > 1:
            near = F.floor(F.col("shard") / FAN_IN).alias("near")
            parts = parts.groupBy(near, "part").applyInArrow(_average, SHARD)
            left = -(-left // FAN_IN)
        found = {r["part"]: r["weights"] for r in parts.select("part", "weights").collect()}
        number = 0
        for name in sorted(weights):
            for lo in range(0, len(weights[name]), ROWS_PER_PART):
                if number in found:
                    row = weights[name][lo : lo + ROWS_PER_PART]
                    row[:] = np.frombuffer(found[number], dtype=np.float32).reshape(row.shape)
                number += 1
    return weights


def log_probabilities(vocabulary: Vocabulary, weights: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """Of each word given both sides."""
    tokens = vocabulary.tokens(words.hash)
    found = np.empty(len(tokens), dtype=np.float64)
    for lo in range(0, len(tokens), 1 << 14):
        at = np.arange(lo, min(len(tokens), lo + (1 << 14)))
        _, _, z = forward(weights, neighbours(words, tokens, at, vocabulary.pad))
        own = tokens[at]
        found[at] = z[np.arange(len(at)), vocabulary.classes[own]] + vocabulary.share[own]
    return found


def _score(vocabulary: Vocabulary, weights: dict[str, np.ndarray]) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=True)
        for frame in frames:
            texts = utf8(frame.column("text"))
            for lo, hi in batches(texts):
                words = Words(hasher, texts[lo:hi])
                sums = np.bincount(
                    words.doc,
                    weights=log_probabilities(vocabulary, weights, words),
                    minlength=hi - lo,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(sums.astype(np.float64)),
                    ],
                    names=["doc_id", "n_words", "log_likelihood"],
                )

    return run


def learn_vocabulary(texts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    scratch = Scratch(texts.sparkSession, "words")
    counted = texts.select("text").mapInArrow(_corpus_words, "word long, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"))
    counts, n_words = scratch.keep(counted, "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(size).toArrow()
    total = counts.agg(F.sum("n")).first()[0] or 0
    hashes = np.asarray(top.column("word").combine_chunks(), dtype=np.int64).view(np.uint64)
    n = np.asarray(top.column("n").combine_chunks(), dtype=np.int64)
    return Vocabulary(hashes, n, total - int(n.sum()), n_words - len(n))


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_words, log_likelihood, mean_log_likelihood)`` for each row of ``docs``."""
    texts = docs.select("doc_id", "text")
    vocabulary = learn_vocabulary(texts)
    weights = train(texts, vocabulary, rounds)
    scored = texts.mapInArrow(
        _score(vocabulary, weights), "doc_id long, n_words long, log_likelihood double"
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return scored.withColumn("mean_log_likelihood", mean)
