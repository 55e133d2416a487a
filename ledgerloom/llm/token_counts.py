"""Token counts from pieces counted once per distinct pre-token.

A pre-token here is a run of bytes between ASCII spaces, cut further, where it is plain
ASCII, before a comma or full stop at its end, and folded to small letters. The tokenizer
splits at these places as well and folds case itself, so a text's count is the sum over its
pre-tokens. What could make the context matter, text outside ASCII and strings of special
tokens, is left uncut and unfolded.

1. Distinct pre-tokens of the corpus are collected, combined in each task first.
2. The tokenizer counts the pieces of each of them once.
3. The pieces of the most frequent short ones, ``head`` at most, go to all tasks; a
   document's other pre-tokens are joined to the table of pieces, as rows of (document,
   pre-token, frequency), and summed. No ids are kept.

Defined cases: null is the empty text, with 0 bytes and tokens. Repeated rows give a row
each. Extra columns are not read.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textbytes import BATCH_TEXTS, batches, utf8
from ledgerloom.scratch import Scratch

LIMIT = 2048
#: Most frequent pre-tokens that are sent to all tasks, and the longest of them in bytes.
HEAD, HEAD_BYTES = 1 << 16, 64
#: Distinct pre-tokens that a task holds before it passes their counts on.
HELD = 200_000
#: Runs between spaces that a task remembers the pieces of; rows that it gathers before it sends them.
REMEMBERED, SENT = 100_000, 30_000
#: Bytes of pre-tokens that are coded at once.
CODED_BYTES = 1 << 16


def cut(unit: bytes) -> tuple[bytes, ...]:
    """The pre-tokens of a run between spaces."""
    if unit.isascii() and b"<|" not in unit:
        unit = unit.lower()
        if unit[-1] in b".," and unit[:-1].isalpha():
            return unit[:-1], unit[-1:]
    return (unit,)


def pretokens(units: Iterable[tuple[bytes, int]]) -> Counter:
    """Frequencies of pre-tokens from those of the runs between spaces."""
    found: Counter = Counter()
    for unit, n in units:
        for part in cut(unit):
            found[part] += n
    return found


def _some_texts(frames: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The texts in order, some rows and bytes at a time."""
    for frame in frames:
        for at in range(0, frame.num_rows, BATCH_TEXTS):
            texts = utf8(frame.column("text").slice(at, BATCH_TEXTS))
            for lo, hi in batches(texts):
                yield texts[lo:hi]


def _corpus_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["unit", "n"],
        )

    held: Counter = Counter()
    for texts in _some_texts(frames):
        held.update(b"\n".join(texts).split())
        if len(held) > HELD:
            yield rows(pretokens(held.items()))
            held = Counter()
    yield rows(pretokens(held.items()))


def _piece_counter(tokenizer_file: str) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has one core; threads of the tokenizer would each hold memory besides.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for frame in frames:
            units = frame.column("unit").to_pylist()
            pieces = [np.zeros(0, dtype=np.int64)]
            for lo, hi in batches(units, CODED_BYTES, len(units)):
                part = [x.decode("utf-8", "replace") for x in units[lo:hi]]
                # A line for each: the tokenizer splits there, and its offsets tell the line.
                coded = tokenizer.encode("\n".join(part), add_special_tokens=False)
                ends = np.cumsum(np.fromiter((len(x) + 1 for x in part), np.int64, len(part)))
                begins = np.fromiter((x[0] for x in coded.offsets), np.int64, len(coded))
                line = np.searchsorted(ends, begins, side="right")
                pieces.append(np.bincount(line, minlength=len(part)))
            yield pa.RecordBatch.from_arrays(
                [frame.column("unit"), frame.column("n"), pa.array(np.concatenate(pieces))],
                names=["unit", "n", "pieces"],
            )

    return run


PARTS = "row long, doc_id long, n_bytes long, unit binary, freq long, base long"


def _frequencies(head: dict[bytes, int]) -> Callable:
    """Rows of a document's other pre-tokens; the first carries its bytes and head tokens.

    A document without others has a row with a pre-token that no text can hold. Runs between
    spaces whose pieces are all in the head are remembered, up to a number of them.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        known: dict[bytes, int] = {}
        for frame in frames:
            ids = frame.column("doc_id").to_pylist()
            texts = (text for some in _some_texts([frame]) for text in some)
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(ids, texts):
                base, tail = 0, {}
                for between, n in Counter(text.split()).items():
                    pieces = known.get(between)
                    if pieces is None:
                        pieces, whole = 0, True
                        for unit in cut(between):
                            if unit in head:
                                pieces += head[unit]
                            else:
                                tail[unit] = tail.get(unit, 0) + n
                                whole = False
                        if whole and len(known) < REMEMBERED:
                            known[between] = pieces
                    base += n * pieces
                if not tail:
                    tail[b" %d" % row] = 0
                k = len(tail)
                columns[0] += [row] * k
                columns[1] += [doc_id] + [None] * (k - 1)
                columns[2] += [len(text)] + [None] * (k - 1)
                columns[3] += tail.keys()
                columns[4] += tail.values()
                columns[5] += [base] + [0] * (k - 1)
                row += 1
                if len(columns[0]) > SENT:
                    yield _parts(columns)
                    columns = [[], [], [], [], [], []]
            yield _parts(columns)

    return run


def _parts(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        names=["row", "doc_id", "n_bytes", "unit", "freq", "base"],
    )


def most_frequent(pieces: DataFrame, head: int) -> dict[bytes, int]:
    """Pieces of the most frequent short pre-tokens, ``head`` of them at most.

    Frequencies fall into some thousand classes; whole classes are taken from the top as long
    as they fit, so the driver sees no more than the classes and the head from all tasks.
    """
    short = pieces.filter(F.length("unit") <= HEAD_BYTES).withColumn(
        "class", F.floor(F.log2("n") * 16)
    )
    sizes = short.groupBy("class").agg(F.count(F.lit(1)).alias("size")).collect()
    lowest, taken = None, 0
    for row in sorted(sizes, reverse=True):
        taken += row["size"]
        if taken > head:
            break
        lowest = row["class"]
    if lowest is None:
        return {}
    top = short.filter(F.col("class") >= lowest).select("unit", "pieces").collect()
    return {bytes(r["unit"]): r["pieces"] for r in top}


def count_tokens(
    docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, head: int = HEAD
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "tokens")
    texts = docs.select("doc_id", "text")
    units = (
        texts.select("text")
        .mapInArrow(_corpus_counts, "unit binary, n long")
        .groupBy("unit")
        .agg(F.sum("n").alias("n"))
    )
    counted = units.mapInArrow(
        _piece_counter(tokenizer_file), "unit binary, n long, pieces long"
    )
    pieces, _ = scratch.keep(counted, "pieces")
    known = most_frequent(pieces, head)
    parts = texts.mapInArrow(_frequencies(known), PARTS)
    joined = parts.join(pieces.select("unit", "pieces"), "unit", "left")
    tokens = F.sum(F.col("base") + F.col("freq") * F.coalesce("pieces", F.lit(0)))
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            tokens.alias("n_tokens"),
        )
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
