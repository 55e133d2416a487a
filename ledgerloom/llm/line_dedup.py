"""Repeated runs of lines across a corpus, found by winnowing; the later ones are deleted.

A *unit* is a line, cut further after ``. ``, ``! `` and ``? `` so that passages set into a
longer line are seen as well. Units without a word are never compared or deleted. Equal
units are equal apart from spaces at their ends.

1. Every run of ``k`` units is hashed; of each ``window`` consecutive hashes in a document the
   smallest is a fingerprint (winnowing). So any run of ``t = k + window - 1`` units that
   occurs twice has a fingerprint in common. A *passage*, fewer than ``t`` units that hold
   ``long_words`` words, is a fingerprint of its own, unless it holds as many without its first
   unit and without its last one too.
2. Positions are joined on fingerprints; those that occur once are done with.
3. Around each fingerprint that repeats, the match is extended both ways: all runs of ``t``
   units that chose it, reaching to its left and right, are compared, and a run that occurred
   earlier, by (doc_id, position), is a later copy. Runs that overlap add up to the whole match.
4. The units of later copies are deleted. A copy that overlaps its own first occurrence, as in
   one unit said over and over, stays.

The result equals a comparison of all runs of ``t`` units and of all shorter ones that hold
``long_words`` words. Runs are equal when a 64-bit and an independent 32-bit hash are; a row is
known by doc_id and 64 bits of its text, without doc_id by 128 bits.

Defined cases: null text stays null, empty text stays empty. Rows repeated with the same
doc_id and text are one document and keep the same units. A null doc_id comes last in the
order. Other columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, unused
from ledgerloom.scratch import Scratch

RUN = 2
WINDOW = 3
LONG_WORDS = 50
#: A unit, up to and with its end; it reads each character once.
UNIT = r"(?!\z)[^\n.!?]*+(?:[.!?](?! )[^\n.!?]*+)*+(?:\n|[.!?] |\z)"
SPAN = ("lo", "hi", "hash", "other")
ENDS = " \t\n\x0b\x0c\r"


def _units(text: Column) -> Column:
    """The text as pieces that add up to it."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _bare(unit: Column) -> Column:
    return F.btrim(unit, F.lit(ENDS))


def _oddly_spaced(text: Column) -> Column:
    """Whether more than single blanks may part the words of a unit."""
    odd = F.contains(text, F.lit("  "))
    for space in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(space))
    return odd


def _n_words(unit: Column, odd: Column) -> Column:
    """Words of a bare unit; without a pattern unless its text is odd."""
    blanks = F.octet_length(unit) - F.octet_length(F.replace(unit, F.lit(" "), F.lit("")))
    return F.when(odd, F.size(F.split(unit, f"{SPACE}+"))).otherwise(blanks + 1)


def _joint_hash(hashes: str, at: Column, size: int) -> Column:
    """Hash of ``size`` entries of the column ``hashes``, read in place."""
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(size)])


def _short_hash(hashes: str, at: Column, size: int) -> Column:
    return F.hash(*[F.get(hashes, at + j) for j in range(size)])


def _key(doc_id: Column, text: Column) -> Column:
    """Tells texts of one doc_id apart, and all texts without one; it travels with every
    fingerprint, so it is no longer than that takes."""
    digest = F.md5(text)
    return F.coalesce(
        F.unhex(F.when(doc_id.isNull(), digest).otherwise(F.substring(digest, 1, 16))), F.lit(b"")
    )


def fingerprints(docs: DataFrame, run: int, window: int, long_words: int) -> DataFrame:
    """Winnowed fingerprints with the hashes of the runs around them.

    ``(doc_id, text_key, print, lo, hi, hash, other)``: from lo on these are arrays, with an
    entry for every run of t units that chose the fingerprint, or for the passage; lo and hi are
    the places of its ends in the text, hash and other its hashes.
    A column that a lambda reads is named outside of it too: Spark computes it once then,
    and not again for each element.
    """
    t = run + window - 1
    bare = F.transform(
        _units(F.col("text")), lambda u, i: F.struct(i.alias("at"), _bare(u).alias("unit"))
    )
    split = docs.select(
        "doc_id",
        _key(F.col("doc_id"), F.col("text")).alias("text_key"),
        _oddly_spaced(F.col("text")).alias("odd"),
        F.filter(bare, lambda x: x["unit"] != "").alias("units"),
    )

    hashed = split.select(
        "doc_id",
        "text_key",
        "odd",
        F.transform("units", lambda x: F.xxhash64(x["unit"])).alias("hashes"),
        F.transform("units", lambda x: F.hash(x["unit"])).alias("others"),
        F.transform("units", lambda x: x["at"]).alias("places"),
        F.transform("units", lambda x: _n_words(x["unit"], F.col("odd"))).alias("words"),
    )
    n = F.size("hashes")
    grams = hashed.withColumn(
        "grams",
        F.when(
            n >= t,
            F.transform(
                F.sequence(F.lit(0), n - run),
                lambda i: F.struct(_joint_hash("hashes", i, run).alias("print"), i.alias("at")),
            ),
        ),
    )
    chosen = grams.withColumn(
        "chosen",
        F.when(
            F.size("grams") >= window,
            F.transform(
                F.sequence(F.lit(0), n - t),
                lambda i: F.get("grams", i)
                if window == 1
                else F.least(*[F.get("grams", i + j) for j in range(window)]),
            ),
        ),
    ).drop("grams")
    # Neighbouring windows mostly choose the same place: one of each stays.
    kept = F.filter(
        "chosen",
        lambda x, i: (i == 0) | (x["at"] != F.element_at("chosen", F.greatest(i, F.lit(1)))["at"]),
    )

    def span(at: Column, size: int) -> Column:
        return F.struct(
            F.element_at("places", at + 1).alias("lo"),
            F.element_at("places", at + size).alias("hi"),
            _joint_hash("hashes", at, size).alias("hash"),
            _short_hash("others", at, size).alias("other"),
        )

    def held(at: Column, first: int, last: int) -> Column:
        """Words of some units from ``at`` on; null where there are not so many."""
        return sum((F.get("words", at + j) for j in range(first, last)), F.lit(0))

    def passage(at: Column, size: int) -> Column:
        """The passage of ``size`` units from ``at`` on, else null."""
        fewer = F.least(held(at, 0, size - 1), held(at, 1, size))
        there = (held(at, 0, size) >= long_words) & (fewer < long_words)
        return F.when(there, span(at, size))

    def passages(at: Column) -> Column:
        """All from ``at`` on, the shortest first: they share a fingerprint."""
        return F.array_compact(F.array(*[passage(at, size) for size in range(1, t)]))

    def may_start(at: Column) -> Column:
        next_ones = [F.coalesce(F.get("words", at + j), F.lit(0)) for j in range(t - 1)]
        return sum(next_ones, F.lit(0)) >= long_words

    def spans(at: Column) -> Column:
        """Each run of t units belongs to the one fingerprint that its window chose."""
        first, last = F.greatest(at - (window - 1), F.lit(0)), F.least(at, n - t)
        chosen_here = F.filter(
            F.sequence(first, last), lambda s: F.element_at("chosen", s + 1)["at"] == at
        )
        return F.transform(chosen_here, lambda s: span(s, t))

    short = F.transform(
        kept, lambda x: F.struct(x["print"].alias("print"), spans(x["at"]).alias("spans"))
    )
    none = F.array().cast(
        "array<struct<print:bigint,spans:array<struct<lo:int,hi:int,hash:bigint,other:int>>>>"
    )
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), may_start))
    found = F.filter(F.transform(starts, passages), lambda spans: F.size(spans) > 0)
    long = F.transform(
        found, lambda spans: F.struct(F.get(spans, 0)["hash"].alias("print"), spans.alias("spans"))
    )
    marks = F.concat(F.coalesce(short, none), F.coalesce(long, none))
    return chosen.select("doc_id", "text_key", F.explode(marks).alias("mark")).select(
        "doc_id", "text_key", "mark.print", *[f"mark.spans.{c}" for c in SPAN]
    )


def later_copies(
    docs: DataFrame, run: int = RUN, window: int = WINDOW, long_words: int = LONG_WORDS
) -> DataFrame:
    """``(doc_id, text_key, spans)``: where each document's later copies lie."""
    scratch = Scratch(docs.sparkSession, "lines")
    marks, _ = scratch.keep(fingerprints(docs, run, window, long_words), "marks")
    # Written, so that a print that many documents share can be split in the join.
    repeated = marks.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated, _ = scratch.keep(repeated.select("print"), "repeated")
    runs = (
        marks.join(repeated, "print")
        .select("doc_id", "text_key", F.inline(F.arrays_zip(*SPAN)))
    )
    runs, _ = scratch.keep(runs, "runs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "lo", "hi")
    firsts = (
        runs.groupBy("hash", "other")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("hash", "other", "first")
    )
    firsts, _ = scratch.keep(firsts, "firsts")
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (
        F.col("first.text_key") == F.col("text_key")
    )
    copies = runs.join(firsts, ["hash", "other"]).filter(~same | (F.col("lo") > F.col("first.hi")))
    return copies.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans")
    )


def delete_repeated_lines(
    docs: DataFrame, run: int = RUN, window: int = WINDOW, long_words: int = LONG_WORDS
) -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``, and ``n_deleted`` pieces added.

    If ``docs`` has a column n_deleted already, the new one gets underscores at its end.
    """
    names = unused(docs, "n_deleted", "hit_doc", "hit_key", "spans", "units", "left")
    copies = later_copies(docs.select("doc_id", "text"), run, window, long_words).select(
        F.col("doc_id").alias(names["hit_doc"]),
        F.col("text_key").alias(names["hit_key"]),
        F.col("spans").alias(names["spans"]),
    )
    joined = docs.join(
        copies,
        docs["doc_id"].eqNullSafe(copies[names["hit_doc"]])
        & (_key(docs["doc_id"], docs["text"]) == copies[names["hit_key"]]),
        "left",
    )
    gone = F.flatten(F.transform(names["spans"], lambda x: F.sequence(x["lo"], x["hi"])))
    units = F.when(F.col(names["spans"]).isNotNull(), _units(F.col("text")))
    marked = joined.withColumn(names["units"], units).withColumn(
        names["left"],
        F.array_except(F.sequence(F.lit(0), F.size(names["units"]) - 1), gone),
    )
    left = F.transform(names["left"], lambda i: F.element_at(names["units"], i + 1))
    cut = F.when(F.col(names["left"]).isNull(), F.col("text")).otherwise(F.array_join(left, ""))
    n_deleted = F.when(F.col(names["left"]).isNull(), 0).otherwise(
        F.size(names["units"]) - F.size(names["left"])
    )
    return marked.select(
        *[cut.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        n_deleted.cast("long").alias(names["n_deleted"]),
    )
