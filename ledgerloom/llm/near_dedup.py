"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its runs of five words; two documents are linked if the
weighted Jaccard similarity of these multisets is at least 0.8. Classes are the connected
components of the links.

BagMinHash: every shingle owns a Poisson process for each dyadic range of weights, [0, 1),
[1, 2), [2, 4) and so on, of a rate that is the range's width. A point of a process has an arrival time, a
component of the signature, and a place in its weight range, found by halving the range. A
document with the shingle ``w`` times sees the points whose place lies below ``w``; each
component keeps the earliest arrival it sees. Equal components then estimate the weighted
Jaccard similarity without bias. Points are drawn in time order up to a bound that covers
all components, so most shingles of a long text cost one draw.

Defined cases: null and wordless texts link with nothing. Texts of one to four words are a
single shingle. Rows of equal multisets are one class whatever their number. A row without
doc_id is in no class (class_id null) and kept. Rows of one doc_id are one document as long as
their multisets are equal, else a document each, which has its own class and is kept or not on
its own; every row gives a row. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, running_sum, unused
from ledgerloom.llm.textbytes import WordHasher, Words, batches, mix64, salted, shingles, utf8
from ledgerloom.scratch import Scratch

SHINGLE = 5
SIMILARITY = 0.8
#: 56 bands of 9 components: a pair of similarity 0.8 misses all bands once in 3,100.
BANDS, ROWS = 56, 9
#: Standard deviations below the threshold at which a pair's estimate rules it out.
SIGMAS = 3.0
#: A round of new pivots is followed by another if it links one in so many undecided rows.
WORTH = 50
#: Bits of each component in the sketch that the estimate is made from.
BITS = 4
#: Bytes and texts signed at a time: a process has some thirty numbers a word meanwhile.
SIGN_BYTES, SIGN_TEXTS = 1 << 20, 512


def weighted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(doc, value)`` in order, with their counts."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.concatenate((at, [len(doc)])))


def bag_minhash(
    doc: np.ndarray, value: np.ndarray, count: np.ndarray, n_docs: int, size: int
) -> np.ndarray:
    """Signatures ``(n_docs, size)`` of the multisets ``(doc, value, count)``; empty: infinity."""
    levels = int(count.max()).bit_length() if len(count) else 0
    owner, seed, low, width, upto = [], [], [], [], []
    tags = salted(64, 5)
    for level in range(levels + 1):
        floor = 0 if level == 0 else 1 << (level - 1)
        has = np.flatnonzero(count > floor)
        if not len(has):
            break
        owner.append(doc[has])
        seed.append(mix64(value[has] ^ tags[level]))
        low.append(np.full(len(has), floor))
        width.append(np.full(len(has), max(1, floor)))
        upto.append(count[has])
    signature = np.full(n_docs * size, np.inf)
    if not owner:
        return signature.reshape(n_docs, size)
    owner, seed, low, width, upto = map(np.concatenate, (owner, seed, low, width, upto))
    total = np.bincount(owner, weights=width, minlength=n_docs)
    with np.errstate(divide="ignore"):
        bound = (np.log(size) + 2.0) / total
    # A process is a row of these arrays: its next point has been drawn but not counted yet.
    state = [owner, low, width, upto, seed, np.zeros(len(owner))]
    state = _next_point(state, size)
    rest: list[list[np.ndarray]] = []
    while True:
        while len(state[0]):
            owner, low, width, upto, draw, arrival = state
            early = arrival <= bound[owner]
            rest.append([x[~early] for x in state])
            state = owner, low, width, upto, draw, arrival = [x[early] for x in state]
            bits = mix64(draw ^ np.uint64(0x94D049BB133111EB))
            component = ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
            place = ((bits >> np.uint64(32)) * width.astype(np.uint64)) >> np.uint64(32)
            seen = low + place.astype(np.int64) < upto
            cell = owner * size + component.astype(np.int64)
            np.minimum.at(signature, cell[seen], arrival[seen])
            state = _next_point(state, size)
        signature = signature.reshape(n_docs, size)
        uncovered = np.isinf(signature).any(axis=1) & (total > 0)
        if not uncovered.any():
            return signature
        signature = signature.ravel()
        bound[uncovered] *= 1.5
        state = [np.concatenate(x) for x in zip(*rest)]
        again = uncovered[state[0]]
        state, rest = [x[again] for x in state], []


def _next_point(state: list[np.ndarray], size: int) -> list[np.ndarray]:
    owner, low, width, upto, draw, arrival = state
    draw = draw + np.uint64(0x9E3779B97F4A7C15)
    uniform = ((mix64(draw) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return [owner, low, width, upto, draw, arrival - np.log(uniform) / (width * float(size))]


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of each signature."""
    cells = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    mixed = (mix64(cells) * salted(ROWS, 7)).sum(axis=2, dtype=np.uint64)
    return mix64(mixed ^ salted(BANDS, 9))


def sketches(signature: np.ndarray) -> np.ndarray:
    """BITS bits of each component, 16 components in a 64-bit word."""
    n, size = signature.shape
    words = -(-size // 16)
    low = np.zeros((n, words * 16), dtype=np.uint64)
    low[:, :size] = mix64(signature.view(np.uint64)) & np.uint64(15)
    shifts = (np.arange(16, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return (low.reshape(n, words, 16) << shifts).sum(axis=2, dtype=np.uint64)


def may_reach(similarity: float, left: str, right: str) -> Column:
    """Whether two sketches differ in few enough components for the similarity.

    Components of a pair of that similarity are equal with probability ``p``, by chance of
    BITS bits included; fewer equal ones than SIGMAS deviations below the mean rule it out.
    """
    size = BANDS * ROWS
    p = similarity + (1 - similarity) / 2**BITS
    most = int(size * (1 - p) + SIGMAS * (size * p * (1 - p)) ** 0.5)

    def differing(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        return F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))

    total = F.aggregate(F.zip_with(left, right, differing), F.lit(0), lambda n, x: n + x)
    return total <= most


SIGNED = (
    "doc_id long, text_key binary, bag_a long, bag_b long, n_shingles long,"
    " bands array<long>, sketch array<long>"
)


def _text_key(text: Column) -> Column:
    """128 bits that tell the texts of one doc_id apart."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for frame in frames:
        texts = utf8(frame.column("text"))
        ids, keys = frame.column("doc_id"), frame.column("text_key")
        for lo, hi in batches(texts, SIGN_BYTES, SIGN_TEXTS):
            doc, value = shingles(Words(hasher, texts[lo:hi]), SHINGLE)
            doc, value, count = weighted(doc, value)
            n = hi - lo
            total = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            bag = np.zeros((2, n), dtype=np.uint64)
            for k in range(2):
                scrambled = mix64(value ^ salted(2, 11)[k]) * mix64(count.astype(np.uint64))
                np.add.at(bag[k], doc, scrambled)
            signature = bag_minhash(doc, value, count, n, BANDS * ROWS)
            lists = []
            for table in (band_hashes(signature), sketches(signature)):
                width = table.shape[1]
                offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
                flat = pa.array(table.view(np.int64).ravel())
                lists.append(pa.ListArray.from_arrays(offsets, flat))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, n),
                    keys.slice(lo, n),
                    pa.array(bag[0].view(np.int64)),
                    pa.array(bag[1].view(np.int64)),
                    pa.array(total),
                    *lists,
                ],
                names=["doc_id", "text_key", "bag_a", "bag_b", "n_shingles", "bands", "sketch"],
            )


def multiset_links(threshold: float) -> Callable:
    """Pairs of texts to those whose weighted Jaccard similarity reaches the threshold."""

    def links(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for frame in frames:
            left, right = utf8(frame.column("text_a")), utf8(frame.column("text_b"))
            texts = [t for pair in zip(left, right) for t in pair]
            keep = np.zeros(len(left), dtype=bool)
            at = 0
            while at < len(texts):
                hi, size = at, 0
                while hi < len(texts) and (hi == at or (size < 1 << 21 and hi - at < 256)):
                    size += len(texts[hi]) + len(texts[hi + 1])
                    hi += 2
                doc, value = shingles(Words(hasher, texts[at:hi]), SHINGLE)
                doc, value, count = weighted(doc, value)
                total = np.bincount(doc, weights=count, minlength=hi - at)
                # Values that both texts of a pair hold stand side by side once sorted.
                order = np.lexsort((doc, value, doc // 2))
                d, v, c = doc[order], value[order], count[order]
                both = (d[1:] // 2 == d[:-1] // 2) & (v[1:] == v[:-1])
                shared = np.bincount(
                    (d[1:] // 2)[both],
                    weights=np.minimum(c[1:], c[:-1])[both],
                    minlength=(hi - at) // 2,
                )
                union = total[0::2] + total[1::2] - shared
                keep[at // 2 : hi // 2] = (union > 0) & (shared >= threshold * union - 1e-9)
                at = hi
            kept = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays(
                [frame.column("a").take(kept), frame.column("b").take(kept)], names=["a", "b"]
            )

    return links


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, class_id, kept)`` for each row of ``docs(doc_id, text)``."""
    return _judged(docs, similarity).select("doc_id", "class_id", "kept")


def _judged(docs: DataFrame, similarity: float) -> DataFrame:
    """``near_duplicates`` with what tells the rows of one doc_id apart: text_key, bag_a, bag_b.

    Equal multisets fall into one class first, and one of each goes on, its head. Heads are
    numbered by doc_id, so that multisets of one doc_id stay apart. In a band's bucket all
    members are compared with one pivot, the member that meets most others over all bands: each
    head first with the one of its pivots that meets most, then with those that it is not in one
    component with yet. Links found make components. A bucket that still holds several gets a new pivot outside
    its largest one, with which all of its other components are compared, and so on, as long as
    that links enough to be worth a round. What is left are pairs of different components in one
    bucket: members outside the bucket's largest component meet those of the other
    components, each pair in the first bucket that it shares, and pairs whose sketches leave a
    similarity that high possible are compared.
    So a group of n copies costs about n comparisons a round, and yet no pair of a bucket stays
    undecided.
    """
    scratch = Scratch(docs.sparkSession, "near")
    keyed = docs.select("doc_id", "text", _text_key(F.col("text")).alias("text_key"))
    signed, _ = scratch.keep(keyed.mapInArrow(sign, SIGNED), "signed")
    bagged = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    bags = bagged.groupBy("bag_a", "bag_b").agg(F.min("doc_id").alias("first_id"))
    numbered = running_sum(
        scratch,
        bags.select("bag_a", "bag_b", "first_id", F.lit(1).alias("one"), F.lit(0).alias("all")),
        "bags",
        "all",
        [F.col("first_id"), F.col("bag_a"), F.col("bag_b")],
        "one",
    )
    heads, _ = scratch.keep(
        numbered.select("bag_a", "bag_b", "first_id", F.col("before").alias("head")), "heads"
    )
    # One row for each head: its own bands.
    own = bagged.join(
        heads.withColumnRenamed("first_id", "doc_id"), ["bag_a", "bag_b", "doc_id"]
    )
    cells = own.select("head", F.posexplode("bands").alias("band", "bucket"))
    cells = cells.select("head", F.xxhash64("band", "bucket").alias("bucket")).distinct()
    crowded = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared, _ = scratch.keep(cells.join(crowded, "bucket"), "shared")

    met = shared.groupBy("head").agg(F.sum("n").alias("met"))
    pivots = (
        shared.join(met, "head")
        .groupBy("bucket")
        .agg(F.max(F.struct("met", (-F.col("head")).alias("minus"))).alias("top"))
        .select("bucket", (-F.col("top.minus")).alias("pivot"), F.col("top.met").alias("pivot_met"))
    )
    pivoted, _ = scratch.keep(shared.join(pivots, "bucket").drop("n"), "pivoted")
    first = pivoted.filter("head <> pivot").select(
        F.least("head", "pivot").alias("a"), F.greatest("head", "pivot").alias("b")
    )
    first, _ = scratch.keep(first.distinct(), "pairs-1")
    # Each head's pivot that meets most: the one pair that links most copies.
    best = F.max(F.struct("pivot_met", (-F.col("pivot")).alias("minus"))).alias("top")
    nearest = pivoted.filter("head <> pivot").groupBy("head").agg(best)
    nearest = nearest.select("head", (-F.col("top.minus")).alias("pivot")).select(
        F.least("head", "pivot").alias("a"), F.greatest("head", "pivot").alias("b")
    )
    nearest, _ = scratch.keep(nearest.distinct(), "pairs-0")
    candidates = pivoted.select("head").distinct()
    places = own.groupBy("head", "doc_id").agg(F.min("text_key").alias("text_key"))
    texts, _ = scratch.keep(
        keyed.join(places.join(candidates, "head"), ["doc_id", "text_key"])
        .dropDuplicates(["head"])
        .select("head", "text"),
        "texts",
    )
    links_0, _ = scratch.keep(_verified(texts, nearest, similarity), "links-0")
    labels = components(scratch, links_0, "nearest")
    # Pairs that are of one component by now cannot join any others.
    others = _apart(first.join(nearest, ["a", "b"], "left_anti"), labels).select("a", "b")
    others, _ = scratch.keep(others, "pairs-others")
    links_1, _ = scratch.keep(_verified(texts, others, similarity), "links-1")
    labels = _merged(scratch, labels, links_1, "first")
    compared = nearest.unionByName(others)

    sketches = own.select("head", "sketch").dropDuplicates(["head"])
    turn = 1
    while True:
        divided, n_divided = _divided(scratch, pivoted, labels, sketches, f"divided-{turn}")
        turn += 1
        pairs = _next_pivots(divided, similarity).join(compared, ["a", "b"], "left_anti")
        pairs, _ = scratch.keep(pairs, f"pairs-pivot-{turn}")
        fresh, n_fresh = scratch.keep(_verified(texts, pairs, similarity), f"links-pivot-{turn}")
        compared = compared.unionByName(pairs)
        if not n_fresh:
            break
        labels = _merged(scratch, labels, fresh, f"pivot-{turn}")
        if n_fresh * WORTH < n_divided:
            divided, _ = _divided(scratch, pivoted, labels, sketches, f"divided-{turn}")
            break
    # At most BANDS buckets a head.
    lists = divided.groupBy("head").agg(F.collect_list("bucket").alias("buckets"))
    placed, _ = scratch.keep(divided.join(lists, "head"), "placed")
    second = _unmet(placed, similarity).join(compared, ["a", "b"], "left_anti")
    second, _ = scratch.keep(second, "pairs-2")
    links_2, n_more = scratch.keep(_verified(texts, second, similarity), "links-2")
    if n_more:
        labels = _merged(scratch, labels, links_2, "second")
    top = heads.select(F.col("head").alias("component"), F.col("first_id").alias("class_id"))
    classes = (
        heads.join(labels.withColumnRenamed("node", "head"), "head", "left")
        .withColumn("component", F.coalesce("component", "head"))
        .join(top, "component")
        .select(
            "bag_a",
            "bag_b",
            "first_id",
            "class_id",
            (F.col("head") == F.col("component")).alias("ahead"),
        )
    )
    classed = bagged.select("doc_id", "text_key", "bag_a", "bag_b").join(classes, ["bag_a", "bag_b"])
    classed = classed.select(
        "doc_id",
        "text_key",
        "bag_a",
        "bag_b",
        "class_id",
        (F.col("ahead") & (F.col("doc_id") == F.col("first_id"))).alias("kept"),
    )
    free = signed.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0))
    return classed.unionByName(
        free.select(
            "doc_id",
            "text_key",
            "bag_a",
            "bag_b",
            F.col("doc_id").alias("class_id"),
            F.lit(True).alias("kept"),
        )
    )


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b, of_a, of_b``: the pairs of different components, and these."""
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    return (
        pairs.join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
        .filter("of_a <> of_b")
    )


def _merged(scratch: Scratch, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The labels after more links: those between the same components are one edge, and a node
    has one edge to its component, however many links it has."""
    between = _apart(links, labels).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    own = labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(scratch, own.unionByName(between), name)


def _divided(
    scratch: Scratch, pivoted: DataFrame, labels: DataFrame, sketches: DataFrame, name: str
) -> tuple[DataFrame, int]:
    """``bucket, head, component, largest, sketch`` of buckets with several components, less the
    first pivots, which have met all others."""
    labelled = pivoted.join(labels.withColumnRenamed("node", "head"), "head", "left").select(
        "bucket", "head", "pivot", F.coalesce("component", "head").alias("component")
    )
    groups, _ = scratch.keep(
        labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")), f"{name}-groups"
    )
    largest = (
        groups.groupBy("bucket")
        .agg(
            F.max(F.struct("n", "component")).alias("top"),
            F.count(F.lit(1)).alias("n_components"),
        )
        .filter("n_components > 1")
        .select("bucket", F.col("top.component").alias("largest"))
    )
    divided = (
        labelled.join(largest, "bucket").filter("head <> pivot").drop("pivot").join(sketches, "head")
    )
    return scratch.keep(divided, name)


def _next_pivots(divided: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of each bucket's new pivot, the first by hash outside of the largest
    component, with the members of other components that may be similar enough."""
    order = F.struct(F.xxhash64("head").alias("rank"), "head", "component", "sketch")
    pivots = (
        divided.filter("component <> largest")
        .groupBy("bucket")
        .agg(F.min(order).alias("p"))
        .select(
            "bucket",
            F.col("p.head").alias("x"),
            F.col("p.component").alias("cx"),
            F.col("p.sketch").alias("sx"),
        )
    )
    return (
        divided.join(pivots, "bucket")
        .filter((F.col("component") != F.col("cx")) & may_reach(similarity, "sketch", "sx"))
        .select(F.least("head", "x").alias("a"), F.greatest("head", "x").alias("b"))
        .distinct()
    )


def _unmet(placed: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of different components of a bucket that may be similar enough, each once.

    ``placed`` has ``buckets``, all of a head's in it. Copies share most of their buckets: a pair is made in the first
    one that both have, by the member outside of the bucket's largest component, the smaller of two such.
    """
    minor = placed.filter("component <> largest").select(
        "bucket",
        F.col("head").alias("x"),
        F.col("component").alias("cx"),
        F.col("sketch").alias("sx"),
        F.col("buckets").alias("bx"),
    )
    met_first = F.array_min(F.array_intersect("buckets", "bx")) == F.col("bucket")
    return (
        minor.join(placed, "bucket")
        .filter(
            (F.col("component") != F.col("cx"))
            & ((F.col("component") == F.col("largest")) | (F.col("head") > F.col("x")))
            & met_first
            & may_reach(similarity, "sketch", "sx")
        )
        .select(F.least("head", "x").alias("a"), F.greatest("head", "x").alias("b"))
    )


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    left = texts.select(F.col("head").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("head").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(multiset_links(similarity), "a long, b long")
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of the smallest doc_id; rows without id all stay."""
    kept = _judged(docs.select("doc_id", "text"), similarity).filter("kept and doc_id is not null")
    names = unused(docs, "kept_id", "kept_key")
    # Dealt anew, so that the join on multisets may split a hot one. Rows of one document may
    # differ in their spaces: one text of them stays.
    kept = kept.repartition("doc_id").groupBy(F.col("doc_id").alias(names["kept_id"]), "bag_a", "bag_b").agg(
        F.min("text_key").alias(names["kept_key"])
    )
    keyed = docs.filter("doc_id is not null").withColumn(
        names["kept_key"], _text_key(F.col("text"))
    )
    keyed = keyed.dropDuplicates(["doc_id", names["kept_key"]])
    same = (keyed["doc_id"] == kept[names["kept_id"]]) & (
        keyed[names["kept_key"]] == kept[names["kept_key"]]
    )
    named = keyed.join(kept, same, "left_semi").select(*docs.columns)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
