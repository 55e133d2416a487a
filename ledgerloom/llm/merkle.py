"""Merkle manifest of a corpus with a witness for each document.

A leaf is the SHA-256 of a document's fields. Leaves of a source, in the order of doc_id, are
joined three by three, level by level, to the source's subroot; subroots, in the order of source,
likewise to the root. A digest goes into the next one as lowercase hexadecimal text.

Leaves are appended in order, each with an empty witness. As soon as a run of three is complete,
the witnesses below each member are extended by the digests of the other two, and the run is
one further node of the level above. A block of 3^7 leaves, aligned to its place in the
source, is appended by one task; block roots are appends of the next round, in blocks again,
until every source has one root, and the sources' roots go the same way. At last the witnesses
of blocks are put behind those of what they hold, from the top down. So no task holds more than
a block, whatever a source's share of the rows, and texts are hashed where they are read.

A witness is a row of steps, one for each level: a byte ``3 * place + others`` and the 32 bytes of
each other digest of the run, in order.

Defined cases: null fields are hashed as ``-``, null sources are a source of their own and come
first, null doc_ids come first in their source. Rows of one doc_id are ordered by their
leaves; repeated rows are leaves of their own, so that which of two equal rows has which of the
two witnesses does not show. An empty table has no leaves and no root. Very long texts are hashed
whole; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import running_sum
from ledgerloom.scratch import Scratch

ARITY = 3
LEVELS = 7
SPAN = ARITY**LEVELS
ROWS = 4_096


# -- leaves -------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    spelled = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(spelled, F.lit("-"))


def leaf(text: Column) -> Column:
    """32 bytes; ``text`` may be another text than the row's own."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def joined(digests: list[bytes]) -> bytes:
    """The digest of a run."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


# -- streaming append ---------------------------------------------------------------------


class Appended:
    """Open subtrees by level, each with the witnesses of what it holds."""

    def __init__(self):
        self.open: list[list[tuple[bytes, list[bytearray]]]] = [[]]
        self.n = [0]

    def append(self, digest: bytes, witness: bytearray) -> None:
        self._push(0, digest, [witness])

    def _push(self, level: int, digest: bytes, below: list[bytearray]) -> None:
        if level == len(self.open):
            self.open.append([])
            self.n.append(0)
        self.open[level].append((digest, below))
        self.n[level] += 1
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """Join the open run of a level: its members' witnesses learn their siblings."""
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _ in run]
        held: list[bytearray] = []
        for place, (_, below) in enumerate(run):
            others = digests[:place] + digests[place + 1 :]
            step = bytes([ARITY * place + len(others)]) + b"".join(others)
            for witness in below:
                witness += step
            held += below
        self._push(level + 1, joined(digests), held)

    def root(self, levels: int | None) -> bytes:
        """The digest at ``levels``, or of the one node that remains if that is ``None``."""
        level = 0
        while level < levels if levels is not None else self.n[level] > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


BLOCKS = (
    "top boolean, grp string, block long, idx long, doc_id long, digest binary, claimed binary, witness binary"
)
ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in fields.split(", ")))
    columns = zip(*rows) if rows else [[] for _ in names]
    arrays = [pa.array(list(c), ARROW[k]) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _blocks(levels: int) -> Callable:
    """Sorted nodes to the same with witnesses inside their block, and a row for each block.

    A first block that is not full is its source's only one: it ends where one node remains.
    All others are as deep as a full one.
    """
    span = ARITY**levels

    def closed(key: tuple, rows: list[tuple], tree: Appended) -> Iterator[tuple]:
        alone = key[1] == 0 and len(rows) < span
        root = tree.root(None if alone else levels)
        for row in rows:
            yield (False, *key, *row[:-1], bytes(row[-1]))
        yield True, *key, None, None, root, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], Appended()
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "block", "idx", "doc_id", "digest", "claimed")]
            for group, block, idx, doc_id, digest, claimed in zip(*columns):
                if (group, block) != key:
                    if held:
                        out += closed(key, held, tree)
                    key, held, tree = (group, block), [], Appended()
                witness = bytearray()
                tree.append(digest, witness)
                held.append((idx, doc_id, digest, claimed, witness))
                if len(out) >= ROWS:
                    yield _batch(out, BLOCKS)
                    out = []
        if held:
            out += closed(key, held, tree)
        yield _batch(out, BLOCKS)

    return run


def _rounds(scratch: Scratch, nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """Blocks, then blocks of block roots, until each group has one root.

    ``nodes`` has ``grp, idx, doc_id, digest, claimed``. The last of the returned tables has
    one block for each group, with its root.
    """
    found: list[DataFrame] = []
    more = True
    while more:
        blocked = (
            nodes.withColumn("block", F.expr(f"idx div {ARITY**levels}"))
            .repartition("grp", "block")
            .sortWithinPartitions("grp", "block", "idx")
        )
        made = blocked.mapInArrow(_blocks(levels), BLOCKS)
        file = f"{name}-{len(found)}"
        last = scratch.write(made, file, last=F.max("block"))["last"]
        table = scratch.read(made.schema, file)
        found.append(table)
        more = bool(last)
        nodes = table.filter("top").select(
            "grp", F.col("block").alias("idx"), "doc_id", "digest", "claimed"
        )
    return found


def _outwards(scratch: Scratch, rounds: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
    """Nodes of the first round with whole witnesses.

    ``top`` has, for each group, ``grp, above, subroot, root``: the steps behind the group's
    root, which digest that is, and the last one of all.
    """
    above = top.withColumn("at", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        held = rounds[k].filter("NOT top")
        outer = above.withColumnRenamed("grp", "_grp")
        held = held.join(outer, (F.col("grp") == F.col("_grp")) & (F.col("block") == F.col("at")))
        steps = F.concat("witness", "above")
        if k:
            above, _ = scratch.keep(
                held.select("grp", F.col("idx").alias("at"), steps.alias("above"), "subroot", "root"),
                f"{name}-above-{k}",
            )
    return held.select(
        "grp", "idx", "doc_id", "digest", "claimed", steps.alias("witness"), "subroot", "root"
    )


def manifest(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, source, leaf, subroot, root, witness, claimed)`` for each row of ``docs``.

    Digests are 32 bytes. ``claimed`` is a text column; where that differs from the text, its
    leaf comes along in a column of that name, else null. Blocks have ``3 ** levels`` nodes.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    own = leaf(F.col("text"))
    other = F.lit(None).cast("binary")
    if claimed is not None:
        other = F.when(~claimed.eqNullSafe(F.col("text")), leaf(claimed))
    # A null source is before all others, also before an empty one.
    group = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    leaves = docs.select(
        group.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("digest"),
        other.alias("claimed"), F.lit(1).cast("long").alias("one"),
    )
    leaves, _ = scratch.keep(leaves, "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    placed = running_sum(scratch, leaves, "sorted", "grp", order, "one")
    below = _rounds(scratch, placed.withColumnRenamed("before", "idx"), "leaves", levels)
    none = F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("claimed")
    sources = below[-1].filter("top").select(
        F.lit("").alias("all"), "grp", "digest", F.lit(1).cast("long").alias("one")
    )
    ranked = running_sum(scratch, sources, "sources", "all", [F.col("grp")], "one")
    ranked, _ = scratch.keep(ranked.withColumnRenamed("before", "idx"), "ranked")
    upper = _rounds(
        scratch, ranked.select(F.col("all").alias("grp"), "idx", none[0], "digest", none[1]), "roots", levels
    )
    root = upper[-1].filter("top").select(
        "grp", F.lit(b"").alias("above"), F.col("digest").alias("subroot"), F.col("digest").alias("root")
    )
    of_sources = _outwards(scratch, upper, root, "roots").select(
        "idx", F.col("digest").alias("subroot"), F.col("witness").alias("above"), "root"
    )
    top = ranked.select("grp", "idx").join(of_sources, "idx").select("grp", "above", "subroot", "root")
    top, _ = scratch.keep(top, "top")
    whole = _outwards(scratch, below, top, "leaves")
    source = F.when(F.col("grp") != "-", F.substring("grp", F.lit(2), F.length("grp")))
    return whole.select(
        "doc_id", source.alias("source"), F.col("digest").alias("leaf"), "subroot", "root", "witness", "claimed"
    )


# -- proofs -------------------------------------------------------------------------------


def steps(witness: bytes) -> Iterator[tuple[int, str]]:
    """Place in the run, and the hexadecimal text of the others, level by level."""
    at = 0
    while at < len(witness):
        place, others = divmod(witness[at], ARITY)
        end = at + 1 + 32 * others
        yield place, witness[at + 1 : end].hex()
        at = end


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for place, others in steps(witness):
        cut = 64 * place
        digest = hashlib.sha256(f"{others[:cut]}{digest.hex()}{others[cut:]}".encode()).digest()
    return digest


PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "leaf", "subroot", "root", "witness", "claimed")
    for batch in batches:
        rows = []
        for doc_id, own, subroot, root, witness, claimed in zip(
            *[batch.column(c).to_pylist() for c in names]
        ):
            siblings = "".join(others for _, others in steps(witness))
            folded = fold(own if claimed is None else claimed, witness)
            proof = hashlib.sha256(siblings.encode()).hexdigest()
            rows.append((doc_id, own.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root))
        yield _batch(rows, PROOFS)


def proofs(manifested: DataFrame) -> DataFrame:
    """Digests as text, the digest of each witness's siblings, and the root that the claimed
    leaf (else the own one) leads to."""
    columns = ("doc_id", "leaf", "subroot", "root", "witness", "claimed")
    return manifested.select(*columns).mapInArrow(_proofs, PROOFS)


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """Proofs where documents with an even CRC-32 of doc_id have lost their line feeds."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    cut = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return proofs(manifest(docs, cut))
