"""Prefix trie of conversations, as adaptive radix trees over turn ids.

A turn has an id of fixed width: the first 16 bytes of SHA-256 over role and text, then the
text's code points as 4 bytes, all big-endian. A conversation's key is the ids of its turns in
a row. Every task holds adaptive radix trees of a bounded number of turns: inner nodes grow
from 4 to 16, 48 and 256 places, a path without branches is one node with its bytes, and only
depths that are whole turns give nodes of the result, also those inside a path.

Keys are dealt by range and sorted, so a node's members lie next to each other. Each tree knows
the key before its first and the key after its last: nodes shared with a neighbour come out as
partial sums, all others as they are. Partial sums meet by a digest of the node's path. A node
is *new* in the tree in which its first member lies, which makes all figures additive. However
many copies a conversation has, they are folded to pieces of some ids before they meet.

Two turns count as equal when role, text length and 128 bits of SHA-256 are. One cell holds the
key of a conversation: 20 bytes for each turn.

Defined cases: null role or text is empty. Turns are in the order of ``turn``, null first, ties by
turn id; repeated rows are turns of their own. Rows without conv_id are left out. An empty table
has no nodes, not even a root. Texts are used whole; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch

WIDTH = 20
SIZE_BYTES = 4
FAMILY = 100
SHARED = 6
#: Ids of members in one row; turns in one tree; rows in one batch.
PIECE = 2048
TREE_TURNS = 50_000
ROWS = 5_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


# -- keys ---------------------------------------------------------------------------------


def turn_id(role: Column, text: Column) -> Column:
    """The id as hexadecimal text; the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    size = F.lpad(F.hex(F.length(text).cast("long")), 2 * SIZE_BYTES, "0")
    return F.concat(F.substring(F.sha2(spelled, 256), 1, 2 * (WIDTH - SIZE_BYTES)), size)


def conversation_keys(conversations: DataFrame) -> DataFrame:
    """``(conv_id, ids)``: turn ids in order, one row for each conversation."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", F.struct("turn", turn_id(F.col("role"), F.col("text")).alias("id")).alias("t")
    )
    in_order = F.sort_array(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.transform(in_order, lambda t: t["id"]).alias("ids"))


def rebuilt_keys(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """``(conv_id, key)``: the family's first turns, then the conversation's own later ones."""
    own, _ = scratch.keep(conversation_keys(conversations), "own")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("ids", 1, SHARED - 1).alias("head")
    )
    taken = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    none = F.array().cast("array<string>")
    ids = F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), taken),
        F.slice("ids", taken + 1, F.size("ids")),
    )
    return (
        own.withColumn("family", family)
        .join(heads, "family", "left")
        .select("conv_id", F.unhex(F.array_join(ids, "")).alias("key"))
    )


# -- adaptive radix tree ------------------------------------------------------------------


class Few:
    """Up to 4, then 16 children: their bytes in a row."""

    __slots__ = ("bytes", "kids", "room")

    def __init__(self):
        self.bytes, self.kids, self.room = bytearray(), [], 4

    def find(self, byte: int):
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def add(self, byte: int, kid):
        if len(self.kids) == self.room:
            if self.room == 16:
                return Indexed(self).add(byte, kid)
            self.room = 16
        self.bytes.append(byte)
        self.kids.append(kid)
        return self

    def ordered(self) -> list:
        return [kid for _, kid in sorted(zip(self.bytes, self.kids), key=lambda x: x[0])]


class Indexed:
    """Up to 48 children behind an index of all bytes."""

    __slots__ = ("index", "kids")
    FREE = 255

    def __init__(self, few: Few):
        self.index, self.kids = bytearray([self.FREE]) * 256, []
        for byte, kid in zip(few.bytes, few.kids):
            self.add(byte, kid)

    def find(self, byte: int):
        at = self.index[byte]
        return None if at == self.FREE else self.kids[at]

    def add(self, byte: int, kid):
        if len(self.kids) == 48:
            return Full(self).add(byte, kid)
        self.index[byte] = len(self.kids)
        self.kids.append(kid)
        return self

    def ordered(self) -> list:
        return [self.kids[at] for at in self.index if at != self.FREE]


class Full:
    """A place for each byte."""

    __slots__ = ("kids",)

    def __init__(self, indexed: Indexed):
        self.kids = [indexed.find(byte) for byte in range(256)]

    def find(self, byte: int):
        return self.kids[byte]

    def add(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def ordered(self) -> list:
        return [kid for kid in self.kids if kid is not None]


class Node:
    """``path``: the bytes from the node above; ``entry``: what ends here."""

    __slots__ = ("path", "entry", "kids")

    def __init__(self, path: bytes, entry=None):
        self.path, self.entry, self.kids = path, entry, Few()


def common_bytes(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def insert(root: Node, key: bytes, entry) -> None:
    node, at = root, 0
    while True:
        path = node.path
        if not key.startswith(path, at):
            shared = common_bytes(path, key[at : at + len(path)])
            below = Node(path[shared:], node.entry)
            below.kids = node.kids
            node.path, node.entry, node.kids = path[:shared], None, Few()
            node.kids = node.kids.add(below.path[0], below)
            path = node.path
        at += len(path)
        if at == len(key):
            node.entry = entry
            return
        kid = node.kids.find(key[at])
        if kid is None:
            node.kids = node.kids.add(key[at], Node(key[at:], entry))
            return
        node = kid


# -- members of each key ------------------------------------------------------------------

RUNS = "part long, kind int, key binary, first_id long, n long, ids string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, conv_id)`` to rows of some members of one key."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    rows: list[tuple] = []
    key, ids = None, []

    def closed() -> tuple:
        return part, 1, key, ids[0], len(ids), ",".join(map(str, ids))

    for batch in batches:
        for its_key, conv_id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (its_key != key or len(ids) == PIECE):
                rows.append(closed())
                ids = []
            key = its_key
            ids.append(conv_id)
        if len(rows) >= ROWS:
            yield _batch(rows, RUNS)
            rows = []
    if ids:
        rows.append(closed())
    yield _batch(rows, RUNS)


ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "binary": pa.binary(),
    "string": pa.string(),
}


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in fields.split(", ")))
    columns = zip(*rows) if rows else [[] for _ in names]
    arrays = [pa.array(list(c), ARROW[k]) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


# -- nodes of one tree --------------------------------------------------------------------

NODES = (
    "kind int, digest binary, parent binary, conv_id long, parent_conv_id long, depth long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, first_id long, ids string"
)
#: Kinds of rows: whole nodes, partial nodes, members of a key that has some in two parts.
WHOLE, PARTIAL, MEMBERS = 0, 1, 2


class Entry:
    """A key's members in this part: pieces of their ids in order."""

    __slots__ = ("key", "first_id", "n", "pieces")

    def __init__(self, key: bytes, first_id: int):
        self.key, self.first_id, self.n, self.pieces = key, first_id, 0, []

    def add(self, first_id: int, n: int, ids: str) -> None:
        self.n += n
        self.pieces.append((first_id, n, ids))

    def ends(self) -> str:
        state = hashlib.sha256()
        for k, (_, _, ids) in enumerate(self.pieces):
            state.update(("," if k else "").encode() + ids.encode())
        return state.hexdigest()


def _digests(key: bytes, upto: int) -> dict[int, bytes]:
    """Digests of the path at each whole turn, as far as it is shared."""
    state = hashlib.sha256()
    found = {0: state.digest()[:16]}
    for end in range(WIDTH, upto + 1, WIDTH):
        state.update(key[end - WIDTH : end])
        found[end] = state.digest()[:16]
    return found


def tree_rows(entries: list[Entry], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """Rows of ``NODES`` for sorted distinct keys, given the keys around them.

    Nodes are visited from the deepest up. What a node hands to the one above: members, the
    smallest one, leaves, saved tokens, children that are new, and rows that wait for the
    id of their parent.
    """
    root = Node(b"")
    for entry in entries:
        insert(root, entry.key, entry)
    first, last = entries[0].key, entries[-1].key
    shared_left = -1 if before is None else common_bytes(before, first) // WIDTH * WIDTH
    shared_right = -1 if after is None else common_bytes(after, last) // WIDTH * WIDTH
    left_digests = _digests(first, shared_left)
    right_digests = _digests(last, shared_right)

    visits: list[tuple] = []
    stack = [(root, -1, 0, True, True, -1)]
    while stack:
        node, start, end, left, right, above = stack.pop()
        me, kids = len(visits), node.kids.ordered()
        visits.append((node, start, end, left, right, above, len(kids)))
        for k, kid in enumerate(kids):
            stack.append(
                (
                    kid,
                    end,
                    end + len(kid.path),
                    left and k == 0 and node.entry is None,
                    right and k == len(kids) - 1,
                    me,
                )
            )
    # Members, smallest member, leaves, saved, new children, waiting rows, some key below.
    sums: list[list] = [[0, None, 0, 0, 0, [], None] for _ in visits]
    for me in range(len(visits) - 1, -1, -1):
        node, start, end, left, right, above, n_kids = visits[me]
        n, least, leaves, saved, fresh, waiting, key = sums[me]
        sums[me] = None
        entry = node.entry
        ends: str | None = NO_ENDS
        if entry is not None:
            key = entry.key
            n += entry.n
            least = entry.first_id if least is None else min(least, entry.first_id)
            extended = right and not n_kids and after is not None and after.startswith(key)
            leaves += not n_kids and not extended
            if key == before or key == after:
                ends = None
                for first_id, k, ids in entry.pieces:
                    digest = left_digests[end] if key == before else right_digests[end]
                    yield MEMBERS, digest, None, None, None, None, k, None, None, None, None, first_id, ids
            else:
                ends = entry.ends()
        place = end // WIDTH * WIDTH
        while place > start:
            by_left, by_right = left and place <= shared_left, right and place <= shared_right
            if place:
                size = int.from_bytes(key[place - SIZE_BYTES : place], "big")
                saved += (n - (not by_left)) * size
            here = ends if place == end else NO_ENDS
            if by_left or by_right:
                digests = left_digests if by_left else right_digests
                digest, parent = digests[place], digests.get(place - WIDTH)
                yield (
                    PARTIAL, digest, parent, least, None, place // WIDTH,
                    n, fresh, leaves, saved, None if entry is None or place < end else ends, None, None,
                )
                for row in waiting:
                    yield (WHOLE, None, digest, row[0], None, *row[1:], None, None)
                waiting, fresh = [], int(not by_left)
            else:
                for row in waiting:
                    yield (WHOLE, None, None, row[0], least, *row[1:], None, None)
                waiting = [(least, place // WIDTH, n, fresh, leaves, saved, here)]
                fresh = 1
            place -= WIDTH
        if above < 0:
            for row in waiting:
                yield (WHOLE, None, None, row[0], None, *row[1:], None, None)
            continue
        up = sums[above]
        up[0] += n
        up[1] = least if up[1] is None else min(up[1], least)
        up[2] += leaves
        up[3] += saved
        up[4] += fresh
        # The longer list takes the shorter one.
        up[5] = up[5] + waiting if len(up[5]) < len(waiting) else _extended(up[5], waiting)
        up[6] = key


def _extended(rows: list, more: list) -> list:
    rows.extend(more)
    return rows


def _trees(tree_turns: int) -> Callable:
    """Rows of parts, sorted, to rows of nodes; a part's trees follow each other."""

    def part_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
        before, after = None, None
        entries: list[Entry] = []
        turns = 0
        for kind, key, first_id, n, ids in rows:
            if kind == 0:
                before = key
            elif kind == 2:
                after = key
            elif entries and entries[-1].key == key:
                entries[-1].add(first_id, n, ids)
            else:
                if turns >= tree_turns:
                    yield from tree_rows(entries, before, key)
                    before, entries, turns = entries[-1].key, [], 0
                entries.append(Entry(key, first_id))
                entries[-1].add(first_id, n, ids)
                turns += 1 + len(key) // WIDTH
        if entries:
            yield from tree_rows(entries, before, after)

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "kind", "key", "first_id", "n", "ids")]
            for part, *row in zip(*columns):
                yield part, tuple(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = by_part(batches)
        held = next(stream, None)
        rows: list[tuple] = []
        while held is not None:
            part = held[0]

            def of_part() -> Iterator[tuple]:
                nonlocal held
                while held is not None and held[0] == part:
                    row = held[1]
                    held = next(stream, None)
                    yield row

            for row in part_rows(of_part()):
                rows.append(row)
                if len(rows) >= ROWS:
                    yield _batch(rows, NODES)
                    rows = []
        yield _batch(rows, NODES)

    return run


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of members to one digest for each node."""
    node, state, rows = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if digest != node:
                if state is not None:
                    rows.append((node, state.hexdigest()))
                node, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        rows.append((node, state.hexdigest()))
    yield _batch(rows, "digest binary, joined string")


# -- the whole trie -----------------------------------------------------------------------


def trie(keys: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """Nodes of the trie of ``(conv_id, key)``, one row each; ids must not repeat."""
    scratch = Scratch(keys.sparkSession, "trie")
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, _ = scratch.keep(keys.select("conv_id", "key"), "keys")
    dealt = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs, _ = scratch.keep(dealt.mapInArrow(_runs, RUNS), "runs")
    # One row a part: the last key of the part before, the first key of the one after.
    fences = runs.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    by_part = Window.orderBy("part")
    around = fences.select(
        "part", F.lag("high").over(by_part).alias("before"), F.lead("low").over(by_part).alias("after")
    )
    none = F.lit(None).cast("long")
    guards = around.select(
        "part",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("before").alias("key")),
                F.struct(F.lit(2).alias("kind"), F.col("after").alias("key")),
            )
        ).alias("g"),
    ).filter("g.key IS NOT NULL")
    guards = guards.select(
        "part", "g.kind", "g.key", none.alias("first_id"), none.alias("n"),
        F.lit(None).cast("string").alias("ids"),
    )
    streamed = (
        runs.unionByName(guards)
        .repartition(parts, "part")
        .sortWithinPartitions("part", "kind", "key", "first_id")
    )
    nodes, _ = scratch.keep(streamed.mapInArrow(_trees(tree_turns), NODES), "nodes")
    members = (
        nodes.filter(F.col("kind") == MEMBERS)
        .select("digest", "first_id", "ids")
        .repartition("digest")
        .sortWithinPartitions("digest", "first_id")
        .mapInArrow(_joined_ends, "digest binary, joined string")
    )
    merged = (
        nodes.filter(F.col("kind") == PARTIAL)
        .groupBy("digest")
        .agg(
            F.max("parent").alias("parent"),
            F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends").alias("ends"),
        )
        .join(members, "digest", "left")
    )
    merged, _ = scratch.keep(merged, "merged")
    parents = merged.select(F.col("digest").alias("parent"), F.col("conv_id").alias("_above"))
    columns = ("depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    whole = nodes.filter(F.col("kind") == WHOLE)
    known = whole.filter("parent IS NULL").withColumn("_above", F.col("parent_conv_id"))
    waiting = whole.filter("parent IS NOT NULL").join(parents, "parent", "left")
    shared = merged.withColumn(
        "ends", F.coalesce("ends", "joined", F.lit(NO_ENDS))
    ).join(parents, "parent", "left")
    found = [
        t.select(
            "conv_id", "depth", F.col("_above").alias("parent_conv_id"), *columns[1:],
            F.col("ends").alias("ends_sha256"),
        )
        for t in (known, waiting, shared)
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def conversation_trie(conversations: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)`` of the trie of the rebuilt conversations."""
    scratch = Scratch(conversations.sparkSession, "conversations")
    return trie(rebuilt_keys(scratch, conversations), tree_turns)
