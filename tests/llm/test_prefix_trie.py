"""The conversation trie against a plain one, and the radix tree on its own."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from ledgerloom.llm import prefix_trie

FIELDS = "conv_id long, turn long, role string, text string, digest string, part int, key string"


def plain_trie(rows):
    """Rows of the result from ``(conv_id, turn, role, text)``."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            spelled = f"{len(role)}:{role}{text}".encode()
            identity = hashlib.sha256(spelled).digest()[:16] + len(text).to_bytes(4, "big")
            turns[conv_id].append((turn is not None, turn or 0, identity, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(math.fmod(c, 100))  # the remainder has the sign of c, as in SQL
        path = tuple(own.get(family, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        size = len(path[-1][1]) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = (len(members[path]) - 1) * size + sum(saved[k] for k in kids[path])
    return sorted(
        (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]),
            leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest(),
        )
        for p in members
    )


def result(df):
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: (r[0], r[1]))


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], FIELDS)


def some_rows(seed, n=240):
    """Few different turns, long copies of one conversation, families with and without a head."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), n):
        if rng.random() < 0.3:
            path = [("user", "hot"), ("assistant", "same é"), ("user", "end")]
        else:
            path = [(rng.choice("ab"), "x" * rng.randrange(3)) for _ in range(rng.randrange(7))]
        rows += [(c, t, *turn) for t, turn in enumerate(path)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tree_turns", [1, 7, 100_000])
def test_nodes_equal_a_plain_trie(spark, tree_turns):
    rows = some_rows(tree_turns)
    got = result(prefix_trie.conversation_trie(make(spark, rows), tree_turns))
    assert got == plain_trie(rows)


def test_members_of_one_key_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "user", text) for c in range(1, 100) for t, text in enumerate(["a", "b"])]
    rows += [(100 + c, t, "user", text) for c in range(60) for t, text in enumerate("cdefgh"[: c % 7])]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = result(prefix_trie.conversation_trie(make(spark, rows), 4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == plain_trie(rows)


def test_odd_rows(spark):
    long = "é" * 300_000
    rows = [
        (None, 0, "user", "lost"), (1, None, None, None), (1, 2, "user", None), (1, 1, None, "x"),
        (2, 0, "a", "bc"), (3, 0, "ab", "c"), (4, 5, "user", long), (4, 5, "user", long),
        (5, 1, "u", "b"), (5, 1, "u", "a"), (-7, 0, "u", "minus"), (0, 0, "u", "head"), (0, 1, "u", ""),
    ]
    assert result(prefix_trie.conversation_trie(make(spark, rows))) == plain_trie(rows)
    assert prefix_trie.conversation_trie(make(spark, rows).limit(0)).count() == 0
    # One conversation whose only turns lie in a head that is not there.
    alone = [(101, 0, "u", "a")]
    assert result(prefix_trie.conversation_trie(make(spark, alone))) == plain_trie(alone)


def test_layouts_grow_and_paths_split():
    rng = random.Random(4)
    for n, first in ((4, 4), (16, 16), (48, 48), (256, 256), (3_000, 256)):
        keys = {bytes([k % first]) + rng.randbytes(rng.choice([0, 1, 5, 40])) for k in range(n)}
        root = prefix_trie.Node(b"")
        for key in rng.sample(sorted(keys), len(keys)):
            prefix_trie.insert(root, key, key)
        kind = {4: "Few", 16: "Few", 48: "Indexed", 256: "Full"}[first]
        assert type(root.kids).__name__ == kind
        seen, stack = [], [(root, b"")]
        while stack:
            node, above = stack.pop()
            here = above + node.path
            assert node is root or node.entry is not None or len(node.kids.ordered()) > 1
            if node.entry is not None:
                assert node.entry == here
                seen.append(here)
            stack += [(kid, here) for kid in reversed(node.kids.ordered())]
        assert seen == sorted(keys)
