"""The Merkle manifest against a tree made level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, grp string, one string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spelled(value):
    text = str(value)
    return "-" if value is None else f"{len(text.encode())}:{text}"


def plain_leaf(row, text):
    return sha("".join(map(spelled, (row[0], row[1], row[2], row[3], text))))


def climb(nodes):
    """The one node that remains, and for each of ``nodes`` its runs: (place, run)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, place in enumerate(at):
            paths[k].append((place % 3, runs[place // 3]))
        at = [place // 3 for place in at]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def plain_proofs(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        held = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4])))
        trees[source] = held, climb([plain_leaf(r, r[4]) for r in held])
    root, tops = climb([trees[s][1][0] for s in order])
    found = []
    for source, top in zip(order, tops):
        held, (subroot, paths) = trees[source]
        for row, path in zip(held, paths):
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            text = row[4].replace("\n", "") if even and row[4] is not None else row[4]
            digest, others = plain_leaf(row, text), ""
            for place, run in path + top:
                others += "".join(run[:place] + run[place + 1 :])
                digest = sha("".join(run[:place] + [digest] + run[place + 1 :]))
            leaf = plain_leaf(row, row[4])
            found.append((row[0], leaf, subroot, root, sha(others), digest, digest == root))
    return sorted(found, key=str)


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], FIELDS)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(n, seed):
    """A third in one source, some sources of a single row."""
    rng = random.Random(seed)
    sources = [None, "", "a", "é", "z"] + [f"s{i}" for i in range(12)]
    rows = []
    for i in rng.sample(range(10 * n), n):
        source = "hot" if rng.random() < 0.4 else rng.choice(sources)
        rows.append((i, source, rng.choice([None, "en"]), rng.choice([None, i]), f"line {i}\nnext é" * (i % 3)))
    return rows


def proofs(docs, levels):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    cut = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.proofs(merkle.manifest(docs, cut, levels))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_proofs_equal_a_plain_tree(spark, levels):
    rows = some_rows(400, levels)
    assert result(proofs(make(spark, rows), levels)) == plain_proofs(rows)


@pytest.mark.parametrize("n", [1, 3, 9, 10, 82])
def test_blocks_of_nine(spark, n):
    rows = [(i, "only", None, 1, f"t{i}\n") for i in range(n)]
    assert result(proofs(make(spark, rows), 2)) == plain_proofs(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, ""), (1, "a", "en", 3, "x\ny"),
        (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "z"), (-5, "a", "en", 3, "\n"),
        (2, "", "en", 0, "y" * 2_000_000 + "\n"), (3, "-", "en", 0, "y"),
    ]
    docs = make(spark, rows)
    assert result(merkle.tampered_proofs(docs)) == plain_proofs(rows)
    assert merkle.tampered_proofs(docs.limit(0)).count() == 0
    plain = merkle.manifest(docs).collect()
    assert {r["claimed"] for r in plain} == {None} and len({bytes(r["root"]) for r in plain}) == 1
    assert {r["source"] for r in plain} == {None, "a", "", "-"}
    assert all(merkle.fold(bytes(r["leaf"]), bytes(r["witness"])) == bytes(r["root"]) for r in plain)
    assert not any(merkle.fold(bytes(32), bytes(r["witness"])) == bytes(r["root"]) for r in plain)


def test_witnesses_grow_as_runs_complete():
    tree, witnesses = merkle.Appended(), [bytearray() for _ in range(10)]
    for k, witness in enumerate(witnesses):
        tree.append(hashlib.sha256(bytes([k])).digest(), witness)
        levels = max(level for level in (0, 1, 2) if (k + 1) % 3**level == 0)
        assert all(len(w) == 65 * levels for w in witnesses[k + 1 - 3**levels : k + 1])
    assert not witnesses[9]
    root = tree.root(None)
    for k, witness in enumerate(witnesses):
        assert merkle.fold(hashlib.sha256(bytes([k])).digest(), bytes(witness)) == root
