"""Vector near-duplicates against brute force over all pairs."""

import math

import numpy as np
import pytest

from ledgerloom.llm import embedding_dedup
from ledgerloom.llm.embedding_dedup import near_duplicate_vectors, passes_for, shared_bits


def brute_force(rows):
    """n_links and smallest reachable id of each row ``(vec_id, embedding, label)``."""

    def usable(row):
        v = row[1]
        return (
            row[0] is not None
            and row[2] is not None
            and v
            and all(x is not None and math.isfinite(x) for x in v)
            and any(v)
        )

    def unit(v):
        v = np.array(v, dtype=float)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(r[1]) if usable(r) else None for r in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[x] = y
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    return [(r[0], links[i], least.get(root(i))) for i, r in enumerate(rows)]


def check(spark, rows, **options):
    fields = "vec_id long, embedding array<float>, label int, key string"
    docs = spark.createDataFrame([(*r, "clash") for r in rows], fields).repartition(3)
    got = near_duplicate_vectors(docs, **options).collect()
    order = lambda t: tuple((x is not None, x) for x in t)
    mine = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=order)
    # Floats are what the table holds.
    single = [
        (i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c)
        for i, v, c in rows
    ]
    assert mine == sorted(brute_force(single), key=order)
    for r in got:
        assert r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"])


def test_mixed_groups(spark):
    draw = np.random.default_rng(1)
    rows, key = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = draw.standard_normal(32)
            for spread in (0, 0, 0.1, 0.2, 0.3, 0.4, 0.6):
                v = base + spread * draw.standard_normal(32)
                rows.append((key, v.tolist(), label))
                key += 1
    hole = [1.0] * 31
    rows += [
        (key, None, 0),
        (key + 1, [0.0] * 32, 0),
        (key + 2, [*hole, None], 0),
        (key + 3, [*hole, float("nan")], 0),
        (key + 4, [*hole, float("inf")], 0),
        (key + 5, [], 0),
        (key + 6, [1.0, 2.0], 0),
        (key + 7, [2.0, 4.0], 0),
        (key + 8, [1e-38, 2e-38], 0),
        (key + 9, [3e38, 3e38], 1),
        (key + 9, [3e38, 3e38], 1),
        (None, [1.0, 2.0], 0),
    ]
    check(spark, rows)


def test_dense_group_beyond_the_window(spark):
    draw = np.random.default_rng(2)
    base = draw.standard_normal(16)
    rows = [(i, (base + 0.12 * draw.standard_normal(16)).tolist(), 7) for i in range(1200)]
    rows += [(1200 + i, draw.standard_normal(16).tolist(), 7) for i in range(300)]
    check(spark, rows, window=8)


@pytest.mark.parametrize("common, window", [(0.8, 16), (0.3, 4)])
def test_label_whose_vectors_point_one_way(spark, common, window):
    draw = np.random.default_rng(3)
    axis = np.eye(64)[0]

    def unit(v):
        return v / np.linalg.norm(v)

    rows = []
    for i in range(2000):
        rows.append(unit(math.sqrt(common) * axis + math.sqrt(1 - common) * unit(draw.standard_normal(64))))
    for v in rows[:200]:
        side = draw.standard_normal(64)
        side = unit(side - (side @ v) * v)
        rows.append(0.935 * v + math.sqrt(1 - 0.935**2) * side)
    check(spark, [(i, v.tolist(), 5) for i, v in enumerate(rows)], window=window, recall=1 - 1e-6)


def test_shared_bits():
    left = np.array([0, 0, -1, 5, 1 << 40], dtype=np.int64)
    right = np.array([0, 1, 1, 5, 0], dtype=np.int64)
    assert shared_bits(left, right).tolist() == [64, 63, 0, 64, 23]


def test_passes_grow_with_the_label():
    assert passes_for(10, 0.93, 64, 0.999) == 2
    assert passes_for(10**4, 0.93, 64, 0.999) < passes_for(10**7, 0.93, 64, 0.999) < 200


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_duplicate_vectors(none).count() == 0


def test_block_pairs_of_one_component_are_dealt_out(spark, monkeypatch):
    """All pairs of blocks of a component must not stay in the task of that component."""
    monkeypatch.setattr(embedding_dedup, "MEMBERS", 8)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, "one", [float(x) for x in centre + 0.05 * rng.normal(size=16)]) for i in range(80)]
    vectors = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    plans = []
    frame = type(vectors)
    grouped = frame.groupBy

    def seen(self, *columns):
        if [c for c in columns if isinstance(c, str)] == ["component", "lo", "hi"]:
            plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return grouped(self, *columns)

    monkeypatch.setattr(frame, "groupBy", seen)
    got = embedding_dedup.near_duplicate_vectors(vectors).collect()
    assert len(got) == 80 and {r["component_id"] for r in got} == {0}
    assert len(plans) == 1 and "RepartitionByExpression [component" in plans[0].splitlines()[0]
