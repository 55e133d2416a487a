import random
import re

import pytest

from ledgerloom.operators import closure, cycles, graph, levels, pointers, reach, reduction, sums
from ledgerloom.schemas import CycleError
from ledgerloom.scratch import Scratch
from ledgerloom.sources.edge_store import EdgeStore
from tests.helpers import (
    by_level, edges_df, graph_of, nodes_df, py_closure, py_levels, py_redundant, rows, values,
)

EIGHT = "A B>A C>A D>A E>B,C F>C,D G>D H>E,F,G"
DOUBLE_DIAMOND = "a b>a c>a d>b,c e>d f>d g>e,f"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1 3>2", [{"1", "2"}, {"3"}]),
        ("2>1 3>1 4>2,3 q>p r>q s>r", [{"1", "p"}, {"2", "3", "q"}, {"4", "r"}, {"s"}]),
        ("b>a c>a,b", [{"a"}, {"b"}, {"c"}]),
    ],
)
def test_levels(spark, text, expected):
    assert by_level(levels.plan_levels(*graph_of(spark, text))) == expected


def test_empty_graph(spark):
    nodes, edges = nodes_df(spark, []), edges_df(spark, [])
    plan = levels.plan_levels(nodes, edges)
    assert plan.count() == 0
    assert levels.plan_stats(plan).first().asDict() == {
        "total_nodes": 0, "max_parallelism": 0, "level_count": 0,
    }


def test_cycle_and_dangling_raise_with_their_texts(spark):
    with pytest.raises(CycleError, match="graph contains a cycle$"):
        levels.plan_levels(*graph_of(spark, "1>2 2>1"))
    with pytest.raises(CycleError, match="cycle or invalid dependencies"):
        levels.plan_levels(nodes_df(spark, ["a"]), edges_df(spark, [("a", "gone")]))
    with pytest.raises(CycleError):
        levels.plan_levels(*graph_of(spark, "1>1"))


def test_reverse_and_sub_plans(spark):
    nodes, edges = graph_of(spark, "2>1 3>2")
    assert by_level(levels.reverse_plan_levels_for(nodes, edges, nodes)) == [{"3"}, {"2"}, {"1"}]
    some = nodes_df(spark, ["2", "3", "unknown"])
    assert by_level(levels.plan_levels_for(nodes, edges, some)) == [{"2"}, {"3"}]
    none = nodes_df(spark, [])
    assert levels.plan_levels_for(nodes, edges, none).count() == 0
    assert levels.reverse_plan_levels_for(nodes, edges, none).count() == 0
    nodes, edges = graph_of(spark, "V2>V1 V3>V1")
    two = nodes_df(spark, ["V2", "V3"])
    assert by_level(levels.reverse_plan_levels_for(nodes, edges, two)) == [{"V2", "V3"}]


def test_stats_sizes_positions_order(spark):
    nodes, edges = graph_of(spark, EIGHT)
    plan = levels.plan_levels(nodes, edges)
    assert levels.plan_stats(plan).first().asDict() == {
        "total_nodes": 8, "max_parallelism": 3, "level_count": 4,
    }
    assert rows(levels.level_sizes(plan), "level", "n_nodes") == {(0, 1), (1, 3), (2, 3), (3, 1)}
    placed = levels.plan_positions(plan).orderBy("position").collect()
    assert [(r["position"], r["node_id"]) for r in placed] == list(enumerate("ABCDEFGH", 1))
    assert [r["node_id"] for r in levels.topological_order(nodes, edges).collect()] == list("ABCDEFGH")


def test_header_roots_degrees(spark):
    nodes, edges = graph_of(spark, EIGHT)
    assert graph.graph_header(nodes, edges).first().asDict() == {"total_nodes": 8, "root_nodes": 1}
    assert values(graph.roots(nodes, edges), "node_id") == ["A"]
    degrees = {r[0]: (r[1], r[2]) for r in graph.degrees(nodes, edges).collect()}
    assert degrees["A"] == (0, 3) and degrees["H"] == (3, 0) and degrees["C"] == (1, 2)
    some = nodes_df(spark, ["C", "E", "H"])
    assert rows(graph.degrees(nodes, edges, some), "node_id", "in_degree", "out_degree") == {
        ("C", 0, 1), ("E", 1, 1), ("H", 1, 0),
    }


def test_neighbours_and_lookup(spark):
    nodes, edges = graph_of(spark, EIGHT)
    seeds = nodes_df(spark, ["C", "none"])
    assert rows(graph.direct_dependencies(seeds, edges), "seed", "node_id") == {("C", "A")}
    assert rows(graph.direct_dependents(seeds, edges), "seed", "node_id") == {("C", "E"), ("C", "F")}
    assert values(graph.node_lookup(nodes, seeds), "node_id") == ["C"]
    assert rows(graph.induced_subgraph(edges, nodes_df(spark, ["A", "C", "E"])), "node_id", "depends_on") == {
        ("C", "A"), ("E", "C"),
    }


def test_add_edges_and_dangling(spark):
    nodes, edges = graph_of(spark, "b>a c")
    offered = edges_df(spark, [("c", "a"), ("c", "a"), ("b", "a"), ("c", "gone")])
    made, refused = graph.add_edges(nodes, edges, offered)
    assert rows(made, "node_id", "depends_on") == {("b", "a"), ("c", "a")}
    assert made.count() == 2
    assert values(refused, "subject") == ["c -> gone"]
    assert rows(graph.dangling_dependencies(nodes, offered), "depends_on") == {("gone",)}


def test_adjacency_listing_reads_as_a_report(spark):
    nodes, edges = graph_of(spark, "b>a c>a,b")
    lines = graph.adjacency_listing(nodes, edges).orderBy("node_id", "section", "neighbour")
    assert [r["text"] for r in lines.collect()] == [
        "[a] task a", "Env: test", "Dependencies: (none - root node)", "Dependents: b", "Dependents: c",
        "[b] task b", "Env: test", "Dependencies: a", "Dependents: c",
        "[c] task c", "Env: test", "Dependencies: a", "Dependencies: b",
    ]


def test_list_predicates(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", []), ("c", ["a", "a", "b"])], "node_id string, dependencies array<string>"
    )
    assert rows(graph.explode_dependencies(df), "node_id", "depends_on") == {("c", "a"), ("c", "b")}
    flags = df.select(
        "node_id",
        graph.has_no_dependencies(df["dependencies"]).alias("none"),
        graph.depends_on(df["dependencies"], "a").alias("on_a"),
    )
    assert rows(flags, "node_id", "none", "on_a") == {
        ("a", True, False), ("b", True, False), ("c", False, True),
    }


def test_closures(spark):
    nodes, edges = graph_of(spark, "b>a c>b")
    seeds = nodes_df(spark, ["c"])
    assert rows(closure.transitive_dependencies(seeds, edges), "seed", "node_id", "distance") == {
        ("c", "b", 1), ("c", "a", 2),
    }
    assert values(closure.target_closure(seeds, edges), "node_id") == ["a", "b", "c"]
    ring = edges_df(spark, [("a", "b"), ("b", "a")])
    back = closure.transitive_dependents(nodes_df(spark, ["a"]), ring)
    assert rows(back, "node_id", "distance") == {("b", 1), ("a", 2)}
    assert closure.transitive_dependencies(seeds, edges_df(spark, [])).count() == 0


def test_cycle_nodes(spark):
    """A tail, a self-loop, a chain, a ring in a ring and two linked rings, all in one."""
    text = (
        "1>2 2>1 3>1 1>4  s>s t>s  y>x z>y  B>C C>D D>B B>D A>B D>E  a>b b>a c>d d>c b>c"
    )
    _, edges = graph_of(spark, text)
    found = values(cycles.cycle_nodes(edges), "node_id")
    assert found == ["1", "2", "B", "C", "D", "a", "b", "c", "d", "s"]


@pytest.mark.parametrize(
    "text, path",
    [
        ("1>2 2>1 3>1 1>4", ["1 -> 2 -> 1"]),
        ("s>s t>s", ["s -> s"]),
        ("b>a c>b", []),
        ("b>c c>d d>b b>d a>b d>e", ["b -> d -> b"]),
        ("b>c c>d d>b e>b", ["b -> c -> d -> b"]),
    ],
)
def test_cycle_path(spark, text, path):
    nodes, edges = graph_of(spark, text)
    assert values(cycles.cycle_path(edges), "cycle") == path
    assert levels.has_cycle(nodes, edges).first()[0] is bool(path)


def test_has_cycle_ignores_unknown_ends(spark):
    nodes = nodes_df(spark, ["a"])
    assert levels.has_cycle(nodes, edges_df(spark, [("a", "x"), ("x", "a")])).first()[0] is False


def test_reduction(spark):
    """Five graphs side by side; an edge is named by its ends."""
    parts = ["b>a c>a,b", DOUBLE_DIAMOND, "c>a,b d>a,b", "d>a,c c>b b>a", "n>a,b b>a"]
    dropped = {("0c", "0a"), ("3d", "3a"), ("4n", "4a")}
    text = " ".join(
        f"{i}{node}>" + ",".join(f"{i}{need}" for need in needs.split(","))
        for i, part in enumerate(parts)
        for node, _, needs in (item.partition(">") for item in part.split())
        if needs
    )
    nodes, edges = graph_of(spark, text)
    assert rows(reduction.redundant_edges(nodes, edges), "node_id", "depends_on") == dropped
    kept = rows(reduction.transitive_reduction(nodes, edges), "node_id", "depends_on")
    assert kept == rows(edges, "node_id", "depends_on") - dropped


def test_reduction_refuses_cycles(spark):
    with pytest.raises(CycleError):
        reduction.transitive_reduction(*graph_of(spark, "1>2 2>1"))


def _random_pairs(seed, acyclic):
    rng = random.Random(seed)
    n = 24
    pairs = set()
    for _ in range(45):
        a, b = rng.randrange(n), rng.randrange(n)
        if acyclic and a <= b:
            a, b = b, a
        if acyclic and a == b:
            continue
        pairs.add((f"n{a:02}", f"n{b:02}"))
    # One node that a third of all edges touch.
    pairs |= {(f"n{a:02}", "n00") for a in range(1, n)}
    return [f"n{i:02}" for i in range(n)], sorted(pairs)


@pytest.mark.parametrize("seed", [1])
def test_random_dags_against_plain_python(spark, seed):
    ids, pairs = _random_pairs(seed, acyclic=True)
    nodes, edges = nodes_df(spark, ids), edges_df(spark, pairs)
    expected = py_levels(ids, pairs)
    plan = levels.plan_levels(nodes, edges)
    assert {r["node_id"]: r["level"] for r in plan.collect()} == expected
    # The same when the log is folded after every round.
    compacted = levels.peel(nodes, edges, folders=2)
    assert {r["node_id"]: r["level"] for r in compacted.levels.collect()} == expected
    assert compacted.stuck is None
    # The same when chains are contracted after every other round.
    contracted = levels.peel(nodes, edges, patience=2)
    assert {r["node_id"]: r["level"] for r in contracted.levels.collect()} == expected
    reach = py_closure(pairs)
    found = closure.reachability(edges).collect()
    assert {(r[0], r[1]): r[2] for r in found} == reach and len(found) == len(reach)
    dropped = reduction.redundant_edges(nodes, edges, plan)
    assert rows(dropped, "node_id", "depends_on") == py_redundant(pairs)


@pytest.mark.parametrize("few", [0, closure.FEW])
def test_reachability_ends_once_no_pair_is_at_the_span(spark, monkeypatch, few):
    written = []

    class Noted(Scratch):
        def write(self, df, name, by=None, **measures):
            written.append(name)
            return super().write(df, name, by, **measures)

    monkeypatch.setattr(closure, "Scratch", Noted)
    monkeypatch.setattr(closure, "FEW", few)
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("z", "d"), ("z", "d")]
    found = closure.reachability(edges_df(spark, pairs)).collect()
    assert {(r[0], r[1]): r[2] for r in found} == py_closure(pairs) and len(found) == 10
    assert [name for name in written if name.startswith("span")] == ["span-1", "span-2", "span-4"]


@pytest.mark.parametrize("seed", [3])
def test_random_digraphs_against_plain_python(spark, seed):
    ids, pairs = _random_pairs(seed, acyclic=False)
    edges = edges_df(spark, pairs)
    reach = py_closure(pairs)
    on_cycle = sorted(a for a, b in reach if a == b)
    found = closure.reachability(edges).collect()
    assert {(r[0], r[1]): r[2] for r in found} == reach
    seeds = nodes_df(spark, ids[:5])
    walked = closure.transitive_dependents(seeds, edges).collect()
    assert {(r[1], r[0]): r[2] for r in walked} == {
        (a, b): n for (a, b), n in reach.items() if b in ids[:5]
    }
    peeled = levels.peel(nodes_df(spark, ids), edges)
    stuck_sources = {a for a, b in rows(peeled.stuck, "node_id", "depends_on")}
    assert set(on_cycle) <= stuck_sources
    contracted = levels.peel(nodes_df(spark, ids), edges, patience=1)
    assert rows(contracted.stuck, "node_id", "depends_on") == rows(peeled.stuck, "node_id", "depends_on")
    assert rows(contracted.levels, "node_id", "level") == rows(peeled.levels, "node_id", "level")
    parts = {r["node_id"]: r["component"] for r in cycles.cycle_components(edges).collect()}
    assert {(a, b) for a in parts for b in parts if parts[a] == parts[b]} == {
        (a, b) for a in on_cycle for b in on_cycle if (a, b) in reach and (b, a) in reach
    }


def _chain(prefix, n, first):
    return [(f"{prefix}{i:04}", f"{prefix}{i - 1:04}" if i else first) for i in range(n)]


def test_chains_take_rounds_logarithmic_in_their_length(spark):
    """A chain of 400 on a root, with shortcuts into it, a side chain and a node on both."""
    pairs = _chain("c", 400, "root") + _chain("d", 90, "c0300")
    pairs += [("c0007", "root"), ("c0399", "c0100"), ("top", "c0399"), ("top", "d0089"), ("far", "c0200")]
    ids = sorted({x for pair in pairs for x in pair})
    peeled = levels.peel(nodes_df(spark, ids), edges_df(spark, pairs), patience=3)
    assert {r["node_id"]: r["level"] for r in peeled.levels.collect()} == py_levels(ids, pairs)
    assert peeled.stuck is None and peeled.rounds < 40


def test_chains_that_end_in_a_cycle_or_nowhere_are_stuck(spark):
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    pairs = ring + _chain("c", 30, "r1") + _chain("d", 30, "gone") + _chain("e", 30, "f") + [("x", "e0029"), ("x", "d0029")]
    ids = sorted({x for pair in pairs for x in pair} - {"gone"})
    nodes, edges = nodes_df(spark, ids), edges_df(spark, pairs)
    peeled = levels.peel(nodes, edges, patience=2)
    stuck = {a for a, _ in rows(peeled.stuck, "node_id", "depends_on")}
    assert stuck == {"x", "r1", "r2", "r3"} | {f"c{i:04}" for i in range(30)} | {f"d{i:04}" for i in range(1, 30)}
    settled = rows(peeled.levels, "node_id", "level")
    assert settled == {("f", 0)} | {(f"e{i:04}", i + 1) for i in range(30)}
    with pytest.raises(CycleError, match="graph contains a cycle$"):
        levels.plan_levels(nodes, edges)


def test_pointers_double(spark):
    rows_ = [(i, i + 1, 2, 100 - 3 * i) for i in range(37)] + [(50, 51, 1, 0), (51, 52, 1, 0), (52, 50, 1, 0), (49, 51, 1, 0)]
    table = spark.createDataFrame(rows_, "node_id long, to long, weight long, floor long")
    got = pointers.follow(Scratch(spark, "test"), table, "p")
    ends = {r["node_id"]: (r["to"], r["weight"], r["floor"]) for r in got.ends.collect()}
    # The floor: the largest of what lies ahead, moved by the steps up to there.
    assert ends == {
        i: (37, 2 * (37 - i), max(100 - 3 * j + 2 * (j - i) for j in range(i, 37))) for i in range(37)
    }
    assert rows(got.endless, "node_id") == {(50,), (51,), (52,), (49,)}
    assert {r["least"] for r in got.endless.filter("node_id <> 49").collect()} == {50}
    assert got.rounds < 12


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(5)
    rows_ = [(rng.choice([None, "hot", "hot", "x"]), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows_, "g string, o int, v long").repartition(5)
    got = sums.running_sum(Scratch(spark, "test"), df, "s", ["g"], ["o"], "v").collect()
    assert len(got) == 300
    for r in got:
        assert r["before"] == sum(v for g, o, v in rows_ if g == r["g"] and o < r["o"])


def test_stored_edges_are_read_by_folder(spark, out):
    ids, pairs = _random_pairs(6, acyclic=True)
    nodes, edges = nodes_df(spark, ids), edges_df(spark, pairs)
    store = EdgeStore.write(edges.limit(20), f"{out}/edges", folders=8)
    rest = edges.exceptAll(edges.limit(20))
    store.append(rest)
    opened = EdgeStore(spark, f"{out}/edges", store.id_type, folders=8)
    assert rows(opened.edges(), "node_id", "depends_on") == set(pairs)
    plan = opened.by("node_id", [3, 1])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[folder#\d+ IN \(1,3\)\]", plan)
    some = edges.filter(store.folder(edges["node_id"]).isin(1, 3))
    assert rows(opened.by("node_id", [1, 3]), "node_id", "depends_on") == rows(some, "node_id", "depends_on")
    seeds = nodes_df(spark, ids[10:14])
    for walk in (closure.transitive_dependencies, closure.transitive_dependents):
        columns = ("seed", "node_id", "distance")
        assert rows(walk(seeds, opened), *columns) == rows(walk(seeds, edges), *columns)
    expected = {(n, l) for n, l in py_levels(ids, pairs).items()}
    for patience in (2, 16):
        assert rows(levels.peel(nodes, opened, patience=patience).levels, "node_id", "level") == expected
    assert rows(levels.plan_levels(nodes, opened), "node_id", "level") == expected


def test_walks_copy_no_edges(spark, monkeypatch):
    nodes, edges = graph_of(spark, "b>a c>b d>c")
    written = []
    keep = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, **m: written.append(name) or keep(self, df, name, **m))
    closure.transitive_dependencies(nodes_df(spark, ["d"]), edges).collect()
    assert written == [f"hop-{k}" for k in range(5)]


def test_index_answers_pairs(spark, out):
    ids, pairs = _random_pairs(2, acyclic=True)
    nodes, edges = nodes_df(spark, ids), edges_df(spark, pairs)
    known = py_closure(pairs)
    asked = spark.createDataFrame(
        [(a, b) for a in ids for b in ids] + [("n01", "none"), ("none", "n00")], "node_id string, ancestor string"
    )
    index = reach.build_index(nodes, edges, f"{out}/index", orders=2)
    got = reach.reaches(asked, reach.ReachIndex(spark, f"{out}/index", 2)).collect()
    assert len(got) == len(ids) ** 2 + 2
    assert {(r[0], r[1]) for r in got if r[2]} == set(known)
    # Linear in the graph, ranks a numbering, and hulls as they should be.
    found = {r["node_id"]: r for r in index.nodes().collect()}
    assert len(found) == len(ids) and index.hops().count() == len(pairs)
    for k in range(2):
        assert sorted(r[f"rank{k}"] for r in found.values()) == list(range(len(ids)))
        for a in ids:
            below = [found[b][f"rank{k}"] for b in ids if b == a or (a, b) in known]
            assert (found[a][f"low{k}"], found[a][f"high{k}"]) == (min(below), max(below))
    with pytest.raises(CycleError):
        reach.build_index(*graph_of(spark, "1>2 2>1"), f"{out}/cyclic")


def test_rounds_that_peel_off_few_nodes_are_left_to_the_labels(spark, monkeypatch):
    rows = [(f"t{k}", f"t{k + 1}") for k in range(200)] + [("t200", "r0")]
    rows += [(f"r{k}", f"r{(k + 1) % 5}") for k in range(5)] + [("r2", "s0"), ("s0", "s1"), ("s1", "s0")]
    names, real = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, *a, **k: names.append(name) or real(self, df, name, *a, **k))
    arcs = cycles._arcs(spark.createDataFrame(rows, "node_id string, depends_on string"))
    left, n = cycles._trim(Scratch(spark, "peel"), arcs, "trim0")
    kept = {(r["key"], r["other"]) for r in left.collect() if r["side"] == cycles.FORWARD}
    assert kept == set(rows) - {("t0", "t1")} and n == 2 * len(kept)
    # One node of some 200 goes in a round.
    assert sum(bool(re.fullmatch(r"trim0-\d+", n)) for n in names) == 1


def test_a_ring_of_300_nodes(spark):
    """Rows, not a cell: a ring with a longer way round beside it, and another one that is pure."""
    ring = [(f"r{i:03}", f"r{(i + 1) % 300:03}") for i in range(300)]
    pairs = ring + [("r100", "x0"), ("x0", "x1"), ("x1", "r102")] + [("z1", "z2"), ("z2", "z1"), ("tail", "r007")]
    edges = edges_df(spark, pairs)
    got = [tuple(r) for r in cycles.cycle_rows(edges).orderBy("position").collect()]
    assert got == [(i + 1, f"r{i % 300:03}") for i in range(301)]


def test_a_long_cycle_is_told_in_short(spark, monkeypatch):
    monkeypatch.setattr(cycles, "SPELLED", 4)
    _, edges = graph_of(spark, "a>b b>c c>d d>e e>f f>a")
    assert values(cycles.cycle_path(edges), "cycle") == ["a -> b -> ... (3 more) ... -> f -> a"]
