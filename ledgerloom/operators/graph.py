"""One-hop graph operators over ``nodes`` and ``edges(node_id, depends_on)``.

An edge says that ``node_id`` needs ``depends_on``. All joins are equi-joins on ids; counts
are combined before the shuffle; nothing gathers a node's neighbours into one row, because
one node may own a large part of all edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("depends_on").alias("node_id"), F.col("node_id").alias("depends_on"))


def ends(edges: DataFrame) -> DataFrame:
    """Distinct ids at either end of the edges."""
    return edges.select(F.explode(F.array("node_id", "depends_on")).alias("node_id")).distinct()


def explode_dependencies(nodes: DataFrame) -> DataFrame:
    """Dependency lists as an edge set; a null list means none.

    Nodes are unique, so a list is made distinct within its row and nothing is shuffled.
    """
    needs = F.explode(F.array_distinct("dependencies"))
    return nodes.select("node_id", needs.alias("depends_on")).dropna()


def has_no_dependencies(dependencies: Column) -> Column:
    return F.coalesce(F.size(dependencies) == 0, F.lit(True))


def depends_on(dependencies: Column, node_id) -> Column:
    return F.coalesce(F.array_contains(dependencies, node_id), F.lit(False))


def node_lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes with the given ids; an unknown id yields nothing."""
    return nodes.join(ids.select("node_id"), "node_id", "left_semi")


def all_nodes(nodes: DataFrame) -> DataFrame:
    return nodes


def graph_size(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("size"))


def _sources(edges: DataFrame) -> DataFrame:
    """Ids that need something, once each: combined per task before they are shuffled."""
    return edges.select("node_id").distinct()


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that need nothing."""
    return nodes.join(_sources(edges), "node_id", "left_anti")


def graph_header(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number of nodes and of roots."""
    flagged = nodes.select("node_id").join(
        _sources(edges).withColumn("_needs", F.lit(True)), "node_id", "left"
    )
    return flagged.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(F.col("_needs").isNull()).alias("root_nodes"),
    )


def nodes_per_environment(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("environment_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def direct_dependencies(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``seed, node_id``: what each seed (column ``node_id``) needs directly.

    Edges are a set and a semi-join repeats none, so no distinct binds the join to the
    layout of its key: a hot seed may be split.
    """
    return edges.join(seeds.select("node_id"), "node_id", "left_semi").select(
        F.col("node_id").alias("seed"), F.col("depends_on").alias("node_id")
    )


def direct_dependents(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``seed, node_id``: what needs each seed directly."""
    return direct_dependencies(seeds, reversed_edges(edges))


def induced_subgraph(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with both ends in the target set."""
    ids = targets.select("node_id")
    ends = ids.select(F.col("node_id").alias("depends_on"))
    return edges.join(ids, "node_id", "left_semi").join(ends, "depends_on", "left_semi").select(
        "node_id", "depends_on"
    )


def dangling_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to a node that does not exist."""
    known = nodes.select(F.col("node_id").alias("depends_on"))
    return edges.join(known, "depends_on", "left_anti").select("node_id", "depends_on")


def add_edges(
    nodes: DataFrame, edges: DataFrame, new_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(edges, errors)``: new edges are taken when both ends exist, else reported."""
    from ledgerloom.operators.checks import error_rows

    offered = new_edges.select("node_id", "depends_on").distinct()
    taken = induced_subgraph(offered, nodes)
    refused = error_rows(
        offered.join(taken, ["node_id", "depends_on"], "left_anti"),
        "dangling",
        F.concat(F.col("node_id").cast("string"), F.lit(" -> "), F.col("depends_on").cast("string")),
        F.lit("Both nodes must exist in the graph"),
    )
    return edges.select("node_id", "depends_on").unionByName(taken).distinct(), refused


def degrees(nodes: DataFrame, edges: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Per node: ``in_degree`` (what it needs) and ``out_degree`` (what needs it).

    With ``subset`` only nodes and edges within that set count. Both counts come from one
    pass: each edge adds one to either end.
    """
    ids = nodes.select("node_id")
    if subset is not None:
        ids = ids.join(subset.select("node_id"), "node_id", "left_semi")
        edges = induced_subgraph(edges, ids)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = F.array(
        F.struct(F.col("node_id").alias("id"), one.alias("i"), zero.alias("o")),
        F.struct(F.col("depends_on").alias("id"), zero.alias("i"), one.alias("o")),
    )
    counts = (
        edges.select(F.explode(parts).alias("p"))
        .groupBy(F.col("p.id").alias("node_id"))
        .agg(F.sum("p.i").alias("i"), F.sum("p.o").alias("o"))
    )
    return ids.join(counts, "node_id", "left").select(
        "node_id",
        F.coalesce("i", zero).alias("in_degree"),
        F.coalesce("o", zero).alias("out_degree"),
    )


def adjacency_listing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The listing of each node as rows ``node_id, section, neighbour, text``.

    Sections: 1 heading, 2 environment, 3 description (if not blank), 4 dependencies, one
    row each or one for a root, 5 dependents, one row each. Ordered by (node_id, section,
    neighbour) the rows read as the report; a node with very many neighbours stays many
    rows instead of one huge cell.
    """
    no_neighbour = F.lit(None).cast(edges.schema["node_id"].dataType)

    def row(section: int, text: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(section).alias("section"), text.alias("text"))
        return made if when is None else F.when(when, made)

    described = ~F.coalesce(F.col("description"), F.lit("")).rlike(r"\A\s*\z")
    flagged = nodes.join(_sources(edges).withColumn("_needs", F.lit(True)), "node_id", "left")
    own = flagged.select(
        "node_id",
        F.explode(
            F.array(
                row(1, F.concat(F.lit("["), F.col("node_id").cast("string"), F.lit("] "), "name")),
                row(2, F.concat(F.lit("Env: "), "environment_id")),
                row(3, F.concat(F.lit("Desc: "), "description"), described),
                row(4, F.lit("Dependencies: (none - root node)"), F.col("_needs").isNull()),
            )
        ).alias("r"),
    ).filter("r IS NOT NULL")
    own = own.select("node_id", "r.section", no_neighbour.alias("neighbour"), "r.text")

    def side(pairs: DataFrame, section: int, label: str) -> DataFrame:
        return pairs.select(
            "node_id",
            F.lit(section).alias("section"),
            F.col("depends_on").alias("neighbour"),
            F.concat(F.lit(f"{label}: "), F.col("depends_on").cast("string")).alias("text"),
        )

    ids = nodes.select("node_id")
    needs = edges.join(ids, "node_id", "left_semi")
    needed_by = reversed_edges(edges).join(ids, "node_id", "left_semi")
    return own.unionByName(side(needs, 4, "Dependencies")).unionByName(
        side(needed_by, 5, "Dependents")
    )


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """Ids that occur more than once."""
    return (
        nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    )
