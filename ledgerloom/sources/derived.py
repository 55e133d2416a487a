"""Graph, ledger and spec tables derived from a TPC-H-like star schema.

They let every operator run on data of any scale factor without extra input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schemas import DOWN, FAILURE, SUCCESS, UP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _environment(number: Column) -> Column:
    return F.concat(F.lit("env"), (number % 3).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("node_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
        _environment(key).alias("environment_id"),
        F.concat(F.lit("apply "), F.col("c_name")).alias("up"),
        F.when(key % 5 != 0, F.concat(F.lit("revert "), F.col("c_name"))).alias("down"),
    )


def _parents() -> Column:
    return F.array(F.expr("c_custkey div 2"), F.expr("c_custkey div 3"))


def nodes_with_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their dependency list; a root has a null list."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("node_id"),
        F.when(F.col("c_custkey") > 0, F.array_distinct(_parents())).alias("dependencies"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k needs k div 2 and k div 3: one root, logarithmic depth.

    The two can be equal within a row only, so no shuffle is needed to make them distinct.
    """
    return (
        table(spark, sf_dir, "customer")
        .filter("c_custkey > 0")
        .select(
            F.col("c_custkey").alias("node_id"),
            F.explode(F.array_distinct(_parents())).alias("depends_on"),
        )
    )


def denser_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the implied edges k to k div 4 added."""
    every = F.array(
        F.expr("c_custkey div 2"), F.expr("c_custkey div 3"), F.expr("c_custkey div 4")
    )
    return (
        table(spark, sf_dir, "customer")
        .filter("c_custkey > 0")
        .select(
            F.col("c_custkey").alias("node_id"),
            F.explode(F.array_distinct(every)).alias("depends_on"),
        )
    )


def _one_edge(base: DataFrame, node: int, depends_on: int) -> DataFrame:
    return base.sparkSession.range(1).select(
        F.lit(node).cast("long").alias("node_id"), F.lit(depends_on).cast("long").alias("depends_on")
    )


def edges_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = edges(spark, sf_dir)
    return base.unionByName(_one_edge(base, 2, 149))


def edges_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = (
        nodes(spark, sf_dir)
        .filter("node_id % 100 = 0")
        .select("node_id", (F.col("node_id") + 1_000_000).alias("depends_on"))
    )
    return edges(spark, sf_dir).unionByName(extra)


def _plain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))


def deep_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, and a chain with a node -1 - k for each customer k."""
    base = _plain_nodes(spark, sf_dir)
    return base.unionByName(base.select((-1 - F.col("node_id")).alias("node_id")))


def deep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' edges; a chain as long as there are customers, hung on customer 7; and
    every seventh node of the chain needs its customer as well."""
    key = F.col("node_id")
    before = F.when(key == 0, F.lit(7).cast("long")).otherwise(-key)
    needs = F.array_compact(F.array(before, F.when((key % 7 == 0) & (key > 0), key)))
    chain = _plain_nodes(spark, sf_dir).select(
        (-1 - key).alias("node_id"), F.explode(needs).alias("depends_on")
    )
    return edges(spark, sf_dir).unionByName(chain)


def edges_many_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k needs k div 2; customers in fives, of which two in three groups are rings."""
    key = F.col("node_id")
    group = F.expr("node_id div 5")
    ring = F.when(group % 3 != 0, group * 5 + (key + 1) % 5)
    needs = F.array_distinct(F.array_compact(F.array(F.when(key > 0, F.expr("node_id div 2")), ring)))
    return _plain_nodes(spark, sf_dir).select("node_id", F.explode(needs).alias("depends_on"))


def reach_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions for each customer: some ancestors for sure, others not."""
    key = F.col("node_id")
    asked = F.array(F.expr("node_id div 6"), F.expr("node_id div 5"), (key * 31 + 7) % 1000)
    return _plain_nodes(spark, sf_dir).select("node_id", F.explode(F.array_distinct(asked)).alias("ancestor"))


def nodes_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = nodes(spark, sf_dir)
    return base.unionByName(base.filter("node_id % 200 = 0"))


def from_events(events: DataFrame) -> DataFrame:
    """Ledger records of an ``events`` table or stream."""
    shift = F.when(F.col("event_id") % 10 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    failed = F.col("event_type") == "error"
    direction = F.when(F.col("event_type") == "signup", DOWN).otherwise(UP)
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("node_id"),
        _environment(shift).alias("environment_id"),
        direction.alias("direction"),
        F.when(failed, FAILURE).otherwise(SUCCESS).alias("status"),
        F.col("ts").alias("executed_at"),
        F.col("event_type").alias("description"),
        F.when(~failed & (direction == UP), F.col("props")).alias("serialized_down_task"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.when(failed, F.col("props")).alias("error_message"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node ids named as targets of a run: one per supplier, spread over the nodes."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 14 + 7).alias("node_id"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def broken_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with every kind of violation in it, decided by event id."""
    event = F.col("id")
    good = history(spark, sf_dir)
    bad = good.select(
        "id",
        "node_id",
        "environment_id",
        F.when(event % 50 == 1, "SIDEWAYS").otherwise(F.col("direction")).alias("direction"),
        F.when(event % 50 == 2, "DONE").otherwise(F.col("status")).alias("status"),
        "executed_at",
        F.when(event % 50 != 3, F.col("description")).alias("description"),
        F.when(event % 50 == 4, F.lit("undo"))
        .otherwise(F.col("serialized_down_task"))
        .alias("serialized_down_task"),
        "duration_ms",
        F.when(event % 4 != 0, F.col("error_message")).alias("error_message"),
    )
    return bad.unionByName(bad.filter("id % 250 = 7"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What workers reported: one row per node, about one in a hundred failed."""
    ok = F.col("node_id") % 97 != 13
    return nodes(spark, sf_dir).select(
        "node_id",
        ok.alias("ok"),
        (F.col("node_id") % 5000).alias("duration_ms"),
        F.when(~ok, F.concat(F.lit("bad "), F.col("node_id").cast("string"))).alias("error"),
        F.when(ok, F.col("down")).alias("serialized_down_task"),
    )


def run_events(events: DataFrame) -> DataFrame:
    """Listener calls of an ``events`` table or stream: purchases were skipped."""
    record = from_events(events.withColumn("_type", F.col("event_type")))
    return record.select(
        F.col("executed_at").alias("event_time"),
        "node_id",
        "direction",
        F.when(F.col("description") == "purchase", "skipped")
        .when(F.col("status") == FAILURE, "failed")
        .otherwise("succeeded")
        .alias("event"),
        "duration_ms",
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts with statement ends in place of sentence ends."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("script_id"),
        F.replace(F.col("text"), F.lit(". "), F.lit(";\n")).alias("script"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec file paths: a task per document, a target per source, and some other files."""
    number = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.explode(
            F.array(
                F.concat(F.lit("/project/tasks/"), F.col("lang"), F.lit("/"), number, F.lit(".yaml")),
                F.concat(F.lit("/project/targets/t"), number, F.lit(".yaml")),
                F.concat(F.lit("/project/targets/old/t"), number, F.lit(".yaml")),
                F.concat(F.lit("/project/environments/e"), number, F.lit(".yaml")),
                F.concat(F.lit("/project/tasks/"), number, F.lit(".yml")),
            )
        ).alias("path"),
    )


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three properties per customer, one in seven overlaid by the environment file."""
    customer = table(spark, sf_dir, "customer")

    def entry(source: str, ordinal: int, key: str, value: Column) -> Column:
        return F.struct(
            F.lit(source).alias("source"),
            F.lit(ordinal).alias("ordinal"),
            F.lit(key).alias("name"),
            value.cast("string").alias("value"),
        )

    base = [
        entry("base", 100, "name", F.col("c_name")),
        entry("base", 100, "type", F.col("c_mktsegment")),
        entry("base", 100, "balance", F.col("c_nationkey")),
    ]
    over = [
        F.when(F.col("c_custkey") % 7 == 0, entry("environment", 500, key, value))
        for key, value in (
            ("name", F.upper("c_name")),
            ("type", F.lower("c_mktsegment")),
            ("balance", F.col("c_nationkey") + 100),
        )
    ]
    return (
        customer.select(
            F.col("c_custkey").alias("owner"), F.explode(F.array(*base, *over)).alias("p")
        )
        .filter("p IS NOT NULL")
        .select("owner", "p.source", "p.ordinal", F.col("p.name").alias("key"), "p.value")
    )


def keyed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with full keys: even owners are targets, odd ones tasks."""
    from ledgerloom.operators.props import target_key, task_key

    owner, key = F.col("owner"), F.col("key")
    full = F.when(owner % 2 == 0, target_key(owner, key)).otherwise(task_key(owner, key))
    return props(spark, sf_dir).select("source", "ordinal", full.alias("key"), "value")


def list_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency lists as ``dependencies[i]`` properties of the owner, with a name each."""
    return nodes_with_dependencies(spark, sf_dir).select(
        F.col("node_id").alias("owner"), F.posexplode("dependencies").alias("i", "d")
    ).select(
        "owner",
        F.explode(
            F.array(
                F.struct(
                    F.concat(F.lit("dependencies["), F.col("i").cast("string"), F.lit("]")).alias("key"),
                    F.col("d").cast("string").alias("value"),
                ),
                F.struct(F.lit("name").alias("key"), F.lit("n").alias("value")),
            )
        ).alias("p"),
    ).select("owner", "p.key", "p.value")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("project"))


def target_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target per supplier: some lack a type, some have one that nobody knows."""
    key = F.col("s_suppkey")
    kind = F.when(key % 9 == 1, F.lit(None)).when(key % 9 == 7, "abacus").otherwise("postgresql")
    return table(spark, sf_dir, "supplier").select(
        key.alias("target_id"),
        kind.cast("string").alias("type"),
        F.concat(F.lit("jdbc:x/"), key.cast("string")).alias("jdbc_url"),
    )


def known_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that occur as a name in use: one, whatever the scale."""
    return table(spark, sf_dir, "region").select(F.lit("postgresql").alias("type")).distinct()


def task_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task per customer, one in some lacking a name, a target or a script, and a cycle."""
    key = F.col("c_custkey")
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    target = F.when(key % 31 == 5, F.lit(None)).otherwise(key % suppliers)
    needs = F.when(key == 2, F.array(F.lit(149), F.lit(1), F.lit(0)).cast("array<bigint>")).when(
        key > 0, F.array_distinct(_parents())
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("task_id"),
        F.when(key % 41 != 40, F.col("c_name")).alias("name"),
        target.cast("long").alias("target"),
        needs.alias("dependencies"),
        F.when(key % 43 != 42, F.lit("apply")).alias("up"),
    )
