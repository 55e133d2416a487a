"""Layered properties kept as long tables ``source, ordinal, key, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_key(target_id: Column, key: Column) -> Column:
    return F.concat(F.lit("target."), target_id.cast("string"), F.lit("."), key)


def task_key(task_id: Column, key: Column) -> Column:
    """Task ids may hold slashes and dots, hence the quotes."""
    return F.concat(F.lit('task."'), task_id.cast("string"), F.lit('".'), key)


def prefix_keys(props: DataFrame, kind: str, owner: str = "owner") -> DataFrame:
    """Keys of ``target`` or ``task`` files with their owner's prefix."""
    make = {"target": target_key, "task": task_key}[kind]
    return props.withColumn("key", make(F.col(owner), F.col("key"))).drop(owner)


def overlay_props(props: DataFrame) -> DataFrame:
    """Per key the value of the highest ordinal (null values do not count)."""
    return (
        props.filter("value IS NOT NULL")
        .groupBy("key")
        .agg(F.max(F.struct("ordinal", "value", "source")).alias("top"))
        .select("key", "top.value", "top.source", "top.ordinal")
    )


def strip_prefix(props: DataFrame, prefix: str) -> DataFrame:
    """Properties below a prefix, with the prefix cut off."""
    return props.filter(F.col("key").startswith(prefix) & F.col("value").isNotNull()).withColumn(
        "key", F.substring("key", len(prefix) + 1, 1 << 30)
    )


def target_ids(props: DataFrame) -> DataFrame:
    """Distinct ids that follow ``target.``, up to the next dot."""
    return (
        props.filter(F.col("key").startswith("target."))
        .select(F.regexp_extract("key", r"^target\.([^.]*)", 1).alias("target_id"))
        .distinct()
    )


def split_key(key: Column) -> Column:
    """Struct ``kind, owner, key`` of a prefixed key; null parts if it has no owner."""
    task = r'^task\."(.*?)"\.(.+)$'
    target = r"^target\.([^.]*)\.(.+)$"
    return (
        F.when(
            key.rlike(task),
            F.struct(
                F.lit("task").alias("kind"),
                F.regexp_extract(key, task, 1).alias("owner"),
                F.regexp_extract(key, task, 2).alias("key"),
            ),
        )
        .when(
            key.rlike(target),
            F.struct(
                F.lit("target").alias("kind"),
                F.regexp_extract(key, target, 1).alias("owner"),
                F.regexp_extract(key, target, 2).alias("key"),
            ),
        )
    )


def pivot_props(props: DataFrame, fields: dict[str, str], owner: str = "owner") -> DataFrame:
    """Key/value rows to one typed record per owner, and per kind where there is one.

    ``fields`` maps keys to types. The list is fixed, so one aggregation with a combine
    step and one shuffle does it; a value that does not fit its type becomes null.
    """
    key, value = F.col("key"), F.col("value")
    wide = props.filter(key.isin(*fields))
    wide = wide.groupBy(*[c for c in ("kind", owner) if c in props.columns])
    return wide.agg(
        *[F.max(F.when(key == k, value)).try_cast(t).alias(k) for k, t in fields.items()]
    )


def collect_list_props(props: DataFrame, name: str = "dependencies") -> DataFrame:
    """List entries ``<name>[i]`` as rows with ``position`` (from 0).

    The list stays long: an owner with very many entries is never gathered into one cell.
    """
    entry = rf"^{name}\[(\d+)\]$"
    others = [c for c in props.columns if c != "key"]
    return props.filter(F.col("key").rlike(entry)).select(
        *others, F.regexp_extract("key", entry, 1).cast("int").alias("position")
    )
