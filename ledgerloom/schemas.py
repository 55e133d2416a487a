"""Schemas and fixed domains shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
UP, DOWN = "UP", "DOWN"
SUCCESS, FAILURE, SKIPPED = "SUCCESS", "FAILURE", "SKIPPED"
DIRECTIONS = (UP, DOWN)
STATUSES = (SUCCESS, FAILURE, SKIPPED)

HISTORY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("node_id", T.StringType(), False),
        T.StructField("environment_id", T.StringType(), False),
        T.StructField("direction", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("executed_at", T.TimestampType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("serialized_down_task", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("error_message", T.StringType()),
    ]
)

TASK_SPECS = T.StructType(
    [
        T.StructField("task_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("dependencies", T.ArrayType(T.StringType())),
        T.StructField("up", T.StringType()),
        T.StructField("down", T.StringType()),
        T.StructField("autocommit", T.BooleanType()),
    ]
)


class CycleError(ValueError):
    """A plan was asked for on a graph that has no order."""


class UnknownNodeError(ValueError):
    """A named target is not a node of the graph."""
