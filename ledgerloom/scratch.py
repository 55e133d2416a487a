"""Written intermediate tables: how the iterative operators cut lineage.

A round of a fixpoint ends with a table written below the shared folder named by
``spark.checkpoint.dir`` and read back from there. A lost executor therefore costs a
re-run of the current round only, plans never grow with the number of rounds, and the
planner sees true file sizes, so it broadcasts a side only when its bytes are below
``spark.sql.autoBroadcastJoinThreshold``. The row counts that steer a loop are observed
during the write itself; no extra job is run for them.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of this session; on a local master else one in its warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps"


class Scratch:
    """One run's private folder below the checkpoint root.

    Results that are returned lazily read from it, so it is left in place: expire the
    ``ledgerloom-<application id>`` folders as any other checkpoint data.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        application = spark.sparkContext.applicationId
        self.path = f"{checkpoint_root(spark)}/ledgerloom-{application}/{label}-{uuid.uuid4().hex}"

    def write(
        self, df: DataFrame, name: str, by: list[str] | None = None, **measures: Column
    ) -> dict[str, Any]:
        """Write ``df``, in folders ``by`` columns, and return its row count ``n`` and the given
        aggregates."""
        seen = Observation()
        observed = df.observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            *[measure.alias(key) for key, measure in measures.items()],
        )
        observed.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{self.path}/{name}")
        return seen.get

    def read(self, schema: T.StructType, *names: str) -> DataFrame:
        """Read written tables back as one; the schema is known, so no file is probed."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def keep(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Write and read back: ``(table, row count)``."""
        counts = self.write(df, name)
        return self.read(df.schema, name), counts["n"]
