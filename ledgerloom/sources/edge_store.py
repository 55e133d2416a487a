"""Edges stored once for many walks: in folders by a hash of either end.

A walk that stands on some nodes reads only the folders that can hold their edges: the frontier's
folders are observed while it is written, and the read filters on them, which prunes files
before any is opened. Nothing is copied for a question, however many are asked.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDERS = 64
ENDS = ("node_id", "depends_on")


class EdgeStore:
    """The edges below ``path``, once by ``node_id`` and once by ``depends_on``.

    Make it with :meth:`write`; another session opens it with the constructor. The number of
    folders belongs to the path's name, so that it cannot be mistaken.
    """

    def __init__(
        self, spark: SparkSession, path: str, id_type: T.DataType, folders: int = FOLDERS
    ):
        self.spark, self.path, self.id_type, self.folders = spark, path, id_type, folders
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def write(cls, edges: DataFrame, path: str, folders: int = FOLDERS) -> EdgeStore:
        store = cls(edges.sparkSession, path, edges.schema["node_id"].dataType, folders)
        store.append(edges)
        return store

    def append(self, edges: DataFrame) -> None:
        """Add edges; those that are there already must not be among them.

        Rebalancing splits the folder of a node that has a large share of all edges.
        """
        for end in ENDS:
            placed = edges.select(*ENDS, self.folder(F.col(end)).alias("folder"))
            (
                placed.hint("rebalance", "folder")
                .sortWithinPartitions("folder", end)
                .write.mode("append")
                .partitionBy("folder")
                .parquet(self._place(end))
            )
        self._tables.clear()

    def _place(self, end: str) -> str:
        return f"{self.path}/{self.folders}-by-{end}"

    def folder(self, node: Column) -> Column:
        """The folder of a node's edges."""
        return F.pmod(F.xxhash64(node), F.lit(self.folders)).cast("int")

    def by(self, end: str, folders: Iterable[int] | None = None) -> DataFrame:
        """``node_id, depends_on``, of the given folders by that end, or all edges.

        Files are listed once for each end, not for each read.
        """
        if end not in self._tables:
            fields = [T.StructField(c, self.id_type) for c in ENDS]
            schema = T.StructType([*fields, T.StructField("folder", T.IntegerType())])
            self._tables[end] = self.spark.read.schema(schema).parquet(self._place(end))
        table = self._tables[end]
        if folders is not None:
            table = table.filter(F.col("folder").isin(sorted(folders)))
        return table.select(*ENDS)

    def edges(self) -> DataFrame:
        return self.by("depends_on")
