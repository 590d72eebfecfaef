"""Tables a run writes between its steps, under the shared checkpoint folder.

A written table cuts the plan, survives the loss of executors, and lets the optimizer see its
real size, so joins with it are broadcast only when it is small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import new_run_folder


class Workspace:
    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.folder = new_run_folder(spark, label)
        self.entries: list[str] = []

    def write(self, table: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The table, written and read back; ``by`` a column, readers of one of its values read nothing else."""
        path = f"{self.folder}/{name}"
        (table.write.partitionBy(by) if by else table.write).parquet(path)
        # The schema is known: reading it back needs no job and no footer look-up.
        return self.spark.read.schema(table.schema).parquet(path)

    def write_buckets(self, table: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """Write a table dealt out and sorted by ``keys``, one file a bucket, as many as the session shuffles into.

        A join on the keys then reads it as it lies: only the other side is shuffled. The catalog entry
        (an external table, its files stay here) is what tells Spark so; drop it with ``forget``.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        entry = f"reachmap_{name}_{uuid.uuid4().hex}"
        dealt = table.repartition(buckets, *keys)
        dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.folder}/{name}").saveAsTable(entry)
        self.entries.append(entry)
        return self.spark.table(entry)

    def forget(self) -> None:
        """Take the bucketed tables out of the catalog; their files stay."""
        while self.entries:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.entries.pop()}")

    def read(self, names: list[str], like: DataFrame) -> DataFrame:
        """Several written tables of one schema as a single scan."""
        return self.spark.read.schema(like.schema).parquet(*[f"{self.folder}/{name}" for name in names])


def keep_matching(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a wide table whose ``key`` is in a written key table.

    The optimizer knows the keys' true size: few are broadcast into the scan, many are joined by shuffle.
    """
    return table.join(keys.select(key), key, "left_semi")
