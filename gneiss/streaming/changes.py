"""Scans as a stream: an extension of our own, since the batch model has only snapshots.

Each micro-batch of scanned rows is compared with the last version and becomes a new version
beside it, so a batch that is run again after a failure gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.incremental import diff


class ChangeStore:
    """Versions of a file table under ``root``, one folder per epoch, and the changes that led to them."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _table(self, name: str, epoch: int) -> DataFrame:
        if epoch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}/epoch={epoch}")

    def state(self, epoch: int) -> DataFrame:
        return self._table("state", epoch)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """``foreachBatch`` function: upsert the batch's rows; a row with null size is a deletion."""
        before = self.state(epoch - 1)
        newest = batch.groupBy("relative_path").agg(F.max_by(F.struct(*batch.columns), "last_write_utc").alias("r")).select("r.*")
        kept = before.join(newest.select("relative_path"), "relative_path", "left_anti").select(*before.columns)
        after = kept.unionByName(newest.where("size_bytes is not null"))
        after.write.mode("overwrite").parquet(f"{self.root}/state/epoch={epoch}")
        diff(before, self.state(epoch)).write.mode("overwrite").parquet(f"{self.root}/changes/epoch={epoch}")

    def changes(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/changes/epoch={epoch}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
