"""Tables in the shared folder that cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Lineage:
    """Writes a table once and reads it back, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
            folder = "file://" + tempfile.mkdtemp(prefix="gneiss-")
            spark.conf.set("spark.checkpoint.dir", folder)
        self.spark, self.root, self.count = spark, f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, if it has fewer.

    A small table in one file would otherwise be worked on by one core: Spark cuts the
    file into splits by bytes, but a row group is read by one of them. So up to one
    split a core is dealt anew; a table of more is left as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
