"""Shared pieces: scratch tables in the cluster's shared folder, Arrow helpers
and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most rows and most Arrow bytes, but for one longer row, that a function over texts turns into Python objects at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1_000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about ``BYTES_AT_ONCE`` in both the JVM and the workers, unless the session sets another bound.

    Batches of 10,000 rows of whole texts would else take up to 64 MB a task on either side.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_AT_ONCE))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor re-reads them from there; superseded tables are deleted
    with :meth:`drop` so that disk use stays near one copy.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a plan that only reads it back."""
        path = f"{self.root}/t{self.count}"
        self.count += 1
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._gneiss_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table of :meth:`cut` that nothing reads any more."""
        self.delete(df._gneiss_path)

    def delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of bounded rows and bytes; a row longer than the bound is a slice of its own."""
    at = 0
    while at < batch.num_rows:
        n = min(ROWS_AT_ONCE, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > BYTES_AT_ONCE:
            n = -(-n // 2)
        yield batch.slice(at, n)
        at += n


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """Lift a function of one Arrow batch to what ``mapInArrow`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield fn(part)
        pa.default_memory_pool().release_unused()  # the worker may live on for other tasks

    return run


class WholeGroups:
    """Batches in the order of a key as tables of about ``rows`` that hold all of each key they hold.

    No more is held than that and one key's rows.
    """

    def __init__(self, key: str, rows: int = 200_000):
        self.key, self.rows = key, rows
        self.held: list[pa.RecordBatch] = []
        self.count, self.wait = 0, rows

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        """The tables that are complete with ``batch``: one or none."""
        if not batch.num_rows:
            return
        self.held.append(batch)
        self.count += batch.num_rows
        if self.count < self.wait:
            return
        table = pa.Table.from_batches(self.held).combine_chunks()
        at = np.flatnonzero(np.diff(table.column(self.key).to_numpy()))
        if not len(at):  # one key alone: look again when twice as much has come
            self.held, self.wait = table.to_batches(), 2 * self.count
            return
        end = int(at[-1]) + 1
        rest = table.slice(end).combine_chunks()
        self.held, self.count, self.wait = rest.to_batches(), rest.num_rows, self.rows
        yield table.slice(0, end).combine_chunks()

    def last(self) -> Iterator[pa.Table]:
        if self.held:
            yield pa.Table.from_batches(self.held).combine_chunks()
            self.held = []


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and, for each, the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        if (lx == ly).all():
            return nodes, nodes[label]
        low = np.minimum(lx, ly)
        np.minimum.at(label, lx, low)
        np.minimum.at(label, ly, low)
        while (label[label] != label).any():
            label = label[label]


def _local_forest(batches):
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, a)) > 4_000_000:  # bounded memory: contract what is held
            nodes, root = forest(np.concatenate(a), np.concatenate(b))
            a, b = [nodes[nodes != root]], [root[nodes != root]]
            if len(a[0]) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], ["u", "v"])
                a, b = [], []
    if a:
        nodes, root = forest(np.concatenate(a), np.concatenate(b))
        keep = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], ["u", "v"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)`` but the smallest of its component; two long columns.

    ``component`` is the smallest node reachable; it has no row of its own. Each input partition is first
    contracted to a forest; then large-star and small-star rounds alternate until
    the edge set is a set of stars, in a number of rounds that grows with the
    logarithm of the graph. Minima are pre-aggregated, a hub's edges can be split,
    and each round's edges are one table in the shared folder.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).mapInArrow(_local_forest, "u long, v long")
    now = scratch.cut(e.distinct())
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = scratch.cut(small.distinct())
        scratch.drop(now)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _star(e: DataFrame) -> DataFrame:
    """Each edge with ``m``, the least of ``u`` and its neighbours.

    The minima get their own shuffle (the sum hides that they are already dealt by
    ``u``), so both sides of the join are exchanges and AQE can split a hub's edges.
    """
    least = e.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).select((F.col("u") + 0).alias("u"), "m")
    return e.join(least, "u")


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
