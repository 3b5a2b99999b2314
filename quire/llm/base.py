"""Shared ground of the operators: scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Only where that is unset on a local master
    (as in tests) is a temporary folder made and set; on a cluster an unset
    folder is an error, for a machine-local one would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of a file of a table whose size is known.
FILE_ROWS = 100_000
#: Bytes of text that stand behind a file of a table.
FILE_BYTES = 16 << 20


class Scratch:
    """Tables written into the shared folder, which cut lineage and outlive lost executors.

    ``keep`` writes a frame and gives it back as read from the files. ``drop``
    deletes tables that no later step reads; the last table of an operator is
    left to the cluster's own clean-up, as it may be read at any later time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None, size: int | None = None) -> DataFrame:
        """rows: about how many there are at most, or size, of how many bytes of text they come, where that is known; little then goes into few files."""
        if rows is not None or size is not None:
            df = df.coalesce(max(8, rows // FILE_ROWS if rows is not None else size // FILE_BYTES))
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


#: Rows and bytes of a batch that Spark sends to a Python worker while a table is written.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches to Python workers are of BATCH's size while this lasts; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_lean = False


def lean() -> None:
    """In a worker process: memory of large arrays that have ended goes back to the system, rather than staying with the process."""
    global _lean
    if not _lean:
        _lean = True
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


def own_partitions(spark: SparkSession, n: int) -> list[int]:
    """n numbers that ``repartition(n, number)`` sends to n different partitions, the first to the first and so on."""
    found: dict[int, int] = {}
    first, many = 0, 16 * n + 64
    while len(found) < n:
        at = F.pmod(F.hash("id"), F.lit(n))
        for r in spark.range(first, first + many).groupBy(at.alias("at")).agg(F.min("id").alias("id")).collect():
            found.setdefault(r["at"], r["id"])
        first += many
    return [found[i] for i in range(n)]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see frames that are no longer held, so the shuffle files of ended steps go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions_of(df: DataFrame) -> int:
    """Number of partitions of the plan as it stands; no job runs."""
    return max(1, df.rdd.getNumPartitions())


#: Edges that one task joins at a time, at most.
TASK_EDGES = 1 << 20


def joined(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components as ``components`` gives them, with fewer steps for graphs of whole numbers.

    Edges are contracted by ``components``' rounds until at most TASK_EDGES are
    left, which are counted first; those are joined by one task.
    """
    return components(edges, scratch, last=TASK_EDGES)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to), the smallest node of its component, for the edges of all batches."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for first in range(0, len(nodes), 1 << 16):
        some = nodes[first : first + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "to"])


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60, last: int = 0) -> DataFrame:
    """Connected components of an undirected graph; DataFrame operations only.

    edges: (a, b), any comparable type; rows with a null end and loops are left
    out. Returns (node, component), component being the smallest node reachable;
    only nodes with an edge to another node are listed.

    Every round contracts the edges: each node takes the smallest neighbour
    below it, these pointers are doubled until they end at a local minimum, and
    the edges are rewritten between such minima. Every second round leaves at most half
    of the nodes, so the rounds are as the logarithm of the nodes; a rising chain
    of any size is gone after one round, a star after two at most. Aggregates by node combine
    before the exchange; nothing is collected but one count or boolean a job.
    last: once so few edges are left, one task joins them (whole numbers only).
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = scratch.keep(e, "edges-0")
    labels = None
    for k in range(most_rounds):
        n = e.count()
        if not n:
            break
        if n <= last:
            step = scratch.keep(e.coalesce(1).mapInArrow(_union, "node long, to long"), f"step-{k}")
            labels = _relabelled(labels, step, scratch, k)
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        step = step.select("node", F.least("node", "to").alias("to"))
        step = scratch.keep(step, f"step-{k}")
        for j in range(most_rounds):
            to = F.coalesce("y.to", "x.to")
            jump = step.alias("x").join(step.alias("y"), F.col("x.to") == F.col("y.node"), "left")
            step = scratch.keep(jump.select("x.node", to.alias("to"), (to < F.col("x.to")).alias("moved")), f"jump-{k}-{j}")
            if step.where("moved").isEmpty():
                break
        step = step.select("node", "to")
        e = (
            e.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .where("a < b")
            .distinct()
        )
        e = scratch.keep(e, f"edges-{k + 1}")
        labels = _relabelled(labels, step, scratch, k)
    else:
        if not e.isEmpty():
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels


def _relabelled(labels: DataFrame | None, step: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    if labels is None:
        return step.select("node", F.col("to").alias("component"))
    now = step.select(F.col("node").alias("component"), "to")
    return scratch.keep(labels.join(now, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"labels-{k}")


def trim() -> None:
    """In a worker process: free pages between what is still held go back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
