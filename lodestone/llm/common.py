"""Shared storage, size checks and graph helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

#: A side of a join is broadcast only when rows * width stays under this many bytes.
BROADCAST_BYTES = 24 << 20
#: Python works on at most so many text bytes (or one row) at once.
SLICE_BYTES = 8 << 20
#: A graph of at most so many edges (2 MB) is finished inside one task.
LOCAL_EDGES = 1 << 17


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for work that is heavy per text: over all cores even where the table is one small file."""
    return spread(documents(spark, sf_dir))


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where unset, an own one in local mode
    and an error on a cluster, whose machines share no temporary folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(_remove_quietly, root)
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def _remove_quietly(root: str) -> None:
    import shutil

    shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/lodestone-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: a cut in the lineage that
    survives lost executors. Returns the reread table and its path (see `discard`)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a materialised table that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def join_small(left: DataFrame, right: DataFrame, on, how: str, rows: int, row_bytes: int = 48) -> DataFrame:
    """Join with `right` broadcast when its checked size allows; else a shuffled join."""
    return left.join(F.broadcast(right) if fits_broadcast(rows, row_bytes) else right.hint("merge"), on, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """`name`, or with leading underscores as far as df has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def slices(batch, column: int, rows: int = 512, size: int = SLICE_BYTES):
    """Cut an Arrow batch where `rows` rows or `size` bytes of its text column are reached, so that long
    texts come few at a time; a single text of more bytes comes alone."""
    texts = batch.column(column)
    if not len(texts):
        return
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + size, side="right"))
        stop = min(max(stop, start + 1), start + rows, len(texts))
        yield batch.slice(start, stop - start)
        start = stop


def _finish(edges: DataFrame) -> DataFrame:
    """(node, to): the components of a small graph, each node to one node of its component."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "to"])

    return edges.coalesce(1).mapInArrow(run, "node long, to long")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of edges(u, v): returns (node, label), label the least node.

    Every round maps each node to the node of its closed neighbourhood that comes first in an order
    drawn anew (a hash keyed by the round), then contracts the edges by that map. Whatever the graph and
    its ids, a round is expected to keep at most three quarters of the nodes that have edges, so the
    rounds are logarithmic in the graph (a path keeps half, a star of any size a share drawn at random);
    the loop ends when no edge is left, not after some count. A round is one partial aggregation and
    equi-joins. Once at most `local_edges` edges are left, one task finishes them by union-find. The
    rounds' maps shrink as the graph does and are composed backwards at the end. All tables but the
    result are deleted.
    """
    spark = edges.sparkSession
    steps, held = [], []

    def keep(df, name):
        out, path = materialise(df, name)
        held.append(path)
        return out

    def tidy(df):
        return keep(df.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")

    left = tidy(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    n, salt = left.count(), 0
    while n > local_edges:
        order = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = left.union(left.select("v", "u"))
        first = both.groupBy("u").agg(F.min(order("v")).alias("near"))
        step = keep(first.select(F.col("u").alias("node"), F.least(F.col("near"), order("u"))["x"].alias("to")), "step")
        steps.append(step)
        to = lambda name: step.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))  # noqa: B023, E731
        left = tidy(left.join(to("u"), "u").join(to("v"), "v").select(F.col("u_to").alias("u"), F.col("v_to").alias("v")))
        n, salt = left.count(), salt + 1
    whole = keep(_finish(left), "step")
    for step in reversed(steps):  # a node's image, followed to the end; images without edges are at theirs
        ahead = whole.select(F.col("node").alias("to"), F.col("to").alias("end"))
        whole = keep(step.join(ahead, "to", "left").select("node", F.coalesce("end", "to").alias("to")), "step")
    least = whole.groupBy("to").agg(F.min("node").alias("label"))
    labels, _ = materialise(whole.join(least, "to").select("node", "label"), "labels")
    for path in held:
        discard(spark, path)
    return labels
