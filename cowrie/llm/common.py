"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions for tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["cowrie"])

#: Rows of an Arrow batch; small, because a row may hold a long text.
ARROW_ROWS = 1000
#: Bytes of text that a task of ours turns into Python objects at a time.
SLICE_BYTES = 4_000_000

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that the driver and all executors reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local session (as in
    tests) gets a temporary folder, which becomes the checkpoint folder as well;
    a cluster gets an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="cowrie-")
            spark.sparkContext.setCheckpointDir(root)
        _OWN[app] = f"{root.rstrip('/')}/cowrie-{uuid.uuid4().hex}"
        atexit.register(_remove_quietly, spark, _OWN[app])
    return _OWN[app]


def open_path(path: str) -> tuple:
    """The file system of a path in the shared folder, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is gone: nothing is left to tell
        pass


def stash(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop(*stashed: DataFrame | None) -> None:
    """Delete tables that ``stash`` wrote and that nothing reads any more."""
    for df in stashed:
        if df is not None and hasattr(df, "_stash_path"):
            remove(df.sparkSession, df._stash_path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for rows with long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shards_for(spark: SparkSession, rows: int, each: int) -> int:
    """Number of groups so that one holds about ``each`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def crc_bucket(key: str | Column, n: int) -> Column:
    """crc32 of a key as text, modulo n; a null key counts as the empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``limit`` bytes each; one row at least."""
    if len(texts) == 0:
        return
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    yield start, len(sizes)


def parts_of(text: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes, cut before a space or a control from 9 to 13."""
    at = 0
    while at < len(text):
        end = at + limit
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end]
        at = end


def utf8(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null gives empty bytes."""
    return [x or b"" for x in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()]


def with_columns_from(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[..., Callable[[list[pa.Array]], list[pa.Array]]],
    *args: object,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Append columns that numpy code makes from ``inputs``, without a shuffle.

    ``make(*args)`` runs once in each task and gives a function from the input
    arrays of a slice (rows with about ``limit`` bytes of the first input) to the
    new arrays. Columns of ``df`` that bear a new name
    are replaced; all others pass through.
    """
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    src = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"cowrie_in_{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*[src.schema[c] for c in keep], *fields])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make(*args)
        for batch in batches:
            for a, b in slices(batch.column(n), limit):
                part = batch.slice(a, b - a)
                made = fn([part.column(n + i) for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=[*keep, *[f.name for f in fields]])

    return src.mapInArrow(run, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node reachable.

    Each round gives every node the least neighbour below it, follows those
    pointers to their ends by doubling, and contracts the edges to what is left
    between the ends. Rounds and doublings grow with the logarithm of the
    longest path; all of it stays in tables.
    """
    e = stash(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    labels = stash(e.select(F.col("hi").alias("node")).union(e.select("lo")).distinct().select("node", F.col("node").alias("root")))
    while not e.isEmpty():
        p = stash(e.groupBy("hi").agg(F.min("lo").alias("to")))
        while True:
            q = p.select(F.col("hi").alias("mid"), F.col("to").alias("further"))
            longer = stash(p.join(q, p["to"] == q["mid"], "left").select("hi", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            moved = not longer.where("moved").isEmpty()
            drop(p)
            p = longer
            if not moved:
                break
        jump = p.select("hi", "to")
        new = stash(labels.join(jump, labels["root"] == jump["hi"], "left").select("node", F.coalesce("to", "root").alias("root")))
        drop(labels)
        labels = new
        up = e.join(jump.withColumnRenamed("to", "hi_to"), "hi", "left").select(F.coalesce("hi_to", "hi").alias("x"), F.col("lo").alias("y"))
        down = up.join(jump.select(F.col("hi").alias("y"), F.col("to").alias("lo_to")), "y", "left").select("x", F.coalesce("lo_to", "y").alias("y"))
        new = stash(down.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
        drop(e, p)
        e = new
    drop(e)
    return labels
