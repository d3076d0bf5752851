"""Photo files by content: each different content is one file named by its SHA-256, an index says which id has which.

Contents go through a data source writer of Spark. A task writes into a staging
folder of its own and moves a file to its name only when it is whole; a task that
fails removes what it staged, and a job that fails removes all of it, so under a
digest lies that content or nothing. The index is a table of a snapshot store and
changes after the files are there, in one step: an id never points to a file that
is missing. Files go only after no id points to them.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cowrie.sources.snapshots import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this module

INDEX = "id string, sha256 string, bytes long"


def _at(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _name(base: str, digest: str) -> str:
    return f"{base}/files/{digest[:2]}/{digest}"


@dataclass
class Saved(WriterCommitMessage):
    """What a task has put in place."""

    files: int
    bytes: int


class BlobWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Saved:
        files, base = _at(self.root)
        staging = f"{base}/staging/{self.job}/{uuid.uuid4().hex}"
        files.create_dir(staging, recursive=True)
        done, size = 0, 0
        try:
            for row in rows:
                content = bytes(row.content)
                digest = hashlib.sha256(content).hexdigest()
                final = _name(base, digest)
                if files.get_file_info(final).type != fs.FileType.NotFound:
                    continue
                with files.open_output_stream(f"{staging}/{digest}") as out:
                    out.write(content)
                files.create_dir(final.rpartition("/")[0], recursive=True)
                files.move(f"{staging}/{digest}", final)  # of two tasks with one content the later replaces it by the same
                done, size = done + 1, size + len(content)
        finally:
            files.delete_dir(staging)
        return Saved(done, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, base = _at(self.root)
        if files.get_file_info(f"{base}/staging/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/staging/{self.job}")


class BlobSink(DataSource):
    """``df.write.format("cowrie_blobs").mode("append").save(folder)`` for rows with ``content``."""

    @classmethod
    def name(cls) -> str:
        return "cowrie_blobs"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        if overwrite or "content" not in schema.names:
            raise ValueError("blobs are appended, from a column named content")
        return BlobWriter(self.options["path"])


class Blobs:
    """Contents by id in a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, f"{self.root}/index", parts)
        spark.dataSource.register(BlobSink)

    def index(self) -> DataFrame:
        """(id, sha256, bytes) of every id."""
        last = self.store.snapshot()
        return last.table("blobs") if "blobs" in last.names() else self.spark.createDataFrame([], INDEX)

    def save(self, rows: DataFrame) -> int:
        """Save (id, content), later contents in place of earlier ones; gives how many ids changed.

        Contents that are there already, under any id, are not written again, and
        ids that keep their content change nothing. Null contents are left out; of
        an id that repeats the content with the least digest is saved.
        """
        told = rows.where("content IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("string").alias("id"), "content", F.sha2("content", 256).alias("sha256"))
        named = told.groupBy("id").agg(F.min("sha256").alias("sha256"))
        held = self.index()
        changed = named.join(held.select("id", "sha256"), ["id", "sha256"], "left_anti")
        sizes = told.select("sha256", F.octet_length("content").cast("long").alias("bytes")).distinct()
        fresh = changed.select("sha256").distinct().join(held.select("sha256").distinct(), "sha256", "left_anti")
        contents = told.join(fresh, "sha256", "left_semi").groupBy("sha256").agg(F.first("content").alias("content"))
        index = changed.join(sizes, "sha256").select("id", "sha256", "bytes")
        contents.select("content").write.format("cowrie_blobs").mode("append").save(self.root)
        n = index.count()
        if n:
            self.store.merge({"blobs": index})
        return n

    def read(self, ids: DataFrame) -> DataFrame:
        """(id, sha256, content) of those of ``ids`` (id) that are there; tasks read the files."""
        root = self.root

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = _at(root)
            for batch in batches:
                for i in range(batch.num_rows):  # a file at a time, as files may be large
                    with files.open_input_stream(_name(base, batch.column(1)[i].as_py())) as f:
                        content = pa.array([f.read()], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), content], names=["id", "sha256", "content"])

        wanted = self.index().join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("id", "sha256")
        return wanted.mapInArrow(load, "id string, sha256 string, content binary")

    def delete(self, ids: DataFrame) -> int:
        """Forget ids, and remove the files that no id points to any more; gives the number of files removed.

        Not to be run while contents are being saved: they may rest on a file that goes.
        """
        held = self.index()
        going = held.join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        freed = going.select("sha256").distinct().join(held.join(going.select("id"), "id", "left_anti").select("sha256"), "sha256", "left_anti")
        root = self.root

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = _at(root)
            for batch in batches:
                for digest in batch.column(0).to_pylist():
                    if files.get_file_info(_name(base, digest)).type != fs.FileType.NotFound:
                        files.delete_file(_name(base, digest))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        if "blobs" not in self.store.snapshot().names():
            return 0
        removing = freed.mapInArrow(remove, "n long")  # bound to the snapshot before the change
        self.store.merge(gone={"blobs": going.select("id")})
        return removing.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
