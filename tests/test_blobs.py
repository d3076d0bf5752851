"""Photo files by content: saved once, read, replaced, deleted; failures leave nothing half done."""

import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from cowrie.sources.blobs import Blobs


def files(root):
    return {p.name: p.stat().st_mtime_ns for p in pathlib.Path(root, "files").rglob("*") if p.is_file()}


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "id string, content binary")


def test_blobs(spark, tmp_path):
    root = f"{tmp_path}/b"
    blobs = Blobs(spark, root, parts=4)
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    rows = [("a", b"one"), ("b", b"two"), ("c", b"one"), ("d", None), (None, b"three"), ("e", b"")]
    assert blobs.save(table(spark, rows).repartition(3)) == 4
    kept = files(root)
    assert set(kept) == {hashlib.sha256(x).hexdigest() for x in (b"one", b"two", b"")} and not any(pathlib.Path(root, "staging").iterdir())
    assert {(r.id, bytes(r.content)) for r in blobs.read(ids("a", "c", "e", "zz")).collect()} == {("a", b"one"), ("c", b"one"), ("e", b"")}
    assert {(r.id, r.bytes) for r in blobs.index().collect()} == {("a", 3), ("b", 3), ("c", 3), ("e", 0)}
    number = blobs.store.snapshot().number
    assert blobs.save(table(spark, rows)) == 0 and files(root) == kept and blobs.store.snapshot().number == number  # a repeated save writes nothing
    assert blobs.save(table(spark, [("a", b"four")])) == 1 and [bytes(r.content) for r in blobs.read(ids("a")).collect()] == [b"four"]
    assert blobs.delete(ids("a", "b")) == 2 and blobs.delete(ids("a", "b")) == 0
    assert {(r.id, bytes(r.content)) for r in blobs.read(ids("a", "b", "c", "e")).collect()} == {("c", b"one"), ("e", b"")}
    assert set(files(root)) == {hashlib.sha256(x).hexdigest() for x in (b"one", b"")}


def test_a_save_that_fails_leaves_index_and_staging_as_they_were(spark, tmp_path):
    root = f"{tmp_path}/b"
    blobs = Blobs(spark, root, parts=2)
    blobs.save(table(spark, [("a", b"one")]))
    bad = spark.range(40).select(F.concat(F.lit("k"), "id").alias("id"), F.when(F.col("id") < 39, F.col("id").cast("string").cast("binary")).otherwise(F.raise_error(F.lit("lost"))).cast("binary").alias("content")).repartition(4)
    with pytest.raises(Exception, match="lost"):
        blobs.save(bad)
    assert [r.id for r in blobs.index().collect()] == ["a"]
    assert not pathlib.Path(root, "staging").exists() or not any(p.is_file() for p in pathlib.Path(root, "staging").rglob("*"))
    assert all(hashlib.sha256(p.read_bytes()).hexdigest() == p.name for p in pathlib.Path(root, "files").rglob("*") if p.is_file())
