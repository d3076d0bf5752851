"""Several tables changed as one: snapshots with a manifest.

A store is a folder. Rows lie in Parquet files under ``data``, dealt into parts
by a hash of their key; a manifest ``manifests/<number>.json`` says which folders
make up each part of each table. A change writes new folders and then publishes
the next manifest in one step that fails if the number is taken, so

* a change that dies halfway leaves the last snapshot as it was;
* a reader holds one snapshot, whatever is published meanwhile;
* of two writers the second one finds the number taken. Parts that the first one
  did not touch are published as they are, the others are merged again on top;
* a change rewrites the parts that its rows fall in and no others.

Old folders are removed by ``vacuum`` alone.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Other writers were first, time and again."""


class Snapshot:
    """One state of all tables."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.path, self.manifest, self.number = spark, path, manifest, manifest["number"]

    def names(self) -> list[str]:
        return sorted(self.manifest["tables"])

    def folders(self, name: str, parts: list[int] | None = None) -> list[str]:
        held = self.manifest["tables"].get(name, {}).get("parts", {})
        return [f for p in (held if parts is None else map(str, parts)) for f in held.get(p, [])]

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or some of its parts; the others' files are not even listed."""
        schema = T.StructType.fromJson(self.manifest["tables"][name]["schema"])
        found = self.folders(name, parts)
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in found])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in self.names()}


class Store:
    """Tables under ``path``, in ``parts`` parts each; the number of parts is fixed by the first change.

    ``key`` tells rows apart. ``by``, the key if not given, deals them to parts: a
    column that all tables have and that a row never changes, such as its trader,
    so that what belongs together lies in the same parts of all tables.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, key: str = "id", by: str | None = None) -> None:
        self.spark, self.path, self.key, self.by = spark, path.rstrip("/"), key, by or key
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(self.path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._files.getScheme() == "file"
        self._empty = {"number": 0, "count": parts, "tables": {}}

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        folder = self._path("manifests")
        if not self._files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _load(self, number: int) -> dict:
        stream = self._files.open(self._path(f"manifests/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The last snapshot, or an earlier one; a store without any is empty and has number 0."""
        if number is None:
            known = self._numbers()
            number = known[-1] if known else 0
        return Snapshot(self.spark, self.path, self._load(number) if number else self._empty)

    def _publish(self, manifest: dict) -> bool:
        """Put a manifest in its place; false if the number is taken."""
        self._files.mkdirs(self._path("manifests"))
        final, temporary = self._path(f"manifests/{manifest['number']:012d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._files.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._local:  # a rename would replace an existing file, a link does not
                where = [p.toUri().getPath() for p in map(self._files.makeQualified, (temporary, final))]
                try:
                    os.link(*where)
                except FileExistsError:
                    return False
                return True
            return bool(self._files.rename(temporary, final))
        finally:
            self._files.delete(temporary, False)

    def _part(self, count: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by).cast("string")), F.lit(count)).cast("int")

    def _write(self, rows: DataFrame, name: str, count: int) -> dict[str, list[str]]:
        """Write rows dealt into parts; folders by part."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.withColumn("part", self._part(count)).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        kept = (s.getPath().getName() for s in self._files.listStatus(self._path(folder)) if s.isDirectory())
        return {n.removeprefix("part="): [f"{folder}/{n}"] for n in kept if n.startswith("part=")}

    def _merged(self, base: Snapshot, name: str, rows: DataFrame | None, gone: DataFrame | None, parts: list[int]) -> dict[str, list[str]]:
        """New folders of the parts: rows of ``base`` without those replaced or gone, and the new rows."""
        old = base.table(name, parts)
        for keys in (rows, gone):
            if keys is not None:
                old = old.join(keys.select(self.key).distinct(), self.key, "left_anti")
        new = old if rows is None else old.unionByName(rows.select(*old.columns))
        made = self._write(new, name, base.manifest["count"])
        return {str(p): made.get(str(p), []) for p in parts}

    def merge(self, rows: Mapping[str, DataFrame] | None = None, gone: Mapping[str, DataFrame] | None = None, attempts: int = 20) -> int:
        """Put ``rows`` in place of those with their keys (or add them), drop the keys of ``gone``, all tables at once; gives the snapshot's number.

        A key that repeats within ``rows`` is an error of the caller and is kept
        as given. Tables that the store lacks are made; rows with a null key are
        added. ``gone`` has the key and the column that deals to parts.
        """
        rows, gone = dict(rows or {}), dict(gone or {})
        base = self.snapshot()
        count, schemas = base.manifest["count"], {n: base.manifest["tables"][n]["schema"] for n in base.names()}
        unknown = set(gone) - set(schemas) - set(rows)
        if unknown:
            raise KeyError(f"no such table: {sorted(unknown)}")
        for n, df in rows.items():
            schemas.setdefault(n, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).jsonValue())
        touched: dict[str, list[int]] = {}
        for n in {*rows, *gone}:
            keys = [df.select(self._part(count).alias("part")) for df in (rows.get(n), gone.get(n)) if df is not None]
            both = keys[0] if len(keys) == 1 else keys[0].union(keys[1])
            touched[n] = sorted(r.part for r in both.distinct().collect())  # at most one row a part
        made: dict[str, dict[str, list[str]]] = {}
        stale = {n: parts for n, parts in touched.items() if parts}
        for _ in range(attempts):
            view = Snapshot(self.spark, self.path, {**base.manifest, "tables": {n: base.manifest["tables"].get(n, {"schema": schemas[n], "parts": {}}) for n in schemas}})
            if stale:
                with ThreadPoolExecutor(len(stale)) as pool:  # one job for each table
                    done = {n: pool.submit(self._merged, view, n, rows.get(n), gone.get(n), parts) for n, parts in stale.items()}
                    for n, f in done.items():
                        made.setdefault(n, {}).update(f.result())
            tables = {n: {"schema": schemas[n], "parts": {**view.manifest["tables"][n]["parts"], **made.get(n, {})}} for n in schemas}
            manifest = {"number": base.number + 1, "count": count, "tables": tables}
            if self._publish(manifest):
                return manifest["number"]
            later = self.snapshot()
            if later.manifest["count"] != count:  # another first change fixed the number of parts
                return self.merge(rows, gone, attempts - 1)
            changed = lambda n, p, x=base, y=later: x.folders(n, [p]) != y.folders(n, [p])
            stale = {n: hit for n, parts in touched.items() if (hit := [p for p in parts if changed(n, p)])}
            for n in later.names():
                schemas.setdefault(n, later.manifest["tables"][n]["schema"])
            base = later
        raise Conflict(f"{attempts} attempts failed")

    def changed_parts(self, since: int, name: str) -> list[int]:
        """Parts of a table whose folders differ between a snapshot and the last one."""
        old, new = self.snapshot(since), self.snapshot()
        return [p for p in range(new.manifest["count"]) if old.folders(name, [p]) != new.folders(name, [p])]

    def vacuum(self, keep: int = 10) -> int:
        """Remove the manifests before the last ``keep`` and the folders that only they name; gives how many folders went.

        Not to be run while a change is being written: its folders have no manifest yet.
        """
        numbers = self._numbers()
        held, going = numbers[-keep:], numbers[:-keep]
        listed = lambda ns: {f for n in ns for t in self._load(n)["tables"].values() for fs in t["parts"].values() for f in fs}
        gone = listed(going) - listed(held)
        for f in gone:
            self._files.delete(self._path(f), True)
        for n in going:
            self._files.delete(self._path(f"manifests/{n:012d}.json"), False)
        return len(gone)
