"""Snapshots: whole or not at all, one state for a reader, no lost rows."""

import threading

import pytest

from cowrie.sources.snapshots import Conflict, Store

LINES, PAGES = "id string, page string, amount long", "id string, status string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_of_several_tables(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", parts=8)
    assert store.snapshot().number == 0 and store.snapshot().tables() == {}
    lines = spark.createDataFrame([(f"l{i}", "p", i) for i in range(20)], LINES)
    assert store.merge({"lines": lines, "pages": spark.createDataFrame([("p", "read")], PAGES)}) == 1
    old = store.snapshot()
    assert store.merge({"lines": spark.createDataFrame([("l3", "p", 300), ("l99", "p", 99)], LINES), "pages": spark.createDataFrame([("p", "confirmed")], PAGES)}, {"lines": spark.createDataFrame([("l4",)], "id string")}) == 2
    want = {f"l{i}": i for i in range(20) if i != 4} | {"l3": 300, "l99": 99}
    assert rows(store.snapshot().table("lines")) == sorted((k, "p", v) for k, v in want.items())
    assert rows(store.snapshot().table("pages")) == [("p", "confirmed")]
    # a reader of the first snapshot still sees both tables as they were
    assert rows(old.table("pages")) == [("p", "read")] and old.table("lines").count() == 20
    assert rows(store.snapshot(1).table("pages")) == [("p", "read")]
    # only the parts of the three changed keys were written
    assert len(store.changed_parts(1, "lines")) <= 3
    plan = store.snapshot().table("lines", store.changed_parts(1, "lines"))
    assert {p.split("/data/lines/")[1].split("/part=")[1].split("/")[0] for p in plan.inputFiles()} <= {str(p) for p in store.changed_parts(1, "lines")}
    assert store.vacuum(keep=1) > 0 and store.snapshot().table("lines").count() == 20
    store.merge(gone={"lines": store.snapshot().table("lines").select("id")})
    assert store.snapshot().table("lines").count() == 0
    with pytest.raises(KeyError):
        store.merge(gone={"payments": lines})


def test_a_change_that_dies_leaves_the_snapshot(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/s", parts=4)
    store.merge({"lines": spark.createDataFrame([("a", "p", 1)], LINES), "pages": spark.createDataFrame([("p", "read")], PAGES)})
    real = Store._write

    def dies(self, df, name, count):
        if name == "pages":
            raise OSError("disk full")
        return real(self, df, name, count)

    monkeypatch.setattr(Store, "_write", dies)
    with pytest.raises(OSError):
        store.merge({"lines": spark.createDataFrame([("a", "p", 2), ("b", "p", 2)], LINES), "pages": spark.createDataFrame([("p", "confirmed")], PAGES)})
    monkeypatch.undo()
    assert store.snapshot().number == 1
    assert rows(store.snapshot().table("lines")) == [("a", "p", 1)] and rows(store.snapshot().table("pages")) == [("p", "read")]


def test_a_writer_that_comes_second_merges_again(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    store, other = Store(spark, path, parts=1), Store(spark, path, parts=1)
    store.merge({"lines": spark.createDataFrame([("a", "p", 1)], LINES)})
    real, calls = Store._publish, []

    def late(self, manifest):
        if self is store and not calls:
            calls.append(1)
            other.merge({"lines": spark.createDataFrame([("b", "p", 2)], LINES)})
        return real(self, manifest)

    monkeypatch.setattr(Store, "_publish", late)
    assert store.merge({"lines": spark.createDataFrame([("c", "p", 3)], LINES)}) == 3
    assert rows(store.snapshot().table("lines")) == [("a", "p", 1), ("b", "p", 2), ("c", "p", 3)]
    monkeypatch.setattr(Store, "_publish", lambda self, manifest: False)
    with pytest.raises(Conflict):
        store.merge({"lines": spark.createDataFrame([("d", "p", 4)], LINES)}, attempts=2)


def test_two_writers_lose_no_row(spark, tmp_path):
    path, failed = f"{tmp_path}/s", []

    def write(who):
        try:
            for i in range(4):
                Store(spark, path, parts=4).merge({"lines": spark.createDataFrame([(f"{who}{i}", who, i)], LINES), f"of_{who}": spark.createDataFrame([(str(i), who)], PAGES)})
        except Exception as e:  # told in the main thread
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = Store(spark, path).snapshot()
    assert not failed and last.number == 8
    assert rows(last.table("lines")) == sorted((f"{w}{i}", w, i) for w in "xy" for i in range(4))
    assert last.table("of_x").count() == last.table("of_y").count() == 4
