"""Days that follow changes equal days made anew, and only changed parts are read."""

import datetime as dt
import random

from cowrie.operators import incremental, profile
from cowrie.sources.snapshots import Store

ENTRY = "id string, trader_id string, source_id string, seq int, status string, date date, description string, amount long, type string"
SOURCE = "id string, trader_id string, created_at int, status string, duplicate_kept boolean"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_days_follow_changes(spark, tmp_path):
    rng = random.Random(4)
    store = Store(spark, f"{tmp_path}/s", parts=16, by="trader_id")
    assert incremental.refresh(store) == []
    day = lambda: dt.date(2026, 9, rng.randint(1, 9)) if rng.random() < 0.95 else None
    line = lambda i, t, p: (f"e{i}", t, p, i, rng.choice(["confirmed", "confirmed", "pending", "rejected"]), day(), rng.choice(["rice", "soap"]), rng.choice([5, 9, 0]), rng.choice(["sale", "expense"]))
    traders = [f"t{k}" for k in range(30)]
    pages = [(f"{t}p{k}", t, k, rng.choice(["read", "read", "duplicate"]), rng.random() < 0.5) for t in traders for k in range(3)]
    owner = {p[0]: p[1] for p in pages}
    lines = [line(i, owner[p], p) for i, p in enumerate(rng.choice(pages)[0] for _ in range(500))]
    # a page and its copy, told apart later
    lines += [(f"{c}{i}", "t3", f"t3p{k}", 900 + i, "confirmed", dt.date(2026, 9, 5 + i), "rice", 50 + i, "sale") for k, c in ((0, "a"), (2, "b")) for i in range(9)]
    store.merge({"entries": spark.createDataFrame(lines, ENTRY), "sources": spark.createDataFrame(pages, SOURCE)})
    batches = [
        {"entries": spark.createDataFrame([line(1000 + i, "t1", "t1p0") for i in range(3)] + [line(7, lines[7][1], lines[7][2])], ENTRY)},
        {"sources": spark.createDataFrame([(pages[8][0], pages[8][1], 1, "duplicate", False)], SOURCE)},
        {"told_apart": spark.createDataFrame([("x", "t3", "t3p0", "t3p2")], "id string, trader_id string, a string, b string")},
        {},
    ]
    made = incremental.refresh(store)
    assert made == list(range(16)) and incremental.refresh(store) == []
    for batch in [None, *batches]:
        if batch is not None:
            touched = {r.part for t in batch.values() for r in t.select(store._part(16).alias("part")).collect()}
            if batch:
                store.merge(batch)
            number, stale = incremental.stale_parts(store)
            assert set(stale) == touched
            if stale:  # the plan reads no file of another part
                plan = incremental.days_of(store.snapshot(number), stale)
                assert {int(f.split("/part=")[1].split("/")[0]) for f in plan.inputFiles() if "/data/entries/" in f or "/data/sources/" in f} <= touched
            assert incremental.refresh(store) == stale
        whole = incremental.days_of(store.snapshot())
        assert rows(incremental.stored_days(store)) == rows(whole.select(*incremental.stored_days(store).columns))
    assert rows(profile.headline(incremental.stored_days(store))) == rows(profile.headline(whole))
    # lines go: their days go too
    store.merge(gone={"entries": store.snapshot().table("entries").where("trader_id = 't3'").select("id", "trader_id")})
    incremental.refresh(store)
    assert incremental.stored_days(store).where("trader_id = 't3'").count() == 0
