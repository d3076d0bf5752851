"""Events of changes, and the same state from the log as from the tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cowrie.operators import changes, history
from cowrie.sources.tables import ENTRY, SOURCE, TRADER

TODAY = dt.date(2026, 9, 30)
WHEN = [dt.datetime(2026, 9, 30, h) for h in range(24)]


def table(spark, ddl, rows):
    names = [x.split()[0] for x in spark.createDataFrame([], ddl).columns]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def start(spark):
    rng = random.Random(3)
    traders = table(spark, TRADER, [{"id": t, "name": t, "consent": (False, None, None, None)} for t in "tuv"])
    sources = table(spark, SOURCE + ", confirmed_at timestamp, error string", [{"id": f"p{i}", "trader_id": "tuv"[i % 3], "kind": "notebook", "status": ["pending", "duplicate", "read"][i // 3 % 3], "distinct_from": []} for i in range(12)])
    lines = [{"id": f"e{i}", "trader_id": "tuv"[i % 12 % 3], "source_id": f"p{i % 12}", "seq": i, "origin": "ai", "status": "pending", "date": TODAY if rng.random() < 0.9 else None, "description": "rice", "amount": rng.choice([5, 9]), "type": "sale", "flags": []} for i in range(48)]
    return {"traders": traders, "sources": sources, "entries": table(spark, ENTRY, lines)}


def keep(df):
    """A local copy, so that plans do not grow from step to step."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_replaying_the_log_gives_the_tables(spark):
    rng, now = random.Random(9), start(spark)
    empty = {n: t.limit(0) for n, t in now.items()}
    log = [history.events_between(empty, now, F.lit(WHEN[0])).withColumn("ord", F.lit(0))]
    lines = now["entries"].select("id", "source_id", F.lit(WHEN[0]).alias("at"), F.lit(-1).alias("ord"))
    ids = lambda column, *names: spark.createDataFrame([(x,) for x in names], f"{column} string")
    for k in range(1, 10):
        was, kind = dict(now), k % 9
        if kind in (1, 5):
            asked = ids("source_id", *[f"p{i}" for i in rng.sample(range(12), 6)])
            now["entries"], now["sources"], _, _ = changes.confirm_pages(was["entries"], was["sources"], asked, TODAY, WHEN[k])
        elif kind == 2:
            now["sources"] = changes.keep_duplicates(was["sources"], ids("source_id", "p3", "p4", "p0"))
        elif kind == 3:
            now["sources"] = changes.mark_distinct(was["sources"], spark.createDataFrame([("p0", "p3"), ("p9", "p0"), ("p1", "p0")], "a string, b string"))
        elif kind == 4:
            patches = spark.createDataFrame([("e1", "rejected", None), ("e8", "rejected", None), ("e6", None, 77), ("e7", "confirmed", None)], "id string, status string, amount long").selectExpr("id", "status", "CAST(NULL AS DATE) AS date", "FALSE AS clear_date", "CAST(NULL AS STRING) AS description", "amount", "CAST(NULL AS STRING) AS type")
            now["entries"] = changes.patch_entries(was["entries"], patches.where("id <> 'e7'"), TODAY, WHEN[k]).select(*was["entries"].columns)
        elif kind == 6:
            now["traders"] = changes.set_consent(was["traders"], spark.createDataFrame([("t", True, "A"), ("u", True, "A"), ("v", True, "B")], "trader_id string, granted boolean, code string"), WHEN[k])
        elif kind == 7:
            now["traders"] = changes.set_consent(was["traders"], spark.createDataFrame([("t", False, None), ("v", True, "C"), ("u", True, "B")], "trader_id string, granted boolean, code string"), WHEN[k])
        elif kind == 8:
            outcomes = spark.createDataFrame([("p3", None, 3), ("p4", "ai_failed", None), ("p1", None, 2)], "source_id string, error string, lines int")
            now["sources"] = changes.record_readings(was["sources"], outcomes)[0]
        else:
            now["sources"], now["entries"], _ = changes.without_sources(was["sources"], was["entries"], was["entries"], ids("source_id", "p9"))
        now = {n: keep(t) for n, t in now.items()}
        log.append(keep(history.events_between(was, now, F.lit(WHEN[k]))).withColumn("ord", F.lit(k)))
    events = log[0]
    for more in log[1:]:
        events = events.unionByName(more)
    events = keep(events)
    kinds = {r.type for r in events.select("type").distinct().collect()}
    assert kinds >= {"trader_created", "consent_granted", "consent_revoked", "page_added", "page_deleted", "photo_duplicate_kept", "page_read", "page_read_failed", "page_confirmed", "pages_marked_distinct", "entry_rejected", "entry_corrected"}
    got = {r.source_id: (r.status, r.confirmed_at, r.duplicate_kept, sorted(r.distinct_from)) for r in history.page_states(events).collect()}
    assert got == {r.id: (r.status, r.confirmed_at, bool(r.duplicate_kept), sorted(r.distinct_from)) for r in now["sources"].collect()}
    got = {r.trader_id: (r.granted, r.code, r.granted_at, r.revoked_at) for r in history.consent_states(events).collect()}
    want = {r.id: (r.consent.granted, r.consent.code, r.consent.granted_at, r.consent.revoked_at) for r in now["traders"].collect()}
    assert got == {k: v for k, v in want.items() if v != (False, None, None, None)} and len(got) == 2
    got = {r.id: (r.status, r.confirmed_at) for r in history.line_states(events, lines.join(now["entries"].select("id"), "id", "left_semi")).collect()}
    assert got == {r.id: (r.status, r.confirmed_at) for r in now["entries"].collect()}
    # at an earlier time
    early = history.page_states(events.where(F.col("at") <= F.lit(WHEN[0])))
    assert {r.status for r in early.collect()} == {"pending", "duplicate", "read"} and early.where("confirmed_at IS NOT NULL").count() == 0


def test_added_lines_and_restored_ones(spark):
    was = start(spark)
    was["entries"] = keep(was["entries"].withColumn("status", F.when(F.col("id") == "e3", "rejected").otherwise(F.col("status"))))
    added = spark.createDataFrame([("n1", "p2", 1, TODAY, "soap", 7, "sale")], "id string, source_id string, ord int, date date, description string, amount long, type string")
    lines, refused = changes.add_entries(was["entries"], added, was["sources"], TODAY, WHEN[1])
    lines = lines.withColumn("status", F.when(F.col("id") == "e3", "pending").otherwise(F.col("status")))
    got = {tuple(r) for r in history.events_between(was, {**was, "entries": lines}, WHEN[1]).select("trader_id", "type", "source_id", "entry_id", "detail").collect()}
    assert got == {("v", "entry_added", "p2", "n1", "7"), ("t", "entry_restored", "p3", "e3", None)} and refused.count() == 0


def test_reread_payments_keep_what_is_on_file(spark):
    ddl = "id string, ord int, trader_id string, source_id string, direction string, amount long, date date, time string, ref string, raw string"
    old = spark.createDataFrame([("a", 1, "t", "p", "in", 5, TODAY, None, "R1", "x", None), ("b", 2, "t", "q", "in", 5, TODAY, None, "r1", "x", "a"), ("c", 3, "t", "q", "in", 5, TODAY, None, "R2", "x", None), ("d", 4, "u", "q", "in", 5, TODAY, None, "R3", "x", None)], ddl + ", duplicate_of string")
    fresh = spark.createDataFrame([("e", 5, "t", "p", "in", 5, TODAY, None, "R2", "y"), ("f", 6, "t", "p", "in", 5, TODAY, None, "R1", "y"), ("g", 7, "t", "p", "in", 5, TODAY, None, "r1", "y"), ("h", 8, "t", "p", "in", 5, TODAY, None, "R3", "y")], ddl)
    got = changes.reread_payments(old, fresh, spark.createDataFrame([("p",)], "source_id string"))
    assert {r.id: r.duplicate_of for r in got.collect()} == {"b": "a", "c": None, "d": None, "e": "c", "f": None, "g": "f", "h": None}
