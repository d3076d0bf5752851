"""Day sums that follow changes instead of being made anew.

Lines and pages lie in a snapshot store, dealt to parts by trader. The sums of
days lie in the same store with the number of the snapshot that they were made
of. A refresh looks up which parts changed since, makes the days of these parts
from their lines alone, and publishes the days and the number in one change; all
other parts are neither read nor written. Weeks, months, weekdays, headline and
trend follow from the days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cowrie.operators import duplicates, ledger, profile
from cowrie.sources.snapshots import Snapshot, Store
from cowrie.sources.tables import cut_lineage

INPUTS = ("entries", "sources", "told_apart")
_MARK = "mark"


def days_of(snapshot: Snapshot, parts: list[int] | None = None) -> DataFrame:
    """(trader_id, date, sales, expenses, lines, sale_lines) of the counted lines in some parts (none: in all)."""
    names = snapshot.names()
    entries, sources = snapshot.table("entries", parts), snapshot.table("sources", parts)
    apart = snapshot.table("told_apart", parts).select("a", "b") if "told_apart" in names else None
    repeated = duplicates.repeated_lines(duplicates.page_lines(entries, sources), apart)
    return profile.daily(ledger.counted(entries, sources, repeated))


def made_of(store: Store) -> int:
    """The number of the snapshot that the stored days were made of; 0 before the first refresh."""
    last = store.snapshot()
    row = last.table(_MARK).agg(F.max("number")).first() if _MARK in last.names() else None
    return row[0] if row and row[0] else 0


def stale_parts(store: Store) -> tuple[int, list[int]]:
    """The last snapshot's number, and the parts whose days no longer hold in it."""
    since, last = made_of(store), store.snapshot()
    if not since:
        return last.number, list(range(last.manifest["count"]))
    old = store.snapshot(since)
    inputs = [n for n in INPUTS if n in last.names()]
    return last.number, [p for p in range(last.manifest["count"]) if any(old.folders(n, [p]) != last.folders(n, [p]) for n in inputs)]


def refresh(store: Store) -> list[int]:
    """Bring the stored ``days`` up to the last snapshot; gives the parts that were made anew.

    The snapshot named by the mark must not have been vacuumed. Days without lines
    any more go. A refresh that dies changes nothing; one that runs twice makes
    the same days. Changes published meanwhile are left to the next refresh.
    """
    number, parts = stale_parts(store)
    snapshot = store.snapshot(number)
    if not number or not parts or "entries" not in snapshot.names():
        return []
    ident = F.concat_ws("|", "trader_id", "date")
    fresh = cut_lineage(days_of(snapshot, parts).select(ident.alias("id"), "*"))
    rows = {"days": fresh, _MARK: store.spark.createDataFrame([("mark", "mark", number)], "id string, trader_id string, number long")}
    gone = {}
    if "days" in snapshot.names():
        gone["days"] = snapshot.table("days", parts).select("id", "trader_id").join(fresh.select("id"), "id", "left_anti")
    store.merge(rows, gone)
    return parts


def stored_days(store: Store) -> DataFrame:
    """The days as of the last refresh."""
    return store.snapshot().table("days").drop("id")
