"""Events of changes, and state as a fold of events.

Every change makes a new version of tables. ``events_between`` compares two
versions by id and says what happened, whichever operator made the change;
``fold`` runs a transition over the ordered events of each entity, so that the
state at any time is a query over the log.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = ("trader_id", "at", "type", "source_id", "entry_id", "detail")


def _moment(at: Column | str) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def _versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, was, now): the row before and after a change, null where there is none; rows that did not change are left out."""
    was = before.select("id", F.struct(*[c for c in before.columns if c != "id"]).alias("was"))
    now = after.select("id", F.struct(*[c for c in after.columns if c != "id"]).alias("now"))
    return was.join(now, "id", "full").where(~F.col("was").eqNullSafe(F.col("now")))


def _rows(t: DataFrame, trader: Column, at: Column | str, found: Mapping[str, tuple[Column, Column]], source: Column, entry: Column) -> DataFrame:
    """One row for each event type whose condition holds; ``found`` maps a type to (condition, detail)."""
    known = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind).alias("type"), detail.cast("string").alias("detail"))) for kind, (cond, detail) in found.items()]))
    out = t.select(trader.cast("string").alias("trader_id"), _moment(at).alias("at"), source.cast("string").alias("source_id"), entry.cast("string").alias("entry_id"), F.explode(known).alias("e"))
    return out.select("trader_id", "at", "e.type", "source_id", "entry_id", "e.detail")


def events_between(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], at: Column | str) -> DataFrame:
    """What happened between two versions of traders, sources and entries, as events.

    Traders are created, grant and revoke consent. Pages are confirmed (detail:
    how many of their lines were), kept as duplicates, told apart (one event for a
    pair, of its lesser id), read, failed and deleted. Lines are added by the
    trader, rejected, restored and corrected (detail: amount before and after).
    Lines that a reader made come and go with the event of their page. Rows of
    unknown tables are ignored; null ids take no part.
    """
    none, was, now = F.lit(None), F.col("was"), F.col("now")
    out = []
    if "traders" in before:
        t = _versions(before["traders"], after["traders"])
        granted = lambda v: F.coalesce(v["consent"]["granted"], F.lit(False))
        kinds = {
            "trader_created": (was.isNull(), none),
            "consent_granted": (now.isNotNull() & granted(now) & ~granted(was), now["consent"]["code"]),
            "consent_revoked": (now.isNotNull() & was.isNotNull() & granted(was) & ~granted(now), none),
        }
        out.append(_rows(t, F.col("id"), at, kinds, none, none))
    if "sources" in before:
        t = _versions(before["sources"], after["sources"])
        both, status = was.isNotNull() & now.isNotNull(), lambda s: (now["status"] == s) & ~was["status"].eqNullSafe(F.lit(s))
        confirmed = both & was["confirmed_at"].isNull() & now["confirmed_at"].isNotNull()
        if "entries" in before:
            moved = _versions(before["entries"], after["entries"]).where("was.status = 'pending' AND now.status = 'confirmed'").groupBy(F.col("now.source_id").alias("id")).agg(F.count("*").alias("lines"))
            t = t.join(moved, "id", "left")
        else:
            t = t.withColumn("lines", F.lit(None).cast("long"))
        kinds = {
            "page_added": (was.isNull(), now["status"]),
            "page_deleted": (now.isNull(), was["kind"]),
            "photo_duplicate_kept": (both & ~F.coalesce(was["duplicate_kept"], F.lit(False)) & now["duplicate_kept"], none),
            "page_read": (both & status("read"), none),
            "page_read_failed": (both & status("failed"), none),
            "page_confirmed": (confirmed, F.coalesce("lines", F.lit(0))),
        }
        trader = F.coalesce(now["trader_id"], was["trader_id"])
        out.append(_rows(t, trader, at, kinds, F.col("id"), none))
        more = t.where(both).select("id", now["trader_id"].alias("trader_id"), F.explode(F.array_except(now["distinct_from"], F.coalesce(was["distinct_from"], F.array().cast("array<string>")))).alias("other")).where(F.col("id").cast("string") < F.col("other"))
        out.append(_rows(more, F.col("trader_id"), at, {"pages_marked_distinct": (F.lit(True), F.col("other"))}, F.col("id"), none))
    if "entries" in before:
        t = _versions(before["entries"], after["entries"])
        both = was.isNotNull() & now.isNotNull()
        changed = F.lit(False)
        for c in ("date", "description", "amount", "type"):
            changed = changed | ~was[c].eqNullSafe(now[c])
        kinds = {
            "entry_added": (was.isNull() & (now["origin"] == "trader"), now["amount"]),
            "entry_rejected": (both & (was["status"] != "rejected") & (now["status"] == "rejected"), none),
            "entry_restored": (both & (was["status"] == "rejected") & (now["status"] != "rejected"), none),
            "entry_corrected": (both & changed, F.concat_ws(">", was["amount"].cast("string"), now["amount"].cast("string"))),
        }
        out.append(_rows(t, F.coalesce(now["trader_id"], was["trader_id"]), at, kinds, F.coalesce(now["source_id"], was["source_id"]), F.col("id")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def fold(events: DataFrame, key: str, initial: Column, step: Callable[[Column, Column], Column], order: tuple[str, ...] = ("at", "ord")) -> DataFrame:
    """(key, state): ``step(state, event)`` over each entity's events in order, from ``initial``.

    An event is a struct of the other columns. Only what a person did to one
    entity lies in one row, so give the events of interest alone: a page has a
    few, a trader a few consents. Null keys are left out; ties of ``order`` are
    broken by the other columns, so reruns agree.
    """
    rest = [c for c in events.columns if c not in (key, *order)]
    packed = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("events"))
    return packed.select(key, F.aggregate("events", initial, step).alias("state"))


_PAGE = "struct<status:string,confirmed_at:timestamp,duplicate_kept:boolean,distinct_from:array<string>,deleted:boolean>"


def page_states(events: DataFrame) -> DataFrame:
    """(source_id, status, confirmed_at, duplicate_kept, distinct_from) of every page, from its events alone; deleted pages have no row.

    ``events`` has at, ord, type, source_id and detail. A pair told apart counts for
    both pages; pages that are gone are no longer named.
    """
    apart = events.where("type = 'pages_marked_distinct'")
    mirrored = apart.withColumns({"source_id": F.col("detail"), "detail": F.col("source_id")})
    log = events.unionByName(mirrored).where("source_id IS NOT NULL AND entry_id IS NULL").select("source_id", "at", "ord", "type", "detail")
    names = ["status", "confirmed_at", "duplicate_kept", "distinct_from", "deleted"]

    def step(s: Column, e: Column) -> Column:
        kind = e["type"]
        new = {
            "status": F.when(kind == "page_added", e["detail"]).when(kind == "photo_duplicate_kept", "pending").when(kind == "page_read", "read").when(kind == "page_read_failed", "failed").otherwise(s["status"]),
            "confirmed_at": F.when(kind == "page_confirmed", e["at"]).otherwise(s["confirmed_at"]),
            "duplicate_kept": s["duplicate_kept"] | (kind == "photo_duplicate_kept"),
            "distinct_from": F.when(kind == "pages_marked_distinct", F.array_union(s["distinct_from"], F.array(e["detail"]))).otherwise(s["distinct_from"]),
            "deleted": s["deleted"] | (kind == "page_deleted"),
        }
        return F.struct(*[new[n].alias(n) for n in names]).cast(_PAGE)

    none = F.struct(F.lit(None).alias("status"), F.lit(None).alias("confirmed_at"), F.lit(False).alias("duplicate_kept"), F.array().alias("distinct_from"), F.lit(False).alias("deleted")).cast(_PAGE)
    states = fold(log, "source_id", none, step).select("source_id", "state.*")
    gone = states.where("deleted").select(F.col("source_id").alias("other"))
    live = states.where("NOT deleted").drop("deleted")
    named = live.select("source_id", F.explode("distinct_from").alias("other")).join(gone, "other", "left_anti").groupBy("source_id").agg(F.sort_array(F.collect_set("other")).alias("distinct_from"))
    return live.drop("distinct_from").join(named, "source_id", "left").withColumn("distinct_from", F.coalesce("distinct_from", F.array().cast("array<string>")))


def line_states(events: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, status, confirmed_at) of ``lines`` (id, source_id, at, ord, clear), from the log alone.

    A line begins pending at its ``at``. Its own events add, reject, restore,
    correct and confirm it; confirming its page confirms it if it is pending then.
    A correction confirms a line that is ``clear`` of issues afterwards (its
    event's detail ends in ``!`` where it is not), as the direct operator does.
    """
    born = lines.select("id", "at", "ord", F.lit("begin").alias("type"), F.lit(None).cast("string").alias("detail"))
    own = events.where("entry_id IS NOT NULL").select(F.col("entry_id").alias("id"), "at", "ord", "type", "detail")
    pages = events.where("type = 'page_confirmed'").select("source_id", "at", "ord", "type", "detail")
    of_page = lines.select("id", "source_id").join(pages, "source_id").select("id", "at", "ord", "type", "detail")
    kind = "struct<status:string,confirmed_at:timestamp>"

    def step(s: Column, e: Column) -> Column:
        t = e["type"]
        sure = t.isin("entry_added", "entry_corrected") & ~F.coalesce(e["detail"].endswith("!"), F.lit(False))
        open_ = t.isin("entry_restored", "begin") | ((t == "entry_corrected") & ~sure)
        confirms = sure | ((t == "page_confirmed") & (s["status"] == "pending"))
        status = F.when(t == "entry_rejected", "rejected").when(confirms, "confirmed").when(open_, "pending").otherwise(s["status"])
        moment = F.when((status == "confirmed"), F.coalesce(s["confirmed_at"], e["at"]))
        return F.struct(status.alias("status"), moment.alias("confirmed_at")).cast(kind)

    log = born.unionByName(own.join(lines.select("id"), "id", "left_semi")).unionByName(of_page)
    return fold(log, "id", F.struct(F.lit(None).alias("status"), F.lit(None).alias("confirmed_at")).cast(kind), step).select("id", "state.*")


def consent_states(events: DataFrame) -> DataFrame:
    """(trader_id, granted, code, granted_at, revoked_at): granting twice keeps the first code, revoking drops it."""
    log = events.where(F.col("type").isin("consent_granted", "consent_revoked")).select("trader_id", "at", "ord", "type", "detail")
    kind = "struct<granted:boolean,code:string,granted_at:timestamp,revoked_at:timestamp>"

    def step(s: Column, e: Column) -> Column:
        grant, revoke = (e["type"] == "consent_granted") & ~s["granted"], (e["type"] == "consent_revoked") & s["granted"]
        null = F.lit(None)
        given = F.struct(F.lit(True).alias("granted"), e["detail"].alias("code"), e["at"].alias("granted_at"), null.alias("revoked_at")).cast(kind)
        taken = F.struct(F.lit(False).alias("granted"), null.alias("code"), null.alias("granted_at"), e["at"].alias("revoked_at")).cast(kind)
        return F.when(grant, given).when(revoke, taken).otherwise(s)

    begin = F.struct(F.lit(False).alias("granted"), *[F.lit(None).alias(x) for x in ("code", "granted_at", "revoked_at")]).cast(kind)
    return fold(log, "trader_id", begin, step).select("trader_id", "state.*")
