"""Changes as new versions of tables: nothing is updated in place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cowrie.functions.dates import as_date
from cowrie.operators.duplicates import payment_key
from cowrie.operators.pages import blocking_issues, date_flags


def latest(versions: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """The last version of each row."""
    last = versions.groupBy(key).agg(F.max_by(F.struct(*[c for c in versions.columns if c != key]), order).alias("v"))
    return last.select(key, "v.*").select(*versions.columns)


def without_traders(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the traders of ``gone`` (trader_id)."""
    key = lambda name: "id" if name == "traders" else "trader_id"
    return {n: t.join(gone.select(F.col("trader_id").alias(key(n))), key(n), "left_anti") for n, t in tables.items()}


def without_sources(sources: DataFrame, entries: DataFrame, payments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop pages (source_id) with their lines and payments, and their mentions in ``distinct_from``."""
    ids = gone.select("source_id")
    kept = sources.join(ids.withColumnRenamed("source_id", "id"), "id", "left_anti")
    mentions = kept.select("id", F.explode("distinct_from").alias("source_id")).join(ids, "source_id", "left_anti").groupBy("id").agg(F.collect_list("source_id").alias("distinct_from"))
    kept = kept.drop("distinct_from").join(mentions, "id", "left").withColumn("distinct_from", F.coalesce("distinct_from", F.array().cast("array<string>")))
    return kept.select(*sources.columns), entries.join(ids, "source_id", "left_anti"), payments.join(ids, "source_id", "left_anti")


def reread(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace reader lines of the pages in ``fresh``; lines that the trader added stay and come first."""
    pages = fresh.select("source_id").distinct()
    keep = entries.join(pages, "source_id", "left_anti").unionByName(entries.join(pages, "source_id", "left_semi").where("origin = 'trader'"))
    own = keep.join(pages, "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("cowrie_n"))
    moved = fresh.join(own, "source_id", "left").withColumn("seq", (F.col("seq") + F.coalesce("cowrie_n", F.lit(0))).cast(fresh.schema["seq"].dataType)).drop("cowrie_n")
    return keep.unionByName(moved)


def record_readings(sources: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages after an attempt to read them, one outcome each (source_id, error, lines; ``error`` null for success); and the events to record.

    A page that was read is ``read`` without an error, else ``failed`` with the
    error's code; a failure leaves its lines and payments as they are, so only
    successes go to ``reread``. Pages that are duplicates or confirmed are not
    read: their outcomes change nothing and have no event, nor have those of unknown pages.
    """
    o = outcomes.select(F.col("source_id").alias("id"), F.lit(True).alias("cowrie_tried"), F.col("error").alias("cowrie_error"), F.col("lines").alias("cowrie_lines"))
    t = sources.join(o, "id", "left")
    go = F.coalesce("cowrie_tried", F.lit(False)) & ~F.coalesce(F.col("status") == "duplicate", F.lit(False)) & F.col("confirmed_at").isNull()
    failed = F.col("cowrie_error").isNotNull()
    events = t.where(go).select("trader_id", F.col("id").alias("source_id"), F.when(failed, "page_read_failed").otherwise("page_read").alias("type"), F.when(failed, F.col("cowrie_error")).otherwise(F.col("cowrie_lines").cast("string")).alias("detail"))
    t = t.withColumns({"status": F.when(go, F.when(failed, "failed").otherwise("read")).otherwise(F.col("status")), "error": F.when(go, F.col("cowrie_error")).otherwise(F.col("error"))})
    return t.select(*sources.columns), events


def patch_entries(entries: DataFrame, patches: DataFrame, today: Column | str, at: Column | str) -> DataFrame:
    """Apply one patch per line: (id, status, date, clear_date, description, amount, type), null where it says nothing.

    Rejecting ignores the other fields. Else the given values replace the line's;
    a change keeps the reader's first values in ``original``, leaves only the hard
    flags, and confirms the line if nothing blocks it, else makes it pending,
    unless the patch states a status. A rejected line becomes pending first. A
    line that would be confirmed in spite of an issue, and an empty patch, change
    nothing: ``refused`` is true and ``issues`` says why. ``happened`` lists the
    events to record. Lines without a patch pass with empty lists.
    """
    values = ("date", "description", "amount", "type")
    p = patches.select("id", F.lit(True).alias("new"), "clear_date", *[F.col(c).alias(f"new_{c}") for c in ("status", *values)])
    t = entries.join(p, "id", "left")
    now, none = as_date(today), F.array().cast("array<string>")
    new, wanted = F.coalesce("new", F.lit(False)), F.col("new_status")
    cleared = F.coalesce("clear_date", F.lit(False))
    empty = new & ~cleared & F.coalesce(wanted, *[F.col(f"new_{c}").cast("string") for c in values]).isNull()
    reject = F.coalesce(wanted == "rejected", F.lit(False))
    after = {c: F.coalesce(f"new_{c}", c) for c in values}
    after["date"] = F.when(cleared, F.lit(None).cast("date")).otherwise(after["date"])
    t = t.withColumns({f"after_{c}": v for c, v in after.items()})
    same = [F.col(c).eqNullSafe(F.col(f"after_{c}")) for c in values]
    changed = new & ~reject & ~(same[0] & same[1] & same[2] & same[3])
    t = t.withColumn("changed", changed).withColumn("was_rejected", F.col("status") == "rejected")
    hard = F.concat(date_flags(F.col("after_date"), now), F.when(F.col("after_amount") <= 0, F.array(F.lit("amount_missing"))).otherwise(none))
    t = t.withColumn("after_flags", F.when(F.col("changed"), hard).otherwise(F.col("flags")))
    t = t.withColumn("issues", F.when(new & ~reject, blocking_issues(F.lit("pending"), F.col("after_flags"), F.col("after_date"), F.col("after_amount"), now)).otherwise(none))
    clear = F.size("issues") == 0
    restored = F.when(F.col("was_rejected"), "pending").otherwise(F.col("status"))
    target = F.when(reject, "rejected").otherwise(F.coalesce(wanted, F.when(F.col("changed"), F.when(clear, "confirmed").otherwise("pending")), restored))
    t = t.withColumn("target", target)
    refused = empty | (new & (F.col("target") == "confirmed") & ~clear)
    t = t.withColumn("refused", refused).withColumn("issues", F.when(empty, F.array(F.lit("empty_patch"))).when(F.col("refused"), F.col("issues")).otherwise(none))
    go = new & ~F.col("refused")
    happened = F.array_compact(F.array(
        F.when(go & reject & ~F.col("was_rejected"), "entry_rejected"), F.when(go & ~reject & F.col("was_rejected"), "entry_restored"), F.when(go & F.col("changed"), "entry_corrected")
    ))
    keeps = go & F.col("changed") & (F.col("origin") == "ai") & F.col("original").isNull()
    moment = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    out = {
        "original": F.when(keeps, F.struct(*values)).otherwise(F.col("original")),
        "confirmed_at": F.when(go & (F.col("target") == "confirmed"), F.coalesce("confirmed_at", moment)).when(go, F.lit(None).cast("timestamp")).otherwise(F.col("confirmed_at")),
        "flags": F.when(go & F.col("changed"), F.col("after_flags")).otherwise(F.col("flags")),
        "status": F.when(go, F.col("target")).otherwise(F.col("status")),
        **{c: F.when(go & F.col("changed"), F.col(f"after_{c}")).otherwise(F.col(c)) for c in values},
        "happened": happened,
    }
    t = t.select(*[out[c].alias(c) if c in out else F.col(c) for c in entries.columns], out["happened"].alias("happened"), "refused", "issues")
    return t


def add_entries(entries: DataFrame, added: DataFrame, sources: DataFrame, today: Column | str, at: Column | str) -> tuple[DataFrame, DataFrame]:
    """Lines that the trader adds (id, source_id, ord, date, description, amount, type), behind the lines of their page; and those refused.

    They are confirmed with confidence 1. Refused are lines of unknown pages and
    those whose date or amount is missing or out of range; ``issues`` says why.
    """
    now = as_date(today)
    t = added.join(sources.select(F.col("id").alias("source_id"), "trader_id"), "source_id", "left")
    flags = F.concat(date_flags(F.col("date"), now), F.when(F.coalesce("amount", F.lit(0)) <= 0, F.array(F.lit("amount_missing"))).otherwise(F.array().cast("array<string>")))
    t = t.withColumn("issues", F.when(F.col("trader_id").isNull(), F.array(F.lit("not_found"))).otherwise(flags))
    last = entries.groupBy("source_id").agg(F.max("seq").alias("cowrie_last"))
    sound = t.where(F.size("issues") == 0).join(last, "source_id", "left")
    seq = F.coalesce("cowrie_last", F.lit(-1)) + F.row_number().over(Window.partitionBy("source_id").orderBy("ord"))
    moment = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    fixed = {"seq": seq, "origin": F.lit("trader"), "status": F.lit("confirmed"), "raw": F.lit(""), "confidence": F.lit(1.0), "flags": F.array().cast("array<string>"), "confirmed_at": moment}
    given = set(added.columns) | {"trader_id"}
    new = sound.select(*[(fixed[f.name] if f.name in fixed else F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema])
    return entries.unionByName(new), t.where(F.size("issues") > 0)


def keep_duplicates(sources: DataFrame, kept: DataFrame) -> DataFrame:
    """Duplicate pages (source_id) that are kept on purpose are pending again."""
    mark = kept.select(F.col("source_id").alias("id"), F.lit(True).alias("cowrie_keep")).distinct()
    t = sources.join(mark, "id", "left")
    go = F.coalesce("cowrie_keep", F.lit(False)) & (F.col("status") == "duplicate")
    return t.withColumn("duplicate_kept", F.when(go, F.lit(True)).otherwise(F.col("duplicate_kept"))).withColumn("status", F.when(go, "pending").otherwise(F.col("status"))).select(*sources.columns)


def mark_distinct(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pages (a, b) of one trader that a person told apart name each other in ``distinct_from``; other pairs change nothing."""
    who = sources.select("id", "trader_id")
    ok = pairs.join(who.toDF("a", "cowrie_ta"), "a").join(who.toDF("b", "cowrie_tb"), "b").where("cowrie_ta = cowrie_tb AND a <> b")
    both = ok.select(F.col("a").alias("id"), F.col("b").alias("other")).union(ok.select("b", "a")).groupBy("id").agg(F.sort_array(F.collect_set("other")).alias("cowrie_more"))
    none = F.array().cast("array<string>")
    joined = F.array_union(F.coalesce("distinct_from", none), F.coalesce("cowrie_more", none))
    t = sources.join(both, "id", "left")
    return t.withColumn("distinct_from", F.when(F.col("cowrie_more").isNotNull(), joined).otherwise(F.col("distinct_from"))).select(*sources.columns)


def create_traders(traders: DataFrame, new: DataFrame, at: Column | str) -> DataFrame:
    """Traders with those of ``new`` (columns of the table, absent ones null) added; an id that exists is not added again."""
    moment = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    stamps = {"created_at": moment, "updated_at": moment}
    rows = new.join(traders.select("id"), "id", "left_anti")
    return traders.unionByName(rows.select(*[(stamps[f.name] if f.name in stamps else F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in traders.schema]))


def touched(traders: DataFrame, events: DataFrame) -> DataFrame:
    """Traders with ``updated_at`` moved on to their newest event."""
    last = events.groupBy(F.col("trader_id").alias("id")).agg(F.max("at").alias("cowrie_last"))
    return traders.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "cowrie_last")).select(*traders.columns)


def confirm_pages(entries: DataFrame, sources: DataFrame, asked: DataFrame, today: Column | str, at: Column | str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Confirm pages (source_id) with all their pending lines: lines and pages afterwards, the events, and what was refused.

    A page is refused as a whole: ``not_found``, ``not_read`` unless its status is
    read, or ``page_has_issues`` if a pending line has a blocking issue. Refusals are
    rows of (source_id, reason, entry_id, issues), one for each such line. Lines
    and pages that are confirmed bear ``at``; a page that was confirmed before is
    confirmed anew. A page asked for twice counts once.
    """
    now, moment = as_date(today), at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    want = asked.select(F.col("source_id").alias("id")).distinct()
    pages = want.join(sources.select("id", "trader_id", "status"), "id", "left")
    pending = entries.where("status = 'pending'").join(want.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    judged = pending.select("source_id", F.col("id").alias("entry_id"), blocking_issues(F.lit("pending"), F.col("flags"), F.col("date"), F.col("amount"), now).alias("issues"))
    sums = judged.groupBy("source_id").agg(F.count("*").alias("lines"), F.count_if(F.size("issues") > 0).alias("faulty"))
    pages = pages.join(sums.withColumnRenamed("source_id", "id"), "id", "left")
    reason = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "read", "not_read").when(F.col("faulty") > 0, "page_has_issues")
    pages = pages.withColumn("reason", reason)
    faulty = judged.where(F.size("issues") > 0).withColumnRenamed("source_id", "cowrie_page")
    refused = pages.where("reason IS NOT NULL").join(faulty, (F.col("id") == F.col("cowrie_page")) & (F.col("reason") == "page_has_issues"), "left")
    refused = refused.select(F.col("id").alias("source_id"), "reason", "entry_id", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))
    ready = pages.where("reason IS NULL")
    mark = ready.select("id", F.lit(True).alias("cowrie_ready"))
    t = entries.join(mark.withColumnRenamed("id", "source_id"), "source_id", "left")
    go = F.coalesce("cowrie_ready", F.lit(False)) & (F.col("status") == "pending")
    lines = t.withColumns({"confirmed_at": F.when(go, moment).otherwise(F.col("confirmed_at")), "status": F.when(go, "confirmed").otherwise(F.col("status"))}).select(*entries.columns)
    p = sources.join(mark, "id", "left").withColumn("confirmed_at", F.when(F.col("cowrie_ready"), moment).otherwise(F.col("confirmed_at"))).select(*sources.columns)
    events = ready.select("trader_id", moment.alias("at"), F.lit("page_confirmed").alias("type"), F.col("id").alias("source_id"), F.coalesce("lines", F.lit(0)).cast("string").alias("detail"))
    return lines, p, events, refused


def reread_payments(payments: DataFrame, fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """Payments after pages (source_id) were read again: theirs are dropped, ``fresh`` ones are added and marked against those on file.

    A fresh payment repeats the last payment on file of its trader with its key
    that repeats none itself, else the first fresh one with its key. Payments
    on file keep their marks. ``fresh`` has the columns of ``payments`` but
    ``duplicate_of``; both have ``ord``, ids follow on ties.
    """
    kept = payments.join(pages.select("source_id").distinct(), "source_id", "left_anti")
    key = payment_key(*[F.col(c) for c in ("ref", "time", "direction", "amount", "date", "raw")]).alias("cowrie_key")
    on_file = kept.where("duplicate_of IS NULL").select("trader_id", key, "ord", "id").groupBy("trader_id", "cowrie_key").agg(F.max(F.struct("ord", "id")).alias("cowrie_file"))
    new = fresh.withColumn("cowrie_key", key)
    first = new.groupBy("trader_id", "cowrie_key").agg(F.min(F.struct("ord", "id")).alias("cowrie_first"))
    new = new.join(first, ["trader_id", "cowrie_key"]).join(on_file, ["trader_id", "cowrie_key"], "left")
    owner = F.coalesce(F.col("cowrie_file.id"), F.when(F.col("cowrie_first.id") != F.col("id"), F.col("cowrie_first.id")))
    return kept.unionByName(new.withColumn("duplicate_of", owner).select(*payments.columns))


def set_consent(traders: DataFrame, asked: DataFrame, at: Column | str) -> DataFrame:
    """Traders after (trader_id, granted, code) was asked for: granting gives the code, unless consent stands already; revoking drops it.

    A code that any trader has is refused: that trader's consent stays as it was.
    Of several requests for a code only the trader with the least id gets it.
    Unknown traders change nothing.
    """
    moment = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    a = asked.groupBy(F.col("trader_id").alias("id")).agg(F.max_by("granted", F.struct("granted", "code")).alias("cowrie_grant"), F.max_by("code", F.struct("granted", "code")).alias("cowrie_code"))
    taken = traders.where("consent.code IS NOT NULL").select(F.col("consent.code").alias("cowrie_code")).distinct()
    owner = a.where("cowrie_grant").groupBy("cowrie_code").agg(F.min("id").alias("cowrie_owner"))
    a = a.join(owner, "cowrie_code", "left").join(taken.withColumn("cowrie_taken", F.lit(True)), "cowrie_code", "left")
    t = traders.join(a, "id", "left")
    stands = F.coalesce(F.col("consent.granted"), F.lit(False))
    free = F.col("cowrie_code").isNotNull() & F.col("cowrie_taken").isNull() & (F.col("cowrie_owner") == F.col("id"))
    kind = traders.schema["consent"].dataType
    null = F.lit(None)
    given = F.struct(F.lit(True).alias("granted"), moment.alias("granted_at"), null.alias("revoked_at"), F.col("cowrie_code").alias("code")).cast(kind)
    gone = F.struct(F.lit(False).alias("granted"), null.alias("granted_at"), moment.alias("revoked_at"), null.alias("code")).cast(kind)
    grants, revokes = F.coalesce(F.col("cowrie_grant"), F.lit(False)) & ~stands & free, ~F.coalesce(F.col("cowrie_grant"), F.lit(True)) & stands
    return t.withColumn("consent", F.when(grants, given).when(revokes, gone).otherwise(F.col("consent"))).select(*traders.columns)


def consent_state(events: DataFrame) -> DataFrame:
    """Latest consent of each trader: granted with its code, or revoked without one."""
    last = Window.partitionBy("trader_id").orderBy(F.desc("at"), F.desc("ord"))
    e = events.where(F.col("type").isin("consent_granted", "consent_revoked")).withColumn("cowrie_rn", F.row_number().over(last)).where("cowrie_rn = 1")
    granted = F.col("type") == "consent_granted"
    return e.select("trader_id", granted.alias("granted"), F.when(granted, F.col("code")).alias("code"), "at")
