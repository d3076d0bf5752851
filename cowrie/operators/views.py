"""Lists and summaries that screens show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cowrie.operators import duplicates
from cowrie.operators.pages import needs_attention


def portfolio(traders: DataFrame, performance: DataFrame, strength: DataFrame, activity: DataFrame) -> DataFrame:
    """One row per trader with its headline figures and last activity; traders without records have zeros."""
    out = traders.join(performance.select("trader_id", "avg_weekly", "trend"), "trader_id", "left")
    out = out.join(strength.select("trader_id", "score", "grade"), "trader_id", "left")
    out = out.join(activity.groupBy("trader_id").agg(F.max("at").alias("last_activity")), "trader_id", "left")
    return out.na.fill(0, ["avg_weekly", "score"]).withColumn("grade", F.coalesce("grade", F.lit("thin")))


def latest_per_trader(events: DataFrame, most: int = 8) -> DataFrame:
    """The newest events of each trader; ``most`` is what the card shows."""
    rank = F.row_number().over(Window.partitionBy("trader_id").orderBy(F.desc("at"), F.desc("ord")))
    return events.withColumn("rank", rank).where(F.col("rank") <= most)


def payment_status(marked: DataFrame, matched: DataFrame) -> DataFrame:
    """duplicate, backed by a line, by a day, not backed, or not a sale; per payment id."""
    how = matched.select("id", "matched", "closed_day", F.lit(True).alias("inflow"))
    t = marked.join(how, "id", "left")
    status = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("matched") == "exact", "backed_line").when(F.col("matched").isNotNull(), "backed_day").when(F.col("inflow"), F.when(F.col("closed_day"), "closed_day").otherwise("not_backed"))
    return t.withColumn("payment_status", F.coalesce(status, F.lit("not_a_sale"))).drop("matched", "closed_day", "inflow")


def _reviewable(sources: DataFrame) -> DataFrame:
    """Notebooks and receipts that are no duplicates, or were kept."""
    usable = (F.col("status") != "duplicate") | F.coalesce("duplicate_kept", F.lit(False))
    return sources.where(F.col("kind").isin("notebook", "receipt") & usable)


def review_overlaps(sources: DataFrame, entries: DataFrame, told_apart: DataFrame | None = None) -> DataFrame:
    """(trader_id, earlier, later, matches, ratio, earlier_date): every pair of pages to review that repeat each other, other kinds of pages and duplicates left out.

    ``earlier_date`` is the day that the earlier page states, if any.
    """
    pages = _reviewable(sources)
    found = duplicates.overlapping_pages(duplicates.page_lines(entries, pages), told_apart)
    days = pages.select(F.col("id").alias("earlier"), F.col("page_date").alias("earlier_date"))
    return found.join(days, "earlier", "left").select("trader_id", "earlier", "later", "matches", "ratio", "earlier_date")


def review_queue(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages to review: notebooks and receipts that are usable, by page date, with counts of pending lines."""
    pending = entries.groupBy("source_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count("*").alias("lines"))
    pages = _reviewable(sources).join(pending.withColumnRenamed("source_id", "id"), "id", "left").na.fill(0, ["pending", "lines"])
    day = F.coalesce("page_date", F.col("created_at").cast("date"))
    order = Window.partitionBy("trader_id").orderBy(day, "created_at", "id")
    todo = F.col("pending") > 0
    ahead = F.min(F.when(todo, F.col("place"))).over(Window.partitionBy("trader_id").orderBy("place").rowsBetween(1, Window.unboundedFollowing))
    first = F.min(F.when(todo, F.col("place"))).over(Window.partitionBy("trader_id"))
    return pages.withColumn("place", F.row_number().over(order)).withColumn("next_todo", F.coalesce(ahead, first))


def by_day(entries: DataFrame) -> DataFrame:
    """Lines and subtotal of each trader's day."""
    return entries.groupBy("trader_id", "date").agg(F.count("*").alias("lines"), F.sum(F.when(F.col("type") == "sale", F.col("amount")).otherwise(0)).alias("sales"), F.sum(F.when(F.col("type") == "expense", F.col("amount")).otherwise(0)).alias("expenses"))


def provenance(entries: DataFrame) -> DataFrame:
    """pending, trader_added, corrected or confirmed for each line."""
    how = F.when(F.col("status") == "pending", "pending").when(F.col("origin") == "trader", "trader_added").when(F.col("original").isNotNull(), "corrected").otherwise("confirmed")
    return entries.withColumn("provenance", how)


def capture_list(sources: DataFrame, entries: DataFrame, payments: DataFrame, today) -> DataFrame:
    """Photos with their lines, lines that need attention and payments; ``place`` counts from the newest of a trader."""
    now = F.lit(today).cast("date")
    live = entries.where("status <> 'rejected'")
    lines = live.groupBy("source_id").agg(F.count("*").alias("lines"), F.count_if(needs_attention(F.col("status"), F.col("flags"), F.col("date"), F.col("amount"), now)).alias("attention"))
    momo = payments.groupBy("source_id").agg(F.count("*").alias("payments"))
    photos = sources.where("kind <> 'message'").withColumn("source_id", F.col("id"))
    out = photos.join(lines, "source_id", "left").join(momo, "source_id", "left").na.fill(0, ["lines", "attention", "payments"])
    return out.withColumn("place", F.row_number().over(Window.partitionBy("trader_id").orderBy(F.desc("created_at"), "id"))).drop("source_id")


def page_view(entries: DataFrame) -> DataFrame:
    """The lines of each page that are not rejected, with their ``place`` on it."""
    return entries.where("status <> 'rejected'").withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("seq", "id")))


def payment_list(payments: DataFrame) -> DataFrame:
    """Payments with their ``place`` in time within a trader, those without a time first of their day."""
    return payments.withColumn("place", F.row_number().over(Window.partitionBy("trader_id").orderBy("date", F.coalesce("time", F.lit("")), "ord")))


def payment_sums(classified: DataFrame, matched: DataFrame) -> DataFrame:
    """What each trader paid out, and received without a record of it."""
    out = classified.groupBy("trader_id").agg(F.coalesce(F.sum(F.when(F.col("class") == "outflow", F.col("amount"))), F.lit(0)).alias("paid_out"))
    open_ = matched.where("matched IS NULL").groupBy("trader_id").agg(F.sum("amount").alias("unmatched"))
    return out.join(open_, "trader_id", "left").na.fill(0, ["unmatched"])


def best_full_week(by_week: DataFrame) -> DataFrame:
    """The full week with the highest sales of each trader, the first on ties."""
    full = by_week.where("NOT partial AND NOT gap")
    return full.groupBy("trader_id").agg(F.max_by("week", F.struct("sales", -F.datediff("week", F.lit("1970-01-01").cast("date")))).alias("week"), F.max("sales").alias("sales"))


def of_weekday(counted: DataFrame, days: DataFrame) -> DataFrame:
    """Counted lines of the asked weekdays (trader_id, weekday)."""
    return counted.withColumn("weekday", F.weekday("date") + 1).join(days.select("trader_id", "weekday").distinct(), ["trader_id", "weekday"], "left_semi")


def lines_behind(evidence: DataFrame, entries: DataFrame, asked: DataFrame) -> DataFrame:
    """The lines behind asked figures (trader_id, metric, key)."""
    wanted = evidence.join(asked, ["trader_id", "metric", "key"], "left_semi").withColumnRenamed("entry_id", "id")
    return wanted.join(entries.drop("trader_id"), "id")


def sorted_portfolio(rows: DataFrame, by: str) -> DataFrame:
    """Traders by strength, sales or recent activity, best first; ties by trader."""
    column = {"strength": "score", "sales": "avg_weekly", "recent": "last_activity"}[by]
    return rows.orderBy(F.col(column).desc_nulls_last(), "trader_id")


def next_step(hub: DataFrame) -> DataFrame:
    """``step``: the first thing still to do of consent, capture, review and share; null if all are done."""
    todo = [F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in ("consent", "capture", "review", "share")]
    return hub.withColumn("step", F.coalesce(*todo))


def hub(found: DataFrame, traders: DataFrame) -> DataFrame:
    """(trader_id, capture, review, profile, share, step): which steps of a trader are done, and the first that is not; null if all are.

    ``found`` is the profile (pages, entries_pending, pages_awaiting_review and
    start); ``traders`` has id and consent. Pages are captured once there is one,
    and reviewed when neither a line nor a page waits; the profile exists with its
    first counted line; it is shared while consent stands. Traders without a
    profile row have everything to do.
    """
    some = F.coalesce("pages", F.lit(0)) > 0
    t = traders.select(F.col("id").alias("trader_id"), F.coalesce("consent.granted", F.lit(False)).alias("share")).join(found.select("trader_id", "pages", "entries_pending", "pages_awaiting_review", "start"), "trader_id", "left")
    done = {"capture": some, "review": some & (F.col("entries_pending") == 0) & (F.col("pages_awaiting_review") == 0), "profile": F.col("start").isNotNull(), "share": F.col("share")}
    out = t.select("trader_id", *[v.alias(k) for k, v in done.items()])
    return out.withColumn("step", F.coalesce(*[F.when(~F.col(k), F.lit(k)) for k in done]))
