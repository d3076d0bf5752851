"""The one counting rule, and the checks of written totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cowrie.functions.numbers import half_up


def usable(sources: DataFrame) -> DataFrame:
    """Pages that are not duplicates, or were kept on purpose."""
    return sources.where((F.col("status") != "duplicate") | F.coalesce(F.col("duplicate_kept"), F.lit(False)))


def build_ledger(entries: DataFrame, sources: DataFrame | None = None, repeated: DataFrame | None = None) -> DataFrame:
    """Append ``bucket``: rejected, pending, repeated, counted or void.

    Lines of unusable ``sources`` are dropped; ``repeated`` holds the ids of
    lines that an earlier page has, with their own page as ``source_id`` or without. A confirmed line counts if its amount is
    positive and it has a date; else it is void.
    """
    rows = entries
    if sources is not None:
        rows = rows.join(usable(sources).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    again = F.lit(False)
    if repeated is not None:
        by = [c for c in ("source_id", "id") if c in repeated.columns]  # with its page a line is found where the page lies
        rows = rows.join(repeated.select(*by, F.lit(True).alias("cowrie_again")).distinct(), by, "left")
        again = F.coalesce("cowrie_again", F.lit(False))
    bucket = (
        F.when(F.col("status") == "rejected", "rejected")
        .when(F.col("status") == "pending", "pending")
        .when(again, "repeated")
        .when((F.col("amount") > 0) & F.col("date").isNotNull(), "counted")
        .otherwise("void")
    )
    return rows.withColumn("bucket", bucket).drop("cowrie_again")


def counted(entries: DataFrame, sources: DataFrame | None = None, repeated: DataFrame | None = None) -> DataFrame:
    return build_ledger(entries, sources, repeated).where("bucket = 'counted'").drop("bucket")


def page_checks(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Written totals against the lines of their page: ``computed``, ``difference`` and ``ok`` appended to ``totals``.

    ``totals`` has source_id, type, date (null: whole page) and amount. Live lines
    are those not rejected with a positive amount. A dated total looks at its
    date only, if the page has several. The tolerance is 25 or 0.5%.
    """
    live = entries.where((F.col("status") != "rejected") & (F.col("amount") > 0))
    by_day = live.groupBy("source_id", "type", "date").agg(F.sum("amount").alias("day"))
    dates = by_day.groupBy("source_id").agg(F.size(F.collect_set("date")).alias("dates"))  # a page has few dates
    whole = by_day.groupBy("source_id", "type").agg(F.sum("day").alias("page"))
    t = totals.join(dates, "source_id", "left").join(whole, ["source_id", "type"], "left")
    own = by_day.select("source_id", "type", F.col("date").alias("cowrie_date"), "day")
    day = own.alias("d")
    t = t.alias("t").join(day, (F.col("t.source_id") == F.col("d.source_id")) & (F.col("t.type") == F.col("d.type")) & (F.col("t.date") == F.col("d.cowrie_date")), "left").select("t.*", "d.day")
    scoped = F.col("date").isNotNull() & (F.coalesce("dates", F.lit(0)) > 1)
    t = t.withColumn("computed", F.coalesce(F.when(scoped, F.coalesce("day", F.lit(0))).otherwise(F.col("page")), F.lit(0)))
    t = t.withColumn("difference", F.col("amount") - F.col("computed"))
    return t.withColumn("ok", F.abs("difference") <= F.greatest(F.lit(25), half_up(F.col("amount") * 0.005))).drop("dates", "page", "day")


def checks_rollup(checks: DataFrame, sources: DataFrame) -> DataFrame:
    """Checks of each trader's confirmed pages: ``checks_passed``, ``checks_total`` and ``pages_passing`` (with a check that holds)."""
    confirmed = sources.where(F.col("confirmed_at").isNotNull()).select("trader_id", F.col("id").alias("source_id"))
    return checks.join(confirmed, "source_id").groupBy("trader_id").agg(F.count_if("ok").alias("checks_passed"), F.count("*").alias("checks_total"), F.count_distinct(F.when(F.col("ok"), F.col("source_id"))).alias("pages_passing"))


def failing_checks(checks: DataFrame, sources: DataFrame) -> DataFrame:
    """The checks of confirmed pages that do not hold."""
    return checks.where("NOT ok").join(sources.where(F.col("confirmed_at").isNotNull()).select("trader_id", F.col("id").alias("source_id")), "source_id")
