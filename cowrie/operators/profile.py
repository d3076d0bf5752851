"""Roll-ups of counted lines; every function covers all traders at once.

``lines`` has trader_id, id, date, type (sale or expense), amount and
description. A shared table of sums per trader and day feeds weeks, months and
weekdays, so raw lines are shuffled once and combined before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cowrie.functions.dates import each_day, iso_weekday, week_start
from cowrie.functions.numbers import half_up
from cowrie.functions.text import clean_label, normalize_item
from cowrie.operators import duplicates, strength
from cowrie.operators import ledger as ledgers
from cowrie.operators import payments as matching
from cowrie.sources.tables import cut_lineage


def daily(lines: DataFrame) -> DataFrame:
    """(trader_id, date, sales, expenses, lines, sale_lines)."""
    sale = F.col("type") == "sale"
    return lines.groupBy("trader_id", "date").agg(
        F.coalesce(F.sum(F.when(sale, F.col("amount"))), F.lit(0)).alias("sales"),
        F.coalesce(F.sum(F.when(~sale, F.col("amount"))), F.lit(0)).alias("expenses"),
        F.count("*").alias("lines"),
        F.count_if(sale).alias("sale_lines"),
    )


def period(days: DataFrame) -> DataFrame:
    """First and last date, days and weeks of each trader."""
    p = days.groupBy("trader_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    weeks = (F.datediff(week_start(F.col("end")), week_start(F.col("start"))) / 7 + 1).cast("int")
    return p.withColumn("days", F.datediff("end", "start") + 1).withColumn("weeks", weeks)


def calendar(days: DataFrame) -> DataFrame:
    """One row for each day of each trader's period, with its sums; days without records have zeros."""
    spine = period(days).select("trader_id", F.explode(each_day(F.col("start"), F.col("end"))).alias("date"))
    return spine.join(days, ["trader_id", "date"], "left").na.fill(0)


def headline(days: DataFrame) -> DataFrame:
    """Period, totals, net and what a day with sales brings, per trader."""
    sums = days.groupBy("trader_id").agg(F.sum("sales").alias("sales"), F.sum("expenses").alias("expenses"), F.count_if(F.col("sale_lines") > 0).alias("active_days"))
    out = period(days).join(sums, "trader_id").withColumn("net", F.col("sales") - F.col("expenses"))
    a_day = F.when(F.col("active_days") > 0, half_up(F.col("sales") / F.col("active_days"))).otherwise(F.lit(0))
    return out.withColumn("avg_per_active_day", a_day).withColumn("active_days_per_week", half_up(F.col("active_days") / (F.col("days") / 7), 1))


def weeks(days: DataFrame) -> DataFrame:
    """One row per trader and week of its period, weeks without records included.

    ``active_days`` are days with sales, ``days_in_period`` those of the week
    inside the period, ``partial`` weeks have fewer than six of them, and a
    ``gap`` week has no day with sales.
    """
    spine = period(days).withColumn("week", F.explode(F.sequence(week_start(F.col("start")), week_start(F.col("end")), F.expr("INTERVAL 7 DAYS"))))
    sums = days.groupBy("trader_id", week_start(F.col("date")).alias("week")).agg(
        F.sum("sales").alias("sales"), F.sum("expenses").alias("expenses"), F.sum("lines").alias("lines"), F.count_if(F.col("sale_lines") > 0).alias("active_days")
    )
    inside = F.datediff(F.least("end", F.date_add("week", 6)), F.greatest("start", "week")) + 1
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = spine.join(sums, ["trader_id", "week"], "left").select("trader_id", "week", zero("sales"), zero("expenses"), zero("lines"), zero("active_days"), inside.alias("days_in_period"))
    return out.withColumn("net", F.col("sales") - F.col("expenses")).withColumn("partial", F.col("days_in_period") < 6).withColumn("gap", F.col("active_days") == 0)


def months(days: DataFrame) -> DataFrame:
    return days.groupBy("trader_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sum("sales").alias("sales"), F.sum("expenses").alias("expenses"), F.sum("lines").alias("lines"), F.count_if(F.col("sale_lines") > 0).alias("active_days")
    )


def weekdays(days: DataFrame) -> DataFrame:
    """Seven rows per trader: total and days of sales, and the rounded mean of a day."""
    sums = days.where("sale_lines > 0").groupBy("trader_id", iso_weekday(F.col("date")).alias("weekday")).agg(F.sum("sales").alias("total"), F.count("*").alias("days"))
    spine = days.select("trader_id").distinct().withColumn("weekday", F.explode(F.sequence(F.lit(1), F.lit(7))))
    out = spine.join(sums, ["trader_id", "weekday"], "left").na.fill(0, ["total", "days"])
    return out.withColumn("average", F.when(F.col("days") > 0, half_up(F.col("total") / F.col("days"))).otherwise(F.lit(0)))


def items(lines: DataFrame) -> DataFrame:
    """Sales by item: sum, lines, share of the trader's sales (three decimals) and the commonest label.

    The label with most lines names the item; ties go to the shorter, then to
    the first in order. Descriptions are summed before labels are made, and the
    text work is done once per different description of all traders.
    """
    texts = lines.where("type = 'sale'").groupBy("trader_id", "description").agg(F.sum("amount").alias("sales"), F.count("*").alias("n"))
    d = F.col("description")
    names = texts.select("description").distinct().select(d.alias("cowrie_d"), normalize_item(d).alias("item"), clean_label(d).alias("label"))
    labels = texts.join(names, d.eqNullSafe(F.col("cowrie_d"))).groupBy("trader_id", "item", "label").agg(F.sum("sales").alias("sales"), F.sum("n").alias("n"))
    by_item = labels.groupBy("trader_id", "item").agg(
        F.sum("sales").alias("sales"), F.sum("n").alias("lines"), F.min(F.struct(-F.col("n"), F.length("label"), F.col("label").alias("label")))["label"].alias("label")
    )
    total = F.sum("sales").over(Window.partitionBy("trader_id"))
    return by_item.withColumn("share", F.when(total > 0, half_up(F.col("sales") / total, 3)).otherwise(F.lit(0.0)))


def top_items(by_item: DataFrame, most: int = 6) -> DataFrame:
    """The best ``most`` items of each trader and one row "others" for the rest."""
    rank = F.row_number().over(Window.partitionBy("trader_id").orderBy(F.desc("sales"), "item"))
    slot = F.when(F.col("rank") <= most, F.col("item")).otherwise(F.lit("others"))
    ranked = by_item.withColumn("rank", rank).withColumn("slot", slot).withColumn("place", F.least("rank", F.lit(most + 1)))
    return ranked.groupBy("trader_id", "place", F.col("slot").alias("item")).agg(F.sum("sales").alias("sales"), F.sum("lines").alias("lines"))


def performance(by_week: DataFrame) -> DataFrame:
    """Averages over the basis weeks, best week, trend and consistency of each trader.

    Basis weeks are the full recorded ones if there are any, else the recorded
    ones. The trend needs four full weeks (slope of four weeks over the mean;
    beyond 5% it grows or declines), consistency three (variation below 0.15,
    0.3 and 0.5). From eight full weeks the last four are compared with the four
    before.
    """
    own = Window.partitionBy("trader_id")
    w = by_week.withColumn("full", ~F.col("partial") & ~F.col("gap")).withColumn("any_full", F.max("full").over(own))
    w = w.withColumn("basis", F.when(F.col("any_full"), F.col("full")).otherwise(~F.col("gap")))
    order = Window.partitionBy("trader_id", "full").orderBy("week")
    w = w.withColumn("at", F.row_number().over(order) - 1).withColumn("back", F.row_number().over(Window.partitionBy("trader_id", "full").orderBy(F.desc("week"))))
    of = lambda cond, c="sales": F.when(F.col(cond), F.col(c))
    full_sales = of("full")
    got = w.groupBy("trader_id").agg(
        F.count("*").alias("weeks_span"),
        F.count_if(~F.col("gap")).alias("recorded_weeks"),
        F.count_if("full").alias("full_weeks"),
        F.count_if("basis").alias("basis_weeks"),
        half_up(F.coalesce(F.avg(of("basis")), F.lit(0.0))).alias("avg_weekly"),
        half_up(F.coalesce(F.percentile(of("basis"), F.lit(0.5)), F.lit(0.0))).alias("median_weekly"),
        F.max(F.when(F.col("basis"), F.struct("sales", (-F.datediff("week", F.lit("1970-01-01").cast("date"))).alias("early"), "week")))["week"].alias("best_week"),
        F.regr_slope(full_sales, of("full", "at").cast("double")).alias("slope"),
        F.avg(full_sales).alias("mean"),
        F.stddev_pop(full_sales).alias("spread"),
        F.avg(F.when(F.col("full") & (F.col("back") <= 4), F.col("sales"))).alias("recent"),
        F.avg(F.when(F.col("full") & F.col("back").between(5, 8), F.col("sales"))).alias("previous"),
    )
    pct = F.when((F.col("full_weeks") >= 4) & (F.col("mean") > 0), half_up(F.coalesce("slope", F.lit(0.0)) * 4 / F.col("mean"), 3))
    cv = F.when(F.col("full_weeks") >= 3, half_up(F.when(F.col("mean") > 0, F.col("spread") / F.col("mean")).otherwise(F.lit(0.0)), 3))
    c = F.col("cv")
    label = F.when(c < 0.15, "very_steady").when(c < 0.3, "steady").when(c < 0.5, "variable").when(c.isNotNull(), "volatile")
    long = F.col("full_weeks") >= 8
    got = got.withColumn("trend_pct", pct).withColumn("trend", F.when(pct > 0.05, "growing").when(pct < -0.05, "declining").when(pct.isNotNull(), "stable")).withColumn("cv", cv).withColumn("consistency", label)
    got = got.withColumn("recent_avg", F.when(long, half_up(F.col("recent")))).withColumn("previous_avg", F.when(long, half_up(F.col("previous"))))
    basis = F.when(F.col("full_weeks") > 0, "full").when(F.col("recorded_weeks") > 0, "partial").otherwise("none")
    return got.withColumn("basis", basis).drop("slope", "mean", "spread", "recent", "previous")


def evidence(lines: DataFrame) -> DataFrame:
    """(trader_id, metric, key, entry_id): the lines behind every week, month and item; long, so no row grows with the data.

    Lines may have their ``item`` (``normalize_item`` of the description); where
    descriptions recur it is cheaper to make it once for each of them.
    """
    item = F.col("item") if "item" in lines.columns else normalize_item(F.col("description"))
    named = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.alias("key"))
    dated = named("week", week_start(F.col("date")).cast("string")), named("month", F.date_format("date", "yyyy-MM"))
    # the outer form has no filter that would make the keys again; no line is without a week
    metrics = F.inline_outer(F.when(F.col("type") == "sale", F.array(*dated, named("item", item))).otherwise(F.array(*dated)))
    return lines.select("trader_id", F.col("id").alias("entry_id"), metrics)


def best_weekday(by_weekday: DataFrame) -> DataFrame:
    """The weekday with the highest mean of each trader, the first on ties."""
    return by_weekday.groupBy("trader_id").agg(F.max_by("weekday", F.struct("average", -F.col("weekday"))).alias("weekday"), F.max("average").alias("average"))


def counts(ledger: DataFrame, sources: DataFrame, payments: DataFrame) -> DataFrame:
    """Thirteen counters of each trader.

    ``ledger`` has ``bucket``, ``origin`` and ``original``; ``sources`` kind, status,
    ``confirmed_at`` and, if they can be kept in spite of a likeness, ``duplicate_kept``; ``payments`` ``duplicate_of``. A trader of any of them has a row.
    """
    bucket = lambda name: F.count_if(F.col("bucket") == name)
    counted = F.col("bucket") == "counted"
    lines = ledger.groupBy("trader_id").agg(
        bucket("counted").alias("entries_counted"), bucket("pending").alias("entries_pending"), bucket("rejected").alias("entries_rejected"), bucket("repeated").alias("excluded_duplicates"),
        F.count_if(counted & F.col("original").isNotNull()).alias("corrections"), F.count_if(counted & (F.col("origin") == "trader")).alias("trader_added"),
    )
    page = F.col("kind").isin("notebook", "receipt")
    read = page & (F.col("status") == "read")
    kept = F.coalesce(F.col("duplicate_kept"), F.lit(False)) if "duplicate_kept" in sources.columns else F.lit(False)
    pages = sources.groupBy("trader_id").agg(F.count_if(kept).alias("near_duplicates_kept"), F.count_if(page).alias("pages"), F.count_if(read).alias("pages_read"), F.count_if(read & F.col("confirmed_at").isNotNull()).alias("pages_confirmed"))
    again = F.col("duplicate_of").isNotNull()
    momo = payments.groupBy("trader_id").agg(F.count_if(~again).alias("momo"), F.count_if(again).alias("momo_duplicates"))
    out = lines.join(pages, "trader_id", "full").join(momo, "trader_id", "full").na.fill(0)
    return out.withColumn("pages_awaiting_review", F.col("pages_read") - F.col("pages_confirmed"))


def integrity(events: DataFrame) -> DataFrame:
    """Photos that were blocked as copies, and copies of another trader's photos, per trader; ``events`` has type and cross_trader."""
    blocked = F.col("type") == "photo_duplicate_blocked"
    across = F.col("type").isin("photo_duplicate_blocked", "photo_duplicate_flagged") & F.coalesce("cross_trader", F.lit(False))
    return events.groupBy("trader_id").agg(F.count_if(blocked).alias("blocked_duplicates"), F.count_if(across).alias("cross_trader"))


def prepare(entries: DataFrame, sources: DataFrame, payments: DataFrame, repeated: DataFrame | None = None, lists: bool = True) -> dict[str, DataFrame]:
    """What every figure is derived from, computed once and stored: lines with their ``bucket``, sums of days, marked payments.

    Without ``lists`` lines have what the profile needs, but no ids and texts.
    """
    rows = ledgers.build_ledger(entries, sources, repeated)
    rows = cut_lineage(rows if lists else rows.select("trader_id", "date", "type", "amount", "bucket", "origin", F.col("original").isNotNull().alias("original")).withColumn("original", F.when(F.col("original"), True)))
    return {"rows": rows, "days": cut_lineage(daily(rows.where("bucket = 'counted'"))), "marked": cut_lineage(duplicates.mark_payment_duplicates(payments))}


def build_profile(traders: DataFrame, entries: DataFrame, sources: DataFrame, payments: DataFrame, events: DataFrame, totals: DataFrame, repeated: DataFrame | None = None, prepared: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per trader: period, headline figures, trend, counters, checks, corroboration, strength and grade.

    Lines, weeks and other lists stay tables of their own (``weeks``, ``months``,
    ``items``, ``weekdays``, ``evidence``), so no row grows with the data. Traders
    without counted lines have null periods and zeros. ``prepared`` is what
    ``prepare`` gave, where more than the profile is derived from it.
    """
    made = prepared or prepare(entries, sources, payments, repeated, lists=False)
    rows, days, marked = made["rows"], made["days"], made["marked"]
    counted = rows.where("bucket = 'counted'")
    spans = period(days).select("trader_id", "start", "end")
    sold = counted.where("type = 'sale'")
    inflows = matching.classify(marked.where("duplicate_of IS NULL"), spans).where("class = 'inflow'")
    rates = matching.corroboration_metrics(matching.corroborate(sold, inflows, named=False), sold)
    checks = ledgers.checks_rollup(ledgers.page_checks(entries, totals), sources)
    out = traders.select("trader_id").join(headline(days), "trader_id", "left").join(performance(weeks(days)).withColumnRenamed("consistency", "steadiness"), "trader_id", "left")
    out = out.join(rates.drop("sales"), "trader_id", "left").join(counts(rows, sources, marked), "trader_id", "left").join(checks, "trader_id", "left").join(integrity(events), "trader_id", "left")
    given = {"counted": "entries_counted", "confirmed": "entries_counted", "pending": "entries_pending", "rate": "rate_amount", "duplicate_lines": "excluded_duplicates"}
    numbers = [f.name for f in out.schema if f.dataType.typeName() in ("long", "integer", "double") and f.name not in ("trader_id", "trend_pct", "cv", "recent_avg", "previous_avg")]
    out = out.na.fill(0, numbers).withColumns({k: F.col(v) for k, v in given.items()}).fillna("none", ["basis"])
    return strength.evidence_strength(out).drop(*given)
