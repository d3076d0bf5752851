"""The lines behind a figure as runs of line numbers.

A trader's counted lines have dense numbers by date and ``ord``, those of their
evidence codes. Weeks and months are runs of them by nature; averages, trends
and totals are a few runs, where a list of ids would grow with the lines. Runs
are rows (trader_id, figure, key, start, end), both ends included, and can be
joined, subtracted and spelled out as ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cowrie.functions.dates import week_start
from cowrie.operators.answers import numbered_lines

KEYS = ["trader_id", "figure", "key"]


def line_numbers(lines: DataFrame) -> DataFrame:
    """Append ``number``: a line's place among its trader's lines by date and ``ord``, from 1."""
    return numbered_lines(lines, "E", "ord").withColumn("number", F.substring("code", 2, 20).cast("long")).drop("code")


def runs_of(members: DataFrame) -> DataFrame:
    """Runs of the numbers of members (trader_id, figure, key, number); a number that repeats counts once."""
    order = Window.partitionBy(*KEYS).orderBy("number")
    island = members.select(*KEYS, "number").distinct().withColumn("island", F.col("number") - F.row_number().over(order))
    return island.groupBy(*KEYS, "island").agg(F.min("number").alias("start"), F.max("number").alias("end")).drop("island")


def union(runs: DataFrame) -> DataFrame:
    """Runs of each figure, those that overlap or touch joined to one."""
    before = F.max("end").over(Window.partitionBy(*KEYS).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0)
    t = runs.select(*KEYS, "start", "end").withColumn("opens", opens)
    t = t.withColumn("island", F.sum("opens").over(Window.partitionBy(*KEYS).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*KEYS, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def difference(runs: DataFrame, less: DataFrame) -> DataFrame:
    """What of each figure's runs the other runs of the same figure do not hold.

    Both ends of all runs are put in order; a stretch between two of them stays
    if a run covers it and no other one does.
    """
    edges = [
        df.select(*KEYS, F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(up).alias("own"), F.lit(down).alias("other")), F.struct((F.col("end") + 1).alias("at"), F.lit(-up).alias("own"), F.lit(-down).alias("other")))))
        for df, up, down in ((runs, 1, 0), (less, 0, 1))
    ]
    steps = edges[0].union(edges[1]).groupBy(*KEYS, "at").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    order = Window.partitionBy(*KEYS).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    t = steps.select(*KEYS, F.col("at").alias("start"), (F.lead("at").over(order) - 1).alias("end"), F.sum("own").over(so_far).alias("held"), F.sum("other").over(so_far).alias("taken"))
    return union(t.where("held > 0 AND taken = 0 AND end >= start"))


def spelled_out(runs: DataFrame, numbered: DataFrame) -> DataFrame:
    """(trader_id, figure, key, entry_id): the ids that runs stand for; ``numbered`` comes from ``line_numbers``."""
    each = runs.select(*KEYS, F.explode(F.sequence("start", "end")).alias("number"))
    return each.join(numbered.select("trader_id", "number", F.col("id").alias("entry_id")), ["trader_id", "number"]).select(*KEYS, "entry_id")


def figure_runs(lines: DataFrame, by_week: DataFrame) -> DataFrame:
    """Runs behind every figure of a profile: sales, expenses, weeks, months, the weekly average and the trend.

    ``lines`` are the counted ones with ``ord``, ``by_week`` their weeks. The
    average rests on the sales of full recorded weeks, or of recorded weeks if none
    is full; the trend on those of full recorded weeks, from four on.
    """
    full = ~F.col("partial") & ~F.col("gap")
    own = Window.partitionBy("trader_id")
    w = by_week.select("trader_id", "week", full.alias("full"), "gap").withColumn("fulls", F.count_if("full").over(own))
    w = w.select("trader_id", "week", F.when(F.col("fulls") > 0, F.col("full")).otherwise(~F.col("gap")).alias("basis"), (F.col("full") & (F.col("fulls") >= 4)).alias("trend"))
    sale, always = F.col("type") == "sale", F.lit(True)
    t = lines.withColumn("week", week_start(F.col("date"))).join(w.withColumn("known", always), ["trader_id", "week"], "left")
    holds = {"any": always, "sales": sale, "expenses": ~sale, "avg_weekly": sale & F.col("basis"), "trend": sale & F.col("trend")}
    held = [F.coalesce(F.col("known") & cond, F.lit(False)).alias(f"is_{k}") for k, cond in holds.items()]
    t = t.select("trader_id", "date", "ord", "week", *held)
    # a line's number less its place among the lines of a figure is one and the same along a run; all figures share one sort
    order = Window.partitionBy("trader_id").orderBy("date", "ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("trader_id", "date", "week", *[f"is_{k}" for k in holds], F.row_number().over(order).cast("long").alias("number"), *[F.count_if(f"is_{k}").over(so_far).alias(f"n_{k}") for k in holds])
    member = lambda figure, key, of: F.when(F.col(f"is_{of}"), F.struct(F.lit(figure).alias("figure"), key.alias("key"), (F.col("number") - F.col(f"n_{of}")).alias("island")))
    kinds: list[Column] = [member("week", F.col("week").cast("string"), "any"), member("month", F.date_format("date", "yyyy-MM"), "any")]
    kinds += [member(k, F.lit(""), k) for k in holds if k != "any"]
    each = t.select("trader_id", "number", F.inline_outer(F.array_compact(F.array(*kinds)))).where("figure IS NOT NULL")
    return each.groupBy(*KEYS, "island").agg(F.min("number").alias("start"), F.max("number").alias("end")).drop("island")
