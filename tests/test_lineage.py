"""Runs of line numbers against lists of ids."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cowrie.operators import lineage, profile

RUN = "trader_id string, figure string, key string, start long, end long"


def numbers(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.trader_id, r.figure, r.key), []).append((r.start, r.end))
    return {k: sorted(v) for k, v in out.items()}


def as_runs(held):
    out = []
    for n in sorted(held):
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def test_union_and_difference_against_sets(spark):
    rng = random.Random(3)
    draw = lambda: [("t", "f", str(k), s := rng.randint(1, 40), s + rng.randint(0, 9)) for k in range(25) for _ in range(rng.randint(0, 5))]
    a, b = draw(), draw()
    sets = lambda rows, k: {n for r in rows if r[2] == k for n in range(r[3], r[4] + 1)}
    one, two = spark.createDataFrame(a, RUN), spark.createDataFrame(b, RUN)
    keys = {r[2] for r in a}
    assert numbers(lineage.union(one)) == {("t", "f", k): as_runs(sets(a, k)) for k in keys}
    assert numbers(lineage.difference(one, two)) == {("t", "f", k): as_runs(left) for k in keys if (left := sets(a, k) - sets(b, k))}
    assert lineage.union(one.limit(0)).count() == 0 and lineage.difference(one.limit(0), two).count() == 0


def test_runs_spell_out_the_lines_of_each_figure(spark):
    rng = random.Random(7)
    rows = [(f"e{i}", i, rng.choice("tu"), dt.date(2026, 5, 4) + dt.timedelta(rng.randrange(70)), rng.choice(["sale", "sale", "expense"]), rng.randint(1, 9)) for i in range(260)]
    lines = spark.createDataFrame([*rows, ("x", 999, "v", dt.date(2026, 5, 6), "sale", 5)], "id string, ord int, trader_id string, date date, type string, amount long")
    weeks = profile.weeks(profile.daily(lines))
    runs = lineage.figure_runs(lines, weeks)
    got = {}
    for r in lineage.spelled_out(runs, lineage.line_numbers(lines)).collect():
        got.setdefault((r.trader_id, r.figure, r.key), set()).add(r.entry_id)
    monday = lambda d: d - dt.timedelta(d.weekday())
    table = {(r.trader_id, r.week): r for r in weeks.collect()}
    want = {}
    for i, _, t, d, kind, _ in [*rows, ("x", 999, "v", dt.date(2026, 5, 6), "sale", 5)]:
        full = [r for (who, _), r in table.items() if who == t and not r.partial and not r.gap]
        mine = table[t, monday(d)]
        figures = [("week", str(monday(d))), ("month", d.isoformat()[:7]), ("sales", "") if kind == "sale" else ("expenses", "")]
        if kind == "sale" and (mine in full if full else not mine.gap):
            figures.append(("avg_weekly", ""))
        if kind == "sale" and mine in full and len(full) >= 4:
            figures.append(("trend", ""))
        for f in figures:
            want.setdefault((t, *f), set()).add(i)
    assert got == want
    whole = runs.where("figure = 'week'").groupBy("trader_id", "key").count()
    assert whole.where("count > 1").count() == 0  # a week is one run
    # what the average leaves out of all sales
    left = lineage.difference(runs.where("figure = 'sales'"), runs.where("figure = 'avg_weekly'").withColumn("figure", F.lit("sales")))
    rest = {(r.trader_id, r.entry_id) for r in lineage.spelled_out(left, lineage.line_numbers(lines)).collect()}
    assert rest == {(t, i) for t in "tuv" for i in want.get((t, "sales", ""), set()) - want.get((t, "avg_weekly", ""), set())}
