"""What is moved and stored grows with the input only: plans and partitions, not times."""

import os
import re
import time

from pyspark.sql import functions as F

from cowrie.functions.text import strip_accents
from cowrie.operators import answers, duplicates, lineage, pages, payments, profile
from cowrie.plans.queries import QUERIES
from cowrie.sources import adapters as a
from cowrie.sources.tables import Scratch, cut_lineage, shared_folder, stored_by

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_stored_by_page_is_grouped_by_page_without_a_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("source_id"), (F.col("id") % 3).alias("kind"))
    t = stored_by(rows, "source_id", 100_000)
    sums = t.groupBy("source_id", "kind").count()
    assert "Exchange" not in plan(sums) and sums.count() == 300


def test_lines_of_the_bundle_are_not_moved_again_to_be_compared(spark):
    b = a.bundle(spark, SMALL)
    tokens = duplicates._tokens(duplicates.page_lines(b["entries"], b["sources"]), 3)
    # pages come to the lines; the lines, already dealt by page, are moved neither by page nor by key
    assert "hashpartitioning(trader_id" not in plan(tokens)


def test_sums_of_sales_match_payments_as_named_lines_do(spark):
    b = a.bundle(spark, SMALL)
    sold = b["entries"].where("type = 'sale'")
    paid = b["payments"].where("kind = 'received'")
    named = payments.corroborate(sold.withColumn("ord", F.col("id")), paid).select("id", "matched", "closed_day")
    summed = payments.corroborate(sold.drop("id"), paid, named=False).select("id", "matched", "closed_day")
    assert sorted(map(tuple, named.collect()), key=str) == sorted(map(tuple, summed.collect()), key=str)


def test_messages_are_dealt_to_partitions_of_bounded_size(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(10)
    assert a.spread(rows, 10).rdd.getNumPartitions() == cores
    assert a.spread(rows, a.SPREAD_ROWS * (cores + 5)).rdd.getNumPartitions() == cores + 5


def test_ascii_texts_are_not_searched_for_accents(spark):
    t = spark.createDataFrame([("Reçu de l'été é",), ("plain",), ("",), (None,)], "x string").select(strip_accents(F.col("x")).alias("x"))
    assert "octet_length" in t._jdf.queryExecution().optimizedPlan().toString()
    assert [r.x for r in t.collect()] == ["Recu de l'ete e", "plain", "", None]


def test_texts_of_answers_are_searched_once(spark):
    t = spark.createDataFrame([("a", 1, "Sales were 1 500 FCFA [E1], 20% more", None, True)], "answer_id string, pack_id int, answer string, citations array<string>, answerable boolean")
    refs = spark.createDataFrame([(1, "E1")], "pack_id int, code string")
    searches = lambda df, what: df._jdf.queryExecution().optimizedPlan().toString().count(what)
    found = answers.figures(t)
    # percentages, and figures with and without any; a filter that Spark derives from the generator would search it all again, twice
    assert searches(found, "regexp_extract_all") == 3
    assert sorted((r.percent, r.value) for r in found.collect()) == [(False, 1500.0), (True, 20.0)]
    done = answers.audit(t, refs)
    # codes of an answer: those in brackets, twice those outside of them, and those of a text without any
    assert searches(done, "regexp_extract_all") == 4
    assert [(r.citations, r.uncited) for r in done.collect()] == [(["E1"], False)]


def test_rows_that_cost_much_are_dealt_by_key(spark):
    dealt = a.spread(spark.range(1000).coalesce(1), 10, "id")
    assert "hashpartitioning(id" in plan(dealt) and dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_figures_of_a_trader_share_one_shuffle(spark):
    lines = a.entries(spark, SMALL).where("status = 'confirmed' AND amount > 0").withColumn("ord", F.col("id"))
    made = lineage.figure_runs(lines, profile.weeks(profile.daily(lines)))
    # lines are moved to their week and to their trader, never once for each figure
    assert "figure#" not in "".join(x for x in plan(made).split("\n") if "Exchange" in x)
    runs = {(r.trader_id, r.figure, r.key, r.start, r.end) for r in made.collect()}
    numbered = lineage.line_numbers(lines)
    whole = lineage.runs_of(numbered.select("trader_id", F.when(F.col("type") == "sale", "sales").otherwise("expenses").alias("figure"), F.lit("").alias("key"), "number"))
    assert {x for x in runs if x[1] in ("sales", "expenses")} == {(r.trader_id, r.figure, r.key, r.start, r.end) for r in whole.collect()}


def test_a_document_of_a_screen_is_parsed_once(spark):
    made = pages.read_payments(a.payment_json(spark, SMALL))
    steps = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert steps.count("parsejson") == 1 and made.count() > 0


def test_evidence_moves_lines_once_and_names_items_by_part(spark):
    steps = plan(QUERIES["evidence_rows"](spark, SMALL)).split("\n")
    at = {name: [i for i, x in enumerate(steps) if name in x] for name in ("Exchange hashpartitioning(trader_id", "Generate inline", "Join", "split(regexp_replace")}
    # a line goes to its trader before it becomes rows of a week, a month and an item; items are made before parts meet lines
    assert len(at["Exchange hashpartitioning(trader_id"]) == 1 and "metric" not in steps[at["Exchange hashpartitioning(trader_id"][0]]
    assert max(at["Generate inline"]) < at["Exchange hashpartitioning(trader_id"][0] and max(at["Join"]) < min(at["split(regexp_replace"])
    lines = a.entries(spark, SMALL, True)
    named = profile.evidence(lines.withColumn("item", F.lit("x")))
    rows = lambda e: sorted(map(tuple, e.collect()))
    assert {r.key for r in named.where("metric = 'item'").collect()} == {"x"}
    assert rows(profile.evidence(lines)) == rows(profile.evidence(a.entries(spark, SMALL, True, True)))


def files(path, name=""):
    return {f"{at}/{n}" for at, _, names in os.walk(path) for n in names if n.startswith(name)}


def test_tables_that_are_stored_leave_no_shuffle_files(spark):
    local = spark.sparkContext.getConf().get("spark.local.dir")
    before = files(local, "shuffle_")
    kept = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    by = stored_by(spark.range(1000), "id", 1000)
    for _ in range(50):  # they are removed beside the job
        if left := files(local, "shuffle_") - before:
            time.sleep(0.1)
    assert not left and kept.count() == 7 and by.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_tables_of_a_scratch_are_removed_and_no_others(spark):
    folder = shared_folder(spark).removeprefix("file://")
    before = files(folder, "part-")
    outer = cut_lineage(spark.range(3))
    mine = files(folder, "part-") - before
    with Scratch(spark) as scratch:
        cut_lineage(spark.range(4))
        name = stored_by(spark.range(5), "id", 5)._jdf.queryExecution().analyzed().toString()
    assert "cowrie_" in name and files(folder, "part-") > before | mine
    scratch.remove()
    assert files(folder, "part-") == before | mine and outer.count() == 3


def test_evidence_keeps_no_table_that_its_facts_do_not_read(spark):
    folder = shared_folder(spark).removeprefix("file://")
    kept = {}
    for name in ("evidence_pack", "evidence_text"):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        made = QUERIES[name](spark, SMALL)
        kept[name] = len(set(os.listdir(folder)) - before)
        assert made.count() > 0
    assert kept == {"evidence_pack": 4, "evidence_text": 5}  # lines, days, payments and profile; with text, payments and what backs them


def test_lines_are_numbered_by_one_shuffle_even_of_null_traders_and_dates(spark):
    rows = [(t, d, o) for t in (None, 1, 2) for d in (None, "2024-01-01", "2024-01-02") for o in (2, 1, 3)]
    df = spark.createDataFrame(rows, "trader_id int, date string, ord int").withColumn("date", F.col("date").cast("date"))
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = answers.numbered_lines(df, "E", "ord")
        assert sum("Exchange hashpartitioning" in x and "ord#" not in x for x in plan(made).split("\n")) == 4  # the lines, their sums twice and the starts; none for the window
        got = made.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    for t in (None, 1, 2):
        mine = sorted((r.date is not None, str(r.date), r.ord, r.code) for r in got if r.trader_id == t)
        assert [c for *_, c in mine] == [f"E{i}" for i in range(1, 10)]


def test_codes_of_a_pack_are_found_by_few_runs(spark, monkeypatch):
    monkeypatch.setattr(answers, "RUN_CODES", 16)
    held = [f"E{i}" for i in range(1, 41)] + ["E50", "M1", "W2024-01-01", "W2024-01-08", "W2024-01-22", "MO2023-12", "MO2024-01", "MO2024-03", "E007", "W2024-02-31", "odd", "G1", "G1"]
    refs = spark.createDataFrame([(1, c) for c in held] + [(2, "E41"), (None, "E42"), (1, None)], "pack_id int, code string")
    runs = {r.pack_id: len(r.cowrie_runs) for r in answers.code_runs(refs).collect()}
    assert runs == {1: 3 + 1 + 1 + 2 + 2 + 1 + 3, 2: 1}
    asked = [*held, "E7", "E0", "E41", "E42", "M2", "E0050", "W2024-01-15", "W2024-01-02", "MO2024-02", "MO2024-13", "W2024-02-30", "I1", "G01"]
    t = spark.createDataFrame([(f"{p}/{i}", p, "", [c]) for p in (1, 2, 3, None) for i, c in enumerate(asked)], "answer_id string, pack_id int, answer string, citations array<string>").withColumn("answerable", F.lit(True))
    got = {r.answer_id: list(r.citations) for r in answers.audit(t, refs).collect()}
    shaped = {c for c in asked if re.fullmatch(answers.CODES, c)}
    assert got == {f"{p}/{i}": [c] * (c in shaped and (c in held if p == 1 else p == 2 and c == "E41")) for p in (1, 2, 3, None) for i, c in enumerate(asked)}


def test_answers_are_dealt_once_by_their_pack(spark):
    steps = plan(QUERIES["answer_audit"](spark, SMALL)).split("\n")
    # neither answers nor their figures are moved again by answer or by code
    assert [x for x in steps if "Exchange hashpartitioning(answer_id" in x or "Exchange hashpartitioning(pack_id" in x and "code#" in x] == []
