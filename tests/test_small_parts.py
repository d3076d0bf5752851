"""Parts that no query uses alone: image types, best readings, versions, tables, contracts, the hub."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cowrie.operators import changes, contracts, pages, privacy, views
from cowrie.sources import tables


def test_image_types(spark):
    heads = {
        "jpeg": b"\xff\xd8\xff\xe0rest", "png": b"\x89PNG\r\n\x1a\nmore", "webp": b"RIFF\x10\0\0\0WEBPVP8 ", "heic": b"\0\0\0\x18ftypheic\0\0",
        None: b"GIF89a......", "jpeg ": b"\xff\xd8\xff", "heic ": b"\0\0\0\x18ftypmif1\0", "none": b"",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()] + [("null", None)], "k string, content binary")
    got = {r.k: r.mime for r in df.select("k", tables.image_type(F.col("content")).alias("mime")).collect()}
    assert got == {"jpeg": "jpeg", "png": "png", "webp": "webp", "heic": "heic", None: None, "jpeg ": None, "heic ": "heic", "none": None, "null": None}


def test_photos_of_a_folder(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0" + b"x" * 20)
    (tmp_path / "in" / "deep" / "b.txt").write_bytes(b"words")
    (tmp_path / "in" / "big").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 90)
    got = {r.path.rpartition("/")[2]: (r.mime, r.problem) for r in tables.read_photos(spark, f"{tmp_path}/in", most_bytes=50).collect()}
    assert got == {"a.jpg": ("jpeg", None), "b.txt": (None, "not_an_image"), "big": ("png", "too_large")}


def test_best_readings(spark):
    df = spark.createDataFrame([("p", 1, 5), ("p", 2, 3), ("p", 3, 3), ("q", 2, 0), ("r", 1, None), ("r", 2, 9)], "page_id string, attempt int, score int")
    assert {(r.page_id, r.attempt) for r in pages.best_reading(df).collect()} == {("p", 2), ("q", 2), ("r", 1)}
    assert pages.best_reading(df.limit(0)).count() == 0


def test_last_versions_and_traders_that_go(spark):
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "id string, updated_at int, v string")
    assert {tuple(r) for r in changes.latest(versions).collect()} == {("a", 3, "z"), ("b", 1, None)}
    held = {"traders": spark.createDataFrame([("t",), ("u",)], "id string"), "entries": spark.createDataFrame([("1", "t"), ("2", "u"), ("3", None)], "id string, trader_id string")}
    left = changes.without_traders(held, spark.createDataFrame([("t",), ("v",)], "trader_id string"))
    assert [r.id for r in left["traders"].collect()] == ["u"] and {r.id for r in left["entries"].collect()} == {"2", "3"}


def test_pages_that_go_take_lines_payments_and_mentions(spark):
    sources = spark.createDataFrame([("p", "t", ["q", "r"]), ("q", "t", ["p"]), ("r", "t", None)], "id string, trader_id string, distinct_from array<string>")
    lines = spark.createDataFrame([("1", "p"), ("2", "q")], "id string, source_id string")
    kept, entries, paid = changes.without_sources(sources, lines, lines, spark.createDataFrame([("q",)], "source_id string"))
    assert {(r.id, tuple(r.distinct_from)) for r in kept.collect()} == {("p", ("r",)), ("r", ())}
    assert [r.id for r in entries.collect()] == ["1"] == [r.id for r in paid.collect()]


def test_tables_are_written_and_replaced_as_a_whole(spark, tmp_path):
    for v in (1, 2):
        tables.write_tables({"x": spark.createDataFrame([(v,)], "v int"), "empty": spark.createDataFrame([], "w string")}, f"{tmp_path}/db")
        assert [r.v for r in spark.read.parquet(f"{tmp_path}/db/x").collect()] == [v] and spark.read.parquet(f"{tmp_path}/db/empty").columns == ["w"]


def test_stored_tables_are_pruned(spark):
    kept = tables.cut_lineage(spark.createDataFrame([(i, "x" * i, None) for i in range(5)], "a int, b string, c array<string>"))
    assert sorted(r.a for r in kept.collect()) == list(range(5))
    plan = kept.select("a").where("a > 2")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<a:int>" in plan and "GreaterThan(a,2)" in plan


@pytest.mark.parametrize(("given", "want"), [(None, []), ([], []), (["mtn", "orange"], []), (["mtn", "bank"], ["provider_unknown"]), (["mtn", "mtn", "orange"], ["providers_many"]), ([None], ["provider_unknown"])])
def test_providers(spark, given, want):
    df = spark.createDataFrame([("Awa", "Foods", "Mokolo", "Douala", None, given)], "a string, b string, c string, d string, e string, f array<string>")
    assert list(df.select(contracts.trader_issues(*[F.col(c) for c in "abcdef"])).first()[0]) == want


def test_hub(spark):
    found = spark.createDataFrame([("a", 0, 0, 0, None), ("b", 2, 1, 0, dt.date(2026, 1, 1)), ("c", 2, 0, 0, None), ("d", 2, 0, 0, dt.date(2026, 1, 1)), ("e", 1, 0, 1, dt.date(2026, 1, 1))], "trader_id string, pages int, entries_pending int, pages_awaiting_review int, start date")
    traders = spark.createDataFrame([(t, (t != "c",)) for t in "abcdef"] + [("g", None)], "id string, consent struct<granted: boolean>")
    got = {r.trader_id: r.step for r in views.hub(found, traders).collect()}
    assert got == {"a": "capture", "b": "review", "c": "profile", "d": None, "e": "review", "f": "capture", "g": "capture"}


def test_lenders_see_consenting_traders_without_phones(spark):
    traders = spark.createDataFrame([("t", "+237 612345678", (True, "TR-AAAA-BBBB")), ("u", "699999999", (False, None)), ("v", None, None)], "id string, phone string, consent struct<granted: boolean, code: string>")
    paid = spark.createDataFrame([("1", "t", "612345678", "Awa Ngono Marie", "from 612345678."), ("2", "u", "612345678", "A B", "612345678")], "id string, trader_id string, phone string, counterparty string, raw string")
    texts = spark.createDataFrame([("p", "t", "call (+237)612345678 or 712345678"), ("q", "t", None), ("r", "v", "612345678")], "id string, trader_id string, text string")
    seen = privacy.lender_bundle({"traders": traders, "payments": paid, "sources": texts, "entries": spark.createDataFrame([("e", "u")], "id string, trader_id string")})
    assert [(r.id, r.phone) for r in seen["traders"].collect()] == [("t", "6•• ••• •78")]
    assert [tuple(r)[1:] for r in seen["payments"].select("id", "phone", "counterparty", "raw").collect()] == [("6•• ••• •78", "Awa N.", "from 6•• ••• •78.")]
    assert {(r.id, r.text) for r in seen["sources"].collect()} == {("p", "call 6•• ••• •78 or 712345678"), ("q", None)} and seen["entries"].count() == 0


def test_accents_of_every_block(spark):
    import unicodedata

    from cowrie.functions import text

    blocks = [(0x20, 0x530), (0x1D00, 0x2000), (0x2100, 0x2150), (0x2C60, 0x2E00), (0xA640, 0xA800), (0xAB30, 0xAB70)]  # Latin, Greek, Cyrillic and Vietnamese letters, and what lies between
    signs = [chr(c) for a, b in blocks for c in range(a, b)]
    rows = [(s, f"x{s}y") for s in signs] + [("vn", "Tiếng Việt ệ"), ("gr", "ᾧ ΐ Ὦ"), ("ru", "Ёжик й"), ("loose", "é")]
    got = {r.k: r.v for r in spark.createDataFrame(rows, "k string, t string").select("k", text.strip_accents(F.col("t")).alias("v")).collect()}
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F)
    # U+0344 and the like are marks that decompose into marks; nothing else may differ
    assert {k: v for k, v in got.items() if v != bare(dict(rows)[k])} == {}


def test_payments_of_a_long_screen_are_all_read(spark, tmp_path):
    from cowrie.plans.queries import QUERIES

    events = spark.range(1, 201).select(F.col("id").alias("event_id"), F.lit("2024-02-03 10:11:12").cast("timestamp").alias("ts"), F.when(F.col("id") <= 150, 7).otherwise(8).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(5.0).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    made = QUERIES["payment_reading"](spark, str(tmp_path))
    assert made._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    got = made.select("page_id", "pos").collect()
    assert sorted(map(tuple, got)) == [(7, i) for i in range(150)] + [(8, i) for i in range(50)]
