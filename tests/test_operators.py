"""Small cases of the operators, and properties against sequential models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cowrie.functions import dates, numbers, text
from cowrie.operators import answers, changes, contracts, duplicates, ledger, messages, pages, payments, photos, privacy, profile, strength, views

TODAY = dt.date(2026, 9, 30)


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_amounts(spark):
    cases = {"2 500": 2500, "2.500": 2500, "2,500 FCFA": 2500, "2500f": 2500, "2k5": 2500, "2,5k": 2500, "15k": 15000, "2500.00": 2500, "2500,5": 2501, "XAF 1 250 000": 1250000, "abc": None, "": None, None: None, "12 50": None}
    assert column(spark, list(cases), "string", numbers.parse_amount) == list(cases.values())


def test_dates(spark):
    cases = {"14/07/2026": (2026, 7, 14), "14-07-26": (2026, 7, 14), "07/14/2026": (2026, 7, 14), "Lundi 14 juillet": (2026, 7, 14), "July 14, 2025": (2025, 7, 14), "25/12": (2025, 12, 25), "1er août 26": (2026, 8, 1), "2026-02-31": None, "31/02/2026": None, "soon": None, "": None, None: None}
    got = column(spark, list(cases), "string", lambda c: dates.parse_loose_date(c, TODAY))
    assert got == [v and dt.date(*v) for v in cases.values()]


def test_boxes_and_confidence(spark):
    assert column(spark, [[0.1, 0.2, 0.5, 0.9], [900.0, 10.0, 100.0, 50.0], [1.0, 2.0], [5.0, 5.0, 5.5, 90.0], None], "array<double>", numbers.normalize_box) == [[100, 200, 500, 900], [100, 10, 900, 50], None, None, None]
    assert column(spark, [0.0, 0.9, 90.0, 1.2, None], "double", numbers.normalize_confidence) == [0.5, 0.9, 0.9, 0.01, 0.5]


def test_texts(spark):
    assert column(spark, ["2 seaux de Tomates fraîches", "Régime plantains", "12 kg", None], "string", text.normalize_item) == ["tomate fraiche", "plantain", "other", "other"]
    assert column(spark, ["237612345678", "6 12 34 56 78", "12", None], "string", text.mask_phone) == ["6•• ••• •78", "6•• ••• •78", None, None]
    assert column(spark, ["call 612345678 or (237612345699)"], "string", text.mask_phones_in_text) == ["call 6•• ••• •78 or 6•• ••• •99"]
    assert column(spark, ["Awa Ngono", "Paul", "", None], "string", text.short_name) == ["Awa N.", "Paul", None, None]


def parse(spark, *raw):
    df = spark.createDataFrame([(i, r, TODAY) for i, r in enumerate(raw)], "i int, raw string, today date")
    return messages.parse_messages(df).orderBy("i").collect()


def test_messages(spark):
    got = parse(spark, "Vous avez reçu 5 000 FCFA de MARIE TCHOUA (237677123456) le 14/07/2026 a 10:42. Solde: 48 250 FCFA. ID: 8123456789 MTN MoMo", "You have sent 25,000 XAF to John Bih on 2026-07-14 09:05. Fee: 250 XAF. Balance: 4,100 XAF. Txn ID PP260714.0905", "hello", "5000 FCFA promo", "Depot de 5000 FCFA", None)
    a, b = got[0], got[1]
    assert (a.ok, a.direction, a.kind, a.amount, a.balance, a.time, a.ref, a.phone, a.counterparty, a.provider, a.confidence) == (True, "in", "received", 5000, 48250, "10:42", "8123456789", "677123456", "MARIE TCHOUA", "mtn", 0.97)
    assert (b.direction, b.kind, b.amount, b.fee, b.balance, b.date, b.counterparty) == ("out", "sent", 25000, 250, 4100, dt.date(2026, 7, 14), "John Bih")
    assert [r.reason for r in got[2:]] == ["no_amount", "no_direction", "no_date", "no_amount"]


def test_split_messages(spark):
    one, two = "You have received 500 XAF on 2026-07-14", "You have sent 700 XAF on 2026-07-15"
    df = spark.createDataFrame([(1, f"{one}\r\n\r\n{two}"), (2, f"{one}\n{two}"), (3, "You have received\n500 XAF"), (4, None), (5, "  ")], "k int, text string")
    rows = messages.split_messages(df).collect()
    assert sorted((r.k, r.raw) for r in rows) == sorted([(1, one), (1, two), (2, one), (2, two), (3, "You have received 500 XAF")])


def test_payment_duplicates(spark):
    rows = [("a", 1, "in", 5, TODAY, "10:00", "Ab1", "x", "t"), ("b", 2, "in", 9, TODAY, None, "aB1", "y", "t"), ("c", 3, "in", 5, TODAY, "10:00", None, "z", "t"), ("d", 4, "in", 5, TODAY, "10:00", None, "q", "t"), ("e", 5, "in", 5, TODAY, None, None, "Hi  there", "t"), ("f", 6, "in", 6, TODAY, None, "", "hi there", "t"), ("g", 7, "in", 6, TODAY, None, "", "hi there", "u")]
    df = spark.createDataFrame(rows, "id string, ord int, direction string, amount long, date date, time string, ref string, raw string, trader_id string")
    got = {r.id: r.duplicate_of for r in duplicates.mark_payment_duplicates(df).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": "c", "e": None, "f": "e", "g": None}
    assert duplicates.mark_payment_duplicates(df.limit(0)).count() == 0


def test_hamming_and_lookalikes(spark):
    df = spark.createDataFrame([("ff00", "fe00"), ("0f", "f0"), ("0f", "0f0"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(duplicates.hamming_hex(F.col("a"), F.col("b"))).collect()] == [1, 8, None, None, None]
    rng = random.Random(5)
    base = [rng.getrandbits(256) for _ in range(30)]
    hashes = base + [b ^ sum(1 << rng.randrange(256) for _ in range(rng.randrange(20))) for b in base] + base[:3]
    rows = [(i, i, f"{h:064x}") for i, h in enumerate(hashes)] + [(99, 99, None)]
    got = {r.id: (r.near_id, r.bits) for r in duplicates.near_duplicates(spark.createDataFrame(rows, "id int, ord int, dhash string")).collect()}
    want = {}
    for i, h in enumerate(hashes):
        best = min(((bin(h ^ g).count("1"), j) for j, g in enumerate(hashes[:i])), default=(99, 0))
        if best[0] <= 14:
            want[i] = (best[1], best[0])
    assert got == want and want


def test_repeated_pages_against_loop(spark):
    rng = random.Random(2)
    pages_ = {p: [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))] for p in range(40)}
    df = spark.createDataFrame([("t", p, p, k) for p, ks in pages_.items() for k in ks], "trader_id string, source_id int, page_ord int, key string")
    got = {(r.earlier, r.later): r.matches for r in duplicates.repeated_pages(df).collect()}
    from collections import Counter

    first: dict = {}
    want = {}
    big = {p: Counter(k) for p, k in pages_.items() if len(k) >= 3}
    for p in sorted(big):
        key = tuple(sorted(big[p].items()))
        if key in first:
            want[first[key], p] = sum(big[p].values())
        else:
            for q in first.values():
                n = sum((big[q] & big[p]).values())
                if n >= 3 and n >= 0.6 * min(sum(big[q].values()), sum(big[p].values())):
                    want[q, p] = n
            first[key] = p
    assert got == want and want


@pytest.mark.parametrize("seed", range(3))
def test_corroborate_against_loop(spark, seed):
    rng = random.Random(seed)
    day = lambda: dt.date(2026, 9, 1) + dt.timedelta(rng.randrange(4))
    sales = [("t", f"s{i}", i, day(), rng.choice([5, 10, 15, 40])) for i in range(14)]
    pays = [("t", f"m{i}", i, day(), rng.choice([None, "06:10", "12:00", "20:30", "23:59"]), rng.choice([5, 10, 15, 25, 60])) for i in range(22)]
    s = spark.createDataFrame(sales, "trader_id string, id string, ord int, date date, amount long")
    p = spark.createDataFrame(pays, "trader_id string, id string, ord int, date date, time string, amount long")
    got = {r.id: r.matched for r in payments.corroborate(s, p).collect()}
    room: dict = {}
    for x in sales:
        room[x[3]] = room.get(x[3], 0) + x[4]
    order = sorted(pays, key=lambda m: (m[3], m[4] or "", m[2]))
    want, used = {m[1]: None for m in pays}, set()
    for m in order:
        hit = next((x for x in sales if x[3] == m[3] and x[4] == m[5] and x[1] not in used), None)
        if hit:
            used.add(hit[1])
            room[m[3]] -= m[5]
            want[m[1]] = "exact"
    rest = sorted((m for m in order if not want[m[1]]), key=lambda m: m[5])
    for m in rest:
        if room.get(m[3], 0) >= m[5]:
            room[m[3]] -= m[5]
            want[m[1]] = "covered"
    for m in rest:
        if want[m[1]] or not m[4]:
            continue
        hour = int(m[4][:2])
        near = m[3] + dt.timedelta(1) if hour >= 20 else m[3] - dt.timedelta(1) if hour < 7 else None
        if near and room.get(near, 0) >= m[5]:
            room[near] -= m[5]
            want[m[1]] = "adjacent"
    assert got == want


def test_strength_bounds(spark):
    names = strength.INPUTS
    zero, best = [0] * len(names), [8, 8, 8, 10, 0, 5, 1, 4, 4, 50, 0, 0, 0]
    df = spark.createDataFrame([tuple(map(float, zero)), tuple(map(float, best)), tuple([None] * len(names))], ", ".join(f"{n} double" for n in names))
    assert [(r.score, r.grade) for r in strength.evidence_strength(df).collect()] == [(0, "thin"), (100, "strong"), (0, "thin")]


def test_weeks_of_partial_period(spark):
    lines = [("t", str(i), dt.date(2026, 7, 1) + dt.timedelta(i), "sale", 10_000, "rice") for i in range(25) if (dt.date(2026, 7, 1) + dt.timedelta(i)).weekday() < 6]
    days = profile.daily(spark.createDataFrame(lines, "trader_id string, id string, date date, type string, amount long, description string"))
    w = profile.weeks(days).orderBy("week").collect()
    assert [(r.sales, r.partial) for r in w] == [(40_000, True), (60_000, False), (60_000, False), (60_000, False)]
    p = profile.performance(profile.weeks(days)).first()
    assert (p.avg_weekly, p.trend, p.full_weeks) == (60_000, None, 3)


def test_reader_output(spark):
    good = '```json\n{"pageDateText": "14/07/2026", "lines": [{"kind": "sale", "description": "rice", "amount": "2k5", "confidence": 95}, {"kind": "sale", "quantity": 3, "unitPrice": 100, "amount": 0, "confidence": 0.9, "box": [0.1, 0.1, 0.2, 0.9]}, {"kind": "date_header", "dateText": "15/07"}, {"kind": "expense", "amount": 503, "confidence": 1}, {"kind": "total_sales", "amount": 2800}, {"kind": "sale", "amount": "x"}]}\n```'
    df = spark.createDataFrame([("a", good, TODAY), ("b", "no json", TODAY), ("c", '{"lines": [1, {"kind": "sale"}]}', TODAY), ("d", None, TODAY)], "page_id string, json string, today date")
    lines = pages.read_lines(df).cache()
    e = pages.page_entries(lines).orderBy("page_id", "seq").collect()
    assert [(r.page_id, r.seq, r.amount, r.type, list(r.flags)) for r in e] == [("a", 0, 2500, "sale", []), ("a", 1, 300, "sale", ["amount_computed"]), ("a", 2, 503, "expense", ["unusual_amount", "low_confidence"]), ("a", 3, 0, "sale", ["amount_missing", "low_confidence"])]
    assert [r.date.day for r in e] == [14, 14, 15, 15] and e[1].box == [100, 100, 200, 900]
    totals = pages.written_totals(lines)
    assert [(t.amount, t.type, t.date.day) for t in totals.collect()] == [(2800, "sale", 15)]
    q = {r.page_id: r for r in pages.reading_quality(pages.page_entries(lines), totals.limit(0), df).collect()}
    assert (q["a"].score, q["a"].second_opinion, q["b"].empty, q["b"].score) == (2, True, True, 5)


def test_ledger_and_checks(spark):
    rows = [("1", "p", "confirmed", TODAY, 100, "sale"), ("2", "p", "pending", TODAY, 50, "sale"), ("3", "p", "rejected", TODAY, 70, "sale"), ("4", "q", "confirmed", None, 5, "sale"), ("5", "dup", "confirmed", TODAY, 5, "sale"), ("6", "p", "confirmed", TODAY, 9, "expense")]
    e = spark.createDataFrame(rows, "id string, source_id string, status string, date date, amount long, type string")
    s = spark.createDataFrame([("p", "read", None), ("q", "duplicate", True), ("dup", "duplicate", None)], "id string, status string, duplicate_kept boolean")
    again = spark.createDataFrame([("6",)], "id string")
    got = {r.id: r.bucket for r in ledger.build_ledger(e, s, again).collect()}
    assert got == {"1": "counted", "2": "pending", "3": "rejected", "4": "void", "6": "repeated"}
    t = spark.createDataFrame([("p", "sale", TODAY, 160), ("p", "expense", None, 50), ("none", "sale", None, 10)], "source_id string, type string, date date, amount long")
    c = {(r.source_id, r.type): (r.computed, r.difference, r.ok) for r in ledger.page_checks(e, t).collect()}
    assert c == {("p", "sale"): (150, 10, True), ("p", "expense"): (9, 41, False), ("none", "sale"): (0, 10, True)}


def test_answer_audit(spark):
    a = spark.createDataFrame([("x", "p", "Sales were 60 000 [W2026-07-06, E9], see E1 and 45% on 14/07/2026, or 999 999 in 2026.", ["M1", " E2 "], True), ("y", "p", None, None, True)], "answer_id string, pack_id string, answer string, citations array<string>, answerable boolean")
    refs = spark.createDataFrame([("p", c) for c in ("W2026-07-06", "E1", "E2")], "pack_id string, code string")
    cited = answers.citations(a, refs)
    assert [r.code for r in cited.orderBy("place").collect()] == ["W2026-07-06", "E2", "E1"]
    known = spark.createDataFrame([("p", False, 60_100.0), ("p", True, 44.5)], "pack_id string, percent boolean, value double")
    assert [(r.percent, r.value) for r in answers.untraced(a, known).collect()] == [(False, 999_999.0)]
    assert [r.answer_id for r in answers.uncited(a, cited).collect()] == ["y"]


def test_answer_segments(spark):
    rows = [
        ("a", "p", "Up in [W2026-07-06, E9]. Rice leads [I1] , then [NOTE] . More  in MO2026-07 .", [" E2 ", "x", "E9"], None),
        ("b", "p", "E1[bad]2 and TE1, see E7", ["E1"], True),
        ("c", "q", "See E1.", None, True),
        ("d", "p", None, None, False),
        ("e", "p", "\u0001[E1][E2]\u0002", None, True),
    ]
    a = spark.createDataFrame(rows, "answer_id string, pack_id string, answer string, citations array<string>, answerable boolean")
    refs = spark.createDataFrame([("p", c) for c in ("W2026-07-06", "E1", "E2", "E12", "I1", "MO2026-07", "E1")], "pack_id string, code string")
    got = {r.answer_id: ("".join(s.value if s.kind == "text" else f"{{{s.value}}}" for s in r.segments), r.citations, r.uncited) for r in answers.audit(a, refs).collect()}
    assert got == {
        "a": ("Up in {W2026-07-06}. Rice leads {I1}, then. More in {MO2026-07}.", ["W2026-07-06", "I1", "E2", "MO2026-07"], False),
        "b": ("{E12} and TE1, see E7", ["E1", "E12"], False),
        "c": ("See E1.", [], True),
        "d": ("", [], False),
        "e": (" {E1}{E2} ", ["E1", "E2"], False),
    }
    assert answers.audit(a.limit(0), refs.limit(0)).collect() == []


def test_untraced_against_loop(spark):
    draw = random.Random(3)
    known = [("p", percent, float(v)) for percent in (True, False) for v in [-300, 0, 50, 4_950, 5_000, 5_050, *[draw.randrange(1, 10 ** draw.randrange(2, 8)) for _ in range(60)]]]
    asked = [round(abs(v) * f + d) for _, _, v in known for f, d in ((1, 50), (1, -51), (1.01, 0), (0.989, 0), (1, 0))] + [draw.randrange(100, 10**7) for _ in range(200)]
    asked = [v for v in asked if v >= 100 and not 2000 <= v <= 2100]
    a = spark.createDataFrame([("x", "p", " ; ".join(map(str, asked)) + " ; " + " ; ".join(f"{v}%" for v in asked[:80]), None, True)], "answer_id string, pack_id string, answer string, citations array<string>, answerable boolean")
    held = lambda percent, v: any(abs(n - v) <= (1 if percent else max(50, abs(n) * 0.01)) for _, p, n in known if p == percent)
    want = {(False, float(v)) for v in asked if not held(False, v)} | {(True, float(v)) for v in asked[:80] if not held(True, v)}
    evidence = spark.createDataFrame(known, "pack_id string, percent boolean, value double")
    assert {(r.percent, r.value) for r in answers.untraced(a, evidence).collect()} == want and 0 < len(want) < len(set(asked))


ENTRY = "id string, trader_id string, source_id string, seq int, origin string, status string, date date, description string, amount long, type string, raw string, confidence double, flags array<string>, original struct<date: date, description: string, amount: long, type: string>, confirmed_at timestamp"
AT = dt.datetime(2026, 9, 30, 12)


def entry(i, source="p", **given):
    base = {"id": i, "trader_id": "t", "source_id": source, "seq": 0, "origin": "ai", "status": "pending", "date": TODAY, "description": "a", "amount": 100, "type": "sale", "raw": "", "confidence": 0.5, "flags": [], "original": None, "confirmed_at": None}
    return tuple((base | given).values())


def test_patches(spark):
    lines = [
        entry("ok", flags=["low_confidence"]), entry("zero", status="confirmed", confirmed_at=AT), entry("back", status="rejected"), entry("again", original=(TODAY, "x", 1, "sale"), status="confirmed", confirmed_at=AT), entry("mine", origin="trader"),
        entry("odd", date=None, flags=["date_missing"]), entry("gone"), entry("none"), entry("same", flags=["low_confidence"]), entry("empty"), entry("cleared"), entry("old"), entry("kept", status="confirmed", confirmed_at=AT),
    ]
    kind = "id string, status string, date date, clear_date boolean, description string, amount long, type string"
    wanted = [
        ("ok", "confirmed", None, None, None, None, None), ("zero", None, None, None, None, 0, None), ("back", None, None, None, "b", None, None), ("again", None, None, None, None, 7, "expense"), ("mine", None, None, None, None, 9, None),
        ("odd", "confirmed", None, None, "new words", None, None), ("gone", "rejected", None, None, "ignored", None, None), ("same", None, None, None, "a", 100, None), ("empty", None, None, None, None, None, None), ("cleared", None, None, True, None, None, None),
        ("old", None, dt.date(2024, 1, 1), None, None, None, None), ("kept", "pending", None, None, None, None, None),
    ]
    got = {r.id: r for r in changes.patch_entries(spark.createDataFrame(lines, ENTRY), spark.createDataFrame(wanted, kind), TODAY, AT).collect()}
    status = {k: (r.status, r.confirmed_at is not None, list(r.flags), list(r.happened)) for k, r in got.items()}
    assert status == {
        "ok": ("confirmed", True, ["low_confidence"], []), "zero": ("pending", False, ["amount_missing"], ["entry_corrected"]), "back": ("confirmed", True, [], ["entry_restored", "entry_corrected"]), "again": ("confirmed", True, [], ["entry_corrected"]),
        "mine": ("confirmed", True, [], ["entry_corrected"]), "odd": ("pending", False, ["date_missing"], []), "gone": ("rejected", False, [], ["entry_rejected"]), "none": ("pending", False, [], []), "same": ("pending", False, ["low_confidence"], []),
        "empty": ("pending", False, [], []), "cleared": ("pending", False, ["date_missing"], ["entry_corrected"]), "old": ("pending", False, ["date_out_of_range"], ["entry_corrected"]), "kept": ("pending", False, [], []),
    }
    assert got["zero"].original.amount == 100 and got["again"].original.amount == 1 and got["mine"].original is None and got["odd"].description == "a" and got["gone"].description == "a"
    assert {k for k, r in got.items() if r.refused} == {"odd", "empty"} and got["odd"].issues == ["date_missing"] and got["empty"].issues == ["empty_patch"]
    corrected = views.provenance(spark.createDataFrame([tuple(got["back"])[: len(lines[0])]], ENTRY)).first()
    assert corrected.provenance == "corrected"


def test_added_lines_pages_and_traders(spark):
    e = spark.createDataFrame([entry("1", seq=4), entry("2", "q", status="rejected")], ENTRY)
    pages_ = spark.createDataFrame([("p", "t", "duplicate", False, ["z"]), ("q", "t", "read", False, None), ("r", "u", "duplicate", False, None), ("s", "t", "read", None, None)], "id string, trader_id string, status string, duplicate_kept boolean, distinct_from array<string>")
    new = spark.createDataFrame([("a", "p", 2, TODAY, "x", 5, "sale"), ("b", "p", 1, TODAY, "x", 6, "expense"), ("c", "s", 1, TODAY, "x", 7, "sale"), ("d", "?", 1, TODAY, "x", 7, "sale"), ("e", "p", 1, None, "x", 0, "sale")], "id string, source_id string, ord int, date date, description string, amount long, type string")
    all_, refused = changes.add_entries(e, new, pages_, TODAY, AT)
    got = {r.id: r for r in all_.collect()}
    assert {k: r.seq for k, r in got.items()} == {"1": 4, "2": 0, "b": 5, "a": 6, "c": 0} and got["a"].origin == "trader" and got["a"].status == "confirmed" and got["a"].confidence == 1.0 and got["c"].trader_id == "t"
    assert {r.id: list(r.issues) for r in refused.collect()} == {"d": ["not_found"], "e": ["date_missing", "amount_missing"]}
    kept = {r.id: (r.status, r.duplicate_kept) for r in changes.keep_duplicates(pages_, spark.createDataFrame([("p",), ("q",), ("p",)], "source_id string")).collect()}
    assert kept == {"p": ("pending", True), "q": ("read", False), "r": ("duplicate", False), "s": ("read", None)}
    told = changes.mark_distinct(pages_, spark.createDataFrame([("p", "q"), ("q", "p"), ("p", "r"), ("s", "s")], "a string, b string"))
    assert {r.id: r.distinct_from for r in told.collect()} == {"p": ["z", "q"], "q": ["p"], "r": None, "s": None}
    t = spark.createDataFrame([("t", "Awa", AT, AT)], "id string, name string, created_at timestamp, updated_at timestamp")
    more = changes.create_traders(t, spark.createDataFrame([("t", "again"), ("v", "Bih")], "id string, name string"), AT)
    later = changes.touched(more, spark.createDataFrame([("v", AT + dt.timedelta(days=1)), ("t", AT - dt.timedelta(days=1))], "trader_id string, at timestamp"))
    assert {r.id: (r.name, r.updated_at) for r in later.collect()} == {"t": ("Awa", AT), "v": ("Bih", AT + dt.timedelta(days=1))}


def test_confirm_pages(spark):
    e = spark.createDataFrame([entry("1"), entry("2", date=None, flags=["date_missing"]), entry("3", "q"), entry("4", "q", status="rejected", amount=0), entry("5", "r"), entry("6", "q", status="confirmed")], ENTRY)
    pages_ = spark.createDataFrame([("p", "t", "read", None), ("q", "t", "read", None), ("r", "t", "pending", None), ("s", "u", "read", None)], "id string, trader_id string, status string, confirmed_at timestamp")
    asked = spark.createDataFrame([("p",), ("q",), ("q",), ("r",), ("s",), ("x",)], "source_id string")
    at = dt.datetime(2026, 9, 30, 12)
    lines, after, events, refused = changes.confirm_pages(e, pages_, asked, TODAY, at)
    got = {r.id: (r.status, r.confirmed_at) for r in lines.collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "pending", "2": "pending", "3": "confirmed", "4": "rejected", "5": "pending", "6": "confirmed"}
    assert {k for k, v in got.items() if v[1] == at} == {"3"}
    assert {r.id: r.confirmed_at for r in after.collect()} == {"p": None, "q": at, "r": None, "s": at}
    assert {(r.trader_id, r.source_id, r.type, r.detail) for r in events.collect()} == {("t", "q", "page_confirmed", "1"), ("u", "s", "page_confirmed", "0")}
    assert {(r.source_id, r.reason, r.entry_id, tuple(r.issues)) for r in refused.collect()} == {("p", "page_has_issues", "2", ("date_missing",)), ("r", "not_read", None, ()), ("x", "not_found", None, ())}


def test_payment_screens(spark):
    line = '{"rawText": " a  b ", "direction": "in", "kind": "unknown", "amount": "5 000 F", "fee": 0, "balance": 48.6, "date": "", "dateText": "14/07/2026", "time": "9:05", "ref": " x1 ", "counterparty": "", "provider": "mtn", "confidence": 95}'
    cases = {
        "ok": '{"transactions": [' + line + "]}", "fenced": '```json\n{"transactions": [' + line + "]}\n```", "no_amount": '{"transactions": [' + line.replace('"5 000 F"', "0") + "]}",
        "no_direction": '{"transactions": [' + line.replace('"in"', '"up"') + "]}", "no_date": '{"transactions": [' + line.replace("14/07/2026", "soon") + "]}", "broken": '{"transactions": [' + line, "mixed": '{"transactions": [1, ' + line + "]}",
        "absent": "{}", "null": None, "many": '{"transactions": [' + ", ".join([line] * 90) + "]}",
    }
    df = spark.createDataFrame([(k, v, TODAY) for k, v in cases.items()], "page_id string, json string, today date")
    got = {}
    for r in pages.read_payments(df).collect():
        got.setdefault(r.page_id, []).append(r)
    assert {k: (len(v), v[0].reason) for k, v in got.items()} == {"ok": (1, None), "fenced": (1, None), "no_amount": (1, "no_amount"), "no_direction": (1, "no_direction"), "no_date": (1, "no_date"), "many": (80, None)}
    r = got["ok"][0]
    assert (r.amount, r.kind, r.fee, r.balance, r.date, r.time, r.ref, r.counterparty, r.raw, r.confidence) == (5000, "received", None, 49, dt.date(2026, 7, 14), "09:05", "X1", None, "a b", 0.95)
    assert pages.read_payments(df.where("page_id = 'many'"), most=None).count() == 90
    assert {r.page_id: r.dropped for r in pages.decode_pages(df.withColumn("json", F.replace("json", F.lit("transactions"), F.lit("lines")))).collect() if r.dropped} == {"many": 10}


def test_small_functions(spark):
    assert column(spark, ["237612345678", "+237 6 12 34 56 78", "222334455", "12", "", None], "string", text.normalize_phone) == ["612345678", "612345678", "222334455", "12", "", None]
    assert column(spark, ["237612345678", "222334455", "322334455", "", None], "string", text.is_phone) == [True, True, False, False, False]
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    assert df.agg(numbers.quantile(F.col("v"), 0.25)).first()[0] == 1.5 and df.where("v > 9").agg(numbers.quantile(F.col("v"), 0.5)).first()[0] == 0.0
    d = spark.createDataFrame([(TODAY, TODAY), (TODAY, TODAY + dt.timedelta(days=2)), (TODAY, TODAY - dt.timedelta(days=1)), (None, TODAY)], "a date, b date")
    assert [len(r[0]) if r[0] is not None else None for r in d.select(dates.each_day(F.col("a"), F.col("b"))).collect()] == [1, 3, 0, None]


def test_profile_of_a_trader_without_records(spark):
    made = {n: spark.createDataFrame([], k) for n, k in {
        "entries": ENTRY, "sources": "id string, trader_id string, kind string, status string, duplicate_kept boolean, confirmed_at timestamp", "events": "trader_id string, type string, cross_trader boolean", "totals": "source_id string, type string, date date, amount long",
        "payments": "id string, ord int, trader_id string, direction string, kind string, amount long, date date, time string, ref string, raw string",
    }.items()}
    r = profile.build_profile(spark.createDataFrame([("t",)], "trader_id string"), **made).first()
    assert (r.start, r.sales, r.avg_weekly, r.trend, r.entries_counted, r.momo, r.score, r.grade, r.consistency, r.basis) == (None, 0, 0, None, 0, 0, 0, "thin", 0.5, "none")


def test_share_code(spark):
    assert column(spark, ["tr-ab12-cd34", "AB12 CD34", "x", None], "string", text.normalize_share_code) == ["TR-AB12-CD34", "TR-AB12-CD34", None, None]
    t = spark.createDataFrame([("1", (True, "TR-AB12-CD34")), ("2", (False, "TR-AB12-CD34"))], "id string, consent struct<granted: boolean, code: string>")
    assert [r.id for r in privacy.find_shared(t, "ab12cd34").collect()] == ["1"]


def test_stream_drops_repeats(spark, tmp_path):
    from cowrie.streaming.messages import read_payments

    kind = "trader_id string, raw string, today date, received_at timestamp"
    one = "You have received 500 XAF on 2026-07-14 10:00"
    spark.createDataFrame([("t", one, TODAY, dt.datetime(2026, 7, 14, 10)), ("t", one, TODAY, dt.datetime(2026, 7, 14, 11)), ("u", one, TODAY, dt.datetime(2026, 7, 14, 11))], kind).write.parquet(f"{tmp_path}/in")
    q = read_payments(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.trader_id for r in spark.table("seen").collect()) == ["t", "u"]


def test_json_database(spark, tmp_path):
    from cowrie.sources.tables import read_database

    (tmp_path / "db.json").write_text('{"version": 1, "traders": [{"id": "tr_1", "name": "Awa", "consent": {"granted": true}}], "entries": [{"id": "en_1", "amount": 5, "date": "2026-07-01", "flags": ["x"]}]}')
    got = read_database(spark, str(tmp_path / "db.json"))
    assert got["traders"].first().consent.granted and got["entries"].first().amount == 5 and got["payments"].count() == 0


def test_message_ingest(spark):
    one, two = "You have received 500 XAF on 2026-07-14 10:00. Ref AB1234", "You have sent 700 XAF on 2026-07-15"
    pasted = spark.createDataFrame([("t", "s1", f"{one}\n\n{two}\n\nhello", TODAY), ("t", "s2", two, TODAY), ("u", "s3", one, TODAY), ("u", "s4", "nothing here", TODAY)], "trader_id string, source_id string, text string, today date")
    have = spark.createDataFrame([("m0", "t", 0, "ab1234", "10:00", "in", 500, dt.date(2026, 7, 14), "x")], "id string, trader_id string, ord int, ref string, time string, direction string, amount long, date date, raw string")
    got = {r.id: (r.trader_id, r.amount, r.duplicate_of) for r in messages.ingest_messages(pasted, have).collect()}
    assert got == {"s1-0": ("t", 500, "m0"), "s1-1": ("t", 700, None), "s2-0": ("t", 700, "s1-1"), "s3-0": ("u", 500, None)}
    assert sorted((r.reason, r.retry) for r in messages.unread(messages.parse_messages(messages.split_messages(pasted))).collect()) == [("no_amount", True), ("no_amount", True)]


def test_near_photos_with_a_hot_band(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(256) & ~(((1 << 64) - 1) << 128) for _ in range(40)]
    values = base + [b ^ sum(1 << rng.randrange(256) for _ in range(rng.randint(0, 16))) for b in base for _ in range(2)]
    hashes = [f"{v:064x}" for v in values]
    want = {}
    for i, v in enumerate(values):
        near = [(bin(v ^ w).count("1"), j) for j, w in enumerate(values[:i]) if bin(v ^ w).count("1") <= 14]
        if near:
            want[i] = min(near)[::-1]
    df = spark.createDataFrame([(i, i, h) for i, h in enumerate(hashes)], "id int, ord int, dhash string")
    for most in (3, 10**6):
        monkeypatch.setattr(duplicates, "CELL_ROWS", most)
        assert {r.id: (r.near_id, r.bits) for r in duplicates.near_duplicates(df).collect()} == want and len(want) > 20
    with pytest.raises(ValueError, match="fewer than 16 digits"):
        duplicates.near_duplicates(df.withColumn("dhash", F.lit("ffff")))


def test_contracts(spark):
    one = lambda f, *values: list(spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'string'}" for i, v in enumerate(values))).select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0])
    assert one(contracts.trader_issues, "Awa", "Foods", "Mokolo", "Yaoundé", "+237 612345678") == [] and one(contracts.trader_issues, " A ", "x" * 81, "Mokolo", None, "12") == ["name_short", "business_long", "city_short", "phone_invalid"]
    assert one(contracts.trader_issues, "Awa", "Foods", "Mokolo", "Douala", "") == []
    assert one(contracts.patch_issues, None, None, None, None, None) == ["empty_patch"] and one(contracts.patch_issues, "", None, 5.0, None, None) == []
    assert one(contracts.patch_issues, "soon", " ", 2.5, "gift", "gone") == ["date_invalid", "description_empty", "amount_whole", "type_unknown", "status_unknown"] and one(contracts.patch_issues, None, None, 6e7, None, None) == ["amount_large"]
    assert one(contracts.added_line_issues, "src_abc123", "2026-07-01", "Tomatoes", 5.0, "sale") == [] and one(contracts.added_line_issues, "p", "2026-02-31", "", 0.0, None) == ["source_invalid", "date_invalid", "description_empty", "amount_missing", "type_unknown"]
    assert one(contracts.messages_issues, "short") == ["messages_short"] and one(contracts.question_issues, "How much?", None) == [] and one(contracts.question_issues, "a", "de") == ["question_short", "locale_unknown"]
    assert one(contracts.consent_issues, True) == [] and one(contracts.distinct_issues, None) == ["source_invalid"] and "Kribi" in contracts.CITIES


def test_lists(spark):
    e = spark.createDataFrame([entry("1", seq=2), entry("2", seq=1), entry("3", status="rejected")], ENTRY)
    assert {r.id: r.place for r in views.page_view(e).collect()} == {"2": 1, "1": 2}
    assert [r.id for r in views.of_weekday(e, spark.createDataFrame([("t", TODAY.isoweekday())] * 2, "trader_id string, weekday int")).collect()] == ["1", "2", "3"]
    assert views.of_weekday(e, spark.createDataFrame([("t", TODAY.isoweekday() % 7 + 1)], "trader_id string, weekday int")).count() == 0
    asked = spark.createDataFrame([("t", "month", "2026-09")], "trader_id string, metric string, key string")
    assert sorted(r.id for r in views.lines_behind(profile.evidence(e), e, asked).collect()) == ["1", "2", "3"]
    hub = spark.createDataFrame([(True, True, False, False), (None, True, True, True), (True, True, True, True)], "consent boolean, capture boolean, review boolean, share boolean")
    assert [r.step for r in views.next_step(hub).collect()] == ["review", "consent", None]
    p = spark.createDataFrame([("a", 1, 5, None), ("b", 9, 5, AT), ("c", 4, 7, AT)], "trader_id string, score int, avg_weekly int, last_activity timestamp")
    assert [[r.trader_id for r in views.sorted_portfolio(p, by).collect()] for by in ("strength", "sales", "recent")] == [["b", "c", "a"], ["c", "a", "b"], ["b", "c", "a"]]
    pay = spark.createDataFrame([("t", dt.date(2026, 1, 2), "09:00", 1, "outflow", 5), ("t", dt.date(2026, 1, 2), None, 2, "inflow", 7), ("t", dt.date(2026, 1, 1), "10:00", 3, "inflow", 9)], "trader_id string, date date, time string, ord int, class string, amount long")
    assert {r.ord: r.place for r in views.payment_list(pay).collect()} == {3: 1, 2: 2, 1: 3}
    sums = views.payment_sums(pay, pay.where("class = 'inflow'").withColumn("matched", F.when(F.col("ord") == 3, "exact"))).first()
    assert (sums.paid_out, sums.unmatched) == (5, 7)
    days = profile.daily(spark.createDataFrame([("t", "x", dt.date(2026, 1, 1), "sale", 5), ("t", "y", dt.date(2026, 1, 3), "expense", 2)], "trader_id string, id string, date date, type string, amount long"))
    assert [(r.date.day, r.sales, r.expenses) for r in profile.calendar(days).orderBy("date").collect()] == [(1, 5, 0), (2, 0, 0), (3, 0, 2)]


def test_ids(spark):
    assert column(spark, ["src_0a1b2c", "en_" + "a" * 24, "en_" + "a" * 25, "src_0A1B2C", "src_0a1b2c\n", "x_aaaaaa", None], "string", text.is_id) == [True, True, False, False, False, False, False]
    assert column(spark, ["src_0a1b2c", "en_0a1b2c"], "string", lambda c: text.is_id(c, "src")) == [True, False]


def test_readings(spark):
    rows = [("1", "t", "pending", None, None), ("2", "t", "failed", "old", None), ("3", "t", "duplicate", None, None), ("4", "t", "read", None, AT), ("5", "t", "read", None, None)]
    pages_ = spark.createDataFrame(rows, "id string, trader_id string, status string, error string, confirmed_at timestamp")
    tried = spark.createDataFrame([("1", "timeout", None), ("2", None, 7), ("3", None, 1), ("4", None, 1), ("none", None, 1)], "source_id string, error string, lines int")
    after, events = changes.record_readings(pages_, tried)
    assert {r.id: (r.status, r.error) for r in after.collect()} == {"1": ("failed", "timeout"), "2": ("read", None), "3": ("duplicate", None), "4": ("read", None), "5": ("read", None)}
    assert {tuple(r) for r in events.collect()} == {("t", "1", "page_read_failed", "timeout"), ("t", "2", "page_read", "7")}


def test_photo_ingest(spark):
    near, far = "0" * 63 + "3", "f" * 64
    old = spark.createDataFrame([("o", 1, "t", "A", "0" * 64)], "id string, ord int, trader_id string, sha256 string, dhash string")
    rows = [
        ("1", 1, "t", "notebook", 5, "png", "A", far, "n"), ("2", 2, "u", "receipt", 5, "png", "B", near, "n" * 130), ("3", 3, "u", "receipt", 5, "png", "B", far, None), ("4", 4, "t", None, 5, "png", "C", far, "n"),
        ("5", 5, "t", "receipt", 99 << 20, "png", "D", far, "n"), ("6", 6, "t", "receipt", 5, None, "E", far, "n"), ("7", 7, "t", "receipt", 5, "png", "F", "short", "n"), ("8", 8, "t", "receipt", 5, "png", None, far, "n"), ("9", 9, "t", "receipt", 5, "png", None, far, "n"),
    ]
    new = spark.createDataFrame(rows, "id string, ord int, trader_id string, kind string, bytes long, mime string, sha256 string, dhash string, name string")
    done = photos.ingest_photos(new, old)
    got = {r.id: (r.problem, r.status, r.duplicate_of, r.cross_trader, r.distance) for r in done.collect()}
    assert got == {
        "1": ("duplicate_photo", None, "o", False, 0), "2": (None, "duplicate", "o", True, 2), "3": ("duplicate_photo", None, "2", False, 0), "4": ("invalid_input", None, None, None, None), "5": ("image_too_large", None, None, None, None),
        "6": ("image_invalid", None, None, None, None), "7": (None, "pending", None, None, None), "8": (None, "pending", None, None, None), "9": (None, "duplicate", "8", False, 0),
    }
    events = [tuple(r) for r in photos.photo_events(done).orderBy("type", "source_id", "of").collect()]
    assert events == [
        ("u", "2", "photo_added", None, None, None), ("t", "7", "photo_added", None, None, None), ("t", "8", "photo_added", None, None, None), ("t", "9", "photo_added", None, None, None),
        ("u", None, "photo_duplicate_blocked", "2", False, 0), ("t", None, "photo_duplicate_blocked", "o", False, 0), ("u", "2", "photo_duplicate_flagged", "o", True, 2), ("t", "9", "photo_duplicate_flagged", "8", False, 0),
    ]
    assert photos.ingest_photos(new.limit(0), old.limit(0)).collect() == []


def plain_overlaps(pages_, told):
    """Pairs (earlier, later, matches) of pages {number: keys in order} and the repeated lines {(page, place): earliest page}."""
    from collections import Counter

    pairs, again = {}, {}
    for later in sorted(p for p in pages_ if len(pages_[p]) >= 3):
        for earlier in sorted(p for p in pages_ if len(pages_[p]) >= 3 and p < later):
            if (earlier, later) in told or (later, earlier) in told:
                continue
            left, hit = Counter(pages_[earlier]), []
            for i, k in enumerate(pages_[later]):
                if left[k] > 0:
                    left[k] -= 1
                    hit.append(i)
            if len(hit) >= 3 and len(hit) >= 0.6 * min(len(pages_[earlier]), len(pages_[later])):
                pairs[earlier, later] = len(hit)
                for i in hit:
                    again.setdefault((later, i), earlier)
    return pairs, again


@pytest.mark.parametrize("seed", range(4))
def test_repeated_lines_with_told_apart_pages(spark, seed):
    rng = random.Random(seed)
    pages_ = {p: [rng.choice("abcde") for _ in range(rng.randrange(1, 8))] for p in range(20)}
    for p in range(20, 45):  # copies and near copies
        pages_[p] = list(pages_[rng.randrange(20)])
        rng.shuffle(pages_[p])
        if rng.random() < 0.4:
            pages_[p].append(rng.choice("abcdez"))
    told = {(rng.randrange(45), rng.randrange(45)) for _ in range(60)} | {(p, p + 1) for p in range(20, 40, 3)}
    told = {(a, b) for a, b in told if a != b}
    df = spark.createDataFrame([("t", p, p, f"{p}#{i}", i, k) for p, ks in pages_.items() for i, k in enumerate(ks)], "trader_id string, source_id int, page_ord int, id string, line_ord int, key string")
    pairs = spark.createDataFrame(sorted(told), "a int, b int")
    want_pairs, want = plain_overlaps(pages_, told)
    got = {r.id: r.earlier for r in duplicates.repeated_lines(df, pairs).collect()}
    assert got == {f"{p}#{i}": e for (p, i), e in want.items()} and want
    found = {(r.earlier, r.later): r.matches for r in duplicates.repeated_pages(df, pairs).collect()}
    assert found.items() <= want_pairs.items()
    # what is not reported follows through a class: equal pages that are told apart from nothing
    named = {p for pair in told for p in pair}
    first = {p: p if p in named else min(q for q in pages_ if q not in named and sorted(pages_[q]) == sorted(pages_[p])) for p in pages_}
    assert {frozenset((first[a], first[b])) for a, b in found} | {frozenset((a, b)) for a, b in found} >= {frozenset((first[a], first[b])) for a, b in want_pairs if first[a] != first[b]}
    assert {(first[b], b) for a, b in want_pairs if first[a] == first[b]} == {(a, b) for a, b in found if first[a] == first[b]}


def test_three_equal_pages_two_pairs_told_apart(spark):
    df = spark.createDataFrame([("t", p, i, f"{p}{j}", j, k) for i, p in enumerate("ABC") for j, k in enumerate("xyz")], "trader_id string, source_id string, page_ord int, id string, line_ord int, key string")
    told = spark.createDataFrame([("A", "B"), ("C", "A")], "a string, b string")
    assert [(r.earlier, r.later) for r in duplicates.repeated_pages(df, told).collect()] == [("B", "C")]
    assert {(r.id, r.earlier) for r in duplicates.repeated_lines(df, told).collect()} == {("C0", "B"), ("C1", "B"), ("C2", "B")}
    assert duplicates.repeated_lines(df.limit(0), told).count() == 0


def test_page_lines_leave_out_what_cannot_repeat(spark):
    entries = spark.createDataFrame([("a", "t", "p", 1, "pending", TODAY, "sale", 5, "2 Rices"), ("b", "t", "p", 2, "rejected", TODAY, "sale", 5, "rice"), ("c", "t", "p", 3, "confirmed", None, "sale", 5, "rice"), ("d", "t", "p", 4, "confirmed", TODAY, "sale", 0, "rice")], "id string, trader_id string, source_id string, seq int, status string, date date, type string, amount long, description string")
    sources = spark.createDataFrame([("p", 7)], "id string, created_at int")
    got = duplicates.page_lines(entries, sources).collect()
    assert [(r.id, r.page_ord, r.line_ord, r.key) for r in got] == [("a", 7, 1, f"{TODAY}|sale|5|rice")]


LINES = "trader_id string, source_id int, page_ord int, id string, line_ord int, key string"


def test_a_short_page_repeats_a_long_one(spark):
    long = [f"own{i}" for i in range(20)] + ["x", "y", "z"]
    pages_ = {1: long, 2: ["x", "y", "z", "w"], 3: [f"more{i}" for i in range(20)] + ["x", "y", "w"]}
    df = spark.createDataFrame([("t", p, p, f"{p}#{i}", i, k) for p, ks in pages_.items() for i, k in enumerate(ks)], LINES)
    want, again = plain_overlaps(pages_, set())
    assert {(r.earlier, r.later): r.matches for r in duplicates.repeated_pages(df).collect()} == want == {(1, 2): 3, (2, 3): 3}
    assert {r.id: r.earlier for r in duplicates.repeated_lines(df).collect()} == {f"{p}#{i}": e for (p, i), e in again.items()}


@pytest.mark.parametrize(("seed", "block"), [(0, 1000), (1, 2), (2, 1)])
def test_every_pair_of_pages_that_overlap(spark, monkeypatch, seed, block):
    monkeypatch.setattr(duplicates, "BLOCK_PAGES", block)
    rng = random.Random(seed)
    pages_ = {p: [rng.choice("abcdefghijkl") for _ in range(rng.choice([2, 4, 5, 30]))] for p in range(20)}
    for p in range(20, 50):  # copies and near copies
        pages_[p] = rng.sample(pages_[p % 6], len(pages_[p % 6])) + ["abcz"[p % 4]] * (rng.random() < 0.3)
    told = {(a, b) for a, b in ((rng.randrange(50), rng.randrange(50)) for _ in range(20)) if a != b}
    df = spark.createDataFrame([("t", p, p, f"{p}#{i}", i, k) for p, ks in pages_.items() for i, k in enumerate(ks)], LINES)
    got = [(r.earlier, r.later, r.matches) for r in duplicates.overlapping_pages(df, spark.createDataFrame(sorted(told), "a int, b int")).collect()]
    want = plain_overlaps(pages_, told)[0]
    assert sorted(got) == sorted((a, b, n) for (a, b), n in want.items()) and want


def test_overlaps_to_review_name_every_pair_of_equal_pages(spark):
    entries = spark.createDataFrame([(f"{p}{i}", "t", p, i, "confirmed", TODAY, "sale", 5 + i, "rice") for p in "pqrs" for i in range(3)], "id string, trader_id string, source_id string, seq int, status string, date date, type string, amount long, description string")
    sources = spark.createDataFrame([(p, "t", "notebook", "read", False, i, None) for i, p in enumerate("pqrs")], "id string, trader_id string, kind string, status string, duplicate_kept boolean, created_at int, page_date date")
    got = {(r.earlier, r.later) for r in views.review_overlaps(sources, entries).collect()}
    assert got == {("p", "q"), ("p", "r"), ("p", "s"), ("q", "r"), ("q", "s"), ("r", "s")}


def test_lines_of_documents_lose_spaces_of_every_kind(spark, tmp_path):
    from cowrie.sources import adapters

    spark.createDataFrame([(1, "s", "\u00a0 a b\u3000\n\u2003\n\tc \r\nd")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.key for r in adapters.page_lines(spark, str(tmp_path)).orderBy("line_ord").collect()] == ["a b", "\tc \r", "d"]
