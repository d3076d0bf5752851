"""Reader output (JSON of a page) as validated ledger lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cowrie.functions.dates import as_date, resolve_date
from cowrie.functions.numbers import half_up, normalize_box, normalize_confidence, parse_amount
from cowrie.functions.text import collapse_spaces

# Limits of the validation.
MAX_LINES, MAX_AMOUNT, REVIEW_BELOW, MAX_AGE = 80, 5_000_000, 0.8, 400
BLOCKING = ("date_missing", "amount_missing", "date_out_of_range")
ATTENTION = ("low_confidence", "date_missing", "date_out_of_range", "amount_missing", "amount_computed", "math_mismatch", "unusual_amount")
LIVE = BLOCKING

TEXTS = {"rawText": "", "kind": "other", "description": "", "date": "", "dateText": "", "unit": ""}
NUMBERS = ("quantity", "unitPrice", "amount", "confidence")
# Fields of a transaction, and kinds of money movements.
PAYMENT_TEXTS = ("rawText", "direction", "kind", "date", "dateText", "time", "ref", "counterparty", "provider")
PAYMENT_NUMBERS = ("amount", "fee", "balance", "confidence")
PAYMENT_KINDS = ("received", "payment_in", "deposit", "sent", "payment_out", "withdrawal")


def strip_fences(text: Column) -> Column:
    """Model text without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def _text(v: Column, path: str, default: str) -> Column:
    """A string field; other types and absent fields give the default."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.lit(default))


def _number(v: Column, path: str) -> Column:
    """A number, or a text that reads as an amount or number; else 0."""
    text = F.try_variant_get(v, path, "string")
    return F.coalesce(F.try_variant_get(v, path, "double"), parse_amount(text).cast("double"), F.translate(text, ",", ".").try_cast("double"), F.lit(0.0))


def _decode(df: DataFrame, json: str, field: str, most: int | None) -> DataFrame:
    """Append ``cowrie_v`` (the document), ``readable``, ``lines`` (the variants of a list field) and ``dropped``.

    Explode ``lines`` by the outer form: Spark derives a filter from the other one, for which each document is parsed again.
    """
    own, none = F.col("cowrie_v"), F.array().cast("array<variant>")
    t = df.withColumn("cowrie_v", F.try_parse_json(strip_fences(F.col(json))))
    t = t.withColumn("readable", F.coalesce(F.schema_of_variant(own).startswith("OBJECT"), F.lit(False)))
    listed = F.coalesce(F.try_variant_get(own, f"$.{field}", "array<variant>"), none)
    sound = F.forall(listed, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    t = t.withColumn("lines", F.when(F.col("readable") & sound, listed).otherwise(none))
    if most is None:
        return t.withColumn("dropped", F.lit(0))
    return t.withColumn("dropped", F.greatest(F.size("lines") - most, F.lit(0))).withColumn("lines", F.slice("lines", 1, most))


def decode_pages(df: DataFrame, json: str = "json", most: int | None = MAX_LINES) -> DataFrame:
    """Append ``readable``, ``page_date_text``, ``page_date_guess``, ``lines`` (variants) and ``dropped``.

    Text that is not a JSON object is not readable and has no lines. A field of
    the wrong type takes its default; one line that is not an object empties
    the list. At most ``most`` lines of a page are kept, as readers are told to
    write (null: all); ``dropped`` counts the others.
    """
    own = F.col("cowrie_v")
    t = _decode(df, json, "lines", most)
    return t.withColumn("page_date_text", _text(own, "$.pageDateText", "")).withColumn("page_date_guess", _text(own, "$.pageDate", "")).drop("cowrie_v")


def reading_limits(pages: DataFrame, field: str = "lines", page: str = "page_id", json: str = "json", most: int | None = MAX_LINES) -> DataFrame:
    """(page_id, readable, lines, dropped) of every page: how many entries of its list are read, and how many are beyond ``most``.

    ``field`` is ``lines`` for notebooks and ``transactions`` for payment screens.
    """
    return _decode(pages, json, field, most).select(F.col(page).alias("page_id"), "readable", F.size("lines").alias("lines"), "dropped")


def read_payments(screens: DataFrame, page: str = "page_id", json: str = "json", today: str = "today", most: int | None = MAX_LINES) -> DataFrame:
    """Every transaction of reader output about mobile-money screens, and why one cannot be used.

    With ``most`` a screen gives its first ones only, null takes all of them.
    ``reason`` is no_amount, no_direction or no_date, tried in this order, null
    for a sound one. A kind that is not known follows from the direction; values
    outside a field's list count as unknown; fees and balances that are not
    positive, empty references and ill-formed times are null.
    """
    t = _decode(screens, json, "transactions", most).select(F.col(page).alias("page_id"), as_date(F.col(today)).alias("today"), F.posexplode_outer("lines").alias("pos", "v")).where("pos IS NOT NULL")
    v = F.col("v")
    t = t.withColumns({f"v_{k}": _text(v, f"$.{k}", "") for k in PAYMENT_TEXTS} | {f"v_{k}": _number(v, f"$.{k}") for k in PAYMENT_NUMBERS} | {"box": normalize_box(F.try_variant_get(v, "$.box", "array<double>"))})
    one_of = lambda c, known: F.when(F.col(c).isin(*known), F.col(c)).otherwise(F.lit("unknown"))
    t = t.withColumn("direction", one_of("v_direction", ("in", "out"))).withColumn("v_kind", one_of("v_kind", PAYMENT_KINDS)).withColumn("provider", one_of("v_provider", ("mtn", "orange")))
    t = t.withColumn("amount", half_up(F.col("v_amount"))).withColumn("date", resolve_date(F.col("v_dateText"), F.col("v_date"), F.col("today")))
    reason = F.when(F.col("amount") <= 0, "no_amount").when(F.col("direction") == "unknown", "no_direction").when(F.col("date").isNull(), "no_date")
    positive = lambda c: F.when(F.col(c) > 0, half_up(F.col(c)))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    time = F.when(F.trim("v_time").rlike(r"^\d{1,2}:\d{2}$"), F.lpad(F.trim("v_time"), 5, "0"))
    kind = F.when(F.col("v_kind") != "unknown", F.col("v_kind")).when(F.col("direction") == "in", "received").when(F.col("direction") == "out", "sent").otherwise("unknown")
    return t.select(
        "page_id", "pos", reason.alias("reason"), "provider", "direction", kind.alias("kind"), "amount", positive("v_fee").alias("fee"), positive("v_balance").alias("balance"), "date", time.alias("time"),
        F.upper(filled("v_ref")).alias("ref"), filled("v_counterparty").alias("counterparty"), F.left(collapse_spaces(F.col("v_rawText")), F.lit(400)).alias("raw"), "box", normalize_confidence(F.col("v_confidence")).alias("confidence"),
    )


def date_flags(date: Column, today: Column) -> Column:
    age = F.datediff(today, date)
    return F.when(date.isNull(), F.array(F.lit("date_missing"))).when((age < -1) | (age > MAX_AGE), F.array(F.lit("date_out_of_range"))).otherwise(F.array().cast("array<string>"))


def live_flags(flags: Column, date: Column, amount: Column, today: Column) -> Column:
    """Stored flags with the date and amount checked anew."""
    stable = F.array_except(flags, F.array(*[F.lit(x) for x in LIVE]))
    return F.concat(stable, date_flags(date, today), F.when(amount <= 0, F.array(F.lit("amount_missing"))).otherwise(F.array().cast("array<string>")))


def blocking_issues(status: Column, flags: Column, date: Column, amount: Column, today: Column) -> Column:
    live = F.array_intersect(live_flags(flags, date, amount, today), F.array(*[F.lit(x) for x in BLOCKING]))
    return F.when(status == "rejected", F.array().cast("array<string>")).otherwise(live)


def needs_attention(status: Column, flags: Column, date: Column, amount: Column, today: Column) -> Column:
    return (status == "pending") & F.arrays_overlap(live_flags(flags, date, amount, today), F.array(*[F.lit(x) for x in ATTENTION]))


def read_lines(pages: DataFrame, page: str = "page_id", json: str = "json", today: str = "today", most: int | None = MAX_LINES) -> DataFrame:
    """Every line of every page with its resolved date, amount and ``role`` (header, total, entry or other).

    ``date`` is the last date written at or above the line, else the page's.
    """
    decoded = decode_pages(pages, json, most)
    now = F.col("today")
    dated = decoded.select(F.col(page).alias("page_id"), as_date(F.col(today)).alias("today"), "page_date_text", "page_date_guess", "lines")
    dated = dated.withColumn("page_date", resolve_date(F.col("page_date_text"), F.col("page_date_guess"), now))
    t = dated.select("page_id", "today", "page_date", F.posexplode_outer("lines").alias("pos", "v")).where("pos IS NOT NULL")
    v = F.col("v")
    t = t.withColumns({f"v_{k}": _text(v, f"$.{k}", d) for k, d in TEXTS.items()} | {f"v_{k}": _number(v, f"$.{k}") for k in NUMBERS} | {"box": normalize_box(F.try_variant_get(v, "$.box", "array<double>"))})
    t = t.withColumn("line_date", resolve_date(F.col("v_dateText"), F.col("v_date"), now)).withColumn("value", half_up(F.col("v_amount")))
    above = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("date", F.coalesce(F.last("line_date", ignorenulls=True).over(above), "page_date"))
    kind = F.col("v_kind")
    header = (kind == "date_header") | ((kind == "other") & (F.col("value") <= 0) & F.col("line_date").isNotNull())
    role = F.when(header, "header").when(kind.isin("total_sales", "total_expenses"), "total").when(kind.isin("sale", "expense"), "entry").otherwise("other")
    label = F.left(collapse_spaces(F.when(F.col("v_description") != "", F.col("v_description")).otherwise(F.col("v_rawText"))), F.lit(120))
    return t.withColumn("role", role).withColumn("label", label).drop("v")


def written_totals(lines: DataFrame) -> DataFrame:
    kind = F.when(F.col("v_kind") == "total_sales", "sale").otherwise("expense")
    label = F.when(F.col("label") != "", F.col("label")).otherwise(F.lit("Total"))
    return lines.where("role = 'total' and value > 0").select("page_id", "pos", label.alias("label"), F.col("value").alias("amount"), kind.alias("type"), "date", "box")


def page_entries(lines: DataFrame) -> DataFrame:
    """Sale and expense lines with computed amounts, flags in order and capped confidence; ``seq`` counts survivors."""
    e = lines.where("role = 'entry'")
    quantity, price = F.when(F.col("v_quantity") > 0, F.col("v_quantity")), F.when(F.col("v_unitPrice") > 0, half_up(F.col("v_unitPrice")))
    e = e.withColumn("quantity", quantity).withColumn("unit_price", price).withColumn("expected", F.col("quantity") * F.col("unit_price"))
    computed = (F.col("value") <= 0) & F.col("expected").isNotNull()
    e = e.withColumn("computed", computed).withColumn("amount", F.when(computed, half_up(F.col("expected"))).otherwise(F.greatest(F.col("value"), F.lit(0))))
    a = F.col("amount")
    marks = {
        "amount_computed": F.col("computed"),
        "amount_missing": a <= 0,
        "math_mismatch": F.coalesce((a > 0) & ~F.col("computed") & (F.abs(F.col("expected") - a) > F.greatest(F.lit(5.0), a * 0.02)), F.lit(False)),
        "unusual_amount": (a > 0) & ((a % 5 != 0) | (a > MAX_AMOUNT)),
    }
    flags = F.concat(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in marks.items()])), date_flags(F.col("date"), F.col("today")))
    e = e.withColumn("flags", flags)
    has = lambda *names: F.arrays_overlap("flags", F.array(*[F.lit(n) for n in names]))
    cap = lambda cond, most: F.when(cond, F.lit(most))
    low = F.least(normalize_confidence(F.col("v_confidence")), cap(has("math_mismatch"), 0.6), cap(has("unusual_amount"), 0.7), cap(has("amount_computed"), 0.85), cap(has("date_missing", "amount_missing"), 0.5))
    e = e.withColumn("confidence", low).withColumn("flags", F.when(F.col("confidence") < REVIEW_BELOW, F.array_append("flags", F.lit("low_confidence"))).otherwise(F.col("flags")))
    seq = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    described = F.when(F.col("label") != "", F.col("label")).otherwise(F.lit("?"))
    return e.select("page_id", seq.alias("seq"), "date", described.alias("description"), "amount", F.col("v_kind").alias("type"), "quantity", F.nullif(F.trim("v_unit"), F.lit("")).alias("unit"), "unit_price", F.left(collapse_spaces(F.col("v_rawText")), F.lit(200)).alias("raw"), "box", "confidence", "flags")


def reading_quality(entries: DataFrame, failed_totals: DataFrame, pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(page_id, unsure, lines, totals_ok, empty, score, second_opinion) of every page; a lower score is better.

    ``failed_totals`` has the page_id of each written total that disagrees.
    """
    per = entries.groupBy("page_id").agg(F.count("*").alias("lines"), F.count_if(F.col("confidence") < REVIEW_BELOW).alias("unsure"))
    bad = failed_totals.select("page_id", F.lit(True).alias("bad")).distinct()
    q = pages.select(F.col(page).alias("page_id")).distinct().join(per, "page_id", "left").join(bad, "page_id", "left").na.fill(0, ["lines", "unsure"])
    q = q.withColumn("totals_ok", F.col("bad").isNull()).withColumn("empty", F.col("lines") == 0).drop("bad")
    score = F.col("unsure") + F.when(F.col("totals_ok"), 0).otherwise(3) + F.when(F.col("empty"), 5).otherwise(0)
    return q.withColumn("score", score).withColumn("second_opinion", F.col("empty") | ~F.col("totals_ok") | (F.col("unsure") > F.col("lines") * 0.25))


def best_reading(readings: DataFrame) -> DataFrame:
    """Of each page's attempts the one with the lowest score, the earliest on ties."""
    first = Window.partitionBy("page_id").orderBy("score", "attempt")
    return readings.withColumn("cowrie_rn", F.row_number().over(first)).where("cowrie_rn = 1").drop("cowrie_rn")
