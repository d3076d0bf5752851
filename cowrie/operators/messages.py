"""Mobile-money messages: split pasted blocks and read fields by rules, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cowrie.functions.dates import written_date
from cowrie.functions.numbers import half_up
from cowrie.functions.text import collapse_spaces, strip_accents
from cowrie.operators.duplicates import mark_payment_duplicates

# Phrases of the direction rules, in the order in which they are tried.
RULES = (
    (r"(recu un depot|depot de|depot effectue|deposit of|cash[ -]?in)", "in", "deposit"),
    (r"(retrait de|retrait effectue|withdrawal of|you have withdrawn|cash[ -]?out)", "out", "withdrawal"),
    (r"(paiement recu|payment received|received a payment|recu un paiement)", "in", "payment_in"),
    (r"(vous avez recu|you have received|recu de|received from|transfert recu|transfer received|a ete credite|credite de|been credited|credited with)", "in", "received"),
    (r"(vous avez paye|you have paid|paid to|paiement de|payment of|paiement effectue|payment made|achat de)", "out", "payment_out"),
    (r"(vous avez envoye|you have sent|envoye a|sent to|vous avez transfere|transfere a|transferred to|transfer to|transfert de [\d .,]+\s*(?:f\s?cfa|fcfa|xaf|cfa|f)?\s*vers|a ete debite|debite de|been debited|debited)", "out", "sent"),
)
# Patterns of the fields.
AMOUNT = r"(?i)(?:\b(fcfa|xaf|cfa)\s*)?(\d{1,3}(?:[ .,]\d{3})+|\d+)(?:[.,]\d{1,2})?\s*(f\s?cfa|fcfa|xaf|cfa|frs?|f)?(?![a-z0-9])"
BALANCE_BEFORE = r"(solde|balance|bal\.?)\s*(disponible|actuel|available|new|nouveau)?\s*(est de|is|de)?\s*[:=]?\s*$"
FEE_BEFORE = r"(frais|fees?|charges?|commission|taxes?|tax)\s*(de|of)?\s*[:=]?\s*$"
ORANGE, MTN = r"orange\s*money|\borange\b|\bom\b", r"\bmtn\b|\bmomo\b|mobile\s*money"
DATE_ISO = r"(\d{4}-\d{2}-\d{2})(?:[ T](\d{1,2}):(\d{2}))?"
DATE_DMY = r"(?i)(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})(?:\s*(?:a|at|,|-)?\s*(\d{1,2})[:h](\d{2}))?"
REFERENCE = r"(?i)(?:trans(?:action)?\s*id|txn\s*id|id\s*(?:de\s*)?(?:la\s*)?transaction|ref(?:erence)?|\bid)\s*[:#.]?\s*([a-z0-9][a-z0-9.\-]{5,})"
PHONES = (r"\(?\+?237\)?[\s.]?(6\d{8})\b", r"\((6\d{8})\)")
NAME = r"\b(?:de|from|a|to|vers|par|by)\s+(?:\(?\+?237\)?\s?\d{9}\)?\s+)?([A-Z][A-Za-z'\-]*\.?(?:\s+[A-Z][A-Za-z'\-]*\.?){0,3})"
NAME_STOP = ("FCFA", "XAF", "CFA", "MTN", "MOMO", "ORANGE", "OM", "ID", "REF", "SOLDE", "BALANCE")

_A, _B, _C = "\u0001", "\u0002", "\u0003"


def amounts_of(norm: Column) -> Column:
    """Array of (value, role) of the amounts with a currency, in text order; role is main, fee or balance."""
    parts = F.split(F.regexp_replace(norm, AMOUNT, f"{_A}$1{_B}$2{_B}$3{_C}"), _A)
    after = lambda part: F.element_at(F.split(part, _C), -1)

    def one(part: Column, i: Column) -> Column:
        fields = F.split(F.element_at(F.split(part, _C), 1), _B)
        before = F.lower(F.right(after(F.get(parts, i)), F.lit(32)))
        role = F.when(before.rlike(BALANCE_BEFORE), "balance").when(before.rlike(FEE_BEFORE), "fee").otherwise("main")
        value = F.regexp_replace(F.get(fields, F.lit(1)), "[ .,]", "").try_cast("long")
        marked = (F.get(fields, F.lit(0)) != "") | (F.get(fields, F.lit(2)) != "")
        return F.struct(F.when(marked, value).alias("value"), role.alias("role"))

    found = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.filter(found, lambda a: a["value"] > 0)


def _first(amounts: Column, role: str) -> Column:
    return F.get(F.filter(amounts, lambda a: a["role"] == role), F.lit(0))["value"]


def _rule(lower: Column) -> Column:
    """Number of the first rule that a text fits, from 1; null if none."""
    out = F
    for i, rule in enumerate(RULES):
        out = out.when(lower.rlike(rule[0]), F.lit(i + 1))
    return out


def _says(rule: Column, at: int) -> Column:
    """What the numbered rule says about direction (1) or kind (2)."""
    return F.get(F.array(*[F.lit(r[at]) for r in RULES]), rule - 1)


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_messages(df: DataFrame, raw: str = "raw", today: str = "today") -> DataFrame:
    """Append ``ok``, ``reason``, the fields of the message, ``text`` and ``confidence``.

    The first check that fails (amount, direction, date) is the reason, and then
    the fields are null. A null message fails as ``no_amount``. Other columns pass;
    columns of the new names are replaced. ``today`` is a date column.
    """
    # each step is inlined from a one-element array: its results are columns, so no expression is repeated in later ones
    step = lambda df, made: df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))
    fields = ("text", "direction", "kind", "amount", "fee", "balance", "date", "time", "provider", "ref", "counterparty", "phone", "reason", "ok", "confidence")
    t = df.select("*", F.col(raw).alias("cowrie_raw"), F.col(today).alias("cowrie_today")).drop(*[c for c in fields if c in df.columns])
    t = step(t, {"text": collapse_spaces(F.coalesce("cowrie_raw", F.lit("")))})
    t = step(t, {"cowrie_norm": strip_accents(F.col("text"))})
    norm = F.col("cowrie_norm")
    lower, now = F.col("cowrie_lower"), F.col("cowrie_today")
    t = step(t, {"cowrie_lower": F.lower(norm), "cowrie_amounts": amounts_of(norm), "cowrie_iso": F.regexp_extract(norm, DATE_ISO, 0), "cowrie_dmy": F.regexp_extract(norm, DATE_DMY, 0)})
    a, iso, written = F.col("cowrie_amounts"), F.col("cowrie_iso"), F.col("cowrie_dmy")
    # the whole text is searched once for each shape; its parts are read off what was found
    dmy = [F.regexp_extract(written, DATE_DMY, i) for i in range(6)]
    year = F.when(F.length(dmy[3]) != 3, dmy[3].try_cast("int"))
    day = F.when(written != "", F.struct(year.alias("y"), dmy[2].try_cast("int").alias("m"), dmy[1].try_cast("int").alias("d"), F.lit(True).alias("open")))
    t = step(t, {"cowrie_rule": _rule(lower), "cowrie_iso_date": F.when(iso != "", F.left(iso, F.lit(10)).try_cast("date")), "cowrie_day": day})
    iso_date, dmy_date = F.col("cowrie_iso_date"), written_date(F.col("cowrie_day"), now)
    clock = lambda h, m: F.when(h != "", F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))
    time = F.when(iso_date.isNotNull(), clock(F.regexp_extract(iso, DATE_ISO, 2), F.regexp_extract(iso, DATE_ISO, 3))).when(written != "", clock(dmy[4], dmy[5]))
    names = F.filter(
        F.transform(F.regexp_extract_all(norm, F.lit(NAME), F.lit(1)), lambda n: F.trim(n)),
        lambda n: ~F.upper(F.regexp_replace(F.get(F.split(n, r"\s+"), F.lit(0)), r"\.$", "")).isin(*NAME_STOP) & F.length(n).between(2, 40),
    )
    made = {
        "direction": _says(F.col("cowrie_rule"), 1),
        "kind": _says(F.col("cowrie_rule"), 2),
        "amount": _first(a, "main"),
        "fee": _first(a, "fee"),
        "balance": _first(a, "balance"),
        "date": F.coalesce(iso_date, dmy_date),
        "time": time,
        "provider": F.when(lower.rlike(ORANGE), "orange").when(lower.rlike(MTN), "mtn").otherwise("unknown"),
        "ref": _or_null(F.upper(F.regexp_replace(F.regexp_extract(norm, REFERENCE, 1), r"[.\-]+$", ""))),
        "counterparty": F.get(names, F.lit(0)),
        "phone": F.coalesce(*[_or_null(F.regexp_extract(norm, p, 1)) for p in PHONES]),
    }
    t = step(t, made).drop("cowrie_raw", "cowrie_today", "cowrie_norm", "cowrie_lower", "cowrie_amounts", "cowrie_iso", "cowrie_dmy", "cowrie_rule", "cowrie_iso_date", "cowrie_day")
    reason = F.when(F.col("amount").isNull(), "no_amount").when(F.col("direction").isNull(), "no_direction").when(F.col("date").isNull(), "no_date")
    t = t.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
    score = 0.97 - F.when(F.col("ref").isNull(), 0.12).otherwise(0.0) - F.when(F.col("provider") == "unknown", 0.08).otherwise(0.0) - F.when(F.col("time").isNull(), 0.05).otherwise(0.0)
    t = t.withColumn("confidence", F.greatest(F.lit(0.6), half_up(score, 2)))
    return t.withColumns({c: F.when(F.col("ok"), F.col(c)) for c in [*made, "confidence"]})


def split_messages(df: DataFrame, text: str = "text", out: str = "raw", keep_order: bool = False) -> DataFrame:
    """One row per message of a pasted block; null and blank texts give none.

    Blank lines separate blocks. A block is split per line if it has several
    lines of which at least two and at least 60% are complete messages. With
    ``keep_order`` the columns cowrie_block_at and cowrie_line_at tell the place.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"))
    blocks = df.select("*", F.posexplode(F.split(clean, r"\n\s*\n+")).alias("cowrie_block_at", "cowrie_block"))
    lines = F.filter(F.transform(F.split("cowrie_block", "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def complete(line: Column) -> Column:
        norm = strip_accents(line)
        main = F.exists(amounts_of(norm), lambda a: a["role"] == "main")
        return main & _rule(F.lower(norm)).isNotNull()

    blocks = blocks.withColumn("cowrie_lines", lines)
    whole = F.size(F.filter("cowrie_lines", complete))
    n = F.size("cowrie_lines")
    each = (n > 1) & (whole >= 2) & (whole >= n * 0.6)
    joined = F.array(collapse_spaces(F.array_join("cowrie_lines", " ")))
    chosen = F.when(n == 0, F.array().cast("array<string>")).when(each, F.col("cowrie_lines")).otherwise(joined)
    return blocks.withColumn("cowrie_chosen", chosen).select(*[c for c in df.columns if c != out], *["cowrie_block_at"] * keep_order, *([F.posexplode("cowrie_chosen").alias("cowrie_line_at", out)] if keep_order else [F.explode("cowrie_chosen").alias(out)]))


def unread(parsed: DataFrame, raw: str = "raw") -> DataFrame:
    """Messages that could not be read, with their reason; ``retry`` marks those that another reader may still read."""
    return parsed.where("NOT ok").select(*[c for c in parsed.columns if c in ("trader_id", "id", raw, "reason")], (F.col("reason") != "no_date").alias("retry"))


def ingest_messages(pasted: DataFrame, payments: DataFrame) -> DataFrame:
    """Pasted texts (trader_id, source_id, text, today) as new payments: split, read, and marked as duplicates.

    ``duplicate_of`` names the first payment of the trader with the same key, among
    ``payments`` (id, trader_id, ord and the key's columns) or earlier in the paste.
    A text without any message that can be read adds nothing.
    """
    split = split_messages(pasted, keep_order=True)
    place = F.row_number().over(Window.partitionBy("trader_id", "source_id").orderBy("cowrie_block_at", "cowrie_line_at")) - 1
    split = split.withColumn("ord", place).drop("cowrie_block_at", "cowrie_line_at")
    new = parse_messages(split).where("ok").withColumn("id", F.concat_ws("-", "source_id", "ord"))
    keys = ["id", "trader_id", "ref", "time", "direction", "amount", "date", "raw"]
    both = payments.select(*keys, F.struct(F.lit(0).alias("batch"), F.lit("").alias("source"), F.col("ord").cast("long").alias("place")).alias("ord")).unionByName(
        new.select(*keys, F.struct(F.lit(1).alias("batch"), F.col("source_id").cast("string").alias("source"), F.col("ord").cast("long").alias("place")).alias("ord"))
    )
    marked = mark_payment_duplicates(both).where("ord.batch = 1").select("trader_id", "id", "duplicate_of")
    return new.join(marked, ["trader_id", "id"])
