"""The generic sales, event and document tables as ledger lines, payments, pages and photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cowrie.functions.numbers import half_up
from cowrie.functions.text import normalize_item
from cowrie.operators.duplicates import page_lines as page_lines_of
from cowrie.operators.duplicates import repeated_lines
from cowrie.sources.tables import stored_by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition that ``spread`` makes.
SPREAD_ROWS = 50_000


def spread(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """Rows that cost much more to compute than to move, dealt (by ``keys``, if any) to partitions of a bounded number of them, and to all cores; ``count`` is about how many there are."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // SPREAD_ROWS)), *keys)


def entries(spark: SparkSession, sf_dir: str, described: bool = False, items: bool = False) -> DataFrame:
    """Order lines as ledger lines of their supplier; with ``described``, the part's name as description, and with ``items`` the item that it tells, made once for each part."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), "rejected").when((F.col("l_linestatus") == "O") & F.col("l_linenumber").isin(5, 6), "pending").otherwise("confirmed")
    rows = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_suppkey").alias("trader_id"),
        F.col("l_orderkey").alias("source_id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_shipdate").cast("date").alias("date"),
        half_up(F.col("l_extendedprice")).alias("amount"),
        F.when(F.col("l_returnflag") == "R", "expense").otherwise("sale").alias("type"),
        status.alias("status"),
        F.col("l_partkey"),
        F.col("l_quantity").alias("quantity"),
    )
    if not described:
        return rows.drop("l_partkey")
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"))
    if items:
        names = spread(names, names.count()).withColumn("item", normalize_item(F.col("description")))
    return rows.join(names, "l_partkey").drop("l_partkey")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("trader_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "message").otherwise("notebook").alias("kind"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", "duplicate").when(F.col("o_orderstatus") == "F", "read").otherwise("pending").alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").alias("duplicate_kept"),
        F.lit(None).cast("date").alias("page_date"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks as sale lines of their user."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    e = e.select(F.col("user_id").alias("trader_id"), F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.col("ts").cast("date").alias("date"), half_up(F.col("value")).alias("amount"), F.lit("sale").alias("type"))
    return e.where("amount > 0")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, signups and errors as payments received, deposited and sent."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "signup", "error"))
    return e.select(
        F.col("user_id").alias("trader_id"),
        F.col("event_id").alias("id"),
        F.col("event_id").alias("ord"),
        F.when(F.col("event_type") == "error", "out").otherwise("in").alias("direction"),
        F.when(F.col("event_type") == "view", "received").when(F.col("event_type") == "signup", "deposit").otherwise("sent").alias("kind"),
        half_up(F.col("value")).alias("amount"),
        F.col("ts").cast("date").alias("date"),
        F.date_format("ts", "HH:mm").alias("time"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.when(F.col("event_id") % 2 == 0, "r-").otherwise("R-"), (F.col("event_id") % 40).cast("string"))).alias("ref"),
        F.col("props").alias("raw"),
    ).where("amount > 0")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in for photos with equal bytes."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("source").alias("trader_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def hashed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in groups of four whose hashes of 32 digits differ in their first digits only."""
    v, four = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 4
    start = F.when(four == 0, "000").when(four == 1, "001").when(four == 2, "03f").otherwise("fff")
    rest = F.substring(F.md5(F.floor(F.col("vec_id") / 4).cast("long").cast("string").cast("binary")), 4, 29)
    return v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.concat(start, rest).alias("dhash"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as the lines of pages."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"\A\p{Zs}+|\p{Zs}+\z", "")), lambda x: x != "")  # all kinds of spaces, as SQL's trim
    rows = d.select(F.coalesce("source", F.lit("")).alias("trader_id"), F.col("doc_id").alias("source_id"), F.col("doc_id").alias("page_ord"), F.posexplode(lines).alias("line_ord", "key"))
    return rows.withColumn("id", F.concat_ws("#", "source_id", "line_ord"))


def told_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source and text that a person told apart from the one before, and from the third before: a part of all."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("trader_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("same"))
    order = Window.partitionBy("trader_id", "same").orderBy("doc_id")
    pairs = [d.select(F.lag("doc_id", back).over(order).alias("a"), F.col("doc_id").alias("b")) for back in (1, 3)]
    return pairs[0].union(pairs[1]).where("a IS NOT NULL AND b % 3 < 2")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments written as the operators' messages, in two languages and for two providers."""
    p = payments(spark, sf_dir)
    phone = F.concat(F.lit("6"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(100_000_000)).cast("string"), 8, "0"))
    ref = F.concat(F.lit("TX"), F.lpad(F.col("id").cast("string"), 8, "0"))
    day = F.date_format("date", "dd/MM/yyyy")
    money = F.regexp_replace(F.col("amount").cast("string"), r"\B(?=(\d{3})+(?!\d))", " ")
    french = F.concat(F.lit("MTN Mobile Money: Vous avez reçu "), money, F.lit(" FCFA de Awa Ngono (237"), phone, F.lit(") le "), day, F.lit(" a "), "time", F.lit(". Frais: 0 FCFA. Solde: "), (F.col("amount") + 1000).cast("string"), F.lit(" FCFA. ID: "), ref, F.lit("."))
    english = F.concat(F.lit("Orange Money. You have sent "), F.col("amount").cast("string"), F.lit(" XAF to Paul Biyong on "), F.date_format("date", "yyyy-MM-dd"), F.lit(" "), "time", F.lit(". Fee: 25 XAF. Balance: "), (F.col("amount") + 7).cast("string"), F.lit(" XAF. Transaction ID "), ref)
    deposit = F.concat(F.lit("Depot de "), money, F.lit(" F effectue le "), day, F.lit(". Ref "), ref)
    raw = F.when(F.col("kind") == "received", french).when(F.col("kind") == "sent", english).otherwise(deposit)
    # one message in eleven fails or is written in another way
    odd = F.col("id") % 11
    no_year = F.concat(F.lit("You have received "), money, F.lit(" FCFA from Awa on 25/12 "), F.lit("and 1 FCFA more"))
    swapped = F.concat(F.lit("Retrait de "), F.col("amount").cast("string"), F.lit(".00 XAF le 03/25/2024. Commission: 12 XAF. MoMo"))
    raw = (
        F.when(odd == 0, F.lit(None).cast("string")).when(odd == 1, F.lit("hello, how are you on 2024-01-01")).when(odd == 2, F.concat(money, F.lit(" FCFA promo le "), day))
        .when(odd == 3, F.concat(F.lit("You have received "), money, F.lit(" FCFA from Awa"))).when(odd == 4, no_year).when(odd == 5, swapped).otherwise(raw)
    )
    return spread(p.select("trader_id", "id", raw.alias("raw"), F.lit("2024-02-01").cast("date").alias("today")), table(spark, sf_dir, "events").count())


def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader output of each order: a dated first line, amounts as text and one computed amount in seven."""
    e = entries(spark, sf_dir)
    line = F.struct(
        F.col("type").alias("kind"),
        F.lit("line").alias("description"),
        F.when(F.col("seq") <= 3, F.date_format("date", "dd/MM/yyyy")).otherwise("").alias("dateText"),
        F.when(F.col("seq") % 7 == 6, F.lit("0 f")).otherwise(F.concat(F.col("amount").cast("string"), F.lit(" FCFA"))).alias("amount"),
        F.col("quantity").alias("quantity"),
        F.lit(100).alias("unitPrice"),
        F.lit(90).alias("confidence"),
    )
    grouped = e.groupBy(F.col("source_id").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "amount", "date", "type", line.alias("line")))).alias("all"))
    doc = F.struct(F.lit("notebook").alias("document"), F.lit("1 mars 1999").alias("pageDateText"), F.transform("all", lambda x: x["line"]).alias("lines"))
    return grouped.select("page_id", F.to_json(doc).alias("json"), F.lit("2001-06-30").cast("date").alias("today"))


def bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as traders with all that belongs to them: their orders as pages, order lines, payments, events and written totals.

    Lines and payments vary by the numbers of part, line and quantity, so that
    every rule of the profile has rows: corrected and added lines, payments that
    lines, days or neighbouring days back, and totals that hold or not. A quarter
    of the pages were photographed again a day later and read with another first
    amount; some of these pairs are told apart.
    """
    o = table(spark, sf_dir, "orders")
    all_lines = table(spark, sf_dir, "lineitem")
    part, line, number, date = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_shipdate").cast("date")
    amount = half_up(F.col("l_extendedprice"))
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount).alias("id")
    kind = F.when(F.col("l_returnflag") == "R", "expense").otherwise("sale")
    open_ = F.col("l_linestatus") == "O"
    status = F.when(open_ & (line == 7), "rejected").when(open_ & line.isin(5, 6), "pending").otherwise("confirmed")
    origin = F.when((line == 3) & (part % 10 == 0), "trader").otherwise("ai")
    before = F.when(part % 7 == 0, F.struct(date.alias("date"), F.lit("").alias("description"), F.lit(0).cast("long").alias("amount"), F.lit("sale").alias("type")))
    thing = F.when(part % 4 == 0, "2 rice").when(part % 4 == 1, "Rice").when(part % 4 == 2, "palm oil").otherwise("soap")
    # a line goes to its page and, photographed again, to the other one; it is dealt by page once, and its long columns are made there
    twice = F.when(F.col("l_orderkey") % 4 == 1, F.array("l_orderkey", -F.col("l_orderkey"))).otherwise(F.array("l_orderkey"))
    dealt = all_lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate", F.explode(twice).alias("source_id"))
    paid = F.when(number % 2 == 1, amount).when(number % 4 == 0, amount - 1).otherwise(amount + 1)
    mine = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("trader_id"))
    payments = all_lines.where(line == 1).join(mine, "l_orderkey").select(
        ident, ident.alias("ord"), "trader_id", F.when(F.col("l_returnflag") == "R", "out").otherwise("in").alias("direction"),
        F.when(F.col("l_returnflag") == "R", "sent").when(F.col("l_returnflag") == "A", "received").when(part % 5 == 0, "deposit").otherwise("payment_in").alias("kind"),
        paid.alias("amount"), F.when(part % 13 == 0, F.date_sub(date, 1)).otherwise(date).alias("date"),
        F.when(part % 11 != 0, F.concat(F.lpad((part % 24).cast("string"), 2, "0"), F.lit(":15"))).alias("time"),
        F.when(part % 3 == 0, F.concat(F.when(number % 2 == 1, "TX").otherwise("tx"), (part % 20).cast("string"))).alias("ref"),
        F.concat(F.lit("Paid  "), (part % 4).cast("string")).alias("raw"),
    )
    key = F.col("o_orderkey")
    pages = o.select(
        key.alias("id"), F.col("o_custkey").alias("trader_id"), F.when(F.col("o_orderpriority") == "5-LOW", "message").when(F.col("o_orderpriority") == "2-HIGH", "receipt").otherwise("notebook").alias("kind"),
        F.when(F.col("o_orderstatus") == "P", "duplicate").when(F.col("o_orderstatus") == "F", "read").otherwise("pending").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("duplicate_kept"),
        F.when((F.col("o_orderstatus") == "F") & (key % 3 != 0), F.col("o_orderdate").cast("timestamp")).alias("confirmed_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    pages = pages.union(pages.where("id % 4 = 1").withColumns({"id": -F.col("id"), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")}))
    again = F.col("source_id") < 0
    entries = stored_by(dealt, "source_id", all_lines.count() * 5 // 4).join(pages.select(F.col("id").alias("source_id"), "trader_id"), "source_id").select(
        F.when(again, F.concat(ident, F.lit("-2"))).otherwise(ident).alias("id"), "trader_id", "source_id", line.alias("seq"), date.alias("date"),
        (amount + F.when(again & (line == 1), 1).otherwise(0)).alias("amount"), kind.alias("type"), status.alias("status"), origin.alias("origin"), before.alias("original"), thing.alias("description"),
    )
    apart = o.where("o_orderkey % 16 = 1").select(key.alias("a"), (-key).alias("b"))
    repeated = repeated_lines(page_lines_of(entries, pages), apart)
    found = F.when(F.col("o_orderpriority") == "1-URGENT", "photo_duplicate_flagged").otherwise("photo_duplicate_blocked")
    events = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("trader_id"), F.col("o_orderdate").alias("at"), found.alias("type"), (key % 40 == 0).alias("cross_trader"))
    written = entries.where("type = 'sale'").groupBy("source_id").agg(F.sum("amount").alias("amount"))
    totals = written.select("source_id", F.lit("sale").alias("type"), F.lit(None).cast("date").alias("date"), (F.col("amount") + F.when(F.col("source_id") % 5 == 0, 1000).otherwise(0)).alias("amount"))
    traders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trader_id"))
    return {"traders": traders, "entries": entries, "sources": pages, "payments": payments, "events": events, "totals": totals, "repeated": repeated, "told_apart": apart}


def patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ledger lines with the day on which they are seen, and one patch for most of them, its shape by their quantity."""
    li = table(spark, sf_dir, "lineitem")
    shape, line, part = F.col("l_quantity").cast("int") % 10, F.col("l_linenumber"), F.col("l_partkey")
    date, amount = F.col("l_shipdate").cast("date"), half_up(F.col("l_extendedprice"))
    rows = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount).alias("id"), F.col("l_orderkey").alias("source_id"), F.when(line == 2, "trader").otherwise("ai").alias("origin"),
        F.when(line == 7, "rejected").when(line.isin(1, 5, 6), "pending").otherwise("confirmed").alias("status"), date.alias("date"), F.lit("line").alias("description"), amount.alias("amount"),
        F.when(F.col("l_returnflag") == "R", "expense").otherwise("sale").alias("type"), F.when(line == 5, F.array(F.lit("unusual_amount"), F.lit("low_confidence"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(line == 3, F.struct(date.alias("date"), F.lit("was").alias("description"), F.lit(1).cast("long").alias("amount"), F.lit("sale").alias("type"))).alias("original"),
        F.when(line.isin(2, 3, 4), F.lit("2001-01-01").cast("timestamp")).alias("confirmed_at"), F.when(part % 4 == 0, F.date_add(date, 500)).otherwise(F.date_add(date, 30)).alias("today"), shape.alias("shape"), part.alias("part"),
    )
    status = F.when(F.col("shape") == 0, "rejected").when(F.col("shape") == 1, "pending").when(F.col("shape") == 2, "confirmed")
    changes = rows.where("shape < 9").select(
        "id", status.alias("status"), F.when((F.col("shape") == 7) & (F.col("part") % 2 == 0), F.date_sub("date", 3)).alias("date"), ((F.col("shape") == 7) & (F.col("part") % 2 == 1)).alias("clear_date"),
        F.when(F.col("shape") == 3, F.lit("better words")).alias("description"), F.when(F.col("shape") == 4, F.lit(0)).when(F.col("shape") == 5, F.col("amount") + 10).when(F.col("shape") == 6, F.col("amount")).cast("long").alias("amount"),
        F.when(F.col("shape") == 3, "expense").alias("type"),
    )
    return rows.drop("shape", "part"), changes


def payment_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader output of each user's screen of transactions, in shapes that vary by event, sound and not."""
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 12)
    amount, date, k = half_up(F.col("value") * 100), F.col("ts").cast("date"), F.col("k")
    doc = F.struct(
        F.concat(F.lit("  seen \n "), F.col("event_type")).alias("rawText"), F.when(k == 1, "unknown").when(k == 2, "sideways").when(k % 2 == 0, "in").otherwise("out").alias("direction"),
        F.when(k == 3, "unknown").when(k == 4, "gift").when(k == 5, "withdrawal").otherwise("payment_in").alias("kind"),
        F.when(k == 0, F.lit("none")).when(k == 6, F.concat(F.lit("XAF "), amount.cast("string"))).otherwise(F.concat(amount.cast("string"), F.lit(" f"))).alias("amount"),
        F.when(k % 3 == 0, 50).otherwise(-5).alias("fee"), F.when(k % 4 == 0, F.lit(1000.5)).otherwise(F.lit(0.0)).alias("balance"),
        F.when(k % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 7, "2001-02-31").otherwise("").alias("date"), F.when(k % 5 == 0, "").when(k == 7, "soon").otherwise(F.date_format("ts", "dd/MM/yyyy")).alias("dateText"),
        F.when(k == 8, "noon").when(k == 9, " 9:05 ").otherwise(F.date_format("ts", "HH:mm")).alias("time"), F.when(k % 2 == 0, F.concat(F.lit(" ref"), F.col("event_id").cast("string"))).otherwise(" ").alias("ref"),
        F.when(k == 10, "mtn").when(k == 11, "bank").otherwise("orange").alias("provider"), F.when(k == 9, 0).otherwise(80).alias("confidence"),
    )
    grouped = e.groupBy(F.col("user_id").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", doc.alias("doc")))).alias("all"))
    whole = F.to_json(F.struct(F.lit("mobile_money").alias("document"), F.transform("all", lambda x: x["doc"]).alias("transactions")))
    json = F.when(F.col("page_id") % 50 == 0, "not json").when(F.col("page_id") % 50 == 1, "[1]").when(F.col("page_id") % 50 == 2, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    return grouped.select("page_id", json.alias("json"), F.lit("2026-06-30").cast("date").alias("today"))


def answers(facts: DataFrame) -> DataFrame:
    """An answer for each week of each pack of evidence, its shape by the day of the month: codes in brackets, in sentences and in lists, sound and not; figures that hold and not."""
    week = facts.where("kind = 'week' AND name = 'sales'")
    k, code, value = F.dayofmonth(F.to_date("key")) % 7, F.col("code"), F.col("value").cast("long").cast("string")
    held, wrong = F.concat(F.lit("Sales were "), value, F.lit(" FCFA ")), F.concat(F.lit("Sales were "), (F.col("value") * 3 + 777777).cast("long").cast("string"), F.lit(" FCFA "))
    text = (
        F.when(k == 0, F.concat(held, F.lit("["), code, F.lit(", E99999999]."))).when(k == 1, F.concat(held, F.lit("in "), code, F.lit("  and 4321% more [FAKE] .")))
        .when(k == 2, F.concat(wrong, F.lit("[E1] in 2001 on 2001-01-01 [I1;G1]"))).when(k == 3, F.lit("Nothing is known")).when(k == 4, F.lit(None).cast("string")).when(k == 5, F.concat(wrong, F.lit("[NONE], see E99999999.")))
        .otherwise("")
    )
    listed = F.when(k == 2, F.array(F.lit("E1"), F.lit(" G2 "), F.lit("x"))).when(k == 6, F.array(code))
    return week.select(F.concat_ws("/", "pack_id", "key").alias("answer_id"), "pack_id", text.alias("answer"), listed.alias("citations"), F.when(k == 3, F.lit(False)).when(k == 4, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("answerable"))


def uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pictures of vectors: every third one is a page on file, the others are new; some repeat another's bytes, look alike or are unsound."""
    v = F.col("vec_id")
    start = F.when(v % 4 == 0, "000").when(v % 4 == 1, "001").when(v % 4 == 2, "03f").otherwise("fff")
    group = F.floor(v / 4).cast("long").cast("string")
    same = F.when(v % 10 < 2, v - v % 2).otherwise(v).cast("string")
    t = table(spark, sf_dir, "embeddings").select(
        v.alias("id"), v.alias("ord"), (v % 7).alias("trader_id"), F.when(v % 17 == 0, "selfie").when(v % 2 == 0, "receipt").otherwise("notebook").alias("kind"), F.when(v % 23 == 0, 11 << 20).otherwise(1000).alias("bytes"),
        F.when(v % 19 != 0, "jpeg").alias("mime"), F.when(v % 13 != 0, F.sha2(same.cast("binary"), 256)).alias("sha256"),
        F.when(v % 29 == 0, "bad").otherwise(F.concat(start, F.substring(F.md5(group.cast("binary")), 4, 29), F.md5(F.concat(F.lit("x"), group).cast("binary")))).alias("dhash"), F.repeat(F.lit("a"), (v % 200).cast("int")).alias("name"),
    )
    return t.where("id % 3 <> 0"), t.where("id % 3 = 0 AND id % 29 <> 0").select("id", "ord", "trader_id", "sha256", "dhash")


def phones(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Traders (two of three agreed to be read), payments and pages with phone numbers in columns and texts."""
    e = table(spark, sf_dir, "events")
    n = F.lpad((F.col("event_id") * 7919 % 100_000_000).cast("string"), 8, "0")
    own = F.concat(F.lit("+237 6"), F.lpad((F.col("trader_id") % 100).cast("string"), 8, "0"))
    who = e.select(F.col("user_id").alias("trader_id")).distinct()
    traders = who.select(F.col("trader_id").alias("id"), own.alias("phone"), F.struct((F.col("trader_id") % 3 > 0).alias("granted"), F.lit("TR-AAAA-AAAA").alias("code")).alias("consent"))
    paid = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("trader_id"), F.concat(F.lit("6"), n).alias("phone"), F.lit("Awa Ngono Marie").alias("counterparty"), F.concat(F.lit("Paid by 6"), n, F.lit(".")).alias("raw"))
    pages = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("trader_id"), F.concat(F.lit("Call 6"), n, F.lit(" or (+237)6"), n, F.lit(", not 16"), n, F.lit("0")).alias("text"))
    return {"traders": traders, "payments": paid, "sources": pages}
