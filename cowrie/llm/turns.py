"""Conversation structure repair by a higher-order fold.

Windows flag faulty rows, each conversation's rows are collected as sorted
structs, and ``aggregate()`` carries one (cost, audit) struct for each of the
four states that role initials can be in: nothing yet, after a system turn,
after a user turn, after an assistant turn. ``least`` picks the cheaper struct
and, on equal cost, the audit that is least in ASCII; a state that cannot be
reached is null, which ``least`` skips. At one row all audits of one cost have
the same length or differ before their ends, so picking early loses nothing.

A conversation is cut into blocks of ``BLOCK`` turn numbers. A block is folded
from each of the four states, and a second fold joins the blocks, so a long
conversation is folded by many tasks. What comes back to one row is only what
its result holds: the audit, and the repaired text whose digest is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of a block; rows without a turn are a block of their own.
BLOCK = 256
#: Costs of the edits; a kept or re-roled turn that is cut off adds ``CUT_OFF``.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
# Space and the controls 9 to 13.
_BLANKS = " \t\n\x0b\x0c\r"
_BEST = "struct<cost:bigint,audit:string>"
_PATH = "struct<cost:bigint,audit:string,path:array<int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with a fault for each crc32 of "conv:turn" modulo 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it a user's.

    A null role or text is one space, as is a null key or turn where they are hashed.
    """
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space(F.col(conv)), F.lit(":"), space(F.col(turn))).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(F.col(role)).alias("role"), space(F.col(text)).alias("text"), h.alias("h")).where("h <> 0")
    kept, said = F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")), F.col("text")
    worn = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.translate(said, ".!?", "")).otherwise(said)
    times = F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv", "turn", kept.alias("role"), worn.alias("text"), F.explode(times).alias("copy")).drop("copy")


def flag(rows: DataFrame) -> DataFrame:
    """Append ``nth``, a row's place among its likes, and ``fault``, the first that a row of (conv, turn, role, text) has: blank, duplicate, truncated or null.

    A row is a duplicate if an earlier one of its conversation has its role and
    text; the window holds one text of one conversation at a time.
    """
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    nth = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(bare == "", F.lit("blank")).when(F.col("nth") > 1, F.lit("duplicate")).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit("truncated"))
    return rows.withColumn("nth", nth).withColumn("fault", fault)


def _more(best: Column, cost: Column | int, edit: str) -> Column:
    """A (cost, audit) with one more edit; null stays null."""
    return F.when(best.isNotNull(), F.struct((best["cost"] + cost).alias("cost"), F.concat(best["audit"], F.lit(edit)).alias("audit")))


def _inserted(b: Column, more: Callable = _more) -> Column:
    """The four states after any useful insertions: a user, an assistant, or both."""
    user = F.least(b["b2"], *[more(b[s], INSERT, "I") for s in ("b0", "b1", "b3")])
    both = [more(b[s], 2 * INSERT, "II") for s in ("b0", "b1")]
    return F.struct(b["b0"].alias("b0"), b["b1"].alias("b1"), user.alias("b2"), F.least(b["b3"], more(b["b2"], INSERT, "I"), *both).alias("b3"))


def _step(b: Column, row: Column) -> Column:
    """The four states after one more row: deleted, kept if its initial fits, or given the role that fits."""
    cost = F.when(row["fault"] == "truncated", F.lit(CUT_OFF)).otherwise(F.lit(0)).cast("long")
    alive = row["fault"].isNull() | (row["fault"] == "truncated")
    initial = F.left(row["role"], F.lit(1))

    def moved(c: Column) -> Column:
        keep = lambda s, letter: F.when(alive & (initial == letter), _more(s, cost, "K"))
        rerole = lambda s: F.when(alive, _more(s, cost + REROLE, "R"))
        gone = {k: _more(c[f"b{k}"], DELETE, "D") for k in range(4)}
        before_user = F.least(c["b0"], c["b1"], c["b3"])
        return F.struct(
            gone[0].alias("b0"),
            F.least(gone[1], keep(c["b0"], "s")).alias("b1"),
            F.least(gone[2], keep(before_user, "u"), rerole(before_user)).alias("b2"),
            F.least(gone[3], keep(c["b2"], "a"), rerole(c["b2"])).alias("b3"),
        )

    return _let(_inserted(b), moved)


def _fold(rows: Column) -> Column:
    """For each state before the rows an array element: the four states after them."""
    none, begin = F.lit(None).cast(_BEST), F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))

    def start(s: Column) -> Column:
        return F.struct(*[F.when(s == k, begin).otherwise(none).alias(f"b{k}") for k in range(4)])

    return F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda s: F.aggregate(rows, start(s), _step))


def _joined(blocks: Column) -> Column:
    """Fold of the blocks' folds: the cheapest (cost, audit, path), with the state after each block as path."""
    none = F.lit(None).cast(_PATH)
    begin = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<int>").alias("path"))
    first = F.struct(begin.alias("b0"), *[none.alias(f"b{k}") for k in (1, 2, 3)])

    def through(b: Column, s: int, e: int, block: Column) -> Column:
        best, step = b[f"b{s}"], F.get(block["after"], F.lit(s))[f"b{e}"]
        made = F.struct((best["cost"] + step["cost"]).alias("cost"), F.concat(best["audit"], step["audit"]).alias("audit"), F.concat(best["path"], F.array(F.lit(e))).alias("path"))
        return F.when(best.isNotNull() & step.isNotNull(), made)

    def step(b: Column, block: Column) -> Column:
        return F.struct(*[F.least(*[through(b, s, e, block) for s in range(4)]).alias(f"b{e}") for e in range(4)])

    def more(best: Column, cost: int, edit: str) -> Column:
        return F.when(best.isNotNull(), F.struct((best["cost"] + cost).alias("cost"), F.concat(best["audit"], F.lit(edit)).alias("audit"), best["path"].alias("path")))

    return F.aggregate(blocks, first, step, lambda b: _let(_inserted(b, more), lambda c: F.least(c["b0"], c["b3"])))


def _replayed(rows: Column, audit: Column, state: Column) -> Column:
    """The turns that an audit makes of rows, as ``role:text``, each behind a newline."""
    begin = F.struct(F.lit(0).alias("i"), state.cast("int").alias("state"), F.lit("").alias("out"))

    def step(acc: Column, edit: Column) -> Column:
        row = F.get(rows, acc["i"])
        given = F.when(acc["state"] == 2, F.lit("assistant")).otherwise(F.lit("user"))
        role = F.when(edit == "K", row["role"]).otherwise(given)
        line = F.when(edit == "D", F.lit("")).otherwise(F.concat(F.lit("\n"), role, F.lit(":"), F.when(edit == "I", F.lit("")).otherwise(row["text"])))
        to = F.when(edit == "D", acc["state"]).when(F.left(role, F.lit(1)) == "s", F.lit(1)).when(acc["state"] == 2, F.lit(3)).otherwise(F.lit(2))
        return F.struct((acc["i"] + F.when(edit == "I", 0).otherwise(1)).alias("i"), to.alias("state"), F.concat(acc["out"], line).alias("out"))

    edits = F.filter(F.split(audit, ""), lambda c: c != "")
    return F.aggregate(edits, begin, step, lambda acc: acc["out"])


def repair(rows: DataFrame) -> DataFrame:
    """Counts of faults and the cheapest repair of each conversation in rows of (conv, turn, role, text).

    Returns conv, gaps, blank, duplicate, truncated, illegal, cost, audit and
    ``repaired``, the text of the repaired turns (``role:text``, joined by
    newlines). Rows follow each other by turn, nulls first, then role and text.
    Edits are Keep, Rerole to user or assistant, Delete (the only one for blank
    and duplicate rows) and Insert of an empty user or assistant turn; the role
    initials left are nothing, or ``ua`` repeated behind an ``s`` or none. Other
    initials than s, u and a cannot be kept. A null conversation is one of its
    own; an empty table gives an empty one.
    """
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))  # null turns come first
    row = F.struct("turn", "role", "text", "nth", "fault")  # of equal rows the first is no duplicate
    blocks = flag(rows).groupBy("conv", block.alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    count = lambda fault: F.size(F.filter("rows", lambda r: r["fault"] == fault)).cast("long").alias(fault)
    initials = F.transform("rows", lambda r: F.left(r["role"], F.lit(1)))
    blocks = blocks.select(
        "conv",
        F.struct(
            "block",
            _fold(F.col("rows")).alias("after"),
            F.col("rows"),
            *[count(x) for x in ("blank", "duplicate", "truncated")],
            initials.alias("initials"),
            F.size(F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull()))).cast("long").alias("turns"),
            F.array_min(F.transform("rows", lambda r: r["turn"])).alias("least"),
            F.array_max(F.transform("rows", lambda r: r["turn"])).alias("most"),
        ).alias("b"),
    )
    whole = blocks.groupBy("conv").agg(F.array_sort(F.collect_list("b"), lambda x, y: F.when(x["block"] < y["block"], -1).when(x["block"] > y["block"], 1).otherwise(0)).alias("blocks"))
    whole = whole.withColumn("best", _joined(F.col("blocks")))
    summed = lambda name: F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, b: acc + b[name])
    letters = F.flatten(F.transform("blocks", lambda b: b["initials"]))
    pairs = F.zip_with(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    path = F.col("best")["path"]
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(path, i - 1))

    def text_of(b: Column, i: Column) -> Column:
        audit = F.get(b["after"], before(i))
        chosen = F.coalesce(*[F.when(F.get(path, i) == e, audit[f"b{e}"]["audit"]) for e in range(4)])
        return _replayed(b["rows"], chosen, before(i))

    used = F.aggregate(F.transform("blocks", lambda b, i: F.length(F.coalesce(*[F.when(F.get(path, i) == e, F.get(b["after"], before(i))[f"b{e}"]["audit"]) for e in range(4)]))), F.lit(0), lambda x, y: x + y)
    tail = F.col("best")["audit"].substr(F.col("used") + 1, F.lit(2))
    said = F.concat(F.array_join(F.transform("blocks", text_of), ""), _replayed(F.array().cast("array<struct<turn:bigint,role:string,text:string,nth:int,fault:string>>"), tail, F.get(path, F.size(path) - 1)))
    least, most = F.array_min(F.transform("blocks", lambda b: b["least"])), F.array_max(F.transform("blocks", lambda b: b["most"]))
    return whole.withColumn("used", used).select(
        "conv",
        F.coalesce(most - least + 1 - summed("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[summed(x).alias(x) for x in ("blank", "duplicate", "truncated")],
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.col("best")["cost"].alias("cost"),
        F.col("best")["audit"].alias("audit"),
        F.substring(said, 2, (1 << 31) - 1).alias("repaired"),
    )


def repair_damaged(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``repair`` of the damaged rows, for every conversation of the table, with the digest of the repaired text.

    Conversations that lost all their rows have zeros, an empty audit and the digest of the empty text.
    """
    found = repair(damage(turns, conv=conv)).withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).drop("repaired")
    every = turns.select(F.col(conv).alias("key")).distinct()
    out = every.join(found, every["key"].eqNullSafe(found["conv"]), "left")
    counts = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("key").alias(conv), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: The rows of op12 in DuckDB's SQL; the checksum is spelled out, and a recursion over rows takes the place of the fold.
SQL = r"""
WITH RECURSIVE
tbl AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (
  SELECT src.*, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT),
         lambda c, b: xor(c >> 8, t[((xor(c, b)) & 255) + 1])), 4294967295) % 20 AS h FROM src, tbl),
dmg AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0),
f1 AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last, left(role, 1) AS i FROM dmg),
f2 AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         LAG(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM f1),
summed AS (
  SELECT conv_id, COUNT(*) AS rows_, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps,
         COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate, COUNT(*) FILTER (fault = 'truncated') AS truncated,
         COUNT(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f2 GROUP BY conv_id),
ins(s, e, cost, edits, said) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
         (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
         (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
moves(s, e, edit, i, extra, given) AS (
  VALUES (0, 0, 'D', NULL, 4, NULL), (1, 1, 'D', NULL, 4, NULL), (2, 2, 'D', NULL, 4, NULL), (3, 3, 'D', NULL, 4, NULL),
         (0, 1, 'K', 's', 0, NULL), (0, 2, 'K', 'u', 0, NULL), (1, 2, 'K', 'u', 0, NULL), (3, 2, 'K', 'u', 0, NULL), (2, 3, 'K', 'a', 0, NULL),
         (0, 2, 'R', NULL, 3, 'user'), (1, 2, 'R', NULL, 3, 'user'), (3, 2, 'R', NULL, 3, 'user'), (2, 3, 'R', NULL, 3, 'assistant')),
run(conv_id, n, s, cost, audit, said) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', '' FROM summed
  UNION ALL
  SELECT conv_id, n, s, cost, audit, said FROM (
    SELECT r.conv_id, f2.n, m.e AS s,
           r.cost + x.cost + m.extra + CASE WHEN m.edit <> 'D' AND f2.fault = 'truncated' THEN 3 ELSE 0 END AS cost, r.audit || x.edits || m.edit AS audit,
           r.said || x.said || CASE WHEN m.edit = 'D' THEN '' ELSE chr(10) || COALESCE(m.given, f2.role) || ':' || f2.text END AS said
    FROM run r JOIN ins x ON x.s = r.s JOIN f2 ON f2.conv_id IS NOT DISTINCT FROM r.conv_id AND f2.n = r.n + 1
    JOIN moves m ON m.s = x.e AND (m.edit = 'D' OR ((f2.fault IS NULL OR f2.fault = 'truncated') AND (m.i IS NULL OR m.i = f2.i)))
    ) QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1),
done AS (
  SELECT conv_id, cost, audit, said FROM (
    SELECT r.conv_id, r.cost + x.cost AS cost, r.audit || x.edits AS audit, r.said || x.said AS said
    FROM run r JOIN summed z ON z.conv_id IS NOT DISTINCT FROM r.conv_id AND z.rows_ = r.n JOIN ins x ON x.s = r.s AND x.e IN (0, 3)
    ) QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT c.conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0)::BIGINT AS blank, COALESCE(duplicate, 0)::BIGINT AS duplicate,
       COALESCE(truncated, 0)::BIGINT AS truncated, COALESCE(illegal, 0)::BIGINT AS illegal, COALESCE(cost, 0)::BIGINT AS cost,
       COALESCE(audit, '') AS audit, sha256(COALESCE(substr(said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN summed z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
