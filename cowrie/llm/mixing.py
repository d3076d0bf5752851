"""Mix sources to target weights: repetition rates and hash-seeded copies.

Each source's words are aggregated, a budget of words is shared by weight, and
a document is emitted floor(rate) times plus one Bernoulli copy whose
probability is the rate's fraction, drawn from a hash of its key. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cowrie.llm.common import drop, stash

#: Weights of the sources in code-point order, null last; they repeat.
WEIGHTS = (5, 2, 1)
#: Words of the mix, in hundredths of all words.
BUDGET_PERCENT = 150
#: Most times that a source's words are taken.
MOST = 2
#: Most sources whose rates are broadcast; beyond it the join shuffles both sides.
BROADCAST_SOURCES = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a key and a seed: the first 52 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources 0, 1, ... in code-point order, null last, without a global window.

    The sorted table is written once; a row's number is its place in its part
    plus the rows of earlier parts, of which there is one number each.
    """
    spark = sources.sparkSession
    placed = stash(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for row in sorted(placed.groupBy(part.alias("part")).agg(F.max("at").alias("last")).collect()):
        offsets.append((row.part, before))
        before += (row.last & ((1 << 33) - 1)) + 1
    parts = spark.createDataFrame(offsets, "part long, before long")
    return placed.join(F.broadcast(parts), part == parts["part"]).select("source", "source_size", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = BUDGET_PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    The budget is shared by weight; a source stops at ``most`` times its size and
    its excess is shared again by weight among the others, until none is above.
    Sums are whole numbers, so the targets do not depend on the order of rows.
    Each round only brings three sums to the driver. A source without words has
    target 0; null is a source of its own.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    table = stash(_ranked(sizes).withColumn("w", w).withColumn("capped", F.lit(False)))
    while True:
        got = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))), F.lit(0)).alias("weight"),
        ).first()
        rest = got.total * percent - got.taken * most * 100  # in hundredths of a word
        if not got.weight:
            break
        over = (~F.col("capped")) & (F.lit(rest) * F.col("w") >= F.col("source_size") * F.lit(most * 100 * got.weight))
        if table.where(over).isEmpty():
            break
        new = stash(table.withColumn("capped", F.col("capped") | over))
        drop(table)
        table = new
    share = F.lit(rest / 100) * F.col("w") / F.lit(got.weight or 1)
    return table.select("source", "source_size", F.when(F.col("capped"), F.col("source_size") * F.lit(float(most))).otherwise(share).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **shares: object) -> DataFrame:
    """Append ``source_size``, ``target``, ``size`` and ``copies`` to each row.

    ``copies`` is floor(rate) plus 1 with the probability of the rate's
    fraction, where rate = target / source_size. Rows with null or wordless text
    have size 0 and follow their source's rate; repeated rows of one key draw the
    same number; a null key is a key of its own. Columns of these names are
    replaced. An empty table gives an empty one.
    """
    new = ("source_size", "target", "size", "copies")
    docs = docs.drop(*[c for c in docs.columns if c in new and c not in (key, text, source)])
    sized = docs.select(F.col(source).alias("source"), words_in(F.col(text)).alias("size"))
    targets = stash(source_targets(sized, **shares))
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = targets.select(F.col("source").alias("cowrie_source"), "source_size", "target")
    joined = docs.join(F.broadcast(rates) if small else rates, docs[source].eqNullSafe(rates["cowrie_source"]), "left").drop("cowrie_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(uniform(F.col(key), seed) < rate - whole, 1).otherwise(0)
    return joined.withColumn("size", words_in(F.col(text))).withColumn("copies", copies.cast("long"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix`` as many times as it has copies, without the columns that ``mix`` added."""
    rows = mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.drop("source_size", "target", "size", "copies")


#: The rows of op1 in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         CASE (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
t AS (
  SELECT SUM(source_size)::BIGINT AS total, SUM(w)::BIGINT AS weight FROM w),
o AS (
  SELECT w.*, ROW_NUMBER() OVER (ORDER BY source_size / w, source) AS k,
         COALESCE(SUM(source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s_before,
         COALESCE(SUM(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS w_before FROM w),
c AS (
  SELECT o.*, (t.total * 150 - s_before * 200) AS rest, (t.weight - w_before) AS rest_w,
         (t.total * 150 - s_before * 200) * w >= source_size * 200 * (t.weight - w_before) AS capped FROM o, t),
f AS (SELECT MIN(k) AS k FROM c WHERE NOT capped),
g AS (SELECT rest, rest_w FROM c JOIN f USING (k)),
r AS (
  SELECT c.source, c.source_size,
         CASE WHEN f.k IS NULL OR c.k < f.k THEN c.source_size * 2.0::DOUBLE
              ELSE (g.rest::DOUBLE / 100) * c.w / g.rest_w END::DOUBLE AS target
  FROM c CROSS JOIN f LEFT JOIN g ON TRUE),
p AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:' || COALESCE(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
