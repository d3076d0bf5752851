"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed, ``GRAM`` words in a row give a rolling (polynomial) hash, and
of each window of ``WINDOW`` grams the least hash is chosen, the rightmost on
ties. A chosen gram is one long: hash in the upper bits, inverted position in
the lower, so the least long is the rightmost least hash. Texts that share a run
of at least ``GRAM + WINDOW - 1`` words share a chosen hash; the positions say
where.

Rolling hashes and window minima are made by doubling: values for 2n words come
from pairs of values for n words, so each costs a few passes over the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a gram and grams of a window.
GRAM, WINDOW = 5, 8
#: Rows of documents between two cuts of the order, about, unless the cluster has more cores than that gives work.
CHUNK_ROWS, CHUNKS_PER_CORE, MOST_CHUNKS = 25_000, 16, 1 << 16
_PRIME, _BASE = (1 << 31) - 1, 1_000_003
_PLACE = 28  # bits of a position: a text has fewer words than that
_MASK = (1 << _PLACE) - 1


def _paired(a: str, b: str, by: int, join) -> Column:
    """join(a[i], b[i + by]) for each i for which both exist."""
    x, y = F.col(a), F.col(b)
    n = F.greatest(F.least(F.size(x), F.size(y) - by), F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1 + by), n), join)


def _fold(df: DataFrame, one: str, length: int, join) -> DataFrame:
    """Replace column ``one`` by the folds of every ``length`` neighbours.

    ``join(n)`` gives the function of a left fold and a right fold of n values.
    Each doubling is a column of its own, so none is computed twice.
    """
    made, n, have = [], 1, one
    parts = []  # folds of the lengths whose sum is ``length``, shortest first
    left = length
    while True:
        if left & n:
            parts.append((have, n))
            left -= n
        if not left:
            break
        new = f"{one}_{2 * n}"
        df = df.withColumn(new, _paired(have, have, n, join(n)))
        made.append(new)
        have, n = new, 2 * n
    have, n = parts.pop()
    while parts:
        more, m = parts.pop()
        new = f"{one}_{n}_{m}"
        df = df.withColumn(new, _paired(have, more, n, join(m)))
        made.append(new)
        have, n = new, n + m
    return df.withColumn(one, F.col(have)).drop(*made)


def add_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Append ``out``: the chosen grams of a text, as an ascending-position array of longs.

    Words are runs of other than space and the controls 9 to 13. A text of fewer
    than ``gram`` words has one gram, the whole of it; null and wordless texts
    have none. Fewer grams than a window are one window.
    """
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn(f"{out}_w", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(_PRIME))))
    w = F.col(f"{out}_w")
    whole = F.pmod(F.xxhash64(F.array_join(w.cast("array<string>"), " ")), F.lit(_PRIME))
    df = df.withColumn(f"{out}_n", F.size(w)).withColumn(f"{out}_s", F.when((F.col(f"{out}_n") < gram) & (F.col(f"{out}_n") > 0), F.array(whole)))

    def rolling(n: int):
        power = pow(_BASE, n, _PRIME)
        return lambda x, y: (x * F.lit(power) + y) % F.lit(_PRIME)

    df = _fold(df, f"{out}_w", gram, rolling)
    grams = F.coalesce(F.col(f"{out}_s"), F.col(f"{out}_w"))
    df = df.withColumn(f"{out}_p", F.transform(grams, lambda h, i: F.shiftleft(h, _PLACE).bitwiseOR(F.lit(_MASK) - i)))
    p = F.col(f"{out}_p")
    df = df.withColumn(f"{out}_s", F.when((F.size(p) < window) & (F.size(p) > 0), F.array(F.array_min(p))))
    df = _fold(df, f"{out}_p", window, lambda n: lambda x, y: F.least(x, y))
    return df.withColumn(out, F.array_distinct(F.coalesce(F.col(f"{out}_s"), F.col(f"{out}_p")))).drop(f"{out}_w", f"{out}_n", f"{out}_s", f"{out}_p")


def hashes(chosen: Column) -> Column:
    """The different hashes of chosen grams."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, _PLACE)))


def positions(chosen: Column) -> Column:
    """First word of each chosen gram."""
    return F.transform(chosen, lambda x: F.lit(_MASK) - x.bitwiseAND(F.lit(_MASK)))


def as_text(chosen: Column) -> Column:
    """Chosen grams as text: hash in hexadecimal, "@", position; separated by spaces."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, _PLACE))), F.lit("@"), (F.lit(_MASK) - x.bitwiseAND(F.lit(_MASK))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of different hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either).cast("double")


def _value(key: Column, kind: T.DataType) -> Column:
    """A double that never falls as the key rises: it only deals keys to chunks, so different keys may share one."""
    if isinstance(kind, T.StringType):  # the first six bytes, as strings are ordered by their bytes
        return F.conv(F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("double")
    return key.cast("double")


def _chunks(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame] | None:
    """Rows with ``chunk`` (0 holds the largest keys, nulls are in the last one), and for each chunk its largest key and the chunk before it (the first follows the last); null for an empty table.

    Chunks are cut at quantiles of the keys' values. There is one for every
    ``CHUNK_ROWS`` documents, but ``MOST_CHUNKS`` at most, so the tables of cuts
    are of bounded size.
    """
    spark, v = docs.sparkSession, _value(F.col(key), docs.schema[key].dataType)
    seen = docs.agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most")).first()
    if not seen.n:
        return None
    cuts = min(MOST_CHUNKS, max(spark.sparkContext.defaultParallelism * CHUNKS_PER_CORE, -(-seen.n // CHUNK_ROWS)))
    cuts = 0 if seen.least is None else min(cuts, seen.n - 1)
    marks = docs.agg(F.percentile_approx(v, [i / (cuts + 1) for i in range(1, cuts + 1)], max(10_000, 4 * cuts))).first()[0] if cuts else []
    marks = sorted(set(marks or []))
    low = seen.least or 0.0
    width = max(((seen.most or 0.0) - low) / max(1, cuts), 5e-324)
    within: dict[int, list[float]] = {}
    for m in marks:
        within.setdefault(int((m - low) / width), []).append(m)
    steps, below = [], 0
    for step in range(int(((seen.most or 0.0) - low) / width) + 1):
        steps.append((step, below, within.get(step, [])))
        below += len(within.get(step, []))
    table = spark.createDataFrame(steps, "step long, below int, within array<double>")

    def placed(df: DataFrame) -> DataFrame:
        at = F.floor((v - F.lit(low)) / F.lit(width))
        found = df.withColumn("step", at).join(F.broadcast(table), "step", "left")  # a row for each cut, about
        chunk = F.lit(len(marks)) - F.col("below") - F.size(F.filter("within", lambda m: m <= v))
        return found.withColumn("chunk", F.coalesce(chunk, F.lit(len(marks) + 1)).cast("int")).drop("step", "below", "within")

    heads = sorted(((r.chunk, r.top) for r in placed(docs.select(key)).groupBy("chunk").agg(F.max(key).alias("top")).collect()), key=lambda r: r[0])
    rows = [(c, top, heads[i - 1][0]) for i, (c, top) in enumerate(heads)]
    tops = spark.createDataFrame(rows, T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("top", docs.schema[key].dataType), T.StructField("before", T.IntegerType())]))
    return placed(docs), tops


def with_next(docs: DataFrame, key: str, text: str, make) -> DataFrame:
    """Append the columns that ``make`` gives each row, and ``next``: a struct of ``text`` and those columns of the following row.

    Keys are numbers, strings, dates or times. Rows follow each other by descending key, nulls last; equal keys in the order
    of their text; the last row is followed by the first, and a single row by
    itself. The order is cut into chunks; the first row of a chunk is copied to
    the chunk before, so one shuffle of the texts and a window within chunks
    suffice.
    """
    k = F.col(key)
    chunks = _chunks(docs, key)
    if chunks is None:
        made = make(docs)
        return made.withColumn("next", F.struct(text, *[c for c in made.columns if c not in docs.columns]))
    placed, tops = chunks
    placed = placed.join(F.broadcast(tops), "chunk")  # one row for each chunk
    own = F.struct(F.col("chunk").alias("at"), F.lit(False).alias("guest"))
    copies = F.when(k.eqNullSafe(F.col("top")), F.array(own, F.struct(F.col("before").alias("at"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = placed.withColumn("copy", F.explode(copies)).select(*docs.columns, "copy.at", "copy.guest").repartition("at")
    made = make(dealt)
    new = [c for c in made.columns if c not in dealt.columns]
    order = Window.partitionBy("at").orderBy("guest", k.desc_nulls_last(), text)
    return made.withColumn("next", F.lead(F.struct(text, *new)).over(order)).where("not guest").drop("at", "guest")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    The edited text replaces the last half of the code points (rounded down) by
    as many (or all) of the first of the next document in descending key order.
    Returns ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``. Null texts count as
    empty; equal texts have equal fingerprints; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, "id", "text", lambda df: add_fingerprint(df, "text", "chosen"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)))
    rows = add_fingerprint(rows.withColumn("next_chosen", F.col("next.chosen")).drop("next", "text"), "edited", "edited_chosen")
    mine = hashes(F.col("chosen"))
    return rows.select(
        F.col("id").alias(key),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("chosen")).alias("fingerprint"),
        as_text(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(mine, hashes(F.col("edited_chosen"))).alias("near_edited"),
        likeness(mine, hashes(F.col("next_chosen"))).alias("near_next"),
    )
