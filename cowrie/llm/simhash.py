"""SimHash near-duplicates by tables of distances to reference fingerprints.

A fingerprint has 64 bits. Its row of the pivot table holds its Hamming
distances to ``REFERENCES``, kept by block of 16 bits; over all blocks they add
up to the distance to the whole reference. Two fingerprints that differ in at
most two bits

* have equal coordinates in at least two of the four blocks, so an equi-join on
  the coordinates of each pair of blocks meets every such pair, and
* differ by at most two in every whole coordinate, so a larger maximum
  coordinate difference discards a pair before its bits are compared.

Survivors are verified on the bits. A cell of the join that holds more than
``CELL_ROWS`` different fingerprints is divided by six of the eight half-bytes that
its key leaves open (of so short a block the coordinates say no less than the
bits); such a cell has at most a few hundred rows then, and the work stays in
proportion to the input whatever the groups are.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.llm.common import connected_components, drop, stash, utf8, with_columns_from

#: Reference fingerprints of the pivot table.
REFERENCES = [int.from_bytes(hashlib.sha256(f"reference {i}".encode()).digest()[:8], "little", signed=True) for i in range(12)]
#: Most bits in which linked fingerprints differ; the blocks below are made for it.
MAX_BITS = 2
#: Different fingerprints of a cell from which the cell is divided.
CELL_ROWS = 256
_SEED = 42


def fingerprint_of(text: bytes, words: int = 3) -> int:
    """The SimHash of a text, as a signed 64-bit number (see ``fingerprints``)."""
    tokens = text.lower().split()
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(tokens)
    if n <= 1:
        hashes = [digest(line, _SEED)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        hashes = [digest(line[a:b], _SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    on = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def _make(words: int):
    def run(columns: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([fingerprint_of(x, words) for x in utf8(columns[0])], pa.int64())]

    return run


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """Append a 64-bit SimHash of every whole text.

    A-Z are lower-cased; words are runs of other than space and the controls 9
    to 13; shingles of ``words`` words, repeats included, are joined by a space
    (fewer words: the whole sequence) and hashed with XXH64, seed 42. A bit is 1
    if it is set in more than half of the hashes. Null and wordless texts get 0.
    """
    return with_columns_from(docs, [text], [T.StructField(out, T.LongType())], _make, words)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(first: int, width: int) -> int:
    return _signed(((1 << width) - 1) << first)


def _code(fp: Column, block: int) -> Column:
    """The coordinates of one block of 16 bits, packed into one number of 5 bits each."""
    out = F.lit(0).cast("long")
    for j, p in enumerate(REFERENCES):
        distance = F.bit_count(fp.bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(_mask(16 * block, 16)))).cast("long")
        out = out.bitwiseOR(F.shiftleft(distance, 5 * j))
    return out


def _open_masks(x: int, y: int) -> list[int]:
    """Masks of six of the eight half-bytes outside blocks x and y."""
    halves = [16 * b + 4 * q for b in range(4) if b not in (x, y) for q in range(4)]
    return [_signed(sum(15 << first for first in pick)) for pick in combinations(halves, 6)]


_DIST = [f"d{j}" for j in range(len(REFERENCES))]
_PAIRS = list(combinations(range(4), 2))


def _near(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Links within cells: pivot filter, then the bits."""
    a, b = cells.alias("a"), cells.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    far = F.greatest(*[F.abs(F.col(f"a.{d}") - F.col(f"b.{d}")) for d in _DIST])
    bits = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    return a.join(b, on & (F.col("a.fp") < F.col("b.fp")) & (far <= MAX_BITS) & (bits <= MAX_BITS)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(classes: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All pairs (a, b) of different fingerprints ``fp`` within two bits; pairs may repeat."""
    fp = F.col("fp")
    table = classes.select(
        "fp",
        *[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("short").alias(d) for p, d in zip(REFERENCES, _DIST, strict=True)],
        *[_code(fp, b).alias(f"c{b}") for b in range(4)],
    )
    cells = table.select("fp", *_DIST, F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"c{x}").alias("k1"), F.col(f"c{y}").alias("k2")) for i, (x, y) in enumerate(_PAIRS)])).alias("k")).select("fp", *_DIST, "k.*")
    key = ["pair", "k1", "k2"]
    sizes = cells.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    cells = stash(cells.join(sizes, key).withColumn("hot", F.col("n") > cell_rows).drop("n"))
    cold = _near(cells.where("not hot"), key)
    masks = F.array(*[F.array(*[F.lit(m) for m in _open_masks(x, y)]) for x, y in _PAIRS])
    hot = cells.where("hot").withColumn("mask", F.explode(F.get(masks, F.col("pair")))).withColumn("k3", F.col("fp").bitwiseAND(F.col("mask")))
    return cold.union(_near(hot, [*key, "mask", "k3"]))


def _groups(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, fp), and for each fingerprint its least key, ``root`` and the ``component_id``."""
    prints = stash(fingerprints(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "text", "fp").select("doc", "fp"))
    classes = stash(prints.groupBy("fp").agg(F.min("doc").alias("least")))
    roots = connected_components(links(classes))
    groups = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    member = stash(groups.join(least, "root").select("fp", "least", "root", "component_id"))
    drop(classes, roots)
    return prints, member


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``fp`` (long) and ``component_id``.

    Documents whose fingerprints differ in at most ``MAX_BITS`` bits are linked;
    ``component_id`` is the least key reachable by links. Rows with a null key
    take part and get the least key of their group (null if the group has none);
    repeated rows are rows of one group; an empty table gives an empty one.
    """
    prints, member = _groups(docs, key, text)
    return prints.join(member.select("fp", "component_id"), "fp").select(F.col("doc").alias(key), "fp", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one row of each group of near duplicates: the least by key, then by fingerprint.

    Null keys come last, so such a row stays only in a group without any key.
    Rows are told apart by key and fingerprint: different texts under one key, or
    without a key, are judged each by its own group. Of rows that agree in both,
    one with the least text stays. Columns are untouched.
    """
    prints, member = _groups(docs, key, text)
    first = member.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("keyless"), "least", "fp")).alias("first"))
    stay = stash(first.select(F.col("first.least").alias("cowrie_key"), F.col("first.fp").alias("cowrie_stay")))
    repeated = prints.groupBy("doc", "fp").count().where("count > 1")
    several = not repeated.join(stay, (repeated["fp"] == stay["cowrie_stay"]) & repeated["doc"].eqNullSafe(stay["cowrie_key"]), "left_semi").isEmpty()
    drop(prints, member)
    marked = fingerprints(docs, text, "cowrie_fp")
    # the kept rows grow with the data, so they are never broadcast
    kept = marked.join(stay.hint("merge"), (marked["cowrie_fp"] == stay["cowrie_stay"]) & marked[key].eqNullSafe(stay["cowrie_key"]), "left_semi")
    if several:
        kept = kept.groupBy(key, "cowrie_fp").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.col(text), F.lit(""))).alias("cowrie_row")).select("cowrie_row.*")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
