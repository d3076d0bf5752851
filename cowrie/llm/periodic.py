"""Periodic runs of words within a document.

A run is a longest stretch of words with smallest period q that is at least
``LEAST`` words and ``TIMES`` periods long. All its words but the last q recur q
words later, and these are at least ``GRAM`` words in a row. So only words inside
a k-gram (k = ``GRAM``) that its document holds more than once can belong to a
run: one sort of rolling hashes masks all others, and a hash that two k-grams
share only spares words from the mask.

The stretches that survive are searched as Main and Lorentz do: cut in the
middle, find the periods for which matching words reach across the cut, and go
on in both halves. Matches are extended to both sides by comparing names of
blocks of 2, 4, 8, ... words, where equal blocks and only these have equal names;
all cuts of one depth in a slice of rows are extended at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.llm.common import parts_of, utf8, with_columns_from

#: A run has so many words and so many periods at least.
LEAST, TIMES = 24, 3
#: Words in a row that recur one period later in any run: max(LEAST, TIMES * q) - q is least where both bounds meet.
GRAM = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST + 1))
#: Block lengths up to 2 to this power have names; longer matches take several steps.
TOP = 16


class _Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's words as places in a list of different words."""
    known, out = _Numbers(), []
    for text in texts:
        parts = [np.zeros(0, np.int32)]
        for part in parts_of(text):
            words = part.split()
            parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        out.append(np.concatenate(parts))
    return out, list(known)


def planted(words: np.ndarray, h: int) -> np.ndarray:
    """The words with a period planted, if the row's hash says so."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def surviving(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches inside repeated k-grams; ``doc`` numbers the text of each word."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words) < GRAM:
        return none
    h, width = _mixed(words.astype(np.uint64)), 1
    while width < GRAM:  # hashes of ever longer grams; the last doubling overlaps if GRAM is no power of two
        by = min(width, GRAM - width)
        h = _mixed(h[:-by] ^ (h[by:] << np.uint64(1)) ^ (h[by:] >> np.uint64(63)))
        width += by
    whole = doc[: len(h)] == doc[GRAM - 1 :]
    at = np.nonzero(whole)[0]
    key = _mixed(h[at] ^ _mixed(doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[at[again]] += 1
    edges[at[again] + GRAM] -= 1
    inside = np.cumsum(edges)[:-1] > 0
    cut = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    cut_doc = np.nonzero(inside[1:] & inside[:-1] & (doc[1:] != doc[:-1]))[0] + 1  # neighbours of two texts
    starts = np.sort(np.concatenate([np.nonzero(cut == 1)[0], cut_doc]))
    ends = np.sort(np.concatenate([np.nonzero(cut == -1)[0], cut_doc]))
    long = ends - starts >= LEAST
    return starts[long], ends[long]


class Names:
    """Equal numbers for equal blocks of 2^k words, for each k; blocks are compared within one stretch only."""

    def __init__(self, y: np.ndarray, longest: int) -> None:
        self.levels = [np.unique(y, return_inverse=True)[1].astype(np.int32)]
        for k in range(min(TOP, max(0, int(longest).bit_length() - 1))):
            r = self.levels[-1].astype(np.int64)
            right = np.zeros(len(r), np.int64)
            right[: max(0, len(r) - (1 << k))] = r[1 << k :] + 1
            self.levels.append(np.unique((r << 32) | right, return_inverse=True)[1].astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words from i on that equal those from j on."""
        got, n = np.zeros(len(i), np.int64), len(self.levels[0])

        def same(level: int, at: np.ndarray) -> np.ndarray:
            a, b = i[at] + got[at], j[at] + got[at]
            inside = b < n
            inside[inside] = self.levels[level][a[inside]] == self.levels[level][b[inside]]
            return inside

        return self._grow(got, same)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words before i that equal those before j, where i < j."""
        got = np.zeros(len(i), np.int64)

        def same(level: int, at: np.ndarray) -> np.ndarray:
            a, b = i[at] - got[at] - (1 << level), j[at] - got[at] - (1 << level)
            inside = a >= 0
            inside[inside] = self.levels[level][a[inside]] == self.levels[level][b[inside]]
            return inside

        return self._grow(got, same)

    def _grow(self, got: np.ndarray, same) -> np.ndarray:
        every, top = np.arange(len(got)), len(self.levels) - 1
        at = every
        while len(at):  # as many longest blocks as match
            at = at[same(top, at)]
            got[at] += 1 << top
        for level in range(top - 1, -1, -1):
            hit = every[same(level, every)]
            got[hit] += 1 << level
        return got


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item i the numbers 1 .. count[i], one after another, and i for each."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(1, len(of) + 1) - np.repeat(np.cumsum(count) - count, count), of


def runs_in(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, length, smallest period) of all runs within the stretches, in order."""
    size = ends - starts
    if not len(size):
        return np.zeros((0, 3), np.int64)
    # stretches one after another, each between marks that equal nothing else
    offset = np.cumsum(size + 1) - size
    step, of = _spread(size)
    y = np.concatenate([[0], -1 - np.arange(int((size + 1).sum()))])
    y[offset[of] + step - 1] = words[starts[of] + step - 1].astype(np.int64)
    y[0] = -1 - len(y)
    names = Names(y, int(size.max()))
    lo, hi = offset, offset + size
    found = [np.zeros((0, 3), np.int64)]
    while len(lo):
        mid = (lo + hi) >> 1
        most = (hi - lo) // TIMES
        for right in (True, False):  # half of the run or more lies right of the cut, or left of it
            q, of = _spread(np.maximum(np.minimum(most, (hi - 1 - mid) if right else (mid - 1 - lo)), 0))
            c = mid[of]
            keep = np.ones(len(q), bool)
            # half a run past the cut is q words and max(LEAST / 2 - q, q / 2) more that match
            for level, least in ((0, 1), (2, 8), (4, 32)):
                if level >= len(names.levels):
                    continue
                at = np.nonzero(keep & (q >= least))[0]
                left = c[at] if right else c[at] - q[at] - (1 << level)
                keep[at] = names.levels[level][left] == names.levels[level][left + q[at]]
            q, c = q[keep], c[keep]
            i = c if right else c - q
            before, behind = names.backward(i, i + q), names.forward(i, i + q)
            length = before + behind + q
            good = length >= np.maximum(LEAST, TIMES * q)
            found.append(np.stack([i - before, length, q], 1)[good])
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        long = hi - lo >= LEAST
        lo, hi = lo[long], hi[long]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)  # multiples of a run's period share its start and length
    runs = runs[first]
    of = np.searchsorted(offset, runs[:, 0], "right") - 1
    runs[:, 0] += starts[of] - offset[of]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _make(plant: bool):
    def run(columns: list[pa.Array]) -> list[pa.Array]:
        docs, vocabulary = _numbered(utf8(columns[0]))
        if plant:
            docs = [planted(words, h) for words, h in zip(docs, columns[1].to_pylist(), strict=True)]
        size = np.array([len(d) for d in docs], np.int64)
        words, doc = np.concatenate([np.zeros(0, np.int32), *docs]), np.repeat(np.arange(len(docs)), size)
        first = np.cumsum(size) - size
        runs = runs_in(words, *surviving(words, doc))
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        stay = np.cumsum(gone)[:-1] == 0
        kept = (words[a : a + n][stay[a : a + n]].tolist() for a, n in zip(first.tolist(), size.tolist(), strict=True))
        collapsed = pa.array([b" ".join([vocabulary[i] for i in d]) for d in kept], pa.binary()).cast(pa.string())
        of = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(docs)))]).astype(np.int32)
        cells = [pa.array(x) for x in (runs[:, 0] - first[of], runs[:, 1], runs[:, 2])]
        made = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cells, ["start", "length", "period"]))
        return [pa.array(size), made, collapsed]

    return run


def find_runs(docs: DataFrame, text: str = "text", plant: Column | None = None) -> DataFrame:
    """Append ``n_words``, ``runs`` (array of start, length, period) and ``collapsed`` to every row, without a shuffle.

    Words are runs of other than space and the controls 9 to 13. Runs come by
    start, then period. A word is dropped from ``collapsed`` if any run contains
    it behind that run's first period; the words that stay are joined by one
    space. Null and wordless texts have no words, no runs and an empty
    ``collapsed``. ``plant``, a whole number for each row, plants a period in some
    rows first (``planted``), which makes cases with a known answer. Columns of
    the new names are replaced, all others pass through; rows are told apart by
    nothing but their place, so keys may repeat or be null.
    """
    kind = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", kind), T.StructField("collapsed", T.StringType())]
    if plant is None:
        return with_columns_from(docs, [text], fields, _make, False)
    name = "cowrie_plant"
    return with_columns_from(docs.withColumn(name, plant), [text, name], fields, _make, True).drop(name)


def sharpest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones, null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, none, lambda a, r: F.when(better(a, r), r).otherwise(a))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its runs after planting by the key's crc32 (null: of the empty text), the sharpest one, and digests."""
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    found = find_runs(docs.select(key, text), text, h).withColumn("best", sharpest(F.col("runs")))
    line = lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.col("best")
    return found.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        *[best[x].alias(x) for x in ("start", "length", "period")],
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
