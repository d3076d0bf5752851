"""Language identification: script ranges, per-word scores and a Viterbi path.

A word's script narrows its candidates to the languages that use the script in
training. Each candidate scores the word by hashed character n-grams and by the
whole word (smoothed log-probabilities from counts). A Viterbi path over the
words with a penalty for switching labels spans of mixed-language text.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.llm.common import parts_of, small_batches, utf8, with_columns_from

#: Rows that a fit learns from, at most: about so many, drawn by a hash of the key.
FIT_ROWS = 6_000
#: Languages from which a fit refuses to learn; a language takes 256 kB of the model.
LANGUAGES = 2_000
#: Hash buckets of the features.
BUCKETS = 1 << 16
#: Natural-log cost of a change of language between two words.
SWITCH = 6.0
#: Most that one word's best language gains over another, in natural logs.
CLIP = 8.0
UNDETERMINED = "und"

# First and last code point of script ranges.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
_NAMES = list(SCRIPTS)
_EDGES = sorted((a, b, i) for i, n in enumerate(_NAMES) for a, b in SCRIPTS[n])
_TRIM = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + b"[\\]^_`{|}~"


def script_of(word: str) -> int:
    """Index of the first letter's script; -1 without letters, ``len(SCRIPTS)`` for another script."""
    for ch in word:
        if ch.isalpha():
            at = ord(ch)
            return next((i for a, b, i in _EDGES if a <= at <= b), len(_NAMES))
    return -1


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words' features (byte 1- to 4-grams with word ends, whole word) and each word's first place."""
    marked = [b"^" + w + b"$" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(data))  # bytes from here to the word's end
    out, place = [], []
    h = np.zeros(len(data), np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            h[: len(data) - n + 1] = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
            inside = left >= n
            mixed = (h[inside] ^ (h[inside] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(64 - 16)).astype(np.int64))
            place.append(owner[inside])
    whole = np.fromiter((zlib.crc32(w, 99) & (BUCKETS - 1) for w in words), np.int64, len(words))
    return np.concatenate([*out, whole]), np.concatenate([*place, np.arange(len(words))])


@dataclass
class Model:
    """Languages, the log-score of each feature bucket, the scripts each language uses, and their shares."""

    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # scripts + 2 (other, none) x languages, bool
    prior: np.ndarray


def _lower(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode() if not text.isascii() else text.lower()


def _count(names: list[str]):
    """Feature counts (kind 0) and script counts (kind 1) of each language over the rows of a task.

    A word counts by the root of its number in a text, in thousandths, so the sums
    do not depend on how rows are dealt over tasks.
    """

    def run(batches):
        at = {n: i for i, n in enumerate(names)}
        counts: dict[int, np.ndarray] = {}
        scripts = np.zeros((len(names), len(_NAMES) + 2), np.int64)
        for batch in batches:
            for text, lang in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words: dict[bytes, int] = {}
                for part in parts_of(text):
                    for w in _lower(part).split():
                        w = w.strip(_TRIM)
                        words[w] = words.get(w, 0) + 1
                words.pop(b"", None)
                if words:
                    k, listed = at[lang], list(words)
                    n = np.rint(1000 * np.sqrt(np.fromiter(words.values(), np.float64, len(words)))).astype(np.int64)
                    buckets, owner = _features(listed)
                    np.add.at(counts.setdefault(k, np.zeros(BUCKETS, np.int64)), buckets, n[owner])
                    np.add.at(scripts[k], [script_of(w.decode("utf-8", "replace")) for w in listed], 1)
        for k, mine in counts.items():
            for kind, table in ((0, mine), (1, scripts[k])):
                full = np.nonzero(table)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), kind, np.int32)), pa.array(np.full(len(full), k, np.int32)), pa.array(full.astype(np.int32)), pa.array(table[full])], names=["kind", "lang", "at", "n"])

    return run


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", limit: int = FIT_ROWS) -> Model:
    """Learn from about ``limit`` of the rows with a label, drawn by a hash of the key.

    Every label is learned, from as many rows of each as there are; more than
    ``LANGUAGES`` labels raise an error. Counts are made where the rows lie and
    added up before they reach the driver. Null labels are left out; without any
    label the model knows no language and every text is undetermined.
    """
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("k")).where("lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES) + 2, 0), bool), np.zeros(0))
    n, total = len(names), sum(sizes.values())
    each = max(1, limit // n)  # of each language as many, so rare ones are learned as well
    share = F.element_at(F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, each / sizes[name]))]), F.col("lang"))
    drawn = rows.where(F.pmod(F.xxhash64("k", F.lit("fit")), F.lit(1 << 30)) < share * (1 << 30))
    made = drawn.select("text", "lang").mapInArrow(_count(names), "kind int, lang int, at int, n long").groupBy("kind", "lang", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, k, at, times = (made[c].to_numpy() for c in ("kind", "lang", "at", "n"))
    counts, scripts = np.zeros((BUCKETS, n)), np.zeros((len(_NAMES) + 2, n))
    counts[at[kind == 0], k[kind == 0]] = times[kind == 0] / 1000
    scripts[at[kind == 1], k[kind == 1]] = times[kind == 1]
    alpha = 0.5
    scores = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * BUCKETS)
    scores -= scores.mean(1, keepdims=True)
    used = scripts >= np.maximum(1, 0.001 * scripts.sum(0))
    return Model(names, scores.astype(np.float32), used, np.array([sizes[x] / total for x in names]))


class Scorer:
    """Scores words once and keeps what it has seen, up to a bound."""

    MOST_NUMBERS = 4_000_000

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.rows = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def ids(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Row numbers in ``rows`` of the words of each text."""
        if len(self.known) * len(self.model.languages) > self.MOST_NUMBERS:
            self.known, self.rows = {}, self.rows[:0]
        known = self.known
        base = len(known)
        out = [np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words)) for words in docs]
        if len(known) > base:
            self.rows = np.concatenate([self.rows, self._score(list(known)[base:])])
        return out

    def _score(self, words: list[bytes]) -> np.ndarray:
        m = self.model
        clean = [w.strip(_TRIM) for w in words]
        buckets, owner = _features(clean)
        total = np.zeros((len(words), len(m.languages)), np.float32)
        for k in range(len(m.languages)):
            total[:, k] = np.bincount(owner, m.scores[buckets, k], len(words))
        parts = np.bincount(owner, minlength=len(words))
        total *= (4.0 / np.sqrt(np.maximum(parts, 16)))[:, None]  # n-grams overlap: they are not independent
        kind = np.fromiter((0 if w.isascii() and w.isalpha() else script_of(w.decode("utf-8", "replace")) for w in clean), np.int64, len(words))
        fits = m.scripts[kind]
        total = np.where(fits | ~fits.any(1, keepdims=True), total, total.min(1, keepdims=True) - CLIP)
        total = np.maximum(total - total.max(1, keepdims=True), -CLIP)
        total[(kind < 0) | ~fits.any(1)] = 0  # no letter, or a script that no language uses: says nothing
        return total


def viterbi(texts: list[np.ndarray], rows: np.ndarray, switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each text (places in ``rows``, the scores of words); texts run in step.

    A word takes a few bytes beside one bit for each language, so a very long
    text fits; values are kept relative to the best one, so none loses digits.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    size = np.array([len(texts[i]) for i in order])
    if not len(size) or not size[0]:
        return [np.zeros(0, np.int16) for _ in texts]
    n = rows.shape[1]
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts longer than t
    first = np.concatenate([[0], np.cumsum(active)])
    # word t of the i-th longest text lies at first[t] + i
    flat = np.empty(first[-1], np.int32)
    for i, o in enumerate(order):
        flat[first[: size[i]] + i] = texts[o]
    best = np.empty(first[-1], np.int16)  # the best language before a switch
    stay = np.empty((first[-1], (n + 7) // 8), np.uint8)
    d = np.zeros((len(size), n), np.float32)
    for t in range(size[0]):
        a = active[t]
        now = d[:a]
        top = now.argmax(1)
        now = now - now[np.arange(a), top][:, None]
        s = slice(first[t], first[t] + a)
        best[s] = top
        stay[s] = np.packbits(now >= -switch, axis=1)
        d[:a] = np.maximum(now, -switch) + rows[flat[s]]
    path = np.empty(first[-1], np.int16)
    state = np.zeros(len(size), np.int64)
    was = 0
    for t in range(size[0] - 1, -1, -1):
        a = active[t]
        state[was:a] = d[was:a].argmax(1)
        was = a
        s = slice(first[t], first[t] + a)
        path[s] = state[:a]
        keep = stay[s][np.arange(a), state[:a] >> 3] >> (7 - (state[:a] & 7)).astype(np.uint8) & 1 > 0
        state[:a] = np.where(keep, state[:a], best[s])
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(texts)
    for i, o in enumerate(order):
        out[o] = path[first[: size[i]] + i]
    return out


def _make(model: Model, spans: bool):
    scorer = Scorer(model)
    names = model.languages

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        raw = utf8(columns[0])
        lettered = [any(c.isalpha() for part in parts_of(x) for c in part.decode("utf-8", "replace")) for x in raw]
        parts = [(i, _lower(part).split()) for i, x in enumerate(raw) for part in parts_of(x)] if names else []
        numbers = scorer.ids([words for _, words in parts]) if names else []
        ids = [[np.zeros(0, np.int64)] for _ in raw]
        for (i, _), at in zip(parts, numbers, strict=True):
            ids[i].append(at)
        ids = [np.concatenate(x) for x in ids]
        paths = viterbi(ids, scorer.rows) if names else ids
        silent = scorer.rows.min(1, initial=0) >= 0
        pred, score, marks = [], [], []
        for i, path in enumerate(paths):
            if not names or not lettered[i]:
                pred.append(UNDETERMINED)
                score.append(0.0)
                marks.append([])
                continue
            says = ~silent[ids[i]]
            told = np.bincount(path[says], minlength=len(names)) if says.any() else model.prior
            k = int(np.argmax(told))
            pred.append(names[k])
            score.append(float(told[k] / told.sum()))
            if spans:
                cut = np.nonzero(np.diff(path))[0] + 1
                marks.append([{"first": int(a), "last": int(b) - 1, "lang": names[path[a]]} for a, b in zip([0, *cut], [*cut, len(path)], strict=True)])
        out = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
        return [*out, pa.array(marks, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])))] if spans else out

    return run


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """Append ``lang_pred``, ``score`` and, if asked for, ``lang_spans`` to every row.

    ``lang_spans`` lists runs of words (first and last word, language) on the
    best path. ``lang_pred`` is the language with most telling words and
    ``score`` its share of them. Null, empty and letterless texts are ``und`` with
    score 0 and no spans; a text of scripts that no language uses gets the
    commonest language with its share of the training rows. Columns of these
    names are replaced; other columns pass through; whole texts are read.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.scripts, model.prior))
    return with_columns_from(docs, [text], [*fields, T.StructField("lang_spans", _SPANS)] if spans else fields, _from_broadcast, shared, spans)


def _from_broadcast(shared, spans: bool):
    return _make(Model(*shared.value), spans)


def keeps(identified: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose language is determined and holds at least ``least`` of the telling words."""
    return identified.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
