"""Toxicity by a convolutional text classifier trained in numpy.

A word's vector joins rows of hashed tables: two of the whole word under
different hashes (so a collision in one seldom matters) and two of its first
bytes. Filters over one, two and three words are max-pooled over the whole text
and a logistic layer gives a probability. A fit learns from every labelled row, in
three passes over Spark's partitions: rows are counted by word bucket, and tables
start from the smoothed log-odds of all of them; shards of rows train in tasks of
their own from that start, and what they moved is averaged; the nets judge rows.
Thresholds are calibrated on logits out of fold: ``FOLDS`` nets each judge the
rows that they did not see, and all of those count. A language's
threshold is drawn towards that of all rows, the less the more toxic rows it
has, and the score is the probability shifted so that its language's threshold
comes out at ``CUT``. All of it is done alike for any number of rows. A text's
language is read off its words, never off a column.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.llm.common import drop, parts_of, slices, small_batches, stash, utf8, with_columns_from

#: Rows and bytes of text of a shard, about: so many are trained on in one task, every row in one shard.
SHARD_ROWS, SHARD_BYTES = 3_000, 32 << 20
#: Score from which a text counts as toxic.
CUT = 0.7
#: Hashed features of a word: bits of the table, seed, bytes of the word (0: all).
TABLES = ((18, 1, 0), (18, 2, 0), (16, 3, 4), (16, 4, 6))
#: Numbers per table row, filters per width, widest filter.
DIM, FILTERS, WIDTHS = 4, 8, 3
STEPS, BATCH, RATE = 200, 64, 0.01
#: Parts that are judged by nets trained on the others, weight of precision in a threshold's F score, and toxic rows that count as much as the overall threshold.
FOLDS, BETA, PRIOR = 3, 0.5, 5
#: Words that pass the filters at a time, when texts are scored.
WINDOW = 200_000
_LANG_BITS = 18
#: Where the rows of each table begin when they are numbered through, and how many there are.
_FIRST = np.cumsum([0] + [1 << bits for bits, _, _ in TABLES])
_ROWS = int(_FIRST[-1])
#: Keys of the sums over tasks, steps of a moved value that count as 1 (sums of whole numbers do not depend on their order), and of a logit.
_PARTS, _GRID, _CELL = 61, 1 << 20, 1 << 10
# ASCII letters to lower case, other ASCII but digits and letters to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: ASCII in lower case and without punctuation, other bytes as they are."""
    return text.translate(_FOLD).split()


class Hasher:
    """Row numbers of words in each table; keeps the words it has seen, up to a bound."""

    MOST = 400_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(TABLES)), np.int32)

    def ids(self, docs: list[list[bytes]]) -> np.ndarray:
        """Table rows of all words of the texts, one after another."""
        if len(self.known) > self.MOST:
            self.known, self.rows = {}, self.rows[:0]
        known, base = self.known, len(self.known)
        at = np.fromiter([known.setdefault(w, len(known)) for d in docs for w in d], np.int64, sum(map(len, docs)))
        if len(known) > base:
            new = list(known)[base:]
            made = [np.fromiter((zlib.crc32(w[:n] if n else w, seed) & ((1 << bits) - 1) for w in new), np.int32, len(new)) for bits, seed, n in TABLES]
            self.rows = np.concatenate([self.rows, np.stack(made, 1)])
        return self.rows[at]


    def rows_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of all texts, and words per text; long texts are split part by part."""
        parts = [(i, words_of(part)) for i, x in enumerate(texts) for part in parts_of(x)]
        size = np.zeros(len(texts), np.int64)
        np.add.at(size, [i for i, _ in parts], [len(words) for _, words in parts])
        return self.ids([words for _, words in parts]), size


class Net:
    """Tables, filters and the logistic layer."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *n: rng.normal(0, 0.1, n).astype(np.float32)
        width = DIM * len(TABLES)
        self.tables = [normal(1 << bits, DIM) * np.float32(0.1) for bits, _, _ in TABLES]
        self.filters = [normal(width * w, FILTERS) for w in range(1, WIDTHS + 1)]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in range(WIDTHS)]
        self.out = np.abs(normal(FILTERS * WIDTHS))
        self.out_bias = np.zeros(1, np.float32)
        for w, f in enumerate(self.filters):  # at first all look for words with high odds
            f[np.arange(len(TABLES)) * DIM] += 0.5 / (w + 1)

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out, self.out_bias]

    def state(self) -> np.ndarray:
        """All numbers in rows of ``DIM``: the tables one after another, then the dense parts."""
        flat = np.concatenate([p.ravel() for p in self.dense()])
        return np.concatenate([*self.tables, np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)])

    def move(self, at: np.ndarray, by: np.ndarray) -> Net:
        """Add to rows of the state."""
        state = self.state()
        state[at] += by
        self.tables = [state[a:b].copy() for a, b in zip(_FIRST[:-1], _FIRST[1:], strict=True)]
        flat, done = state[_ROWS:].ravel(), 0
        for p in self.dense():
            p[...] = flat[done : done + p.size].reshape(p.shape)
            done += p.size
        return self

    def forward(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of texts whose words' table rows follow one another."""
        width = DIM * len(TABLES)
        x = np.zeros((len(ids) + WIDTHS - 1, width), np.float32)
        for k, t in enumerate(self.tables):
            x[: len(ids), k * DIM : (k + 1) * DIM] = t[ids[:, k]]
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        full = size > 0
        pooled = np.full((len(size), FILTERS * WIDTHS), -1e9, np.float32)
        each = []
        for w in range(1, WIDTHS + 1):
            y = np.zeros((len(ids), FILTERS), np.float32)
            for j in range(w):
                y += x[j : j + len(ids)] @ self.filters[w - 1][j * width : (j + 1) * width]
            # a window may not reach into the next text
            for j in range(1, w):
                last = (first + size - j)[size >= j]
                y[last] = np.float32(-1e9)
            each.append(y)
            if full.any():
                got = np.maximum.reduceat(y, first[full], axis=0)
                pooled[full, (w - 1) * FILTERS : w * FILTERS] = got + self.bias[w - 1]
        hidden = np.maximum(pooled, 0)
        return hidden @ self.out + self.out_bias[0], {"x": x, "each": each, "first": first, "hidden": hidden}

    def gradient(self, ids: np.ndarray, size: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """Gradients of the dense parts and, per table, of the rows at the maxima."""
        logits, kept = self.forward(ids, size)
        delta = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - target) * weight / len(size)).astype(np.float32)
        width = DIM * len(TABLES)
        hidden, x, first = kept["hidden"], kept["x"], kept["first"]
        g_filters = [np.zeros_like(f) for f in self.filters]
        g_bias = [np.zeros_like(b) for b in self.bias]
        rows: list[np.ndarray] = []
        g_rows: list[np.ndarray] = []
        for w in range(1, WIDTHS + 1):
            part = slice((w - 1) * FILTERS, w * FILTERS)
            d = delta[:, None] * self.out[part] * (hidden[:, part] > 0)
            g_bias[w - 1] = d.sum(0)
            y = kept["each"][w - 1]
            top = np.stack([y[a : a + n].argmax(0) + a if n else np.zeros(FILTERS, np.int64) for a, n in zip(first, size, strict=True)])
            for j in range(w):
                at = top + j
                f = self.filters[w - 1][j * width : (j + 1) * width]
                g_filters[w - 1][j * width : (j + 1) * width] = np.einsum("dfk,df->kf", x[at], d)
                inside = (at < (first + size)[:, None]) & (d != 0)
                rows.append(at[inside])
                g_rows.append((d[..., None] * f.T[None])[inside])
        at, g = np.concatenate(rows), np.concatenate(g_rows)
        sparse = [(ids[at, k], g[:, k * DIM : (k + 1) * DIM]) for k in range(len(TABLES))]
        return [*g_filters, *g_bias, hidden.T @ delta, np.array([delta.sum()], np.float32)], sparse


def train(net: Net, ids: list[np.ndarray], target: np.ndarray, pos: int, neg: int, seed: int = 3) -> Net:
    """Train on texts given as table rows, some or all of ``pos`` toxic and ``neg`` clean ones; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.dense()]
    step = 0
    weight = np.where(target > 0, (pos + neg) / (2 * pos), (pos + neg) / (2 * neg))
    for _ in range(-(-STEPS // -(-(pos + neg) // BATCH))):  # passes over the rows, for about as many steps at any size; one at least
        order = rng.permutation(len(target))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            size = np.array([len(ids[i]) for i in pick])
            if not size.sum():
                continue
            dense, sparse = net.gradient(np.concatenate([ids[i] for i in pick]), size, target[pick], weight[pick])
            step += 1
            for p, g, (m, v) in zip(net.dense(), dense, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            for t, (rows, g) in zip(net.tables, sparse, strict=True):
                np.subtract.at(t, rows, np.float32(0.1) * g)
    return net


def logits_of(net: Net, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logits of texts in windows of ``WINDOW`` words.

    Windows of one text overlap by what the widest filter needs, and the maxima of
    its windows are joined, so the result is that of the whole text.
    """
    end = np.cumsum(size)
    out, i = np.zeros(len(size)), 0
    while i < len(size):
        if size[i] <= WINDOW:
            j = max(i + 1, int(np.searchsorted(end, end[i] - size[i] + WINDOW, "right")))
            out[i:j] = net.forward(ids[end[i] - size[i] : end[j - 1]], size[i:j])[0]
            i = j
            continue
        text = ids[end[i] - size[i] : end[i]]
        starts = range(0, len(text) - WIDTHS + 1, WINDOW - WIDTHS + 1)
        hidden = [net.forward(text[a : a + WINDOW], np.array([len(text[a : a + WINDOW])]))[1]["hidden"][0] for a in starts]
        out[i] = np.max(hidden, 0) @ net.out + net.out_bias[0]
        i += 1
    return out


def threshold(logits: np.ndarray, target: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The logit with the best F score (``BETA``), in the middle of the gap below it.

    With ``rows``, a logit stands for so many rows and ``target`` has its toxic
    ones. Half of the marked rows must be toxic at least; where no logit does that,
    and without toxic rows, it is one above all logits.
    """
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(target[order])
    marked = np.cumsum(np.ones(len(order), np.int64) if rows is None else rows[order])
    score = (1 + BETA**2) * hits / (marked + BETA**2 * target.sum())
    score[2 * hits < marked] = 0
    if not score.any():
        return float(logits.max() + 1)
    k = int(score.argmax())
    low = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 2
    return float((logits[order[k]] + low) / 2)


def _add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two sparse tables of whole numbers, each as places, none twice, and their rows of values."""
    at, values = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.nonzero(np.diff(at, prepend=-1))[0]
    return at[first], np.add.reduceat(values[order], first, axis=0, dtype=np.int64) if len(at) else values.astype(np.int64)


_SPARSE = "part int, at binary, n binary"


def _sparse(at: np.ndarray, values: np.ndarray, together: int = 1) -> pa.RecordBatch:
    """A sparse table in ``_PARTS`` parts; places with one quotient by ``together`` stay together."""
    part = at // together % _PARTS
    own = [part == p for p in range(_PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([at[o].astype("<i8").tobytes() for o in own], pa.binary()), pa.array([values[o].astype("<i4").tobytes() for o in own], pa.binary())], names=["part", "at", "n"])


def _sums(made: DataFrame, width: int, finish) -> list:
    """What ``finish`` makes, in tasks, of each part of the sum of all sparse tables of ``width`` values a place."""
    tables = made.rdd.map(lambda r: (r.part, (np.frombuffer(r.at, "<i8"), np.frombuffer(r.n, "<i4").reshape(-1, width))))
    return tables.reduceByKey(_add).mapValues(lambda total: finish(*total)).values().collect()


def _count(names: list[str]):
    """Rows that hold each table row, by part and class, and by language for the first table."""
    number, width = {x: i for i, x in enumerate(names)}, 2 * FOLDS + len(names)

    def run(batches):
        hasher, total = Hasher(), (np.zeros(0, np.int64), np.zeros((0, 1), np.int64))
        for batch in batches:
            for a, b in slices(batch["text"]):
                rows = batch.slice(a, b - a)
                ids, size = hasher.rows_of(utf8(rows["text"]))
                doc = np.repeat(np.arange(len(size)), size)
                held = np.unique((doc[:, None] * _ROWS + ids + _FIRST[:-1]).ravel())
                doc, at = held // _ROWS, held % _ROWS
                kind = 2 * np.asarray(rows["fold"]) + np.asarray(rows["toxic"])
                tongue = np.array([number.get(x, -1) for x in rows["lang"].to_pylist()], np.int64)[doc]
                told = (tongue >= 0) & (at < 1 << _LANG_BITS)
                seen = np.concatenate([at * width + kind[doc], at[told] * width + 2 * FOLDS + tongue[told]])
                at, n = np.unique(seen, return_counts=True)
                total = _add(total, (at, n[:, None]))
        yield _sparse(*total, width)

    return run


def _odds(seen: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the tables of a net start from, of rows that hold each table row and of all rows, by class."""
    odds = np.log((seen[:, 1] + 1) / (size[1] + 2)) - np.log((seen[:, 0] + 1) / (size[0] + 2))
    return (np.where(seen.sum(1) >= 3, np.clip(odds, -2, 4), 0) / 4).astype(np.float32)


def _start(counted: tuple[np.ndarray, np.ndarray], fold: int) -> Net:
    """A net before training."""
    net, (at, odds) = Net(), counted
    for k, table in enumerate(net.tables):
        table[:, 0] = 0
        own = (at >= _FIRST[k]) & (at < _FIRST[k + 1])
        table[at[own] - _FIRST[k], 0] = odds[own, fold]
    return net


def _train_shard(counted, sizes: np.ndarray):
    """Train a net on all rows of the shard but those of one part, for each part and for none; what it moved, and a 1 for each row moved."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        table = table.sort_by("k")
        hasher, ids = Hasher(), []
        for batch in table.to_batches():
            for a, b in slices(batch["text"]):
                found, size = hasher.rows_of(utf8(batch["text"].slice(a, b - a)))
                ids += np.split(found, np.cumsum(size)[:-1])
        target, part = np.asarray(table["toxic"]).astype(float), np.asarray(table["fold"])
        places, values = [], []
        for fold in range(FOLDS + 1):
            rows = np.nonzero(part != fold)[0]
            neg, pos = sizes[fold]
            if not (pos and neg and len(rows)):
                continue
            net = _start(counted.value, fold)
            before = net.state()
            by = train(net, [ids[i] for i in rows], target[rows], pos, neg, 3 + shard).state() - before
            at = np.nonzero(by.any(1))[0]
            places.append(fold * len(by) + at)
            values.append(np.pad(np.rint(by[at].astype(float) * _GRID).astype(np.int64), ((0, 0), (0, 1)), constant_values=1))
        return pa.Table.from_batches([_sparse(np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros((0, DIM + 1), np.int64)]))])

    return run


def _nets(counted, moved, sizes: np.ndarray, folds) -> dict[int, Net]:
    """Trained nets of those parts that leave rows of both classes."""
    out, (at, by) = {}, moved
    for fold in (f for f in folds if sizes[f].all()):
        net = _start(counted, fold)
        n = len(net.state())
        own = at // n == fold
        out[fold] = net.move(at[own] % n, by[own])
    return out


def spoken_of(tongue: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The language of each text by its words; the first one for texts without words."""
    spoken, full = np.zeros(len(size), np.int64), size > 0
    if tongue.shape[1] and full.any():
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        spoken[full] = np.add.reduceat(tongue[ids[:, 0]], first[full], axis=0).argmax(1)
    return spoken


def _judge(shared, sizes: np.ndarray):
    """Language, logit on a grid and class of each row, by the net that did not see it."""

    def run(batches):
        counted, moved, tongue = shared.value
        hasher, nets = Hasher(), _nets(counted, moved, sizes, range(FOLDS))
        for batch in batches:
            for a, b in slices(batch["text"]):
                rows = batch.slice(a, b - a)
                ids, size = hasher.rows_of(utf8(rows["text"]))
                fold, spoken, cell = np.asarray(rows["fold"]), spoken_of(tongue, ids, size), np.zeros(len(size), np.int64)
                for f, net in nets.items():
                    own = fold == f
                    cell[own] = np.rint(logits_of(net, ids[np.repeat(own, size)], size[own]) * _CELL).astype(np.int64)
                judged = np.isin(fold, list(nets))
                yield pa.RecordBatch.from_arrays([pa.array(spoken[judged]), pa.array(cell[judged]), pa.array(np.asarray(rows["toxic"])[judged].astype(np.int64))], names=["spoken", "cell", "toxic"])

    return run


def calibrate(logits: np.ndarray, target: np.ndarray, spoken: np.ndarray, languages: int, rows: np.ndarray | None = None) -> np.ndarray:
    """A threshold for each language, from logits out of fold."""
    overall = threshold(*_alike(logits, target, rows))
    cuts = []
    for k in range(max(1, languages)):
        own = spoken == k
        n = target[own].sum()
        cuts.append((n * threshold(logits[own], target[own], None if rows is None else rows[own]) + PRIOR * overall) / (n + PRIOR) if n else overall)
    return np.array(cuts)


def _alike(logits: np.ndarray, target: np.ndarray, rows: np.ndarray | None) -> tuple:
    """Equal logits of several languages as one."""
    if rows is None:
        return logits, target, None
    at, where = np.unique(logits, return_inverse=True)
    return at, np.bincount(where, target), np.bincount(where, rows)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str | None = "lang", toxic: str = "toxic") -> tuple:
    """Learn from all labelled rows.

    Rows of ``labels`` that share a key count once, as toxic if any says so; null
    labels and keys are left out. ``lang`` names the languages for which
    thresholds are calibrated (none: one threshold); those without a toxic row
    have the threshold of all. Where no net can judge a toxic row unseen (there is
    but one) the threshold is even odds. Without any toxic or any clean row every
    score is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(toxic).cast("int").alias("toxic"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"))
    # rows that share a key are one
    found = rows.join(known, "k").groupBy("k", "toxic").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("least")).select(F.col("k").cast("string").alias("k"), "toxic", "least.*")
    kept = stash(found.withColumn("fold", (F.crc32(F.concat(F.lit("calibrate "), "k").cast("binary")) % FOLDS).cast("int")))
    try:
        return _fit(kept)
    finally:
        drop(kept)


def _fit(rows: DataFrame) -> tuple:
    """``fit`` for one row of each key: k, toxic, text, lang, fold."""
    spark = rows.sparkSession
    by = rows.groupBy("fold", "toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    parts = np.zeros((FOLDS + 1, 2), np.int64)
    for r in by:
        parts[r.fold, r.toxic] = r.n
    sizes = parts.sum(0) - parts  # rows that each net learns from, by class; the last one from all
    if not sizes[FOLDS].all():
        return None
    names = sorted(r.lang for r in rows.select("lang").where("lang IS NOT NULL").distinct().collect())

    width = 2 * FOLDS + len(names)

    def started(places: np.ndarray, n: np.ndarray):
        at, where = np.unique(places // width, return_inverse=True)
        seen = np.zeros((len(at), width), np.int64)
        seen[where, places % width] = n[:, 0]
        each = seen[:, : 2 * FOLDS].reshape(-1, FOLDS, 2)
        odds = np.stack([_odds(each.sum(1) - (each[:, f] if f < FOLDS else 0), sizes[f]) for f in range(FOLDS + 1)], 1)
        some, spoken = odds.any(1), at < 1 << _LANG_BITS
        return at[some].astype(np.int32), odds[some], at[spoken].astype(np.int32), seen[spoken, 2 * FOLDS :].astype(np.float32)

    got = _sums(rows.mapInArrow(_count(names), _SPARSE), 1, started)
    counted = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    counts = np.zeros((1 << _LANG_BITS, len(names)), np.float32)
    for _, _, at, n in got:
        counts[at] = n
    tongue = np.log(counts + 0.2) - np.log(counts.sum(0) + 0.2 * len(counts))
    tongue = (tongue - tongue.max(1, keepdims=True) if names else tongue).astype(np.float32)

    def averaged(at: np.ndarray, sums: np.ndarray):
        return at.astype(np.int32), (sums[:, :DIM] / sums[:, DIM:] / _GRID).astype(np.float32)

    shards = max(-(-int(parts.sum()) // SHARD_ROWS), -(-sum(r.bytes for r in by) // SHARD_BYTES))
    dealt = rows.drop("lang").withColumn("shard", F.pmod(F.xxhash64("k", F.lit("shard")), F.lit(shards)).cast("int")).repartitionByRange(shards, "shard")
    trained = dealt.groupBy("shard").applyInArrow(_train_shard(spark.sparkContext.broadcast(counted), sizes), _SPARSE)
    got = _sums(trained, DIM + 1, averaged)
    moved = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    whole = _nets(counted, moved, sizes, [FOLDS])[FOLDS]
    state = [t.astype(np.float16) for t in whole.tables], whole.filters, whole.bias, whole.out, whole.out_bias
    judged = rows.mapInArrow(_judge(spark.sparkContext.broadcast((counted, moved, tongue)), sizes), "spoken long, cell long, toxic long")
    # one row for each language and step of the grid
    cells = judged.groupBy("spoken", "cell").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).orderBy("spoken", "cell").collect()
    told = np.array([[r.spoken, r.cell, r.toxic, r.n] for r in cells], np.int64).reshape(-1, 4).T
    if not told[2].any():  # one toxic row: no net can judge it unseen
        return state, tongue, np.full(max(1, len(names)), 0.0)
    return state, tongue, calibrate(told[1] / _CELL, told[2].astype(float), told[0], len(names), told[3])


def _make(shared):
    model = shared.value
    hasher, net = Hasher(), Net()
    if model is not None:
        (tables, net.filters, net.bias, net.out, net.out_bias), tongue, cuts = model
        net.tables = [t.astype(np.float32) for t in tables]
        hidden_cut = np.log(CUT / (1 - CUT))

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        n = len(columns[0])
        if model is None:
            return [pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32))]
        ids, size = hasher.rows_of(utf8(columns[0]))
        logits = logits_of(net, ids, size)
        score = 1 / (1 + np.exp(-np.clip(logits - cuts[spoken_of(tongue, ids, size)] + hidden_cut, -40, 40)))
        return [pa.array(score), pa.array((score >= CUT).astype(np.int32))]

    return run


def score(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from ``CUT`` on) to every row, over whole texts.

    Null and empty texts get the score of a text without findings. Columns of
    these names are replaced; other columns pass through; equal texts get equal
    scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns_from(docs, [text], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], _make, shared)
