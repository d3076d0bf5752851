"""Removal of repeated byte strings through run-length indexes.

A window is a string of ``WINDOW`` bytes inside one text. Every byte of a window
that also starts earlier (smaller key, or same text and earlier) is removed.
All windows of the corpus are far too many to shuffle, so

1. texts are dealt into batches, written once into the shared folder. A window's
   anchor is its least-hashed gram of ``GRAM`` bytes, the leftmost on ties, so
   equal windows have equal anchors at equal places. Windows in a row that share
   an anchor form a piece of at most ``2 * WINDOW - GRAM`` bytes;
2. of each batch's different pieces, (anchor, digest, place) is shuffled. A piece
   that an earlier place holds too is removed whole. A piece that is the first
   of its kind needs a closer look only if its anchor lies in other pieces too;
3. the bytes of these go to shards by anchor. A shard sorts them in the order of
   their places and builds a run-length index: the suffixes are sorted, only the
   runs of the Burrows-Wheeler transform are kept, each with the text position
   at its start, the one at the end of the run before, and the length of their
   match. Streamed along the text these samples give each position's matching
   statistic, as both the length and its source move by one from position to
   position until the next sample. Matches of ``WINDOW`` bytes and more link a
   window to a like one; all but the first of each chain are marked;
4. every batch cuts the marked bytes out of its texts.

An anchor that lies in very many different pieces (a frequent line) would fill
one task. These anchors are found on a sample of pieces; windows of their pieces
are shuffled one by one by their own digest, so the result is the same.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cowrie.llm.common import open_path, shared_dir, slices, small_batches, stash, utf8
from cowrie.llm.lm import pack, unpack

#: Bytes of a window and of an anchor.
WINDOW, GRAM = 100, 32
#: Bytes of text in a batch, about (a longer text is a batch of its own), and of pieces in a shard.
BATCH_BYTES, SHARD_BYTES = 8_000_000, 2_000_000
#: One piece in so many is drawn to find anchors with very many pieces; an anchor counts as one from so many drawn on, or an eighth of a partition.
SAMPLE, HOT = 16, 64
_PLACE, _WIDTH, _SEQUENCE = 28, 7, 12  # bits of a place in a batch, of a piece's number of windows, of a task's batches
_CHUNK = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _doubled(x: np.ndarray, length: int, join) -> np.ndarray:
    """Folds of every ``length`` neighbours from folds of 1, 2, 4, ... of them; ``join(left, right, size of the right one)``."""
    parts, have, n, left = [], x, 1, length
    while True:
        if left & n:
            parts.append((have, n))
            left -= n
        if not left:
            break
        have, n = join(have[:-n], have[n:], n), 2 * n
    have, n = parts.pop()
    while parts:
        more, m = parts.pop()
        size = min(len(have), len(more) - n)
        have, n = join(have[:size], more[n : n + size], m), n + m
    return have


def _rolled(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    return x * np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64)) + y


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts that lie one after another: first window, number of windows, place of the anchor."""
    n = len(data)
    inside = np.zeros(max(0, n - WINDOW + 1), bool)
    begin = 0
    for end in ends.tolist():
        inside[begin : max(begin, end - WINDOW + 1)] = True
        begin = end
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    place = np.empty(len(inside), np.int32)
    bits = np.uint64((1 << (_CHUNK.bit_length() + 1)) - 1)
    for a in range(0, len(inside), _CHUNK):
        b = min(len(inside), a + _CHUNK)
        h = _mixed(_doubled(_BYTE[data[a : b + WINDOW - 1]], GRAM, _rolled))
        keyed = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
        place[a:b] = (_doubled(keyed, WINDOW - GRAM + 1, lambda x, y, _: np.minimum(x, y)) & bits).astype(np.int32) + a
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    start = np.nonzero(new)[0]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:]
    return start, np.nonzero(last)[0] + 1 - start, place[start].astype(np.int64)


def _digests(data: memoryview, start: list[int], end: list[int], seed: int) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(data[a:b], seed) for a, b in zip(start, end, strict=True)), np.uint64, len(start))


def _put(path: str, data: bytes) -> None:
    files, where = open_path(path)
    files.create_dir(where.rpartition("/")[0], recursive=True)
    with files.open_output_stream(where, compression=None) as f:
        f.write(data)


class Batch:
    """Texts one after another, the order of their rows, and their pieces."""

    def __init__(self, path: str) -> None:
        files, where = open_path(path)
        with files.open_input_stream(where, compression=None) as f:
            key, tie, size, start, windows, anchor, first, self.data = unpack(f.read())
        self.key, self.tie = key.view(np.int64), tie.astype(np.int64)
        self.ends = np.cumsum(size.astype(np.int64))
        self.start, self.windows, self.first = np.cumsum(start, dtype=np.int64), windows.astype(np.int64), first.astype(bool)
        self.anchor = self.start + anchor.astype(np.int64)

    @staticmethod
    def write(path: str, keys: list[int], texts: list[bytes]) -> tuple[int, int, bytes]:
        """Write a batch; give its bytes, its different pieces and a sample of these as (anchor, digest)."""
        joined = b"".join(texts)
        data, view = np.frombuffer(joined, np.uint8), memoryview(joined)
        if len(data) >= 1 << _PLACE:
            raise ValueError(f"a text has more than {(1 << _PLACE) - 1} bytes")
        ends = np.cumsum([len(x) for x in texts])
        key, tie = np.array(keys, np.int64), np.array([xxhash.xxh64_intdigest(x, 3) & 0xFFFFFF for x in texts], np.int64)
        start, windows, place = anchors(data, ends)
        digest = _digests(view, start.tolist(), (start + windows + WINDOW - 1).tolist(), 1)
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((np.arange(len(key)), tie, key))] = np.arange(len(key))
        order = np.lexsort((start, rank[np.searchsorted(ends, start, "right")], digest))
        first = np.ones(len(start), bool)
        first[order[1:]] = digest[order[1:]] != digest[order[:-1]]
        drawn = np.nonzero(first & (digest % np.uint64(SAMPLE) == 0))[0]
        grams = _digests(view, place[drawn].tolist(), (place[drawn] + GRAM).tolist(), 2)
        small = [np.diff(start, prepend=0).astype("<u4"), windows.astype(np.uint8), (place - start).astype(np.uint8), first.view(np.uint8)]
        _put(path, pack(key, tie.astype("<u4"), np.diff(ends, prepend=0).astype("<u4"), *small, data))
        return len(data), int(first.sum()), np.stack([grams, digest[drawn]], 1).tobytes()


def _deal(folder: str):
    """Write batches of rows (id, text)."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        keys: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            size, pieces, sample = Batch.write(f"{folder}/{name}", keys, texts)
            if made >> _SEQUENCE:
                raise ValueError(f"an input split has more than {1 << _SEQUENCE} batches; raise BATCH_BYTES or lower spark.sql.files.maxPartitionBytes")
            row = (pa.array([(part << _SEQUENCE) | made], pa.int64()), pa.array([name]), pa.array([size], pa.int64()), pa.array([pieces], pa.int64()), pa.array([sample], pa.binary()))
            return pa.RecordBatch.from_arrays(list(row), names=["batch", "name", "bytes", "pieces", "sample"])

        for b in arrow:
            for lo, hi in slices(b.column(1)):
                for key, text in zip(b.column(0).slice(lo, hi - lo).to_pylist(), utf8(b.column(1).slice(lo, hi - lo)), strict=True):
                    if keys and held + len(text) > BATCH_BYTES:
                        yield flush()
                        keys, texts, held, made = [], [], 0, made + 1
                    keys.append(key)
                    texts.append(text)
                    held += len(text)
        if keys:
            yield flush()

    return run


def _drawn(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow:
        for sample in b.column(0).to_pylist():
            x = np.frombuffer(sample, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in (0, 1)], names=["anchor", "digest"])


def _places(folder: str, hot: np.ndarray):
    """(anchor, digest, key, at, width, known) of a batch's different pieces; pieces of hot anchors window by window."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            for number, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                batch = Batch(f"{folder}/{name}")
                view = memoryview(batch.data)
                start, windows, place = (x[batch.first] for x in (batch.start, batch.windows, batch.anchor))
                digest = _digests(view, start.tolist(), (start + windows + WINDOW - 1).tolist(), 1)
                anchor = _digests(view, place.tolist(), (place + GRAM).tolist(), 2)
                known = np.zeros(len(start), bool)
                if len(hot):
                    of = np.isin(anchor, hot)
                    count = windows[of]
                    one = np.repeat(start[of] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                    single = _digests(view, one.tolist(), (one + WINDOW).tolist(), 5)
                    start, windows = np.concatenate([start[~of], one]), np.concatenate([windows[~of], np.ones(len(one), np.int64)])
                    anchor, digest = np.concatenate([anchor[~of], single]), np.concatenate([digest[~of], single])
                row = np.searchsorted(batch.ends, start, "right")
                if len(hot):
                    # of a window that the batch has several times only the first is compared with other batches
                    rank = np.empty(len(batch.key), np.int64)
                    rank[np.lexsort((np.arange(len(batch.key)), batch.tie, batch.key))] = np.arange(len(batch.key))
                    order = np.lexsort((start, rank[row], digest))
                    known = np.zeros(len(start), bool)
                    known[order[1:]] = digest[order[1:]] == digest[order[:-1]]
                    anchor = np.where(known, _mixed(start.astype(np.uint64) ^ np.uint64(number << _PLACE)), anchor)
                cells = anchor.view(np.int64), digest.view(np.int64), batch.key[row], (number << _PLACE) | start, (batch.tie[row] << _WIDTH) | windows
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cells], pa.array(known)], names=["anchor", "digest", "key", "at", "width", "known"])

    return run


def _fetch(folder: str, shards: int):
    """The bytes of the pieces that a batch is asked for, as a message to each shard."""

    def run(table: pa.Table) -> pa.Table:
        names = [x for x in table["name"].to_pylist() if x is not None]
        asked = np.asarray(table["anchor"].is_valid())
        columns = [np.asarray(table[x].filter(pa.array(asked))) for x in ("anchor", "at", "width", "key")]
        out: list[tuple[int, int, bytes]] = []
        if len(columns[0]):
            data = Batch(f"{folder}/{names[0]}").data
            number = table["batch"][0].as_py()
            anchor, at, width, key = columns
            start, windows = at & ((1 << _PLACE) - 1), width & ((1 << _WIDTH) - 1)
            shard = (anchor.view(np.uint64) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((start, shard))
            cuts = np.concatenate([[0], np.nonzero(np.diff(shard[order]))[0] + 1, [len(order)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pick = order[a:b]
                size = windows[pick] + WINDOW - 1
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                body = data[np.repeat(start[pick], size) + step]
                out.append((int(shard[pick[0]]), number, pack(key[pick], (width[pick] >> _WIDTH).astype("<u4"), start[pick].astype("<u4"), size.astype("<u4"), body)))
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["shard", "batch", "data"])

    return run


def suffixes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; ``left`` counts the bytes from each position to the end of its piece.

    A suffix ends with its piece; of equal suffixes the earlier comes first, as
    if each piece ended in a mark of its own.
    """
    n = len(text)
    symbol = np.concatenate([text.astype(np.int64) + 1, np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for t in range(7):
        key = (key << 9) | np.where(left > t, symbol[t : t + n], 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    width = 7
    while True:
        # positions in groups of several, in the order of their groups
        place = rank[order]
        lone = np.ones(n, bool)
        lone[1:] &= place[1:] != place[:-1]
        lone[:-1] &= place[1:] != place[:-1]
        open_ = np.nonzero(~lone)[0]
        open_ = open_[left[order[open_]] > width] if len(open_) and not (left[order[open_]] <= width).any() else open_
        if not len(open_) or (left[order[open_]] <= width).all():
            break
        at = order[open_]
        ahead = np.where(left[at] > width, rank[np.minimum(at + width, n - 1)] + 1, 0)
        pair = (rank[at] << 32) | ahead
        by = np.argsort(pair, kind="stable")
        order[open_] = at[by]
        pair = pair[by]
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[at[by]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(pair)), 0))]
        width *= 2
    return order


class RunIndex:
    """The runs of a Burrows-Wheeler transform with their samples, by text position.

    ``head`` is the text position at the start of a run, ``source`` the one at the
    end of the run before (its predecessor in suffix order), ``match`` how many
    bytes they share.
    """

    def __init__(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        left = np.repeat(begin + size, size) - np.arange(len(text))
        order = suffixes(text, left)
        starts = np.zeros(len(text), bool)
        starts[begin] = True
        before = text[order - 1]  # the transform; a piece's start has a mark of its own there
        mark = starts[order]
        run = np.ones(len(text), bool)
        run[1:] = (before[1:] != before[:-1]) | mark[1:] | mark[:-1]
        at = np.nonzero(run)[0][1:]
        head, source = order[at], order[at - 1]
        match = self._match(text, left, head, source)
        sort = np.argsort(head)
        self.head, self.source, self.match = head[sort], source[sort], match[sort]
        self.n = len(text)

    @staticmethod
    def _match(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(left[a], left[b])
        got = np.zeros(len(a), np.int64)
        wide = np.concatenate([text, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(wide, 8)
        word = np.ascontiguousarray(eight[: len(text)]).view("<u8").ravel()
        at = np.nonzero(most >= 8)[0]
        while len(at):
            at = at[word[a[at] + got[at]] == word[b[at] + got[at]]]
            got[at] += 8
            at = at[got[at] + 8 <= most[at]]
        at = np.nonzero(got < most)[0]
        while len(at):
            at = at[text[a[at] + got[at]] == text[b[at] + got[at]]]
            got[at] += 1
            at = at[got[at] < most[at]]
        return got

    def long_matches(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Stream the matching statistics: positions whose match has ``least`` bytes or more, and where it is."""
        until = np.concatenate([self.head[1:], [self.n]])
        count = np.minimum(self.match - least + 1, until - self.head)
        pick = np.nonzero(count > 0)[0]
        count = count[pick]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(self.head[pick], count) + step, np.repeat(self.source[pick], count) + step


def later_windows(text: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions, ascending, whose window also starts at a smaller position."""
    at, source = RunIndex(text, begin, size).long_matches(window)
    if not len(at):
        return at
    to = np.arange(len(text))
    to[at] = source
    while True:  # to the end of each chain, in doubling steps
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    least = np.arange(len(text))
    every = np.unique(np.concatenate([at, to[at]]))
    np.minimum.at(least, to[every], every)
    return every[every > least[to[every]]]


def _mark(table: pa.Table) -> pa.Table:
    """Index a shard's pieces and mark, for each batch, the stretches that earlier windows cover."""
    heads = [unpack(x.as_py()) for x in table["data"]]
    batch = np.repeat(np.asarray(table["batch"]), [len(h[0]) for h in heads])
    key, tie, start, size, text = (np.concatenate([h[i] for h in heads]) for i in range(5))
    key, tie, start, size = key.view(np.int64), tie.astype(np.int64), start.astype(np.int64), size.astype(np.int64)
    del heads
    order = np.lexsort((start, batch, tie, key))
    old = (np.cumsum(size) - size)[order]
    batch, start, size = batch[order], start[order], size[order]
    begin = np.cumsum(size) - size
    text = text[np.repeat(old - begin, size) + np.arange(len(text))]
    later = later_windows(text, begin, size)
    piece = np.searchsorted(begin, later, "right") - 1
    new = np.ones(len(later), bool)
    new[1:] = (later[1:] != later[:-1] + 1) | (piece[1:] != piece[:-1])
    a = np.nonzero(new)[0]
    b = np.concatenate([a[1:], [len(later)]])[: len(a)] - 1
    where = piece[a]
    low, high = start[where] + later[a] - begin[where], start[where] + later[b] - begin[where] + WINDOW
    out = []
    for number in np.unique(batch[where]):
        mine = np.nonzero(batch[where] == number)[0] if len(where) else where
        out.append((int(number), pack(low[mine].astype("<u4"), high[mine].astype("<u4"))))
    return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()), "data": pa.array([x[1] for x in out], pa.binary())})


def _finish(folder: str):
    """Cut the marked bytes out of a batch's texts."""

    def run(table: pa.Table) -> pa.Table:
        batch = Batch(f"{folder}/{next(x for x in table['name'].to_pylist() if x is not None)}")
        edge = np.zeros(len(batch.data) + 1, np.int32)

        def cover(low: np.ndarray, high: np.ndarray) -> None:
            np.add.at(edge, low, 1)
            np.add.at(edge, high, -1)

        again = ~batch.first
        cover(batch.start[again], batch.start[again] + batch.windows[again] + WINDOW - 1)
        asked = np.asarray(table["at"].is_valid())
        start, width = (np.asarray(table[x].filter(pa.array(asked))).astype(np.int64) for x in ("at", "width"))
        start = start & ((1 << _PLACE) - 1)
        cover(start, start + (width & ((1 << _WIDTH) - 1)) + WINDOW - 1)
        for data in table["data"].drop_null().to_pylist():
            cover(*(x.astype(np.int64) for x in unpack(data)))
        gone = np.cumsum(edge)[:-1] > 0
        begin = np.concatenate([[0], batch.ends[:-1]]).astype(np.int64)
        spans, kept, count = [], [], [0]
        for a, b in zip(begin.tolist(), batch.ends.tolist(), strict=True):
            cut = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
            spans.append(np.stack([np.nonzero(cut == 1)[0], np.nonzero(cut == -1)[0]], 1))
            count.append(count[-1] + len(spans[-1]))
            kept.append(batch.data[a:b][~gone[a:b]].tobytes())
        flat = np.concatenate([np.zeros((0, 2), np.int64), *spans])
        cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1)], ["start", "end"])
        made = pa.ListArray.from_arrays(pa.array(np.array(count, np.int32)), cells)
        return pa.table([pa.array(batch.key), pa.array(batch.ends - begin), made, pa.array(kept, pa.binary())], names=["key", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, spans, kept) of every row: its size, what is removed (array of start, end) and the bytes that stay.

    Rows come by key, null first; rows that share a key by a hash of their text.
    Null texts are empty; texts shorter than a window stay whole; of equal texts
    all but the first lose every byte (if they have a window). Keys are whole
    numbers. ``kept`` is bytes, as a cut may fall inside a character. An empty
    table gives an empty one. A text has less than 256 MB.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}"
    null = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(null)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = stash(rows.mapInArrow(_deal(folder), "batch long, name string, bytes long, pieces long, sample binary"))
    sums = dealt.agg(F.count("*").alias("n"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces")).first()
    tasks = max(1, min(sums.n, max(2 * spark.sparkContext.defaultParallelism, -(-sums.n // 4))))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = dealt.select("sample").mapInArrow(_drawn, "anchor long, digest long").distinct().groupBy("anchor").agg(F.count("*").alias("n"))
    often = often.where(F.col("n") >= max(HOT, sums.pieces // (8 * SAMPLE * partitions)))  # at most some 8 for each partition
    hot = np.array([r.anchor for r in often.select("anchor").collect()], np.int64).view(np.uint64)
    names = dealt.select("batch", "name")
    places = names.repartition(tasks).mapInArrow(_places(folder, hot), "anchor long, digest long, key long, at long, width long, known boolean")
    same = Window.partitionBy("anchor", "digest").orderBy("key", "width", "at")
    every = Window.partitionBy("anchor")
    judged = places.select("*", F.row_number().over(same).alias("nth"), (F.min("digest").over(every) != F.max("digest").over(every)).alias("mixed"))
    told = judged.where("known or nth > 1 or mixed").select(F.shiftright("at", _PLACE).alias("batch"), "at", "width", F.expr("if(known or nth > 1, null, anchor)").alias("anchor"), "key")
    told = stash(told)
    asked = told.where("anchor is not null")
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-asked.count() * (WINDOW + (WINDOW - GRAM) // 2) // SHARD_BYTES))
    request = names.withColumns({"at": F.lit(None).cast("long"), "width": F.lit(None).cast("long"), "anchor": F.lit(None).cast("long"), "key": F.lit(None).cast("long")})
    request = request.unionByName(asked.withColumn("name", F.lit(None).cast("string"))).repartition(tasks, "batch")
    sent = request.groupBy("batch").applyInArrow(_fetch(folder, shards), "shard int, batch long, data binary")
    marks = sent.repartition(shards, "shard").groupBy("shard").applyInArrow(_mark, "batch long, data binary")
    nothing = lambda **kinds: {k: F.lit(None).cast(v) for k, v in kinds.items()}
    parts = names.withColumns(nothing(at="long", width="long", data="binary"))
    parts = parts.unionByName(told.where("anchor is null").select("batch", "at", "width").withColumns(nothing(name="string", data="binary")))
    parts = parts.unionByName(marks.withColumns(nothing(name="string", at="long", width="long"))).repartition(tasks, "batch")
    out = parts.groupBy("batch").applyInArrow(_finish(folder), "key long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.select(F.nullif(F.col("key"), F.lit(null)).cast(docs.schema[key].dataType).alias(key), "n_bytes", "spans", "kept")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes, spans and the digest of what stays, of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs, key, text).select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
