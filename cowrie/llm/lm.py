"""Language-model scores from a compact n-gram trie, dealt over shards by key range.

The model is an interpolated trigram with absolute discounting. Words are 64-bit
hashes, and n-grams are ordered by the hashes of their words, a prefix before
what follows it. So a shard, a range of that order, holds a part of one trie; a
context that a limit cuts in two lies in both shards, and a hot word or pair of
words fills as many shards as it needs. Neither the driver nor a task ever holds
the model:

1. a scan task turns its rows into batches of ``BATCH_TOKENS`` tokens, written once
   into the shared folder as local word numbers; a sample of n-grams gives the
   limits of the shards;
2. a batch sends each shard its distinct n-grams in that range, as a trie of its
   own with the number of training occurrences;
3. a shard adds these up and builds its part of the trie in memory-mapped levels:
   sorted words, Elias-Fano coded monotone pointers to the successors, Elias-Fano
   coded successors relative to their context, and 16-bit codes of the smoothed
   (discounted) probabilities on one fixed grid. The n-grams asked for are looked
   up in it: a successor search within the context's range, level by level;
4. the answers go back to the batch, which adds up the numbers of successors of a
   context that lies in several shards, and scores its rows.

All probabilities of words after a context sum to 1 over the words of training
and one unseen word, as in add-one counting: each word that training lacks has
that word's probability, which is below that of a word seen once.

Counts, numbers of successors and the grid depend on the training rows alone, so
the scores do not depend on batches, shards or partitions. What is sent is at
most one n-gram a token, however many batches and shards there are.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cowrie.llm.common import crc_bucket, open_path, parts_of, shared_dir, slices, small_batches, stash, utf8

#: What each different successor of a context gives up, and each different word.
DISCOUNT, DISCOUNT_1 = 0.75, 0.5
#: Tokens of a batch and n-grams asked of a shard, about; a longer text is a batch of its own.
BATCH_TOKENS, SHARD_NGRAMS = 2_500_000, 2_000_000
#: Bits of a successor's id in the two lower levels.
BITS_2, BITS_3 = 40, 32
# The grid of counts, exact up to the first, then in steps of natural logs; code 0 is absent.
_EXACT, _STEP = 1 << 15, 5e-4
_END = np.uint64(xxhash.xxh64_intdigest(b"\x00end", 0))
_BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\x00begin", 0))
_MASK = np.uint64((1 << 32) - 1)
_32 = np.uint64(32)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, compressed byte plane by byte plane: the upper bytes of small numbers cost next to nothing."""
    head = np.array([len(arrays), *[v for x in arrays for v in (x.itemsize, len(x))]], "<i8").tobytes()
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    raw = b"".join([head, *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, as unsigned numbers of the same widths."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for width, size in head.tolist():
        planes = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(size))
        at += width * size
    return out


def encode_counts(n: np.ndarray) -> np.ndarray:
    """16-bit codes of discounted counts; 0 for a count of 0."""
    code = np.where(n > _EXACT, _EXACT + np.rint(np.log(np.maximum(n, _EXACT) / _EXACT) / _STEP), n)
    return np.minimum(code, 65_535).astype("<u2")


def decode_counts(code: np.ndarray) -> np.ndarray:
    """Discounted counts of codes; 0 for code 0."""
    far = np.maximum(code.astype(np.float64) - _EXACT, 0)
    return np.where(code > _EXACT, _EXACT * np.exp(far * _STEP), code) - DISCOUNT * (code > 0)


class Words(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_numbers(text: bytes, known: Words) -> np.ndarray:
    """Numbers of a text's words: A-Z are lower-cased, words are runs of other than space and the controls 9 to 13."""
    parts = []
    for part in parts_of(text):
        words = part.lower().split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


class Batch:
    """Rows and their tokens, as places in the sorted list of the batch's words."""

    def __init__(self, keys: np.ndarray, size: np.ndarray, train: np.ndarray, words: np.ndarray, ids: np.ndarray) -> None:
        self.keys, self.size, self.train, self.words, self.ids = keys.view(np.int64), size.astype(np.int64), train.astype(bool), words, ids.astype(np.uint64)

    def data(self) -> bytes:
        return pack(self.keys, self.size.astype("<u4"), self.train.view(np.uint8), np.diff(self.words, prepend=np.uint64(0)), self.ids.astype("<u4"))

    @staticmethod
    def read(path: str) -> Batch:
        files, place = open_path(path)
        with files.open_input_stream(place, compression=None) as f:
            keys, size, train, words, ids = unpack(f.read())
        return Batch(keys, size, train, np.cumsum(words, dtype=np.uint64), ids)

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of the word before each token, and which tokens are a row's first."""
        first = np.zeros(len(self.ids), bool)
        first[np.cumsum(self.size) - self.size] = True
        left = np.empty_like(self.ids)
        left[1:] = self.ids[:-1]
        left[first] = np.searchsorted(self.words, _BEGIN)
        return left, first

    def ngrams(self) -> None:
        """Distinct pairs (place of the left word, place of the word) and triples (number of the pair, place), in order."""
        left, self.first = self.left()
        self.pairs, self.of_pair = np.unique((left << _32) | self.ids, return_inverse=True)
        self.inner = np.nonzero(~self.first)[0]
        before = self.of_pair[self.inner - 1].astype(np.uint64)
        self.triples, self.of_triple = np.unique((before << _32) | self.ids[self.inner], return_inverse=True)

    def training_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        told = np.repeat(self.train, self.size)
        one = np.bincount(self.ids[told].astype(np.int64), minlength=len(self.words))
        one[np.searchsorted(self.words, _BEGIN)] += int(self.train.sum())
        return one, np.bincount(self.of_pair[told], minlength=len(self.pairs)), np.bincount(self.of_triple[told[self.inner]], minlength=len(self.triples))

    def cuts(self, limits: np.ndarray) -> np.ndarray:
        """For each limit (three words): first word, pair and triple behind it, and whether its word and its pair occur."""
        last = len(self.words) - 1
        place = lambda h: np.searchsorted(self.words, h)
        held = lambda at, h: self.words[np.minimum(at, last)] == h
        u, v, w = (place(limits[:, i]).astype(np.uint64) for i in range(3))
        has_u, has_v = held(u.astype(np.int64), limits[:, 0]), held(v.astype(np.int64), limits[:, 1])
        pair = np.searchsorted(self.pairs, np.where(has_u, (u << _32) | v, u << _32))
        has_pair = has_u & has_v & (self.pairs[np.minimum(pair, len(self.pairs) - 1)] == ((u << _32) | v))
        p = pair.astype(np.uint64) << _32
        triple = np.searchsorted(self.triples, np.where(has_pair, p | w, p))
        return np.stack([u.astype(np.int64) + has_u, pair + has_pair, triple, has_u, has_pair], 1)

    def messages(self, limits: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """What the batch asks of each shard."""
        self.ngrams()
        counts = self.training_counts()
        ends = [len(self.words), len(self.pairs), len(self.triples)]
        cut = np.concatenate([np.zeros((1, 5), np.int64), self.cuts(limits), [[*ends, 0, 0]]])
        for s in range(len(cut) - 1):
            (a1, a2, a3, more_u, more_pair), (b1, b2, b3) = cut[s].tolist(), cut[s + 1, :3].tolist()
            c1, c2 = a1 - more_u, a2 - more_pair  # the context that the limit cuts comes along
            if c1 == b1 and c2 == b2 and a3 == b3:
                continue
            n1, n2, n3 = counts[0][c1:b1].copy(), counts[1][c2:b2].copy(), counts[2][a3:b3]
            n1[: a1 - c1] = 0
            n2[: a2 - c2] = 0
            pairs, triples = self.pairs[c2:b2], self.triples[a3:b3]
            kids_1 = np.bincount((pairs >> _32).astype(np.int64) - c1, minlength=b1 - c1)
            kids_2 = np.bincount((triples >> _32).astype(np.int64) - c2, minlength=b2 - c2)
            v = self.words[(pairs & _MASK).astype(np.int64)] >> np.uint64(64 - BITS_2)
            step = np.diff(v, prepend=np.uint64(0))
            lead = (np.cumsum(kids_1) - kids_1)[kids_1 > 0]
            step[lead] = v[lead]
            w = self.words[(triples & _MASK).astype(np.int64)] >> np.uint64(64 - BITS_3)
            head = np.array([c1, a1, b1, c2, a2, b2, a3, b3], "<i8")
            yield s, pack(head, np.diff(self.words[c1:b1], prepend=np.uint64(0)), *(x.astype("<u4") for x in (kids_1, n1)), step, *(x.astype("<u4") for x in (kids_2, n2, w, n3)))

    def scores(self, answers: list[bytes], total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, sum of log10(c + 1) and log10 probability of each row."""
        self.ngrams()
        n1, types_1 = np.zeros(len(self.words), np.int64), np.zeros(len(self.words))
        n2, types_2, n3 = np.zeros(len(self.pairs)), np.zeros(len(self.pairs)), np.zeros(len(self.triples))
        for data in answers:
            head, count, kinds_1, code_2, kinds_2, code_3 = unpack(data)
            c1, a1, b1, c2, a2, b2, a3, b3 = head.view(np.int64).tolist()
            n1[a1:b1] = count[a1 - c1 :]
            types_1[c1:b1] += kinds_1
            n2[a2:b2] = decode_counts(code_2[a2 - c2 :])
            types_2[c2:b2] += kinds_2
            n3[a3:b3] = decode_counts(code_3)
        row = np.repeat(np.arange(len(self.size)), self.size)
        ids = self.ids.astype(np.int64)
        by_row = lambda x: np.bincount(row, x, len(self.size))
        known, base = by_row(n1[ids] > 0), by_row(np.log10(n1[ids] + 1.0))
        if not total:
            return known, base, np.zeros(len(self.size))
        # what the words gave up is shared evenly by all of them and one unseen word, so these sum to 1
        p1 = (np.maximum(n1 - DISCOUNT_1, 0) + DISCOUNT_1 * distinct / (distinct + 1)) / total
        u, w = (self.pairs >> _32).astype(np.int64), (self.pairs & _MASK).astype(np.int64)
        p2 = np.where(n1[u] > 0, (n2 + DISCOUNT * types_1[u] * p1[w]) / np.maximum(n1[u], 1), p1[w])
        p = p2[self.of_pair]
        context = self.of_pair[self.inner - 1]
        times = np.where(n2 > 0, n2 + DISCOUNT, 0.0)[context]
        p[self.inner] = np.where(times > 0, (n3[self.of_triple] + DISCOUNT * types_2[context] * p[self.inner]) / np.maximum(times, 1e-9), p[self.inner])
        return known, base, by_row(np.log10(p))


def _deal(folder: str, sample: int):
    """Write batches of rows (id, text, train); tell where, their sizes and a sample of their n-grams."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        known, keys, trains, ids = Words(), [], [], []
        held = 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in known), np.uint64, len(known))
            words, place = np.unique(np.concatenate([hashes, [_END, _BEGIN]]), return_inverse=True)
            size = np.fromiter((len(x) + 1 for x in ids), np.int64, len(ids))
            tokens = np.full(int(size.sum()), place[len(known)], np.uint32)
            end = np.zeros(len(tokens), bool)
            end[np.cumsum(size) - 1] = True
            tokens[~end] = place[np.concatenate(ids)]
            batch = Batch(np.array(keys, np.int64), size, np.array(trains, bool), words, tokens)
            name = uuid.uuid4().hex
            files, where = open_path(f"{folder}/{name}")
            files.create_dir(where.rpartition("/")[0], recursive=True)
            with files.open_output_stream(where, compression=None) as f:
                f.write(batch.data())
            left, first = batch.left()
            full = batch.words[batch.ids.astype(np.int64)]
            with np.errstate(over="ignore"):
                mixed = full * np.uint64(0x9E3779B97F4A7C15)
                mixed[1:] ^= batch.words[left[1:].astype(np.int64)] * np.uint64(0xC2B2AE3D27D4EB4F)
                mixed[2:] ^= batch.words[left[1:-1].astype(np.int64)] * np.uint64(0x165667B19E3779F9)
                mixed = (mixed ^ (mixed >> np.uint64(31)) ^ np.uint64(part * 1_000_003 + made)) * np.uint64(0x9E3779B97F4A7C15)
            drawn = np.nonzero(~first & ((mixed >> np.uint64(32)) % np.uint64(sample) == 0))[0]
            drawn = drawn[np.unique(mixed[drawn], return_index=True)[1]]  # once, however often it occurs
            limits = np.stack([batch.words[left[drawn - 1].astype(np.int64)], full[drawn - 1], full[drawn]], 1)
            row = (name, int(size.sum()), int(size[batch.train].sum()), limits.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["batch", "tokens", "told", "sample"])

        for b in arrow:
            for lo, hi in slices(b.column(1)):
                for key, text, train in zip(b.column(0).slice(lo, hi - lo).to_pylist(), utf8(b.column(1).slice(lo, hi - lo)), b.column(2).slice(lo, hi - lo).to_pylist(), strict=True):
                    numbers = word_numbers(text, known)
                    keys.append(key)
                    trains.append(train)
                    ids.append(numbers)
                    held += len(numbers) + 1
                    if held >= BATCH_TOKENS:
                        yield flush()
                        known, keys, trains, ids, held = Words(), [], [], [], 0
                        made += 1
        if keys:
            yield flush()

    return run


def _training_words(folder: str):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            for name in b.column(0).to_pylist():
                batch = Batch.read(f"{folder}/{name}")
                told = np.unique(batch.ids[np.repeat(batch.train, batch.size)].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(batch.words[told].view(np.int64))], names=["word"])

    return run


def _ask(folder: str, limits: np.ndarray):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            for name in b.column(0).to_pylist():
                for shard, data in Batch.read(f"{folder}/{name}").messages(limits):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([data], pa.binary())], names=["shard", "batch", "data"])

    return run


class EliasFano:
    """A sorted sequence of whole numbers below ``bound``; lower bits packed, upper bits unary, both memory-mapped."""

    def __init__(self, x: np.ndarray, bound: int, file) -> None:
        self.n = len(x)
        self.low_bits = max(0, int(bound // max(1, self.n)).bit_length() - 1)
        x = x.astype(np.uint64)
        low = x & np.uint64((1 << self.low_bits) - 1)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        bits = np.zeros(self.n + int(bound >> self.low_bits) + 2, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.upper = _mapped(np.packbits(bits, bitorder="little"), file)
        self.lower = _mapped(_pack_bits(low, self.low_bits), file)
        # rank directory: ones before each byte of the upper bits
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.upper), dtype=np.int64)])

    def select(self, i: np.ndarray) -> np.ndarray:
        """Place in the upper bits of the i-th one."""
        byte = np.searchsorted(self.ones, i, "right") - 1
        need = i - self.ones[byte]
        return byte * 8 + _SELECT[self.upper[byte], need]

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self.select(i) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | _unpack_bits(self.lower, self.low_bits, i)


def _select_table() -> np.ndarray:
    out = np.zeros((256, 8), np.int64)
    for b in range(256):
        on = [k for k in range(8) if b >> k & 1]
        out[b, : len(on)] = on
    return out


_SELECT = _select_table()


def _mapped(x: np.ndarray, file) -> np.ndarray:
    """The array in a memory-mapped file."""
    if not x.nbytes:
        return x
    at = file.seek(0, 2)
    file.write(b"\0" * (-at % 8))
    at = file.tell()
    file.write(x.tobytes())
    file.flush()
    return np.memmap(file, x.dtype, "r", at, x.shape)


def _pack_bits(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x) * width + 63) // 64 + 2, np.uint64)
    if width and len(x):
        bit = np.arange(len(x), dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, x << shift)
        over = shift + np.uint64(width) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, x[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack_bits(data: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.uint64)
    bit = i.astype(np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    low = data[word] >> shift
    high = np.where(shift > 0, data[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


class Level:
    """Successors of the contexts of the level above, relative to their context, with codes."""

    def __init__(self, context: np.ndarray, successor: np.ndarray, count: np.ndarray, contexts: int, bits: int, file) -> None:
        self.bits = bits
        self.pointers = EliasFano(np.searchsorted(context, np.arange(contexts + 1)), len(context) + 1, file)
        # the context's number above the successor's bits keeps the level monotone
        self.successors = EliasFano((context.astype(np.uint64) << np.uint64(bits)) | successor, (contexts + 1) << bits, file)
        self.codes = _mapped(encode_counts(count), file)

    def types(self, at: np.ndarray) -> np.ndarray:
        """Different successors of contexts by their place; 0 for place -1.

        A first successor without a code is another shard's and only a context here.
        """
        out = np.zeros(len(at), np.int64)
        seen = np.nonzero(at >= 0)[0]
        if len(seen) and len(self.codes):
            lo, end = (self.pointers.get(at[seen] + i).astype(np.int64) for i in (0, 1))
            out[seen] = end - lo - ((lo < end) & (self.codes[np.minimum(lo, len(self.codes) - 1)] == 0))
        return out

    def find(self, at: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Place of each successor within the range of its context; -1 if unseen."""
        out = np.full(len(at), -1)
        seen = np.nonzero(at >= 0)[0]
        if not len(seen) or not self.successors.n:
            return out
        lo = self.pointers.get(at[seen]).astype(np.int64)
        end = self.pointers.get(at[seen] + 1).astype(np.int64)
        want = (at[seen].astype(np.uint64) << np.uint64(self.bits)) | successor[seen]
        hi = end.copy()
        open_ = np.nonzero(lo < hi)[0]
        while len(open_):  # binary search of all ranges in step
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.successors.get(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        hit = lo < end
        hit[hit] = self.successors.get(lo[hit]) == want[hit]
        out[seen[hit]] = lo[hit]
        return out

    def code(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.codes[np.maximum(at, 0)] if len(self.codes) else 0, 0).astype("<u2")


class Trie:
    """Words with their counts, and two levels of successors; from n-grams in order with their training counts."""

    def __init__(self, words: np.ndarray, n1: np.ndarray, pairs: np.ndarray, n2: np.ndarray, triples: np.ndarray, n3: np.ndarray, file) -> None:
        # a context without a count of its own (another shard has it) is kept if a successor is
        of = (triples >> np.uint64(BITS_3)).astype(np.int64)
        keep_3 = n3 > 0
        keep_2 = (n2 > 0) | (np.bincount(of[keep_3], minlength=len(pairs)) > 0)
        above = (pairs >> np.uint64(BITS_2)).astype(np.int64)
        keep_1 = (n1 > 0) | (np.bincount(above[keep_2], minlength=len(words)) > 0)
        place_1, place_2 = np.cumsum(keep_1) - 1, np.cumsum(keep_2) - 1
        self.words, self.counts = _mapped(words[keep_1], file), _mapped(n1[keep_1].astype(np.int64), file)
        mask = lambda x, bits: x & np.uint64((1 << bits) - 1)
        self.second = Level(place_1[above[keep_2]], mask(pairs[keep_2], BITS_2), n2[keep_2], int(keep_1.sum()), BITS_2, file)
        self.third = Level(place_2[of[keep_3]], mask(triples[keep_3], BITS_3), n3[keep_3], int(keep_2.sum()), BITS_3, file)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of words; -1 for unseen ones."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


def _answer(table: pa.Table) -> pa.Table:
    """Add up what the batches sent to a shard, build its trie, and look all of it up for them."""
    asked = [unpack(x.as_py()) for x in table["data"]]
    u = [np.cumsum(m[1], dtype=np.uint64) for m in asked]
    words, of_word = np.unique(np.concatenate(u), return_inverse=True)
    join = lambda i: np.concatenate([m[i] for m in asked])
    kids_1, kids_2 = join(2).astype(np.int64), join(5).astype(np.int64)
    start = np.cumsum(kids_1) - kids_1
    step = join(4)
    v = np.cumsum(step, dtype=np.uint64)
    full = kids_1 > 0
    v -= np.repeat(v[start[full]] - step[start[full]], kids_1[full])
    pairs, of_pair = np.unique((np.repeat(of_word, kids_1).astype(np.uint64) << np.uint64(BITS_2)) | v, return_inverse=True)
    triples, of_triple = np.unique((np.repeat(of_pair, kids_2).astype(np.uint64) << np.uint64(BITS_3)) | join(7), return_inverse=True)
    n1, n2, n3 = (np.bincount(of, join(i), len(x)).astype(np.int64) for of, i, x in ((of_word, 3, words), (of_pair, 6, pairs), (of_triple, 8, triples)))
    sizes = [(len(m[1]), len(m[4]), len(m[7])) for m in asked]
    heads = [m[0] for m in asked]
    del asked, u, v, step, kids_1, kids_2, start
    with tempfile.TemporaryFile() as file:
        trie = Trie(words, n1, pairs, n2, triples, n3, file)
        at_1 = trie.find(words)
        count = np.where(at_1 >= 0, trie.counts[np.maximum(at_1, 0)] if len(trie.counts) else 0, 0).astype("<u8")
        low = lambda x, bits: x & np.uint64((1 << bits) - 1)
        at_2 = trie.second.find(at_1[(pairs >> np.uint64(BITS_2)).astype(np.int64)], low(pairs, BITS_2))
        at_3 = trie.third.find(at_2[(triples >> np.uint64(BITS_3)).astype(np.int64)], low(triples, BITS_3))
        found = count, trie.second.types(at_1).astype("<u4"), trie.second.code(at_2), trie.third.types(at_2).astype("<u4"), trie.third.code(at_3)
        del trie
    out, at = [], [0, 0, 0]
    for head, size in zip(heads, sizes, strict=True):
        w, p, t = (of[a : a + n] for of, a, n in zip((of_word, of_pair, of_triple), at, size, strict=True))
        out.append(pack(head, found[0][w], found[1][w], found[2][p], found[3][p], found[4][t]))
        at = [a + n for a, n in zip(at, size, strict=True)]
    return pa.table({"batch": table["batch"], "data": pa.array(out, pa.binary())})


def _finish(folder: str, total: int, distinct: int):
    def run(table: pa.Table) -> pa.Table:
        batch = Batch.read(f"{folder}/{table['batch'][0].as_py()}")
        known, base, score = batch.scores([x.as_py() for x in table["data"]], total, distinct)
        base -= batch.size * np.log10(total + distinct + 1)
        return pa.table({"row": batch.keys, "n_tokens": batch.size, "n_known": known.astype(np.int64), "base_score": base, "score": score})

    return run


def _limits(sample: list[bytes], shards: int) -> np.ndarray:
    """Three words for each limit between shards, from a sample of n-grams."""
    x = np.frombuffer(b"".join(sample), np.uint64).reshape(-1, 3)
    x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
    return np.unique(x[np.arange(1, shards) * len(x) // shards], axis=0) if len(x) else x


def score(docs: DataFrame, train: str = "train", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text with a model learned from the rows where ``train`` is true.

    Returns ``key``, ``n_tokens`` (words and one end), ``n_known`` (tokens that occur
    in training), ``train_tokens``, ``base_score`` (add-one unigrams) and ``score``
    (the model's log10 probability of the text). Null texts count as empty; keys
    are whole numbers and may repeat; null keys are kept, null marks of training
    rows count as false; without training rows all words are unknown and have
    probability 1; an empty table gives an empty one. Of every ``SHARD_NGRAMS``
    n-grams 16 go to the driver as a sample (24 bytes each).
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    null = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(null)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    dealt = stash(rows.mapInArrow(_deal(folder, max(1, SHARD_NGRAMS // 16)), "batch string, tokens long, told long, sample binary"))
    sums = dealt.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("told"), F.lit(0)).alias("told"), F.count("*").alias("n")).first()
    limits = _limits([r.sample for r in dealt.select("sample").collect()], max(spark.sparkContext.defaultParallelism, -(-sums.tokens * 3 // (2 * SHARD_NGRAMS))))
    batches = dealt.select("batch").repartition(max(1, sums.n))
    distinct = batches.mapInArrow(_training_words(folder), "word long").distinct().count()
    asked = batches.mapInArrow(_ask(folder, limits), "shard int, batch string, data binary")
    answers = asked.groupBy("shard").applyInArrow(_answer, "batch string, data binary")
    out = answers.groupBy("batch").applyInArrow(_finish(folder, sums.told, distinct), "row long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.nullif(F.col("row"), F.lit(null)).cast(docs.schema[key].dataType).alias(key), "n_tokens", "n_known", F.lit(sums.told).cast("long").alias("train_tokens"), "base_score", "score")


def score_held_out(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """``score`` with the rows of one fold of crc32(doc_id) held out; adds ``held_out``."""
    marked = docs.select("doc_id", "text", (crc_bucket("doc_id", folds) != fold).alias("train"))
    out = score(marked)
    return out.select("doc_id", (crc_bucket("doc_id", folds) == fold).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
