"""Sampled segmentations into vocabulary pieces: Gumbel top-k without replacement.

A text's lattice has an edge for each vocabulary piece at each place; edges
weigh by the piece's rank (Zipf), bytes stand in for characters that the
vocabulary lacks. A perturbed A-star search over the tree of segmentations
takes the root's Gumbel value down: the path drawn from the backward
probabilities keeps it, and the siblings left aside at a place become one agenda
node, whose value is a Gumbel of their mass, truncated at the path's. The best
agenda node is the next distinct segmentation; the best one left after ``k`` is
the threshold of the inclusion scores. Draws hash the row key, so reruns agree.

Pieces do not cross from a letter to a space, so the lattice falls into words; each different
word's lattice and backward pass is made once and kept for later rows of a task,
up to a bound, in numpy arrays over all words together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.llm.common import utf8, with_columns_from

#: Where the vocabulary lies unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct segmentations of a text, and the sharpness of the distribution.
SAMPLES, ALPHA = 2, 1.0
#: Bytes of text of a slice.
SLICE = 1_000_000
_SPACE = "▁"
_PARTS = re.compile(b" *[^ ]+| +")
_B = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[int]]:
    """The bytes of each piece by id (empty for control pieces) and the ids of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            pieces.append(b"")
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(piece.replace(_SPACE, " ").encode())
    if -1 in byte_ids:
        raise ValueError(f"{path} has no piece for every byte")
    return pieces, byte_ids


class Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: bytes) -> list[bytes]:
    """The parts that no piece crosses: a run of spaces with the word behind it, if any."""
    return _PARTS.findall(text) or [b""]


class Vocabulary:
    """Pieces by length, for matching at all places at once."""

    def __init__(self, pieces: list[bytes], byte_ids: list[int], alpha: float = ALPHA) -> None:
        self.bytes = list(pieces)
        for value, i in enumerate(byte_ids):
            self.bytes[i] = bytes([value])
        self.byte_ids = np.array(byte_ids, np.int32)
        weight = alpha * -np.log(np.arange(len(pieces)) + 2.7)
        self.logp = weight.astype(np.float64)
        self.byte_logp = float(weight.min() - 2 * alpha)
        self.whole = np.empty(len(self.bytes), object)
        self.whole[:] = self.bytes
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        # by length and hash: 1 where there may be a piece, 2 where a longer one may begin so
        self.marks = np.zeros((max(map(len, pieces)) + 1, 1 << 20), np.uint8)
        for n in sorted({len(p) for p in pieces if p}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int32)
            raw = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n)
            h = np.zeros(len(ids), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(n):
                    h = h * _B + raw[:, j] + np.uint64(1)
                    self.marks[j + 1, (h * _MIX) >> np.uint64(44)] |= np.uint8(1 if j + 1 == n else 2)
            order = np.argsort(h)
            self.by_length[n] = (h[order], ids[order], raw[order])
        self.longest = max(self.by_length)


@dataclass
class Lattice:
    """Edges of all words, by start; ``upto`` is the probability of the place's edges up to this one, for drawing."""

    first: np.ndarray  # start of each word in the joined bytes
    last: np.ndarray  # its end
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    logq: np.ndarray
    upto: np.ndarray
    head: np.ndarray  # first edge of each place, one place more than there are

    def followed_by(self, other: Lattice) -> Lattice:
        """Both lattices in one, the words of the other behind."""
        places, edges = len(self.head) - 1, len(self.start)
        moved = {"first": places, "last": places, "start": places, "end": places, "piece": 0, "logq": 0, "upto": 0}
        joined = {k: np.concatenate([getattr(self, k), getattr(other, k) + by if by else getattr(other, k)]) for k, by in moved.items()}
        return Lattice(**joined, head=np.concatenate([self.head[:-1], other.head + edges]))


def build(vocabulary: Vocabulary, words: list[bytes]) -> Lattice:
    """Edges and backward probabilities of the words' lattices."""
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    last = np.cumsum(size)
    n = len(data)
    left = (np.repeat(last, size) - np.arange(n)).astype(np.int32)  # bytes from here to the word's end
    alive, h = np.arange(n), np.zeros(n, np.uint64)
    starts, ids, lengths = [], [], []
    char = np.ones(n, np.int8)
    char[data >= 0xC0] = 2
    char[data >= 0xE0] = 3
    char[data >= 0xF0] = 4
    head = (data & 0xC0) != 0x80
    known = np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for k in range(1, vocabulary.longest + 1):
            if k > 1:  # only places where a longer piece may begin go on
                on = np.nonzero((mark & 2 > 0) & (left[alive] >= k))[0]
                alive, h = alive[on], h[on]
            if not len(alive):
                break
            h = h * _B + data[alive + (k - 1)] + np.uint64(1)
            mark = vocabulary.marks[k][(h * _MIX) >> np.uint64(44)]
            if k not in vocabulary.by_length:
                continue
            hashes, piece, raw = vocabulary.by_length[k]
            at = np.nonzero(mark & 1)[0]
            j = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            hit = hashes[j] == h[at]
            at, j = alive[at[hit]], j[hit]
            same = (data[at[:, None] + np.arange(k)] == raw[j]).all(1)
            at, j = at[same], j[same]
            starts.append(at)
            ids.append(piece[j])
            lengths.append(np.full(len(at), k, np.int64))
            known[at[char[at] == k]] = True
    # bytes of characters that are no piece
    lone = head & ~known
    lost = np.nonzero(lone)[0]
    count = char[lost].astype(np.int64)
    extra = np.repeat(lost, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts.append(extra)
    ids.append(vocabulary.byte_ids[data[extra]])
    lengths.append(np.ones(len(extra), np.int64))
    # long pieces first: most often they are drawn
    start, piece, length = (np.concatenate(x[::-1]) for x in (starts, ids, lengths))
    byte = np.zeros(len(start), bool)
    byte[: len(extra)] = True
    order = np.argsort(start, kind="stable")
    start, piece, length, byte = start[order], piece[order], length[order], byte[order]
    end = start + length
    logp = np.where(byte, vocabulary.byte_logp, vocabulary.logp[piece])
    # backward: from the ends of words, all words in step
    beta = np.full(n + 1, -np.inf)
    done = np.zeros(len(start), np.float64)
    reach = left[start] if n else np.zeros(0, np.int32)
    turn = np.argsort(reach.astype(np.int16) if int(reach.max(initial=0)) < 1 << 15 else reach, kind="stable")
    cut = np.searchsorted(reach[turn], np.arange(1, (int(reach.max(initial=0))) + 2))
    ends_word = left[start] == length if n else np.zeros(0, bool)
    for r in range(len(cut) - 1):
        e = turn[cut[r] : cut[r + 1]]
        if not len(e):
            continue
        v = logp[e] + np.where(ends_word[e], 0.0, beta[end[e]])
        done[e] = v
        s = start[e]
        lead = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0]
        beta[s[lead]] = np.logaddexp.reduceat(v, lead)
    logq = done - beta[start] if n else done
    live = np.isfinite(logq)  # a place inside a character leads nowhere
    start, end, piece, logq = start[live], end[live], piece[live], logq[live]
    total = np.cumsum(np.exp(logq))
    lead = np.nonzero(np.concatenate([[True], start[1:] != start[:-1]]))[0] if len(start) else np.zeros(0, np.int64)
    before = np.repeat(total[lead] - np.exp(logq[lead]), np.diff(np.append(lead, len(start))))
    upto = np.clip(total - before, 0, 1)
    if len(lead):
        upto[np.append(lead[1:], len(start)) - 1] = 1.0
    head_edge = np.zeros(n + 1, np.int64)
    head_edge[start[lead]] = lead
    return Lattice(last - size, last, start, end, piece, logq, upto, head_edge)


def uniforms(seed: np.ndarray, place: np.ndarray, what: int) -> np.ndarray:
    """Numbers in (0, 1) from row seeds, places in the text and the purpose."""
    with np.errstate(over="ignore"):
        z = seed + (place.astype(np.uint64) * np.uint64(64) + np.uint64(what)) * _MIX
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _draw(lat: Lattice, at: np.ndarray, stop: np.ndarray, shift: np.ndarray, seed: np.ndarray, what: int) -> tuple[np.ndarray, np.ndarray]:
    """Draw a path for each occurrence from ``at`` to ``stop``; edges one after another, and edges per occurrence.

    ``shift`` turns a place among the words into a place of the text.
    """
    n = len(at)
    now = at.copy()
    active = np.nonzero(now < stop)[0]
    steps = []
    count = np.zeros(n, np.int64)
    while len(active):
        here = now[active]
        u = uniforms(seed[active], here + shift[active], what)
        e = lat.head[here]
        late = np.nonzero(lat.upto[e] <= u)[0]
        while len(late):
            e[late] += 1
            late = late[lat.upto[e[late]] <= u[late]]
        steps.append((active, e))
        count[active] += 1
        now[active] = lat.end[e]
        active = active[now[active] < stop[active]]
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for t, (who, e) in enumerate(steps):
        out[first[who] + t] = e
    return out, count


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    return np.where(x > -0.693, np.log(np.maximum(-np.expm1(np.minimum(x, -1e-300)), 1e-300)), np.log1p(-np.exp(np.minimum(x, -0.693))))


def _rests(logq: np.ndarray, before: np.ndarray, top: float | np.ndarray, seed: np.ndarray, place: np.ndarray, what: int) -> np.ndarray:
    """Values of the siblings left aside at each step of a path that has value ``top``."""
    mass = before + _log1mexp(logq)
    gumbel = mass - np.log(-np.log(uniforms(seed, place, what)))
    return np.where(logq > -1e-12, -np.inf, -np.logaddexp(-top, -gumbel))


class Words:
    """Numbers and lattices of the words met so far; forgets them all beyond ``MOST``."""

    MOST = 100_000

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.numbers, self.lattice = vocabulary, Numbers(), None

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Numbers of the words of each text; their lattices are in ``lattice`` then."""
        if len(self.numbers) > self.MOST:
            self.numbers, self.lattice = Numbers(), None
        known = len(self.numbers)
        out = [np.fromiter(map(self.numbers.__getitem__, ws), np.int64, len(ws)) for ws in map(words_of, texts)]
        if len(self.numbers) > known:
            new = build(self.vocabulary, list(self.numbers)[known:])
            self.lattice = new if self.lattice is None else self.lattice.followed_by(new)
        return out


def sample(vocabulary: Vocabulary, texts: list[bytes], keys: list[bytes], k: int = SAMPLES, seed: int = 0, words: Words | None = None) -> list[list[dict]]:
    """Up to ``k`` distinct segmentations of each text, best perturbed value first.

    Each is a dict of ``ids``, ``log_prob`` (of the segmentation), ``value``
    (perturbed) and ``log_inclusion`` (log of the probability of being among the
    samples, given the value of the best segmentation not among them).
    """
    words = words or Words(vocabulary)
    occurrences = words.of(texts)
    lat = words.lattice
    width = lat.last - lat.first
    seeds = np.array([xxhash.xxh64_intdigest(x, seed) for x in keys], np.uint64)
    word = np.concatenate(occurrences)
    per = np.array([len(o) for o in occurrences])
    doc = np.repeat(np.arange(len(texts)), per)
    offset = np.cumsum(width[word]) - width[word]
    head = np.cumsum(per) - per
    offset -= np.repeat(offset[head], per)  # place of each word in its text
    shift = offset - lat.first[word]
    edges, count = _draw(lat, lat.first[word], lat.last[word], shift, seeds[doc], 0)
    steps = np.add.reduceat(count, head)
    begin = np.cumsum(steps) - steps
    owner = np.repeat(np.arange(len(texts)), steps)
    of_word = np.repeat(np.arange(len(word)), count)
    logq = lat.logq[edges]
    total = np.cumsum(logq)
    base = np.concatenate([[0.0], total])[begin]
    before = total - logq - base[owner]
    top = -np.log(-np.log(uniforms(seeds, np.zeros(len(seeds), np.int64), 1)))
    rest = _rests(logq, before, top[owner], seeds[owner], lat.start[edges] + shift[of_word], 2)

    made: list[list[dict]] = [[] for _ in texts]
    agenda: list[list[dict]] = [[] for _ in texts]
    for i in range(len(texts)):
        s = slice(begin[i], begin[i] + steps[i])
        made[i].append({"edges": edges[s], "value": float(top[i]), "log_prob": float(logq[s].sum())})
        agenda[i].append({"values": rest[s].copy(), "before": before[s], "edges": edges[s], "words": of_word[s], "gone": {}})
    for j in range(1, k):
        ask, at, stop, moves, rows, tops = [], [], [], [], [], []
        for i in range(len(texts)):
            best = max(((float(a["values"].max(initial=-np.inf)), x) for x, a in enumerate(agenda[i])), default=(-np.inf, -1))
            if best[0] == -np.inf:
                continue
            a = agenda[i][best[1]]
            t = int(a["values"].argmax())
            rows.append(i)
            tops.append((best[0], a, t))
        if not rows:
            break
        # numbers of all rows are drawn at once
        pick = np.array(rows)
        leaders = np.array([int(a["edges"][t]) for _, a, t in tops])
        lead_words = np.array([int(a["words"][t]) for _, a, t in tops])
        lead_places = lat.start[leaders] + shift[lead_words]
        chances = uniforms(seeds[pick], lead_places, 8 + 4 * j).tolist()
        gumbels = -np.log(-np.log(uniforms(seeds[pick], lead_places, 9 + 4 * j)))
        for r, (i, (value, a, t)) in enumerate(zip(rows, tops, strict=True)):
            e0, w = int(leaders[r]), int(lead_words[r])
            lo = int(lat.head[lat.start[e0]])
            hi = lo + int(np.searchsorted(lat.start[lo : lo + vocabulary.longest + 1], lat.start[e0], "right"))
            gone = a["gone"].setdefault(t, {e0})
            others = np.array([e for e in range(lo, hi) if e not in gone])
            p = np.exp(lat.logq[others])
            e = int(others[min(len(others) - 1, int(np.searchsorted(np.cumsum(p) / p.sum(), chances[r], "right")))])
            gone.add(e)
            gone_mass = float(np.exp(lat.logq[list(gone)]).sum())
            if len(gone) == hi - lo or gone_mass >= 1:
                a["values"][t] = -np.inf
            else:
                g = a["before"][t] + np.log1p(-gone_mass) + gumbels[r]
                a["values"][t] = -np.logaddexp(-value, -g)
            moves.append((value, a, t, e, w))
            n = head[i] + per[i] - w
            ask.append(np.arange(w, w + n))
            first = lat.first[word[ask[-1]]].copy()
            first[0] = lat.end[e]
            at.append(first)
            stop.append(lat.last[word[ask[-1]]])
        flat = np.concatenate(ask)
        drawn, drawn_count = _draw(lat, np.concatenate(at), np.concatenate(stop), shift[flat], seeds[doc[flat]], 10 + 4 * j)
        sizes = np.array([len(x) for x in ask])
        lead = np.cumsum(sizes) - sizes
        got = np.add.reduceat(drawn_count, lead)
        places = np.cumsum(got) - got
        drawn_word = np.repeat(flat, drawn_count)
        drawn_logq = lat.logq[drawn]
        tails = []
        for r in range(len(rows)):
            _, a, t, e, _ = moves[r]
            tail_logq = np.concatenate([lat.logq[e : e + 1], drawn_logq[places[r] : places[r] + got[r]]])
            tails.append((tail_logq, float(a["before"][t]) + np.cumsum(tail_logq) - tail_logq))
        value_of = np.repeat(np.array([m[0] for m in moves]), got)
        rest = _rests(drawn_logq, np.concatenate([b[1:] for _, b in tails]), value_of, np.repeat(seeds[pick], got), lat.start[drawn] + shift[drawn_word], 11 + 4 * j)
        for r, i in enumerate(rows):
            value, a, t, e, w = moves[r]
            s = slice(places[r], places[r] + got[r])
            tail_logq, tail_before = tails[r]
            whole = np.concatenate([a["edges"][:t], [e], drawn[s]])
            made[i].append({"edges": whole, "value": value, "log_prob": float(tail_before[-1] + tail_logq[-1])})
            values = np.full(len(whole), -np.inf)
            values[t + 1 :] = rest[s]
            agenda[i].append({"values": values, "before": np.concatenate([a["before"][:t], tail_before]), "edges": whole, "words": np.concatenate([a["words"][:t], [w], drawn_word[s]]), "gone": {}})
    out = []
    for i, found in enumerate(made):
        kappa = max((float(a["values"].max(initial=-np.inf)) for a in agenda[i]), default=-np.inf)
        row = []
        for m in found:
            x = m["log_prob"] - kappa
            inclusion = 0.0 if kappa == -np.inf or x > 30 else (x if x < -30 else float(np.log(-np.expm1(-np.exp(x)))))
            # rounded, since sums depend on which rows share a slice in the last digits
            row.append({"ids": lat.piece[m["edges"]], "log_prob": round(m["log_prob"], 6), "value": round(m["value"], 6), "log_inclusion": round(inclusion, 6)})
        out.append(row)
    return out


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of piece ids."""
    return b"".join(vocabulary.whole[ids].tolist())


_SAMPLE = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())])
_DIGEST = T.StructType([T.StructField("n_pieces", T.LongType()), T.StructField("ids_hash", T.StringType()), T.StructField("log_prob", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType()), T.StructField("restores", T.BooleanType())])


def _make(shared, k: int, seed: int, digest: bool):
    vocabulary = Vocabulary(*shared.value)
    words = Words(vocabulary)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        texts = utf8(columns[0])
        keys = [str(x).encode() for x in columns[1].to_pylist()]
        found = sample(vocabulary, texts, keys, k, seed, words)
        flat = [s for row in found for s in row]
        number = lambda name: pa.array([s[name] for s in flat], pa.float64())
        columns_ = {"log_prob": number("log_prob"), "value": number("value"), "log_inclusion": number("log_inclusion")}
        size = np.array([len(s["ids"]) for s in flat], np.int64)
        if digest:
            restores = [decode(vocabulary, s["ids"]) == text for text, row in zip(texts, found, strict=True) for s in row]
            hashes = [f"{xxhash.xxh64_intdigest(s['ids'].astype('<i4').tobytes()):016x}" for s in flat]
            made = {"n_pieces": pa.array(size), "ids_hash": pa.array(hashes, pa.string()), **columns_, "restores": pa.array(restores, pa.bool_())}
        else:
            ids = np.concatenate([s["ids"] for s in flat] or [np.zeros(0)]).astype(np.int32)
            made = {"ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(ids)), **columns_}
        offsets = np.append(0, np.cumsum([len(row) for row in found]))
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(made.values()), list(made)))]

    return run


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY, k: int = SAMPLES, seed: int = 0, digest: bool = False, copies: bool = False, out: str = "samples") -> DataFrame:
    """Append ``out``: up to ``k`` distinct segmentations of each whole text.

    With ``digest`` a sample holds the number of its pieces, a hash of their ids
    and whether they restore the text, in place of the ids. Rows of one key and
    text draw alike, unless ``copies`` is set: then they are numbered (a shuffle by
    key and text) and have a draw of their own each, the same ones wherever they
    lie. Null texts count as empty and have the one empty segmentation;
    characters without a piece become bytes. Other columns pass; one of the name
    ``out`` is replaced. The vocabulary is read once by the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    kind = [T.StructField(out, T.ArrayType(_DIGEST if digest else _SAMPLE))]
    if not copies:
        return with_columns_from(docs, [text, key], kind, _make, shared, k, seed, digest, limit=SLICE)
    like = Window.partitionBy(F.col(key), F.xxhash64(text)).orderBy(F.col(key))
    numbered = docs.withColumn("cowrie_copy", F.row_number().over(like) - 1)
    own = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("None")), F.when(F.col("cowrie_copy") > 0, F.concat(F.lit(" copy "), "cowrie_copy")).otherwise(F.lit("")))
    return with_columns_from(numbered.withColumn("cowrie_copy", own), [text, "cowrie_copy"], kind, _make, shared, k, seed, digest, limit=SLICE).drop("cowrie_copy")


def _decode_rows(shared):
    vocabulary = Vocabulary(*shared.value)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([decode(vocabulary, np.array(x or [], np.int64)).decode("utf-8", "replace") for x in columns[1].to_pylist()], pa.string())]

    return run


def decode_column(df: DataFrame, ids: str, path: str = VOCABULARY, out: str = "text") -> DataFrame:
    """Append ``out``, the text of the piece ids in each row (null: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    sized = df.withColumn("cowrie_size", F.lit(""))
    return with_columns_from(sized, ["cowrie_size", ids], [T.StructField(out, T.StringType())], _decode_rows, shared).drop("cowrie_size")
