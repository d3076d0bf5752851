"""Removal of repeated byte strings against a dictionary of all windows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from cowrie.llm import repeats
from cowrie.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(rows):
    seen, out = set(), []
    for key, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_query_equals_plain(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    assert sorted(tuple(r) for r in QUERIES["op13_suffix_dedup"](spark, DATA).collect()) == sorted(plain(rows))


def test_suffixes_and_windows_of_pieces():
    rng = random.Random(2)
    for _ in range(300):
        base = bytes(rng.choice(b"ab") for _ in range(40))
        pieces = [base[a : a + rng.randint(5, 30)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 10))) for a in (rng.randrange(30) for _ in range(rng.randint(1, 6)))]
        text, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        begin = np.cumsum(size) - size
        left = np.repeat(begin + size, size) - np.arange(len(text))
        raw = [(bytes(text[i : i + n]), i) for i, n in enumerate(left.tolist())]
        assert repeats.suffixes(text, left).tolist() == [i for _, i in sorted(raw)]
        seen, want = set(), []
        for w, i in ((w[:6], i) for w, i in raw if len(w) >= 6):
            want += [i] * (w in seen)
            seen.add(w)
        assert repeats.later_windows(text, begin, size, 6).tolist() == want


def test_the_index_is_as_small_as_the_runs():
    text = np.frombuffer(b"a stretch of text that is not repetitive by itself; 0123456789" * 200, np.uint8)
    index = repeats.RunIndex(text, np.array([0]), np.array([len(text)]))
    assert len(index.head) < 100 < len(text)


def texts_of(rng):
    words = [str(rng.randrange(10**6)) for _ in range(300)]
    line = "a line of over one hundred bytes that many rows share, with nothing else in common: " + "=" * 60
    short = "a common line of less than a window, 64 bytes long in all rows .."
    out = [None, "", "x" * 99, "x" * 100, "x" * 350, "é" * 120, "ab" * 90, "ba" * 90]
    for _ in range(150):
        body = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        out.append(" ".join([*body, *[line] * (rng.random() < 0.4), *body[: rng.randint(0, 30)], *[short] * (rng.random() < 0.6), str(rng.random())]))
    out += [out[20]] * 5 + [out[30][:-3] + "zzz", "q" + out[31]]
    return out


@pytest.mark.parametrize(("hot", "batch", "shard", "parts"), [(64, 8_000_000, 6_000_000, 1), (2, 5_000, 3_000, 7), (3, 20_000, 6_000_000, 3)])
def test_hot_anchors_batches_and_shards(spark, monkeypatch, hot, batch, shard, parts):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    rng = random.Random(4)
    rows = [(i * 7 - 300, x) for i, x in enumerate(texts_of(rng))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, spans string").repartition(parts)
    assert ordered(tuple(r) for r in repeats.report(docs).collect()) == ordered(plain(sorted(rows, key=lambda r: r[0])))
    for r in repeats.remove_repeats(docs).collect():
        text = (dict(rows)[r.doc_id] or "").encode()
        at, kept = 0, b""
        for s in r.spans:
            kept, at = kept + text[at : s.start], s.end
        assert bytes(r.kept) == kept + text[at:]


def test_repeated_and_null_keys(spark):
    long = "".join(chr(97 + i % 26) * (i % 5 + 1) for i in range(90))
    rows = [(5, long), (5, long), (None, long + "!"), (None, None), (9, long[:150])]
    got = ordered(tuple(r)[:4] for r in repeats.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(long)
    assert got == ordered([(None, 0, 0, 0), (None, n + 1, 0, 0), (5, n, n, 1), (5, n, n, 1), (9, 150, 150, 1)])
    assert repeats.report(spark.createDataFrame([], "doc_id int, text string")).count() == 0
