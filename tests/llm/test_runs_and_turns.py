"""Periodic runs and conversation repair against plain versions."""

import hashlib
import random
import zlib

import duckdb
import pytest

from cowrie.llm import periodic, turns
from cowrie.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def split(text):
    return [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]


def plain_runs(w):
    """Every run by trying all periods: {(start, length): smallest period}."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_report(doc_id, text):
    w = split(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query_equals_plain(spark):
    want = sorted(plain_report(*r) for r in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_periodic_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a " * 23, "a " * 24, "a b c " * 8, "\x0b".join("xy" * 20), "ä " * 30 + "b " * 40]
    for _ in range(60):  # nested and overlapping periods, few different words
        w = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(20, 90))]
        a, p = rng.randrange(len(w)), rng.randint(1, 25)
        w[a:] = [w[a + i % min(p, len(w) - a)] for i in range(len(w) - a)]
        texts.append(" ".join(w))
    rows = [(i if i % 7 else None, x, "kept") for i, x in enumerate(texts)] + [(1, "", "kept")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in periodic.report(docs).collect()), key=key) == sorted((plain_report(*r[:2]) for r in rows), key=key)
    found = periodic.find_runs(docs.withColumnRenamed("runs", "extra")).collect()
    for r in found:
        assert [tuple(x) for x in r.runs] == sorted(plain_runs(split(r.text)), key=lambda r: (r[0], r[2])) and r.extra == "kept"
    assert periodic.report(docs.limit(0)).count() == 0


def test_long_periods_and_many_equal_words(spark):
    rng = random.Random(1)
    block = [str(rng.randrange(10**6)) for _ in range(7000)]
    docs = spark.createDataFrame([(1, " ".join(block * 3)), (2, " ".join(block * 2 + block[:6999])), (3, "z " * 50000)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.find_runs(docs).select("doc_id", "runs").collect()}
    assert got == {1: [(0, 21000, 7000)], 2: [], 3: [(0, 50000, 1)]}


def plain_repair(rows):
    """All edit sequences by shortest paths over (rows used, state), cost first and then audit; rows of (turn, role, text) in order."""
    blanks = " \t\n\x0b\x0c\r"
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(blanks)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {(0, 0): (0, "", ())}
    todo = [(0, 0)]
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    while todo:
        i, s = at = todo.pop()
        cost, audit, said = best[at]
        moves = [((i, step[s, c]), 3, "I", (name + ":",)) for c, name in (("u", "user"), ("a", "assistant")) if (s, c) in step]
        if i < len(rows):
            _, role, text = rows[i]
            moves.append(((i + 1, s), 4, "D", ()))
            if faults[i] in (None, "truncated"):
                more = 3 * (faults[i] == "truncated")
                if (s, role[:1]) in step:
                    moves.append(((i + 1, step[s, role[:1]]), more, "K", (f"{role}:{text}",)))
                moves += [((i + 1, step[s, c]), 3 + more, "R", (f"{name}:{text}",)) for c, name in (("u", "user"), ("a", "assistant")) if (s, c) in step]
        for to, c, edit, line in moves:
            new = (cost + c, audit + edit, said + line)
            if to not in best or new[:2] < best[to][:2]:
                best[to] = new
                todo.append(to)
    cost, audit, said = min((best[len(rows), s] for s in (0, 3) if (len(rows), s) in best), key=lambda x: x[:2])
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(said))


@pytest.mark.parametrize("block", [2, 256])
def test_repair_equals_shortest_paths(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rng, rows = random.Random(block), []
    for conv in range(120):
        for k in range(rng.randint(1, 12)):
            turn = None if rng.random() < 0.05 else rng.choice([k, k, k, rng.randint(-5, 40)])
            rows.append((conv if conv else None, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "]), rng.choice(["Hi.", "Well", "So?\n", "", " \x0b", "x! ", "Y.", "Z.", "A. "])))
    got = {r[0]: tuple(r)[1:] for r in turns.repair(spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(5)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got[conv] == plain_repair(mine), mine


def test_damaged_conversations_equal_sql(spark, tmp_path):
    rows = [(c, t, r, x) for c in [1, 2, None, -7] for t in [0, 1, 2, None, 3, 3] for r, x in [("user", "a b."), (None, None)]] + [(99, 5, "assistant", "Dropped? Perhaps."), (17, 1, "user", "Ha!")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "x")
    table.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    got = turns.repair_damaged(table)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({turns.SQL})").fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert len(want) == 6
    assert turns.repair_damaged(table.limit(0)).count() == 0
