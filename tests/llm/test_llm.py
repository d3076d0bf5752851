"""Operators against brute force, round trips, held-out accuracy and odd tables."""

import datetime
import decimal
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cowrie.llm import common, embeddings, html, language, lm, mixing, pieces, simhash, toxicity, warc, winnow
from cowrie.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "same text of a few words here and there"), (5, "same text of a few words here and there"), (5, "same text of a few words here and there"), (6, LONG), (None, "keyless"), (7, "Ünïcode ⛵ 漢字 text"), (8, "a")]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'").df()


def rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    kind = "doc_id long, text string, source string, lang string, score string, size string, train string, fp string, n_chars int"
    return spark.createDataFrame([(k, t, None if i % 3 == 0 else "s", None if i % 2 else "en", "x", "x", "x", "x", 1) for i, (k, t) in enumerate(ODD)], kind)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {ORACLE_SQL[name]}")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    cols = ", ".join(sorted(r[0] for r in con.execute("DESCRIBE got").fetchall()))
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []


def test_mixing_meets_targets(spark):
    got = rows(spark, "op1_mixing")
    assert all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        s = by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] = s + r.taken
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    assert all(abs(n - t) <= 0.25 * t for (_, t), n in by.items() if t > 20_000)


def test_mixing_odd(spark, odd):
    got = mixing.mix(odd)
    assert got.count() == len(ODD)
    copies = {(r.doc_id, r.source, r.copies) for r in got.collect()}
    assert len({c for d, s, c in copies if d == 5 and s == "s"}) <= 1
    assert set(mixing.emit(got).columns) == set(odd.columns) - {"size"}
    assert mixing.mix(odd.limit(0)).count() == 0


def components(n, near):
    root = list(range(n))
    while True:
        was = list(root)
        for i in range(n):
            for j in np.nonzero(near[i])[0]:
                root[i] = min(root[i], root[j])
        if was == root:
            return root


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 16))
    x = np.concatenate([base, base[:200] + rng.normal(size=(200, 16)) * 0.03, base[:60] + rng.normal(size=(60, 16)) * 0.05, base[:5]])
    label = rng.integers(0, 2, len(x))
    data = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    bad = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, data[0][1], None), (2005, [], 1)]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("clash"))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    root = components(len(x), near)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist() and near.sum() > 200
    assert [got[i].component_id for i in range(len(x))] == root
    assert all(got[b[0]].n_links == 0 and got[b[0]].kept for b in bad)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    """One cell of many blocks finds the same links."""
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 7)
    monkeypatch.setattr(embeddings, "PRODUCT_ROWS", 3)
    monkeypatch.setattr(embeddings, "CELL_FACTOR", 0)
    data = [(i, [math.cos(i / 50), math.sin(i / 50)], 1) for i in range(60)]
    got = embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    want = [sum(j != i and math.cos((i - j) / 50) >= 0.98 for j in range(60)) for i in range(60)]
    assert [r.n_links for r in got] == want and all(r.component_id == 0 for r in got)


def test_embeddings_without_keys_and_with_repeated_keys(spark):
    near = lambda t: [math.cos(t), math.sin(t)]
    data = [(None, near(0.0), 1), (None, near(0.05), 1), (4, near(0.1), 1), (None, near(2.0), 1), (None, near(2.05), 1), (7, near(4.0), 1), (7, near(5.0), 1), (7, near(5.0), 1), (None, None, None), (9, near(5.05), 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    want = [(None, 2, 4, False)] * 2 + [(4, 2, 4, True)] + [(None, 1, None, True)] * 2 + [(7, 0, 7, True)] + [(7, 2, 7, True)] * 2 + [(None, 0, None, True), (9, 2, 7, False)]
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_embeddings_query_against_all_pairs(spark):
    got = {r.vec_id: r for r in rows(spark, "op2_embedding_dedup")}
    t = table("embeddings")
    assert t.vec_id.is_unique and len(got) == len(t)
    sound = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) and y is not None and y == y for v, y in zip(t.embedding, t.label, strict=True)]
    at = [i for i, ok in enumerate(sound) if ok]
    x = np.array([np.asarray(t.embedding[i], np.float64) for i in at])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label, ids = t.label.to_numpy()[at], t.vec_id.to_numpy()[at]
    order = np.argsort(ids)
    x, label, ids = x[order], label[order], ids[order]
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    root = components(len(ids), near)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in ids] == [(int(n), ids[r], ids[r] == i) for i, n, r in zip(ids, near.sum(1), root, strict=True)]


def exact_trigrams(docs, train):
    """For each {key: words}: known tokens, base score and log10 probability under the exact model of the keys in ``train``."""
    ends = {i: [*ws, "\0"] for i, ws in docs.items()}
    c = Counter(w for i in train for w in ends[i])
    n, v = sum(c.values()), len(c)
    pairs = lambda ws: list(zip(["^", *ws], ws, strict=False))
    triples = lambda ws: list(zip(["^", *ws], ws, ws[1:], strict=False))
    bi, tri = Counter(p for i in train for p in pairs(ends[i])), Counter(t for i in train for t in triples(ends[i]))
    left = Counter(a for i in train for a, _ in pairs(ends[i]))
    types, types_2 = Counter(a for a, _ in bi), Counter((a, b) for a, b, _ in tri)
    p1 = lambda w: (max(c[w] - 0.5, 0) + 0.5 * v / (v + 1)) / n
    p2 = lambda a, w: (max(bi[a, w] - 0.75, 0) + 0.75 * types[a] * p1(w)) / left[a] if left[a] else p1(w)
    p3 = lambda a, b, w: (max(tri[a, b, w] - 0.75, 0) + 0.75 * types_2[a, b] * p2(b, w)) / bi[a, b] if bi[a, b] else p2(b, w)
    base = lambda ws: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
    return n, {i: (sum(c[w] > 0 for w in ws), base(ws), math.log10(p2("^", ws[0])) + sum(math.log10(p3(*t)) for t in triples(ws))) for i, ws in ends.items()}


def test_lm_scores_of_the_query_against_the_exact_model(spark):
    got = {r.doc_id: r for r in rows(spark, "op3_lm_scoring")}
    docs = table("documents").drop_duplicates("doc_id")
    words = {i: WORD.findall(lower(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    n, want = exact_trigrams(words, train)
    for i, ws in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws) + 1, want[i][0], n, i not in set(train))
        assert r.base_score == pytest.approx(want[i][1], abs=1e-6) and r.score == pytest.approx(want[i][2], rel=5e-4, abs=1e-3)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_prefers_seen_words_and_sums_to_one(spark):
    docs = {i: f"the cat number{i} sat on the mat of room{i % 5}".split() for i in range(40)}
    words = sorted({w for ws in docs.values() for w in ws})
    # one text of two words for each second word, the end and one unseen word among them: the shares of "the x" sum to those of "the"
    probes = {1000 + k: f"the {w}" for k, w in enumerate([*words, "neverseen"])} | {2000: "the"}
    extra = {3000: "qzx wvv pkk jjq", 3001: "number1 number2 number3 number4", 3002: "the cat sat on"}
    rows_ = [(i, " ".join(ws), True) for i, ws in docs.items()] + [(i, t, False) for i, t in (probes | extra).items()]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows_, "doc_id long, text string, train boolean")).collect()}
    assert got[3000] < got[3001] < got[3002]
    tri = exact_trigrams({i: ws for i, ws in docs.items()} | {i: t.split() for i, t in (probes | extra).items()}, list(docs))[1]
    assert all(got[i] == pytest.approx(tri[i][2], rel=5e-4, abs=1e-3) for i in [*probes, *extra])
    # the exact model itself: all words, the end and one unseen word sum to 1 after any context
    p2, p3 = _counts(docs)
    every = [*words, "\0", "neverseen"]
    assert sum(p2("^", w) for w in every) == pytest.approx(1) and sum(p3("^", "the", w) for w in every) == pytest.approx(1) and sum(p3("sat", "on", w) for w in every) == pytest.approx(1)


def _counts(docs):
    ends = [[*ws, "\0"] for ws in docs.values()]
    c = Counter(w for ws in ends for w in ws)
    bi = Counter(p for ws in ends for p in zip(["^", *ws], ws))
    tri = Counter(t for ws in ends for t in zip(["^", *ws], ws, ws[1:]))
    left = Counter(a for ws in ends for a in ["^", *ws[:-1]])
    p1 = lambda w: (max(c[w] - 0.5, 0) + 0.5 * len(c) / (len(c) + 1)) / sum(c.values())
    kinds, kinds_2 = Counter(a for a, _ in bi), Counter((a, b) for a, b, _ in tri)
    p2 = lambda a, w: (max(bi[a, w] - 0.75, 0) + 0.75 * kinds[a] * p1(w)) / left[a] if left[a] else p1(w)
    p3 = lambda a, b, w: (max(tri[a, b, w] - 0.75, 0) + 0.75 * kinds_2[a, b] * p2(b, w)) / bi[a, b] if bi[a, b] else p2(b, w)
    return p2, p3


def test_lm_scores_do_not_depend_on_batches_shards_or_partitions(spark, monkeypatch):
    """With a hot word, a hot pair and limits that cut contexts."""
    rng = np.random.default_rng(5)
    docs = {i: [x for k in rng.zipf(1.3, 50) if k < 400 for x in (["hot", f"w{k}"] if k % 3 else ["hot", "pair", f"w{k}"])] for i in range(240)}
    docs |= {300: [], 301: ["once"], 302: docs[7], 303: ["hot"] * 90}
    train = [i for i in docs if i % 4 > 0]
    n, want = exact_trigrams(docs, train)
    df = spark.createDataFrame([(i, " ".join(ws), i % 4 > 0) for i, ws in docs.items()], "doc_id long, text string, train boolean").repartition(3, "doc_id")
    seen, partitions = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, batch, shard in ((2, 10**6, 10**6), (8, 2_000, 4_000), (64, 500, 300), (3, 100, 60)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            monkeypatch.setattr(lm, "BATCH_TOKENS", batch)
            monkeypatch.setattr(lm, "SHARD_NGRAMS", shard)
            seen.append({r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    differ = [(s[k], seen[0][k]) for s in seen for k in s if s[k] != seen[0][k]]
    assert differ == []
    for i, (known, base, value) in want.items():
        assert seen[0][i][:2] == (known, n) and seen[0][i][2] == pytest.approx(base, abs=1e-6) and seen[0][i][3] == pytest.approx(value, rel=5e-4, abs=1e-3)


def test_long_texts_are_split_without_loss(spark, monkeypatch):
    text = " ".join(f"word{i % 37}\t{'x' * (i % 90)}" for i in range(500)).encode()
    parts = list(common.parts_of(text, 64))
    assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split() and list(common.parts_of(b"")) == []
    rng = np.random.default_rng(2)
    net = toxicity.Net()
    size = np.array([3, 0, 950, 1, 40, 201, 2])
    ids = np.stack([rng.integers(0, 1 << bits, size.sum()) for bits, _, _ in toxicity.TABLES], 1)
    whole = net.forward(ids, size)[0]
    monkeypatch.setattr(toxicity, "WINDOW", 100)
    assert toxicity.logits_of(net, ids, size) == pytest.approx(whole, abs=1e-5)


def test_elias_fano_and_odd(spark, odd, tmp_path):
    x = np.sort(np.random.default_rng(0).integers(0, 10**9, 2000)).astype(np.uint64)
    with open(tmp_path / "ef", "w+b") as f:
        assert (lm.EliasFano(x, 10**9, f).get(np.arange(2000)) == x).all()
    got = lm.score(odd.withColumn("train", F.lit(True))).collect()
    assert len(got) == len(ODD) and all(r.score <= 0 for r in got)
    assert lm.score(odd.withColumn("train", F.lit(True)).limit(0)).count() == 0
    assert lm.score(odd.withColumn("train", F.lit(None).cast("boolean"))).count() == len(ODD)


def test_html_cases(spark):
    trees = html.train(pages=300)
    article = "".join(f"<p>Sentence {i} of the story has words, commas and some length to it &amp; more.</p>" for i in range(6))
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>About</a></li></ul></nav><article><h1>A  title\n here</h1>{article}</article><div class='sidebar'><a href='/r'>Related stuff</a></div><footer>&copy; someone</footer><script>var x = '<p>no</p>';</script></body></html>"
    cases = [(1, page), (2, None), (3, ""), (4, page), (5, "<p>broken <b>markup"), (6, "<<<>>><p" * 50)]
    df = spark.createDataFrame([(i, "u", h, "clash") for i, h in cases], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df, trees).collect()}
    want = "\n".join(["A title here", *[f"Sentence {i} of the story has words, commas and some length to it & more." for i in range(6)]])
    assert got[1] == got[4] == want and got[2] == got[3] == ""
    assert html.extract(df.limit(0), trees).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><body><p>some words</p>", ["some words"]),
        ("<html><head><title>T</title><meta name=a><p>some words</p>", ["some words"]),
        ("<head><link rel=x>bare words<p>more</p>", ["bare words", "more"]),
        ("<head><title>T</title></head><body><p>words</p>", ["words"]),
        ("<p>some</p><head><p>words</p>", ["some", "words"]),
        ("<p><svg class='i'/> words</p><p>more</p>", ["words", "more"]),
        ("<p>a <svg><path d='x'/>no</svg> b</p><p><math/>c</p>", ["a b", "c"]),
    ],
)
def test_html_open_heads_and_self_closed_elements_lose_no_text(page, want):
    assert [t for _, t in html.Page(page).blocks] == want


@pytest.mark.parametrize("piece", ["<a ", "<a \">\" ", "<div></b>", "<a '", "<b><div></div>", "<li><ul><div><li></li>", "<p><li><b><div></div>", "<!--", "<![", "&#99999999999999", "<table><tr><td>", "<td>", "</", "<a=\"'>"])
def test_html_hostile_pages_take_linear_time(piece):
    def seconds(n):
        page = piece * (n // len(piece))
        began = time.perf_counter()
        html.Page(page)
        return time.perf_counter() - began

    seconds(50_000)
    small = min(seconds(100_000) for _ in range(2))
    assert seconds(800_000) < 25 * small + 1.0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a &#0000000065; &#99999999999; b</p>", ["a A \ufffd b"]),
        ("<p>x " + "&#" + "9" * 6000 + "; y</p>", ["x \ufffd y"]),
        ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
        ("<p title='a > b'>quoted</p><p>next</p>", ["quoted", "next"]),
        ("<p title='never closed>broken</p><p>next</p>", ["broken", "next"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("a <!-- hidden", ["a"]),
        ("tail <b", ["tail <b"]),
        ("<p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["We know that x=2 holds"]),
        ("<p>so <math><semantics><mrow><mi>y</mi></mrow><annotation>\\y</annotation></semantics></math> too</p>", ["so y too"]),
        ("<p>a <svg><g><text>no</text></g><title>no</title></svg>b</p>", ["a b"]),
        ("<p>see <object data='x'>the <b>plan</b></object> here</p>", ["see the plan here"]),
        ("<p>hear <audio controls><source src='x'>no</audio> it</p>", ["hear it"]),
        ("<p>watch <video><track>no</video>it<canvas>no</canvas>now</p>", ["watch it now"]),
        ("<p>press <button>no</button> it</p>", ["press it"]),
        ("<p>open <svg><g><p>next</p>", ["open", "next"]),
        ("<div><p>one <svg><path></p><p>two</p></div>", ["one", "two"]),
    ],
)
def test_html_blocks(page, want):
    assert [t for _, t in html.Page(page).blocks] == want


class Article(HTMLParser):
    """Text blocks inside the article element, by a parser of its own."""

    def __init__(self):
        super().__init__()
        self.depth, self.skip, self.blocks, self.open = 0, 0, [], []

    def cut(self):
        if (text := " ".join("".join(self.open).split())) and self.depth:
            self.blocks.append(text)
        self.open = []

    def handle_starttag(self, tag, attrs):
        if tag not in html.INLINE and tag != "br":
            self.cut()
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        self.open += [" "] if tag == "br" else []

    def handle_endtag(self, tag):
        if tag not in html.INLINE and tag != "br":
            self.cut()
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        self.open += [data] if self.depth and not self.skip else []


def test_html_query_gives_the_articles(spark):
    """The pages of these tables hold their main text in one article element."""
    got = {r.page_id: r for r in rows(spark, "op4_html_extraction")}
    pages, checked = table("pages"), 0
    assert len(got) == len(pages)
    for i, url, page in zip(pages.page_id, pages.url, pages.html, strict=True):
        r = got[i]
        assert r.url == url and r.n_chars == len(r.text)
        if page and page.count("<article") == 1 and "</article>" in page:
            parser = Article()
            parser.feed(page)
            parser.close()
            assert r.text == "\n".join(parser.blocks)
            checked += 1
    assert checked > 0.8 * len(pages)


@pytest.mark.parametrize("named", [True, False])
def test_html_held_out_pages(named):
    """Precision and recall by characters of blocks on pages that the trees have not seen, also with names that say nothing."""
    trees, rng = html.train(), random.Random(99)
    kept = right = wanted = 0
    for _ in range(250):
        source = html.sample_page(rng)
        if not named:
            source = re.sub(r' (class|id)="[^"]*"', "", source)
        page = html.Page(source)
        chosen = html.decode(page, trees.logits(html.features([page])))
        for k, body in page.blocks:
            main = html._MARK in body
            wanted += main * len(body)
            kept += chosen[k] * len(body)
            right += (chosen[k] and main) * len(body)
    print(f"named {named}: precision {right / kept:.3f}, recall {right / wanted:.3f}")
    assert right / kept > (0.97 if named else 0.9) and right / wanted > (0.97 if named else 0.9)


def test_html_decoding_is_consistent():
    rng = np.random.default_rng(0)
    p = html.Page("<div><div><p>a</p><p>b</p></div><div><p>c</p></div></div>")
    n = len(p.tag)
    for _ in range(30):
        logits = rng.normal(size=n) * 3
        kept = html.decode(p, logits)
        prob = 1 / (1 + np.exp(-logits))
        value = lambda k: sum(math.log(prob[i] if k[i] else 1 - prob[i]) for i in range(1, n))
        best = max((value((True, *k)) for k in __import__("itertools").product([True, False], repeat=n - 1) if all(not k[i - 1] or p.parent[i] == 0 or k[p.parent[i] - 1] for i in range(1, n))))
        assert all(not kept[i] or kept[p.parent[i]] for i in range(1, n)) and value(kept) == pytest.approx(best)


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "PART_LINES", 7)
    data = [(i, f"http://{'www' if i % 2 else 'm'}.h{i % 4}.example.org/p?{i % 6}", f"<p>{i % 9} é</p>") for i in range(40)] + [(50, None, None), (51, "not a url [", ""), (52, "http://h0.example.org/", "x" * 200_000), (None, "http://k/", "<p>only</p>"), (53, "http://a/\r\nb", "y")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    index = warc.build_index(warc.write_archives(df, folder), folder)
    got = {r.page_id: r for r in warc.lookup(index, df, folder).collect()}
    last = {}
    for i, _, h in data:
        last[h or ""] = max(last.get(h or "", -1), i if i is not None else -1)
    for i, _, h in data:
        r = got[i]
        body = (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.digest_of(body))
        other = last[h or ""] not in (i, -1)
        assert (r.record_type, r.refers_to) == (("revisit", last[h or ""]) if other else ("response", None))
    assert len(got) == len(data)
    assert warc.lookup(index, df.where("page_id = 3"), folder).count() == 1
    assert warc.archive_and_read(df.limit(0)).count() == 0
    again = df.where("page_id < 20").union(df.where("page_id in (3, 4, 50)")).union(df.where("page_id = 3"))
    repeats = Counter(r.page_id for r in warc.archive_and_read(again).collect())
    assert repeats == Counter({**{i: 1 for i in range(20)}, 3: 3, 4: 2, 50: 1})


def test_pieces_round_trip_and_inclusion(spark, odd):
    got = pieces.encode(odd).collect()
    restored = pieces.decode_column(pieces.encode(odd.select("doc_id", "text")).select("doc_id", F.col("text").alias("was"), F.explode("samples.ids").alias("ids")), "ids")
    assert all(r.text == (r.was or "") for r in restored.collect())
    for r in got:
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples) and [s.value for s in r.samples] == sorted((s.value for s in r.samples), reverse=True)
        assert all(s.log_inclusion <= 0 for s in r.samples)
    assert pieces.encode(odd.limit(0)).count() == 0


def test_pieces_copies_draw_their_own_samples_and_spaces_join(spark):
    text = "sampled segmentations of one text " * 5
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text), (2, text), (1, text)], "doc_id long, text string").coalesce(1)
    drawn = [(r.doc_id, tuple(r.samples[0].ids)) for r in pieces.encode(df, copies=True).collect()]
    assert Counter(k for k, _ in drawn) == {1: 3, 2: 3} and len(set(drawn)) == 6
    assert len({tuple(r.samples[0].ids) for r in pieces.encode(df).collect()}) == 2
    assert pieces.words_of(b"  a  b   ") == [b"  a", b"  b", b"   "] and pieces.words_of(b"") == [b""]
    parts = [b"a", b"  ", b" ", b""] + [bytes([i]) for i in range(256)]
    v = pieces.Vocabulary(parts[:4] + [b""] * 256, list(range(4, 260)))
    assert {tuple(s["ids"].tolist()) for s in pieces.sample(v, [b"a  a"], [b"1"], k=5)[0]} == {(0, 1, 0), (0, 2, 2, 0)}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_copies_draw_their_own_samples_wherever_they_lie(spark, parts):
    rows_ = [(7, "sampled segmentations of one text " * 5)] * 6 + [(8, "another text of several words"), (7, "one more under that key"), *[(None, "keyless segmentations of several words " * 5)] * 2]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").repartition(parts)
    drawn = [(r.doc_id, r.text, tuple(tuple(s.ids) for s in r.samples)) for r in pieces.encode(docs, copies=True).collect()]
    assert len({d for d in drawn if d[:2] == rows_[0]}) == 6 and len({d for d in drawn if d[0] is None}) == 2
    whole = [(r.doc_id, r.text, tuple(tuple(s.ids) for s in r.samples)) for r in pieces.encode(docs.coalesce(1), copies=True).collect()]
    assert Counter(drawn) == Counter(whole)


def test_pipeline_keeps_columns_whose_names_clash(spark, tmp_path):
    """Columns that bear the names of what the operators add come through each stage as they were."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = ["size", "target", "copies", "source_size", "score", "predicted", "lang_pred", "samples", "fp", "root", "cowrie_rest", "k", "toxic", "at"]
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        kept = [n for n in names if name != "pieces" or n != "samples"]
        if name != "pieces":
            assert out.columns == docs.columns
        assert out.count() > 100 and out.where(" OR ".join(f"`{n}` <> concat('{n}', doc_id)" for n in kept)).count() == 0
        if name != "pieces":
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")


def test_pieces_query_restores_every_text(spark):
    got = {r.doc_id: r for r in rows(spark, "op6_piece_sampling")}
    docs = table("documents")
    vocabulary = pieces.Vocabulary(*pieces.load_vocabulary())
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        r = got[i]
        assert r.n_bytes == len((text or "").encode()) and r.samples
        assert all(s.restores and s.n_pieces > 0 for s in r.samples) or not text
        assert len({s.ids_hash for s in r.samples}) == len(r.samples)
    for i, text in list(zip(docs.doc_id, docs.text, strict=True))[:40]:
        for s, m in zip(got[i].samples, pieces.sample(vocabulary, [(text or "").encode()], [str(i).encode()])[0], strict=True):
            assert s.n_pieces == len(m["ids"]) and pieces.decode(vocabulary, m["ids"]) == (text or "").encode()
            logq = log_probability(vocabulary, (text or "").encode(), m["ids"]) if text and len(text) < 3000 else s.log_prob
            assert s.log_prob == pytest.approx(logq, rel=1e-6, abs=1e-4)


def test_places_where_no_longer_piece_begins_are_left(monkeypatch):
    parts = [b"", b"", b"", b"", b"a", b"ab", b"abcdef", b"b", b"c", b"zz", b"z"]
    v = pieces.Vocabulary(parts + [b""] * 256, list(range(len(parts), len(parts) + 256)))
    words = [b"abcabcdefz", b"zzz", b"xa" * 5, b"c"]
    looked = []

    class Marks(np.ndarray):
        def __getitem__(self, k):
            row = super().__getitem__(k).view(np.ndarray)
            return type("Row", (), {"__getitem__": lambda _, at: (looked.append((k, len(at))), row[at])[1]})()

    monkeypatch.setattr(v, "marks", v.marks.view(Marks))
    lat = pieces.build(v, words)
    data = b"".join(words)
    edges = {(a, a + len(x)) for w, end in zip(words, np.cumsum(list(map(len, words))).tolist(), strict=True) for a in range(end - len(w), end) for x in parts if x and data[a:end].startswith(x)}
    single = {(a, a + 1) for a in range(len(data)) if data[a : a + 1] not in parts}
    assert set(zip(lat.start.tolist(), lat.end.tolist(), strict=True)) == edges | single
    # all places are looked at once; the third byte only where "ab" has another one behind it
    assert looked[0] == (1, len(data)) and dict(looked)[3] == 2


def log_probability(vocabulary, text, ids):
    """Log probability of a segmentation among all of the text's, by a plain sum over its lattice."""
    weight = {}
    for i, piece in enumerate(vocabulary.bytes):
        if piece and i not in set(vocabulary.byte_ids.tolist()):
            weight[piece] = max(weight.get(piece, -np.inf), vocabulary.logp[i])
    total = 0.0
    for word in pieces.words_of(text):
        beta = [-np.inf] * len(word) + [0.0]
        for a in range(len(word) - 1, -1, -1):
            if word[a] & 0xC0 == 0x80:
                continue  # inside a character only its bytes lead on
            size = next((n for n, low in ((4, 0xF0), (3, 0xE0), (2, 0xC0)) if word[a] >= low), 1)
            ways = [weight[word[a:b]] + beta[b] for b in range(a + 1, min(len(word), a + vocabulary.longest) + 1) if word[a:b] in weight]
            if word[a : a + size] not in weight:
                ways.append(size * vocabulary.byte_logp + beta[a + size])
            beta[a] = float(np.logaddexp.reduce(ways))
        total += beta[0]
    byte = set(vocabulary.byte_ids.tolist())
    return sum(vocabulary.byte_logp if int(i) in byte else vocabulary.logp[i] for i in ids) - total


def test_pieces_do_not_depend_on_the_words_met_before(monkeypatch):
    vocabulary = pieces.Vocabulary(*pieces.load_vocabulary())
    texts = [(t or "").encode() for t in table("documents").text[:60]]
    keys = [str(i).encode() for i in range(60)]
    words = pieces.Words(vocabulary)
    monkeypatch.setattr(pieces.Words, "MOST", 500)
    at_once = pieces.sample(vocabulary, texts, keys)
    in_turn = [pieces.sample(vocabulary, [t], [k], words=words)[0] for t, k in zip(texts, keys, strict=True)]
    for a, b in zip(at_once, in_turn, strict=True):
        assert [x["ids"].tolist() for x in a] == [x["ids"].tolist() for x in b] and [x["value"] for x in a] == pytest.approx([x["value"] for x in b], abs=1e-5)


def test_pieces_sample_without_replacement():
    """Over many keys, first samples follow the lattice's probabilities."""
    parts = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b""] + [bytes([i]) for i in range(256)]
    v = pieces.Vocabulary(parts[:7] + [b""] * 256, list(range(7, 263)))
    n = 4000
    found = pieces.sample(v, [b"abc"] * n, [str(i).encode() for i in range(n)], k=3)
    seen = Counter(tuple(f[0]["ids"].tolist()) for f in found)
    prob = {tuple(s["ids"].tolist()): math.exp(s["log_prob"]) for f in found for s in f}
    assert sum(prob.values()) == pytest.approx(1, abs=1e-3)
    assert all(abs(seen[p] / n - q) < 4 * math.sqrt(q / n) + 0.003 for p, q in prob.items())
    second = Counter(tuple(f[1]["ids"].tolist()) for f in found)
    want = Counter()
    for a, pa in prob.items():
        for b, pb in prob.items():
            if a != b:
                want[b] += pa * pb / (1 - pa)
    assert all(abs(second[p] / n - q) < 4 * math.sqrt(q / n) + 0.003 for p, q in want.items())


def chosen_by_hand(hashes, window=winnow.WINDOW):
    out = []
    for i in range(max(1, len(hashes) - window + 1)) if hashes else []:
        part = hashes[i : i + window]
        at = max(j for j, h in enumerate(part) if h == min(part)) + i
        if at not in out:
            out.append(at)
    return [(hashes[i], i) for i in out]


def grams_by_hand(text):
    """Rolling hashes of five words, from xxhash alone: word hashes as Spark's xxhash64 gives them (seed 42), folded to a prime."""
    prime, base = (1 << 31) - 1, 1_000_003
    signed = lambda b: (h := xxhash.xxh64_intdigest(b, 42)) - (1 << 64) * (h >> 63)
    w = [signed(x.encode()) % prime for x in WORD.findall(text)]
    if 0 < len(w) < 5:
        return [signed(" ".join(map(str, w)).encode()) % prime]
    out = []
    for i in range(len(w) - 4):
        h = 0
        for x in w[i : i + 5]:
            h = (h * base + x) % prime
        out.append(h)
    return out


def fingerprint_by_hand(text):
    seen = chosen_by_hand(grams_by_hand(text))
    return " ".join(f"{h:x}@{i}" for h, i in seen)


def test_query_fingerprints_by_hand(spark):
    docs = table("documents").sort_values("doc_id", ascending=False)
    ids, texts = docs.doc_id.tolist(), [t or "" for t in docs.text]
    got = {r.doc_id: r for r in rows(spark, "op7_fingerprints")}
    for i, (k, t) in enumerate(zip(ids, texts, strict=True)):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]
        assert got[k].fingerprint == fingerprint_by_hand(t) and got[k].edited_fingerprint == fingerprint_by_hand(edited)


@pytest.mark.parametrize("chunk", [1, 3, 25_000])
def test_next_document_of_any_ordered_key(spark, monkeypatch, chunk):
    monkeypatch.setattr(winnow, "CHUNK_ROWS", chunk)
    tables = {
        "long": [-(1 << 63), (1 << 63) - 1, (1 << 62), -(1 << 62), 0, 0, (1 << 62) + 1, None],
        "string": ["", "a", "ab", "same prefix of many letters 1", "same prefix of many letters 2", "é", "漢字", "~", None, "a"],
        "int": [3, 2, 2, 7], "date": [datetime.date(1, 1, 1), datetime.date(9999, 12, 31), datetime.date(2024, 2, 29), None],
        "decimal(38,0)": [decimal.Decimal(10**37), decimal.Decimal(-(10**37)), decimal.Decimal(5), decimal.Decimal(6)],
    }
    for kind, keys in tables.items():
        df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], f"id {kind}, text string").repartition(3)
        last = sorted((i for i, k in enumerate(keys) if k is None), key=lambda i: f"t{i}")
        order = sorted((i for i, k in enumerate(keys) if k is not None), key=lambda i: f"t{i}")
        order = sorted(order, key=lambda i: keys[i].encode() if kind == "string" else keys[i], reverse=True)
        # a reversed sort keeps equal keys in the order they came
        order += last
        want = {f"t{i}": f"t{order[(j + 1) % len(order)]}" for j, i in enumerate(order)}
        assert {r.text: r.next.text for r in winnow.with_next(df, "id", "text", lambda d: d).collect()} == want, kind


def test_winnowing(spark, odd):
    df = winnow.add_fingerprint(odd, "text", "chosen").select("text", winnow.hashes(F.col("chosen")).alias("h"), winnow.positions(F.col("chosen")).alias("p"), winnow.as_text(F.col("chosen")).alias("s"))
    grams = winnow.add_fingerprint(odd.select("text"), "text", "every", window=1).select("text", F.transform("every", lambda x: F.shiftright(x, 28)).alias("g")).collect()
    by_text = {r.text: r.g for r in grams}
    for r in df.collect():
        if r.text and r.text != LONG:
            want = chosen_by_hand(by_text[r.text])
            assert list(r.p) == [i for _, i in want] and r.s == " ".join(f"{h:x}@{i}" for h, i in want)
    out = winnow.fingerprint_documents(odd).collect()
    assert len(out) == len(ODD) and all(0 <= r.near_next <= 1 for r in out)
    assert winnow.fingerprint_documents(odd.limit(0)).count() == 0


def likeness_by_hand(a, b):
    a, b = ({g.split("@")[0] for g in x.split()} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("chunk", [7, 50_000])
def test_fingerprints_of_edited_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(winnow, "CHUNK_ROWS", chunk)
    docs = table("documents").sort_values("doc_id", ascending=False)
    ids, texts = docs.doc_id.tolist(), [t or "" for t in docs.text]
    got = {r.doc_id: r for r in rows(spark, "op7_fingerprints")}
    edits = []
    for i, (k, t) in enumerate(zip(ids, texts, strict=True)):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        edits.append((k, edited))
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[k].near_next == pytest.approx(likeness_by_hand(got[k].fingerprint, got[ids[(i + 1) % len(ids)]].fingerprint))
        assert got[k].near_edited == pytest.approx(likeness_by_hand(got[k].fingerprint, got[k].edited_fingerprint))
    again = winnow.add_fingerprint(spark.createDataFrame(edits, "doc_id long, text string"), "text", "c").select("doc_id", winnow.as_text(F.col("c")).alias("f"))
    assert all(got[r.doc_id].edited_fingerprint == r.f for r in again.collect())


def test_next_document_with_gaps_ties_and_no_keys(spark):
    keys = [-(10**15), -5, -5, 0, 1, 2, 3, 10**17, 10**17 + 1, None, None]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "id long, text string")
    order = sorted(enumerate(keys), key=lambda x: (x[1] is None, -(x[1] or 0), f"t{x[0]}"))
    want = {f"t{i}": f"t{order[(j + 1) % len(order)][0]}" for j, (i, _) in enumerate(order)}
    got = winnow.with_next(df, "id", "text", lambda d: d.withColumn("twice", F.concat("text", "text"))).collect()
    assert {r.text: r.next.text for r in got} == want and all(r.next.twice == r.next.text * 2 for r in got)
    assert [r.next.text for r in winnow.with_next(df.where("id = 0"), "id", "text", lambda d: d).collect()] == ["t3"]


def test_toxicity(spark, odd):
    got = rows(spark, "op8_toxicity")
    docs = table("documents")
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and (r.score >= 0.7) == bool(r.predicted) for r in got)
    toxic = "zzbad qqworse xxawful"
    train = spark.createDataFrame([(i, f"plain words number {i} and more {i % 7} " + (toxic if i % 4 == 0 else "kind good fine"), "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = train.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    model = toxicity.fit(train, labels)
    test = [("some text with " + toxic, 1), ("some text that is kind good fine", 0)]
    scored = toxicity.score(spark.createDataFrame(test, "text string, y int"), model).collect()
    assert [r.predicted for r in scored] == [r.y for r in scored]
    again = toxicity.score(odd, model)
    assert again.count() == len(ODD) and {r.predicted for r in again.where("text is null or text = ''").collect()} == {0}
    assert toxicity.fit(train, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_simhash_against_all_pairs(spark):
    got = {r.doc_id: r for r in rows(spark, "op9_simhash_dedup")}
    docs = table("documents").drop_duplicates("doc_id")
    prints = {}
    for k, t in zip(docs.doc_id, docs.text, strict=True):
        ws = WORD.findall(lower(t))
        sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        prints[k] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 2
    root = components(len(ids), near)
    for i, k in enumerate(ids):
        assert got[k].fingerprint == f"{prints[k]:016x}" and got[k].component_id == ids[root[i]]


def test_simhash_hot_cells_and_odd(spark, odd):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False))) for _ in range(400)} | {int(x) for x in rng.integers(0, 2**63, 200)})
    f = np.array(fps, np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None]) <= 2, 1))
    want = {(fps[a], fps[b]) for a, b in zip(i, j, strict=True)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for cell_rows in (5, 10**6):
        assert {(r.a, r.b) for r in simhash.links(df, cell_rows).collect()} == want
    out = simhash.near_duplicates(odd).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert len(out) == len(ODD) and by[5] == {4} and by[1] == by[2] == by[3] == {1}
    kept = simhash.deduplicate(odd)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 6, 7, 8] and kept.columns == odd.columns
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_deduplicate_tells_rows_apart_by_key_and_text(spark):
    words = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, 60))
    a, b, c, d, e, f = (words(i) for i in range(6))
    data = [(None, a), (None, b), (None, b), (None, c), (3, c), (1, d), (5, d), (5, e), (7, e), (2, f), (2, f), (2, words(9)), (1, words(9))]
    got = simhash.deduplicate(spark.createDataFrame([(k, t, "clash") for k, t in data], "doc_id long, text string, fp string"))
    assert got.columns == ["doc_id", "text", "fp"]
    want = [(None, a), (None, b), (3, c), (1, d), (5, e), (2, f), (1, words(9))]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def test_language(spark, odd):
    got = {r.doc_id: r for r in rows(spark, "op10_language_id")}
    docs = table("documents")
    held = [(k, v) for k, v in zip(docs.doc_id, docs.lang, strict=True) if got[k].held_out and v]
    assert np.mean([got[k].lang_pred == v for k, v in held]) >= 0.95
    train = spark.createDataFrame([(i, ["the house and the garden are green", "das haus und der garten sind grün", "дом и сад зелёные очень"][i % 3], ["en", "de", "ru"][i % 3]) for i in range(90)], "doc_id long, text string, lang string")
    model = language.fit(train)
    mixed = "the house and the garden are green das haus und der garten sind grün дом и сад зелёные"
    out = language.identify(spark.createDataFrame([(mixed,), (None,), ("123 !?",), ("漢字",)], "text string"), model).collect()
    assert [s.lang for s in out[0].lang_spans] == ["en", "de", "ru"] and [(s.first, s.last) for s in out[0].lang_spans] == [(0, 6), (7, 13), (14, 17)]
    assert [(r.lang_pred, r.score) for r in out[1:3]] == [("und", 0.0)] * 2 and out[3].lang_pred in ("en", "de", "ru")
    again = language.identify(odd, model)
    assert again.count() == len(ODD) and language.identify(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(train.where("lang is null"))).collect()} == {"und"}


def test_rare_languages_are_learned_and_too_many_refused(spark, monkeypatch):
    data = [(i, f"common words of tongue{i % 3} w{i % 50}", f"l{i % 3}") for i in range(300)] + [(1000 + i, f"zyx{i}qq uvw qqq", f"rare{i}") for i in range(230)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert len(model.languages) == 233
    again = language.fit(df.repartition(7))
    assert (model.scores == again.scores).all()
    monkeypatch.setattr(language, "LANGUAGES", 232)
    with pytest.raises(ValueError):
        language.fit(df)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for n in (1, 4, 6):
        s = rng.normal(size=(n, 3)).astype(np.float32) * 4 - 3
        path = language.viterbi([np.arange(n), np.arange(1)], s, switch=2.0)[0]
        value = lambda p: sum(s[t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(value(p) for p in __import__("itertools").product(range(3), repeat=n))
        assert value(path.tolist()) == pytest.approx(best, abs=1e-4)


def copies_by_hand(docs):
    """Copies of each (key, source, text) by the mixing contract."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) * 1.5 - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        target = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] >= 2 * sizes[s]}
        if not over:
            break
        capped |= over
    out = []
    for key, text, source in docs:
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        u = int(hashlib.md5(f"mix:{'' if key is None else key}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(key, text)] * (int(rate) + (u < rate - int(rate)))
    return Counter(out)


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "pieces":
            assert out.columns == spark.read.parquet(f"{DATA}/documents.parquet").columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept["in", name], docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    # toxicity: the rows whose own score, one text at a time, is below the cut
    before, after = kept["in", "toxicity"], pairs(kept["in", "language"])
    model = toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    one = toxicity._make(type("Shared", (), {"value": model}))
    assert Counter(after) == Counter(r for r in pairs(before) if not one([pa.array([r[1]])])[1][0].as_py())
    toxic = dict(table("labels").dropna(subset=["toxic"])[["doc_id", "toxic"]].itertuples(index=False))
    clean = [r for r in pairs(before) if toxic.get(r[0]) == 0]
    assert sum(toxic.get(r[0]) == 1 for r in after) <= 0.25 * sum(toxic.get(r[0]) == 1 for r in pairs(before)) and sum(toxic.get(r[0]) == 0 for r in after) >= 0.97 * len(clean)
    # language: the best path of each text, by itself
    before, after = after, pairs(kept["in", "near duplicates"])
    alone = language._make(language.fit(kept["in", "language"]), False)
    say = lambda t: [x[0].as_py() for x in alone([pa.array([t], pa.string())])]
    assert Counter(after) == Counter(r for r in before if (s := say(r[1]))[0] != "und" and s[1] >= 0.5)
    # near duplicates: the least key of each group by all pairs
    before, after = after, pairs(kept["in", "mixing"])
    before = sorted(before, key=lambda r: r[0])
    prints = np.array([simhash.fingerprint_of((r[1] or "").encode()) for r in before], np.int64).view(np.uint64)
    root = components(len(before), np.bitwise_count(prints[:, None] ^ prints[None]) <= 2)
    assert len({r[0] for r in before}) == len(before) and Counter(after) == Counter(r for i, r in enumerate(before) if root[i] == i)
    # mixing, and pieces that restore every copy
    emitted = copies_by_hand(after)
    assert Counter(r[:2] for r in pairs(kept["in", "pieces"])) == emitted
    vocabulary = pieces.Vocabulary(*pieces.load_vocabulary())
    told = [(r.doc_id, tuple(tuple(s.ids) for s in r.samples)) for r in docs.collect()]
    texts = {k: (t or "").encode() for k, t in emitted}
    assert Counter(k for k, _ in told) == Counter(k for k, _ in emitted.elements()) and all(pieces.decode(vocabulary, np.array(ids)) == texts[k] for k, found in told for ids in found)
    assert len(set(told)) > 0.95 * len(told)  # copies have samples of their own
    run = corpus_pipeline.run(spark, DATA)
    assert Counter(r.doc_id for r in run.collect()) == Counter(k for k, _ in told)


def test_toxicity_query_held_out(spark):
    """Rows that were not learned from, at a size where each language has a few toxic rows."""
    data = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, data).where("held_out").collect()}
    told = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").collect() if r.doc_id in got}
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())
    toxic, clean = [k for k, r in told.items() if r.toxic], [k for k, r in told.items() if not r.toxic]
    assert len(toxic) > 10 and sum(got[k].predicted for k in toxic) >= 0.75 * len(toxic)
    assert sum(got[k].predicted for k in clean) <= 0.02 * len(clean)
    foreign = [k for k in clean if told[k].lang != "en"]
    assert sum(got[k].predicted for k in foreign) <= 0.04 * len(foreign)


def test_thresholds_by_language_at_any_size():
    rng = np.random.default_rng(0)
    for n in (60, 499, 501, 3000):  # two languages whose logits lie apart
        spoken, target = np.arange(n) % 2, (np.arange(n) % 10 < 3).astype(float)
        logits = rng.normal(0, 0.2, n) + 3 * target + 2 * spoken
        cuts = toxicity.calibrate(logits, target, spoken, 3)
        assert 0.5 < cuts[0] < 2.9 and 2.5 < cuts[1] < 4.9 and cuts[0] < cuts[1]
        assert cuts[2] == toxicity.threshold(logits, target)


def test_toxicity_learns_from_every_row(spark):
    """Words are counted over all labelled rows, more of a class than one task trains on."""
    docs = spark.range(6_540).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "gamma").when(F.col("id") % 3 == 0, "alpha").otherwise("beta").alias("text"), F.when(F.col("id") < 40, None).when(F.col("id") % 3 == 0, "en").otherwise("fr").alias("lang"))
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") < 40).cast("int").alias("toxic")))
    en, fr = docs.where("lang = 'en'").count(), docs.where("lang = 'fr'").count()
    ids, _ = toxicity.Hasher().rows_of([b"alpha", b"beta"])
    odds = lambda n, total: math.log(n + 0.2) - math.log(total + 0.2 * (1 << 18))
    assert en + fr == 6_500 and model[1][ids[:, 0]] == pytest.approx(np.array([[0, odds(0, fr) - odds(en, en)], [odds(0, en) - odds(fr, fr), 0]]), abs=1e-4)
    got = toxicity.score(spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "text string"), model).collect()
    assert [r.predicted for r in got] == [0, 0, 1]


def test_toxicity_of_shards_is_the_same_in_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 90)
    toxic = "zzbad qqworse xxawful"
    train = spark.createDataFrame([(i, f"plain words number {i} and more {i % 7} " + (toxic if i % 4 == 0 else "kind good fine"), "en" if i % 5 else None) for i in range(400)], "doc_id long, text string, lang string")
    labels = train.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    models = [toxicity.fit(train.repartition(n), labels.repartition(n)) for n in (1, 7)]
    test = spark.createDataFrame([("some text with " + toxic,), ("some text that is kind good fine",), (None,)], "text string")
    scores = [[(r.score, r.predicted) for r in toxicity.score(test, m).collect()] for m in models]
    assert scores[0] == scores[1] and [p for _, p in scores[0]] == [1, 0, 0]
    rng = np.random.default_rng(0)
    cell, hit = rng.integers(-9, 9, 500), rng.integers(0, 2, 500)
    at, where = np.unique(cell, return_inverse=True)
    full = at[np.bincount(where) > 0]
    rows = toxicity.threshold(full / 4, np.bincount(where, hit), np.bincount(where))
    best = max(full, key=lambda c: 1.25 * hit[cell >= c].sum() / ((cell >= c).sum() + 0.25 * hit.sum()) * (2 * hit[cell >= c].sum() >= (cell >= c).sum()))
    assert rows == pytest.approx(best / 4 - 0.125)
