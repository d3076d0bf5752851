"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded as a tree.

Each element that is not inline gets features of itself (tag, attribute tokens,
depth), of its subtree (text, links, density, punctuation) and of its siblings.
Boosted trees give the probability that its subtree holds main text. Decoding
picks the most probable labelling of the whole tree in which nothing under a
rejected node is kept. The trees are trained in numpy on pages from a seeded
generator that marks its main text.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.llm.common import utf8, with_columns_from

#: Generated pages, trees, their depth, bins of a feature and step of boosting.
PAGES, TREES, DEPTH, BINS, STEP = 900, 60, 5, 32, 0.25

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_LONG_REFERENCE = re.compile(r"&#(?:0*([1-9][0-9]{7,})|[xX]0*([1-9a-fA-F][0-9a-fA-F]{7,})|0+([0-9]{1,7})(?![0-9])|[xX]0+([0-9a-fA-F]{1,7})(?![0-9a-fA-F]));?")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z-]+)""")
_SPACE = re.compile(r"\s+")
_MARK = ""  # what the generator puts before main text

# Kinds of elements.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MEDIA = frozenset("audio button canvas svg video".split())
FORMULA = frozenset("math annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = MEDIA | FORMULA | frozenset("object picture a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = MEDIA | frozenset("select option head datalist annotation annotation-xml".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Elements that may lie in a head; any other tag, and any text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())

# Groups of tags and of attribute tokens that are features.
TAG_GROUPS = (("article", "main"), ("nav", "menu"), ("header", "hgroup"), ("footer", "address"), ("aside",), ("form", "fieldset"), ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html"))
TOKEN_GROUPS = (
    ("article", "content", "post", "entry", "story", "main", "text", "body", "paragraph", "prose"),
    ("nav", "menu", "breadcrumb", "breadcrumbs", "topnav", "navbar", "pagination", "pager", "toc", "links"),
    ("header", "masthead", "logo", "top", "banner", "hero", "branding"),
    ("footer", "copyright", "legal", "bottom", "credits", "colophon"),
    ("sidebar", "side", "widget", "related", "rail", "recommended", "trending", "popular", "more", "aside", "tags"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adslot", "dfp", "promotion"),
    ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "gdpr", "message", "warning", "signup", "paywall"),
    ("comment", "comments", "reply", "replies", "disqus", "respond", "commentlist", "discussion", "thread"),
    ("share", "social", "follow", "tweet", "login", "search", "form", "register", "author", "meta", "byline"),
)
_GROUP_OF = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_TOKEN_OF = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tags:
    """The tags of a page, each found in time in proportion to what is read.

    A tag ends at the first ">" outside of quotes. Where there is none, the page's
    quotes are broken, and from there on tags end at the next ">".
    """

    def __init__(self, source: str) -> None:
        self.source, self.broken = source, False
        self.last = source.rfind(">")

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """First character, end, name, whether it is an end tag, and attributes of the next tag; a comment has no name."""
        source = self.source
        while True:
            start = source.find("<", at)
            if start < 0 or (start > self.last and not source.startswith("<!--", start)):
                start = source.find("<!--", start) if start >= 0 else start
                return (start, len(source), "", False, "") if start >= 0 else None
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(source), "", False, ""
            m = _NAME.match(source, start)
            if m:
                rest = None if self.broken else _REST.match(source, m.end())
                self.broken |= rest is None
                end = rest.end() if rest else source.find(">", m.end()) + 1
                return start, end, m[1].lower(), source[start + 1] == "/", source[m.end() : end - 1]
            if source[start + 1 : start + 2] in ("!", "?"):
                return start, source.find(">", start) + 1, "", False, ""
            at = start + 1


def _short_reference(m: re.Match) -> str:
    """A numeric reference with leading zeros or too many digits, for ``html.unescape``."""
    return "\ufffd" if m[1] or m[2] else f"&#{m[3]};" if m[3] else f"&#x{m[4]};"


class Page:
    """Nodes of a page in document order and the blocks of text that they own."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.tokens, self.hidden = ["html", "body"], [-1, 0], [0, 0], [False, False]
        self.own, self.link, self.marks = [0, 0], [0, 0], [0, 0]  # characters of own text, in links, punctuation
        self.blocks: list[tuple[int, str]] = []
        # open elements: name, node (inline ones keep their owner's), place of the nearest that is not inline
        stack: list[tuple[str, int, int]] = [("html", 0, 0), ("body", 1, 1)]
        places: dict[str, list[int]] = {"html": [0], "body": [1]}  # of open elements by name
        parts: list[str] = []
        links = silent = 0
        at = 0

        def text(piece: str) -> None:
            if stack[-1][0] == "head" and piece.strip(" \t\n\r\f"):
                close(len(stack) - 1)
            if silent or not piece:
                return
            if "&" in piece:
                piece = entities.unescape(_LONG_REFERENCE.sub(_short_reference, piece) if "&#" in piece else piece)
            parts.append(piece)
            if links and not piece.isspace():
                self.link[stack[-1][1]] += len(piece)

        def flush() -> None:
            if parts:
                body = _SPACE.sub(" ", "".join(parts)).strip()
                parts.clear()
                if body:
                    k = stack[-1][1]
                    self.blocks.append((k, body))
                    self.own[k] += len(body)
                    self.marks[k] += body.count(".") + body.count(",")

        def close(to: int) -> None:
            nonlocal links, silent
            while len(stack) > to:
                name = stack[-1][0]
                if name not in INLINE and not places.get("svg"):
                    flush()
                stack.pop()
                places[name].pop()
                links -= name == "a"
                silent -= name in SILENT

        def push(name: str, node: int) -> None:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, node, stack[-1][2] if name in INLINE or places.get("svg") else len(stack)))

        def highest(names: tuple[str, ...]) -> int:
            return max((places[x][-1] for x in names if places.get(x)), default=-1)

        n = len(source)
        tags = Tags(source)
        while at < n:
            m = tags.next(at)
            if m is None:
                text(source[at:])
                break
            start, end, name, ends, attrs = m
            text(source[at:start])
            at = end
            if not name:
                continue
            # the end tag of a head may be left out; a head elsewhere is no element
            if stack[-1][0] == "head" and (name in ("body", "html", "br") if ends else name not in IN_HEAD and name not in ("head", "html")):
                close(len(stack) - 1)
            if ends:
                if (d := highest((name,))) > 1:
                    close(d)
                continue
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(source, at)
                at = source.find(">", end.end()) + 1 if end else n
                at = at or n
                parts.append(" ")
                continue
            if name in VOID:
                if name in INLINE or name in ("br", "img", "input", "embed", "param", "source", "track"):
                    parts.append(" ")
                else:
                    flush()
                continue
            if name in CLOSES_P and stack[d := stack[-1][2]][0] == "p":
                close(d)
            if name in PEERS:
                scope = highest(SCOPES[name])
                if name == "tr":  # a row ends the cells and rows above the table, the lowest included
                    open_ = [p[bisect.bisect_right(p, scope)] for x in PEERS[name] if (p := places.get(x)) and p[-1] > scope]
                    if open_:
                        close(min(open_))
                elif (d := highest(PEERS[name])) > scope:
                    close(d)
            if name in ("html", "body") or (name == "head" and (len(stack) > 2 or len(self.tag) > 2)):
                continue
            if name in INLINE or places.get("svg"):  # what is drawn in a line of text does not end it
                if name in MEDIA:
                    parts.append(" ")
                if name in ("svg", "math") and attrs and attrs.endswith("/"):
                    continue
                links += name == "a"
                silent += name in SILENT
                push(name, stack[-1][1])
                continue
            flush()
            bits, hidden = 0, False
            if attrs and attrs.strip("/ \n\t\r"):
                for a in _ATTR.finditer(attrs):
                    key, value = (a[1] or a[5] or "").lower(), a[2] or a[3] or a[4] or ""
                    if key in ("class", "id", "role", "itemprop", "aria-label"):
                        for w in _WORDS.findall(value):
                            g = _TOKEN_OF.get(w.lower())
                            if g is not None:
                                bits |= 1 << g
                    elif key == "hidden" or (key == "style" and _HIDDEN.search(value)) or (key == "aria-hidden" and value == "true"):
                        hidden = True
            k = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1][1])
            self.tokens.append(bits)
            self.hidden.append(hidden)
            self.own.append(0)
            self.link.append(0)
            self.marks.append(0)
            silent += name in SILENT
            push(name, k)
        close(0)


def features(pages: list[Page]) -> np.ndarray:
    """One row per node, page after page."""
    size = np.array([len(p.tag) for p in pages])
    base = np.repeat(np.cumsum(size) - size, size)
    cat = lambda name, kind=np.float64: np.concatenate([np.array(getattr(p, name), dtype=kind) for p in pages])
    parent = cat("parent", np.int64)
    root = parent < 0
    parent = np.where(root, np.arange(len(parent)), parent + base)
    tokens = cat("tokens", np.int64)
    own, link, marks = cat("own"), cat("link"), cat("marks")
    group = np.array([_GROUP_OF.get(t, len(TAG_GROUPS)) for p in pages for t in p.tag])
    depth, above = np.zeros(len(parent)), np.zeros(len(parent), np.int64)
    above_tag = np.zeros(len(parent), np.int64)
    total, links, dots, below = own.copy(), link.copy(), marks.copy(), np.ones(len(parent))
    before = np.zeros(len(parent))
    up, tk, gp, dp, ab, at = parent.tolist(), tokens.tolist(), group.tolist(), [0] * len(parent), [0] * len(parent), [0] * len(parent)
    for i, u in enumerate(up):
        if u != i:
            dp[i] = dp[u] + 1
            ab[i] = ab[u] | tk[u]
            at[i] = at[u] | (1 << gp[u])
    depth, above, above_tag = np.array(dp), np.array(ab), np.array(at)
    sums = [x.tolist() for x in (total, links, dots, below)]
    for i in range(len(up) - 1, -1, -1):
        u = up[i]
        if u != i:
            for s in sums:
                s[u] += s[i]
    total, links, dots, below = (np.array(s) for s in sums)
    page = np.repeat(np.arange(len(pages)), size)
    whole = np.maximum(total[root][page], 1)
    before = np.cumsum(own) - own
    before = before - before[root][page]
    kids = np.bincount(parent[~root], minlength=len(parent))
    kid_text = np.bincount(parent[~root], total[~root], len(parent))
    kid_links = np.bincount(parent[~root], links[~root], len(parent))
    order = np.zeros(len(parent))
    seen: dict[int, int] = {}
    for i, u in enumerate(up):
        order[i] = seen.get(u, 0)
        seen[u] = int(order[i]) + 1
    peers = np.maximum(kids[parent] - 1, 1)
    columns = [np.where(group == g, 1.0, 0.0) for g in range(len(TAG_GROUPS))]
    columns += [(above_tag >> g & 1).astype(float) for g in range(6)]
    columns += [(group[parent] == g).astype(float) for g in range(len(TAG_GROUPS))]
    columns += [(tokens >> g & 1).astype(float) for g in range(len(TOKEN_GROUPS))]
    columns += [(above >> g & 1).astype(float) for g in range(len(TOKEN_GROUPS))]
    columns += [
        cat("hidden"), depth, np.log1p(total), np.log1p(own), links / np.maximum(total, 1), total / below, np.log1p(below), dots / np.maximum(total, 1) * 100,
        total / whole, before / whole, order / np.maximum(kids[parent], 1), np.log1p(kids[parent]), np.log1p(np.maximum(kid_text[parent] - total, 0) / peers), (kid_links[parent] - links) / np.maximum(kid_text[parent] - total, 1), np.log1p(kids),
    ]
    return np.stack(columns, 1).astype(np.float32)


class Trees:
    """Complete binary trees of one depth: a feature and a threshold per inner node."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float) -> None:
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Logistic gradient boosting on binned features."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    n, m = x.shape
    base = math.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight)))
    f = np.full(n, base)
    features_, cut_, leaf_ = [], [], []
    inner = (1 << DEPTH) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = (y - p) * weight, p * (1 - p) * weight
        at = np.zeros(n, np.int64)
        tf, tc = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            node = at - first
            key = (node[:, None] * m + np.arange(m)[None, :]) * BINS + binned
            hist = [np.bincount(key.ravel(), np.repeat(v, m), count * m * BINS).reshape(count, m, BINS).cumsum(2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[:, :, -1] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), BINS)
                if flat[k, best[k]] > 1e-6 and b < len(cuts[j]):
                    tf[first + k], tc[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), tf[at]] > tc[at])
        leaf = at - inner
        value = STEP * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        f += value[leaf]
        features_.append(tf)
        cut_.append(tc)
        leaf_.append(value)
    return Trees(np.array(features_), np.array(cut_), np.array(leaf_), base)


def decode(page: Page, logits: np.ndarray) -> list[bool]:
    """Kept nodes of the most probable labelling without a kept node under a rejected one."""
    keep = np.minimum(0, logits) - np.log1p(np.exp(-np.abs(logits)))  # log p
    lose = (keep - logits).tolist()  # log (1 - p)
    yes, no = keep.tolist(), list(lose)
    gain = [0.0] * len(yes)
    for i in range(len(yes) - 1, 0, -1):
        u = page.parent[i]
        y = yes[i] + gain[i]
        gain[u] += max(y, no[i])
        no[u] += no[i]
    kept = [True] * len(yes)
    for i in range(1, len(yes)):
        kept[i] = kept[page.parent[i]] and yes[i] + gain[i] >= no[i]
    return kept


# Names that the generator gives to parts of pages.
_NAMES = {
    "main": "content article-body post-content entry-content story main-text post entry article story-body page-content prose".split(),
    "nav": "nav menu main-menu navbar breadcrumbs topnav pagination".split(),
    "header": "header masthead site-header top branding page-header".split(),
    "footer": "footer site-footer copyright legal bottom colophon".split(),
    "side": "sidebar widget related right-rail popular side trending tags recommended".split(),
    "ad": "ad ads advert sponsored promo adslot advertisement ad-box promotion".split(),
    "notice": "cookie notice alert consent newsletter popup subscribe gdpr banner message signup".split(),
    "comments": "comments comment-list reply discussion disqus responses thread commentlist".split(),
    "share": "share social follow author byline meta login search".split(),
}


def sample_page(rng: random.Random) -> str:
    """A generated page; main text begins with a mark."""
    syllables = [a + b for a in "b c d f g l m n p r s t v".split() for b in "a e i o u an er is on".split()]

    def words(n: int) -> str:
        out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        for i in range(0, n, rng.randint(6, 14)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += rng.choice([".", ".", ","])
        return " ".join(out) + rng.choice([".", "", "."])

    plain = rng.random() < 0.25  # names say nothing

    def attrs(kind: str) -> str:
        if plain or rng.random() < 0.15:
            return rng.choice(["", "", f' class="{rng.choice(syllables)}{rng.randint(1, 99)}"'])
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(_NAMES[kind])}"'

    def el(tag: str, kind: str, body: str) -> str:
        return f"<{tag}{attrs(kind)}>{body}</{tag}>"

    def links(n: int, most: int = 3) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, most))}</a></li>' for i in range(n)) + "</ul>"

    def paragraph(mark: str = "", n: int | None = None) -> str:
        body = words(n or rng.choice([rng.randint(3, 12), rng.randint(15, 60), rng.randint(40, 160)]))
        if rng.random() < 0.25:
            body += f' <a href="/x">{words(2)}</a> {words(rng.randint(3, 20))}'
        if rng.random() < 0.15:
            body = f"<b>{body}<br>" if rng.random() < 0.5 else f"<em>{body}</em>"
            return f"<p>{mark}{body}" if rng.random() < 0.5 else f"<p>{mark}{body}</p>"
        return f"<p>{mark}{body}</p>"

    def article() -> str:
        out = []
        if rng.random() < 0.8:
            out.append(f"<h1>{_MARK}{words(rng.randint(2, 10))}</h1>")
            if rng.random() < 0.25:
                out.append(el("div", "share", f'<a href="/s">{words(1)}</a> <a href="/t">{words(1)}</a>'))
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            r = rng.random()
            if r < 0.7:
                out.append(paragraph(_MARK))
            elif r < 0.78:
                out.append(f"<h{rng.randint(2, 4)}>{_MARK}{words(rng.randint(2, 8))}</h{rng.randint(2, 4)}>")
            elif r < 0.83:
                out.append("<ul>" + "".join(f"<li>{_MARK}{words(rng.randint(3, 25))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.9:
                out.append(f"<blockquote>{paragraph(_MARK)}</blockquote>")
            elif r < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_MARK}{words(rng.randint(1, 6))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif r < 0.97:
                out.append(f"<pre>{_MARK}{words(rng.randint(5, 30))}</pre>")
            else:
                out.append(f'<figure><img src="x.png"><figcaption>{_MARK}{words(rng.randint(3, 12))}</figcaption></figure>')
            if rng.random() < 0.08:
                out.append(el(rng.choice(["div", "aside"]), rng.choice(["ad", "notice", "side"]), paragraph(n=rng.randint(3, 30))))
        body = "".join(out)
        if rng.random() < 0.1:
            return body
        tag = rng.choice(["article", "article", "div", "div", "main", "section"])
        body = f"<{tag}{attrs('main') if tag in ('div', 'section') or rng.random() < 0.3 else ''}>{body}</{tag}>"
        return f"<main>{body}</main>" if rng.random() < 0.2 else body

    def comments() -> str:
        one = lambda: f'<{k}{attrs("comments")}><a href="/u">{words(1)}</a>{paragraph(n=rng.randint(3, 60))}</{k}>'
        k = rng.choice(["div", "li", "article", "div"])
        body = "".join(one() for _ in range(rng.randint(1, 6)))
        body = f"<ol>{body}</ol>" if k == "li" else body
        head = f"<h3>{words(2)}</h3>" if rng.random() < 0.6 else ""
        tag = rng.choice(["div", "section", "div"])
        name = "comments" if plain and tag == "div" and k != "li" else None
        return f'<{tag} id="{name}">{head}{body}</{tag}>' if name else el(tag, "comments", head + body)

    def notice() -> str:
        return el(rng.choice(["div", "div", "section", "p", "aside"]), "notice", words(rng.randint(4, 40)) + (f"<button>{words(1)}</button>" if rng.random() < 0.5 else ""))

    def advert() -> str:
        return el(rng.choice(["div", "div", "aside", "section"]), "ad", rng.choice([words(rng.randint(3, 40)), paragraph(n=rng.randint(3, 40)), f'<a href="/b">{words(rng.randint(2, 8))}</a>']))

    def side() -> str:
        return el(rng.choice(["aside", "div", "div"]), "side", f"<h3>{words(2)}</h3>" * (rng.random() < 0.6) + rng.choice([links(rng.randint(2, 8), 8), paragraph(n=rng.randint(5, 40)), links(rng.randint(2, 5), 6) + paragraph(n=rng.randint(5, 30))]))

    def form() -> str:
        return f"<form{attrs('share')}><label>{words(2)}</label><input><p>{words(rng.randint(2, 15))}</p><button>{words(1)}</button></form>"

    def menu() -> str:
        body = links(rng.randint(3, 12))
        return f"<nav>{body}</nav>" if rng.random() < 0.6 else el("div", "nav", body)

    def header() -> str:
        body = rng.choice([f'<a href="/">{words(2)}</a>', f"<h1>{words(2)}</h1>", f"<h2>{words(2)}</h2><p>{words(6)}</p>"]) + (menu() if rng.random() < 0.5 else "")
        return f"<header>{body}</header>" if rng.random() < 0.6 else el("div", "header", body)

    def footer() -> str:
        body = rng.choice([f"&copy; {words(rng.randint(2, 30))}", f"<p>&copy; {words(rng.randint(5, 30))}</p>", links(rng.randint(2, 8)) + words(5)])
        return f"<footer>{body}</footer>" if rng.random() < 0.65 else el("div", "footer", body)

    if rng.random() < 0.1:  # nothing but text
        return rng.choice([_MARK + words(rng.randint(2, 40)), "".join(paragraph(_MARK) for _ in range(rng.randint(1, 5))), f"<body>{_MARK}{words(20)}<br>{_MARK}{words(20)}</body>"])
    some = lambda p, f: f() if rng.random() < p else ""
    before = [some(0.5, header), some(0.6, menu), some(0.4, advert), some(0.35, notice)]
    rng.shuffle(before)
    left, right = some(0.2, side), some(0.35, side)
    tail = [some(0.4, comments), some(0.25, form), some(0.3, side), some(0.2, advert), some(0.15, notice)]
    rng.shuffle(tail)
    middle = left + article() + right
    if rng.random() < 0.4:
        middle = f"<div{rng.choice(['', ' class=\"wrap\"', ' id=\"page\"', ' class=\"container\"'])}>{middle}{''.join(tail)}</div>"
        tail = []
    return f"<html><head><title>{words(4)}</title></head><body>{''.join(before)}{middle}{''.join(tail)}{some(0.85, footer)}</body></html>"


def train(pages: int = PAGES, seed: int = 11) -> Trees:
    """Trees from generated pages."""
    rng = random.Random(seed)
    made = [Page(sample_page(rng)) for _ in range(pages)]
    x = features(made)
    y = []
    for p in made:
        mine = [0.0] * len(p.tag)
        for k, body in p.blocks:
            if _MARK in body:
                while k >= 0 and not mine[k]:
                    mine[k] = 1.0
                    k = p.parent[k]
        y += mine
    y = np.array(y)
    return boost(x, y, np.ones(len(y)))


def _make(model):
    trees = Trees(*model)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        pages = [Page(x.decode("utf-8", "replace")) for x in utf8(columns[0])]
        logits = trees.logits(features(pages))
        out, at = [], 0
        for p in pages:
            kept = decode(p, logits[at : at + len(p.tag)])
            at += len(p.tag)
            out.append("\n".join(body for k, body in p.blocks if kept[k]))
        return [pa.array(out, pa.string())]

    return run


def extract(pages: DataFrame, trees: Trees, html: str = "html", out: str = "text") -> DataFrame:
    """Append ``out``, the main text of each page ("" if it has none).

    Character references are decoded, white space inside a block becomes one
    space, blocks follow in page order joined by a newline; nothing is capped.
    Null and empty pages give "". A column of that name is replaced; others pass.
    """
    return with_columns_from(pages, [html], [T.StructField(out, T.StringType())], _make, (trees.feature, trees.cut, trees.leaf, trees.base))


def main_texts(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    found = extract(pages.select("page_id", "url", "html"), trees or train())
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
