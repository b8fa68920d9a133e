"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the stretches of text between block-level tags.
A block's features are its ancestors (tags, and the words of their class, id
and role), and its text (length, link share, punctuation, marks such as
copyright signs).  A two-state chain, article or not, weighs features and
neighbours; it is trained by maximum likelihood on labelled pages and decoded
by Viterbi.  Labelled pages are made here, from layouts that name the same
parts in the many ways of the web, so nothing of the pages to extract from is
needed.  Pages are independent: extraction is one map, and only weights travel.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the hashed feature space; labelled pages and passes over them in training.
FEATURES, TRAINING_PAGES, PASSES, SEED = 1 << 14, 600, 12, 20240617

_BLOCK = frozenset("html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside form fieldset legend blockquote pre figure figcaption address details summary dialog menu hgroup center search option select".split())
_TRACKED = _BLOCK | {"a", "button", "label", "span", "small"}
#: Elements whose content is no markup, and elements that show no text of their own; ``math`` and ``object`` are read like any other.
_RAW, _SKIPPED = "script|style|textarea", frozenset("noscript template svg iframe head canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(
    rf"<!--(?s:.*?)(?:-->|\Z)|<({_RAW})(?=[\s/>])(?![^>]*[\s\"']/>|/>)[^>]*>(?s:.*?)(?:</\1(?=[\s/>])[^>]*>|(?=<body[\s/>])|\Z)"
    r"|<title(?=[\s>])(?![^>]*[\s\"']/>)[^>]*>(?s:.*?)(?:</title(?=[\s/>])[^>]*>|(?=<body[\s/>]|</(?:head|svg)[\s>])|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]+\Z|([^<]++|<)",
    re.I,
)
_MAY_SKIP = re.compile(rf"<(?:{'|'.join(sorted(_SKIPPED))})[\s>]", re.I)
_EMPTY = re.compile(r"(?:^|[\s\"'])/\Z")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORDS = re.compile(r"[A-Za-z]+")
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table select menu".split())


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = {w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _NAME_WORDS.findall(next(filter(None, m.groups()), ""))}
    return tuple(sorted(found))


@dataclass
class Block:
    """A leaf block: its text, the open elements around it, and how much of it is inside links."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def _tokens(page: str) -> Iterator[re.Match]:
    """The tokens of a page outside of skipped elements.

    A skipped element reaches from its start tag to its own end tag, or to a body
    within it.  One that is empty (``<svg/>``) or never ends hides nothing.
    """
    ends: dict[int, int] = {}
    if _MAY_SKIP.search(page):
        open_: dict[str, list[int]] = {name: [] for name in _SKIPPED}
        for m in _TOKEN.finditer(page):
            name = (m[3] or m[6] or "").lower()
            if name == "body" and not (m[2] or m[5]):
                for starts in open_.values():
                    ends |= dict.fromkeys(starts, m.start())
                    starts.clear()
            elif name not in _SKIPPED:
                continue
            elif m[2] or m[5]:
                if open_[name]:
                    ends[open_[name].pop()] = m.end()
            elif not _EMPTY.search(m[4] if m[4] is not None else m[7]):
                open_[name].append(m.start())
    at = 0
    while at is not None:
        start, at = at, None
        for m in _TOKEN.finditer(page, start):
            if m.start() in ends:
                at = ends[m.start()]
                break
            yield m


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order.

    Character references are decoded, runs of white space are one space.
    Comments, scripts, styles and other elements that are not text are left
    out, and so is a tag that the end of the page cuts off.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            parts = []
        linked = 0

    for m in _tokens(page or ""):
        text = m[8]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in _VOID or name not in _TRACKED:
            if name in _VOID and name == "hr":
                flush()
            continue
        if name in _BLOCK:
            flush()
        if m[2] or m[5]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    links -= sum(e[0] == "a" for e in stack[i:])
                    del stack[i:]
                    break
            continue
        if name in _BLOCK:  # a block ends an open paragraph, and its like within a list or table
            closes = _CLOSES.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                tag = stack[i][0]
                if tag == "p" or tag in closes:
                    links -= sum(e[0] == "a" for e in stack[i:])
                    del stack[i:]
                    if tag != "p":
                        break
                elif tag in _SCOPES or tag in _BLOCK and tag not in closes and not closes:
                    break
        attributes = m[4] if m[4] is not None else m[7]
        if not (attributes or "").endswith("/") or name in _BLOCK:
            stack.append((name, _names(attributes or "")))
            links += name == "a"
    flush()
    return out


_ids: dict[str, int] = {}
_paths: dict[tuple, tuple[int, ...]] = {}


def _id(feature: str) -> int:
    if feature not in _ids:
        if len(_ids) > 200_000:
            _ids.clear()
        _ids[feature] = zlib.crc32(feature.encode()) % FEATURES
    return _ids[feature]


def _path_features(path: tuple) -> tuple[int, ...]:
    if path not in _paths:
        if len(_paths) > 100_000:
            _paths.clear()
        named = {f"in={tag}" for tag, _ in path} | {f"name={n}" for _, names in path for n in names}
        if path:
            named |= {f"leaf={path[-1][0]}", f"leaf2={'/'.join(t for t, _ in path[-2:])}"} | {f"leafname={n}" for n in path[-1][1]}
        _paths[path] = tuple(sorted({_id(f) for f in named}))
    return _paths[path]


_MARKS = (("copyright", re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved", re.I)), ("consent", re.compile(r"cookie|consent|subscribe|newsletter|sign up|log ?in|register", re.I)), ("ad", re.compile(r"advert|sponsored|promot|buy now|special offer", re.I)), ("talk", re.compile(r"\bcomments?\b|\brepl(?:y|ies)\b|\bposted by\b", re.I)))


def features(blocks: list[Block]) -> list[list[int]]:
    """Feature numbers of every block of a page."""
    out = []
    for b in blocks:
        own = list(_path_features(b.path))
        n = len(b.text)
        words = b.text.count(" ") + 1
        own.append(_id(f"words={min(6, words.bit_length())}"))
        own.append(_id(f"links={min(4, 4 * b.linked // max(1, n))}"))
        own.append(_id(f"end={'stop' if b.text[-1] in '.!?' else 'no'}"))
        own.append(_id(f"stops={min(3, b.text.count('. '))}"))
        if n < 400:
            own += [_id(f"mark={name}") for name, pattern in _MARKS if pattern.search(b.text)]
        out.append(own)
    return out


@dataclass
class Chain:
    """Weights of a two-state linear chain (0: other, 1: article): of features for state 1, and of transitions and starts."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def decode(self, page: list[list[int]]) -> np.ndarray:
        """The likeliest states, by Viterbi."""
        if not page:
            return np.zeros(0, np.int64)
        w = self.weights
        scores = [float(w[f].sum()) for f in page]
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for e in scores[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00), (b + m11 if from1 else a + m01) + e
        state = int(b > a)
        states = [state]
        for step in reversed(back):
            state = int(step[state])
            states.append(state)
        return np.array(states[::-1])


def train(pages: list[tuple[list[list[int]], list[int]]], passes: int = PASSES, ridge: float = 1e-4, rate: float = 0.1) -> Chain:
    """Maximum likelihood of labelled pages (features of their blocks, states), by stochastic gradients with per-weight rates."""
    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    squares = [np.full_like(x, 1e-6) for x in (chain.weights, chain.moves, chain.start)]
    rng = np.random.default_rng(SEED)
    for _ in range(passes):
        for k in rng.permutation(len(pages)):
            feats, states = pages[k]
            n = len(feats)
            if not n:
                continue
            e = np.zeros((n, 2))
            e[:, 1] = [chain.weights[f].sum() for f in feats]
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = chain.start + e[0]
            for i in range(1, n):
                fwd[i] = np.logaddexp(fwd[i - 1, 0] + chain.moves[0], fwd[i - 1, 1] + chain.moves[1]) + e[i]
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp(chain.moves[:, 0] + e[i + 1, 0] + bwd[i + 1, 0], chain.moves[:, 1] + e[i + 1, 1] + bwd[i + 1, 1])
            total = np.logaddexp(fwd[-1, 0], fwd[-1, 1])
            p = np.exp(fwd + bwd - total)
            y = np.asarray(states)
            gm, gs = np.zeros((2, 2)), np.zeros(2)
            if n > 1:
                np.add.at(gm, (y[:-1], y[1:]), 1)
                gm -= np.exp(fwd[:-1, :, None] + chain.moves[None] + (e + bwd)[1:, None, :] - total).sum(axis=0)
            gs[y[0]] += 1
            gs -= p[0]
            lens = [len(f) for f in feats]
            flat = np.concatenate([np.asarray(f) for f in feats])
            touched, where = np.unique(flat, return_inverse=True)
            gw = np.bincount(where, np.repeat(y - p[:, 1], lens)) - ridge * chain.weights[touched]
            squares[0][touched] += gw * gw
            chain.weights[touched] += rate * gw / np.sqrt(squares[0][touched])
            for x, s, g in ((chain.moves, squares[1], gm), (chain.start, squares[2], gs)):
                s += g * g
                x += rate * g / np.sqrt(s)
    return chain


#: How layouts name their parts: (tag, attributes) by kind of part.
_PARTS = {
    "menu": ["nav", "nav class=menu", "div class=nav", 'div id="menu"', 'ul class="navbar"', 'div role="navigation"', "div class=breadcrumbs", 'div class="site-navigation"', "menu", 'div class="topbar links"'],
    "header": ["header", 'div id="header"', 'div class="site-header"', 'div class="masthead"', 'div role="banner"', "div class=logo"],
    "footer": ["footer", 'div id="footer"', 'div class="site-footer"', 'div role="contentinfo"', 'div class="copyright"', 'div class="footer-links"'],
    "sidebar": ["aside", 'div class="sidebar"', 'div id="secondary"', 'section class="related"', 'div class="widget"', 'div role="complementary"', 'div class="recommended"', 'div class="side"', 'div class="more-stories"'],
    "advert": ["div class=ad", 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="sponsor"', 'div class="promo"', 'div class="banner"', 'aside class="ad"', 'p class="ad"', 'div class="sponsored"', 'section class="ad-slot"'],
    "notice": ['div class="cookie"', 'div class="notice"', 'div id="cookie-banner"', 'div class="consent"', 'div class="popup"', 'div class="alert"', 'div class="newsletter"', 'div role="alert"', 'p class="notice"', 'dialog', 'div class="gdpr"'],
    "form": ["form", 'form class="search"', 'form id="login"', 'form class="subscribe"', 'div class="search-form"'],
    "comments": ['div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="comment"', 'div id="disqus"', 'section class="discussion"', 'div class="replies"', 'ul class="comments"', 'div class="reader-comments"', 'section class="responses"'],
    "article": ["article", 'div class="content"', "main", 'div class="post"', 'div id="article"', 'section class="entry"', 'div class="article-body"', 'div role="main"', 'div class="story"', 'article class="post"', 'div class="entry-content"', 'div class="text"', 'div id="content"', "div"],
}
_OTHER = [k for k in _PARTS if k != "article"]


class _Writer:
    """Labelled pages from random layouts; invented words of random syllables."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def words(self, n: int) -> str:
        syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu an er in on st ou ç é ö ñ".split()
        r = self.rng
        return " ".join("".join(r.choice(syllables, r.integers(1, 5))) for _ in range(n))

    def sentence(self) -> str:
        s = self.words(int(self.rng.integers(1, 22)))
        return s[:1].upper() + s[1:] + self.rng.choice([".", ".", ".", ".", "?", "!"])

    def paragraph(self) -> str:
        n = int(self.rng.choice([1, 1, 2, 4, 8]))
        if self.rng.random() < 0.08:
            return " | ".join(self.words(1) for _ in range(int(self.rng.integers(2, 30))))
        if self.rng.random() < 0.06:
            return self.words(int(self.rng.integers(1, 5)))
        text = " ".join(self.sentence() for _ in range(n))
        if self.rng.random() < 0.15:
            text += self.rng.choice([' <a href="/x">' + self.words(2) + "</a>.", " &amp; " + self.words(3) + ".", " Copyright &copy; is a word here.", " Comments are welcome.", " Cookies taste good."])
        return text

    def wrapped(self, opener: str, inner: str) -> str:
        return f"<{opener}>{inner}</{opener.split()[0]}>"

    def part(self, kind: str) -> list[tuple[str, int]]:
        """Pieces of markup; state 2 marks markup without text of its own."""
        r, opener = self.rng, str(self.rng.choice(_PARTS[kind]))
        if kind == "article":
            inner: list[tuple[str, int]] = [("<h1>" + self.words(int(r.integers(2, 9))) + "</h1>", 1)] if r.random() < 0.8 else []
            for _ in range(int(r.choice([1, 2, 3, 6, 12, 25]))):
                k = r.random()
                if k < 0.75:
                    inner.append((r.choice(["<p>", "<p><b>", "<p>"]) + self.paragraph() + r.choice(["</p>", "</p>", "", "<br>"]), 1))
                elif k < 0.83:
                    inner.append(("<h2>" + self.words(3) + "</h2>", 1))
                elif k < 0.88:
                    inner += [("<ul>", 2)] + [("<li>" + self.sentence() + "</li>", 1) for _ in range(3)] + [("</ul>", 2)]
                elif k < 0.92:
                    inner.append(("<blockquote>" + self.paragraph() + "</blockquote>", 1))
                elif k < 0.96:
                    inner += [("<table><tr>", 2)] + [("<td>" + self.words(2) + "</td>", 1) for _ in range(4)] + [("</tr></table>", 2)]
                else:
                    inner += self.part(str(r.choice(["advert", "sidebar", "form", "notice"])))
            return [(f"<{opener}>", 2), *inner, (f"</{opener.split()[0]}>", 2)]
        n = int(r.integers(1, 7))
        if kind == "menu" or kind in ("sidebar", "footer", "header") and r.random() < 0.4:
            items = [("<li>" + f'<a href="/{i}">' + self.words(int(r.integers(1, 3))) + "</a></li>", 0) for i in range(n)]
            inner = [("<ul>", 2), *items, ("</ul>", 2)] if r.random() < 0.8 else [(f'<a href="/{i}">{self.words(1)}</a> ', 0) for i in range(1)]
        elif kind == "form":
            inner = [("<label>" + self.words(1) + "</label> <input> <button>" + r.choice(["Search", "Log in", "Subscribe", self.words(1)]) + "</button>", 0)]
        elif kind == "footer":
            inner = [(r.choice(["&copy; ", "Copyright ", ""]) + self.words(2) + " &middot; " + self.sentence(), 0)]
        elif kind == "header":
            inner = [(r.choice(["<h1>", "<h2>", "<div>", "<p>"]) + self.words(2), 0)]
        elif kind == "notice":
            inner = [(r.choice(["", "<p>"]) + r.choice(["We use cookies. ", "Subscribe to our newsletter. ", ""]) + self.sentence(), 0)]
        elif kind == "comments":
            inner = [(r.choice(["<p>", "<div>", "<li>"]) + r.choice(["", "Posted by ", "Reply: "]) + self.paragraph(), 0) for _ in range(n)]
        else:
            inner = [(r.choice(["<p>", "<div>", "", ""]) + r.choice(["", "", "Sponsored: ", "Buy now. "]) + self.paragraph(), 0) for _ in range(int(r.choice([1, 1, 2])))]
            inner = inner[:1] if not inner[0][0].startswith("<") else [x if x[0].startswith("<") else ("<div>" + x[0], 0) for x in inner]
        return [(f"<{opener}>", 2), *inner, (f"</{opener.split()[0]}>", 2)]

    def page(self) -> list[tuple[str, int]]:
        r = self.rng
        before = [str(k) for k in r.permutation(["menu", "header", "advert", "notice", "form", "sidebar"])[: int(r.integers(0, 5))]]
        after = [str(k) for k in r.permutation(["sidebar", "advert", "comments", "form", "notice", "menu"])[: int(r.integers(0, 4))]] + (["footer"] if r.random() < 0.9 else [])
        body = [x for k in [*before, "article", *after] for x in self.part(k)]
        wrapper = str(r.choice(["", "", "div", 'div id="page"', 'div class="wrapper"']))
        return [("<!DOCTYPE html><html><body>", 2), *([(f"<{wrapper}>", 2)] if wrapper else []), *body, *([("</div>", 2)] if wrapper else []), ("</body></html>", 2)]


def labelled_page(writer: _Writer) -> tuple[str, list[tuple[str, int]]]:
    """A made page and, in order, its texts with their states."""
    pieces = writer.page()
    return "".join(m for m, _ in pieces), [(" ".join(html.unescape(re.sub(r"<[^>]*>", "", m)).split()), s) for m, s in pieces if s < 2]


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[list[list[int]], list[int]]]:
    """Features and states of the blocks of ``n`` made pages.  Every block of a made page has one state by its layout."""
    writer, out = _Writer(seed), []
    for _ in range(n):
        page, truth = labelled_page(writer)
        blocks, states, k, rest = leaf_blocks(page), [], 0, ""
        for b in blocks:
            # blocks and pieces come in the same order; a block without a stop between pieces may join two of them
            while k < len(truth) and not truth[k][1] >= 2 and not (truth[k][0] and (truth[k][0] in b.text or b.text in truth[k][0])):
                k += 1
            states.append(truth[k][1] if k < len(truth) else 0)
            if k < len(truth) and b.text.endswith(truth[k][0]):
                k += 1
        out.append((features(blocks), states))
    return out


_trained: dict[tuple, Chain] = {}


def default_chain() -> Chain:
    """The chain trained on the made pages, once in a process."""
    key = (TRAINING_PAGES, PASSES, SEED)
    if key not in _trained:
        _trained[key] = train(labelled_pages())
    return _trained[key]


def main_text(page: str | None, chain: Chain) -> str:
    """The article of one page: its blocks in order, two line ends between them."""
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, s in zip(blocks, chain.decode(features(blocks))) if s)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Null, empty and text-free pages give an empty text; repeated rows give one
    row each.  Returns page_id, url, text and n_chars.
    """
    shared = pages.sparkSession.sparkContext.broadcast(chain or default_chain())  # FEATURES weights: 128 KB

    @F.pandas_udf("string")
    def text(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in htmls:
            yield pd.Series([main_text(h if isinstance(h, str) else None, shared.value) for h in batch])

    out = pages.select("page_id", "url", text(F.col("html").cast("string")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
