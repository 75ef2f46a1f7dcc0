"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is read as a sequence of words and tags. A word scores between -1 and 1: by a logistic
regression on the elements around it (their names, the words of their classes, ids and roles,
whether they are hidden), whose weights are learned from labelled pages. A tag scores negative,
by how much rarer its name is in the articles of the labelled pages than around them. One linear
scan finds the contiguous region of the highest sum; its words that score positive are the text.
In an element that is trusted to be content, tags score least, and what scores negative (adverts,
forms or comments in an article) is left out but doesn't end the region.

Scripts, styles and comments are never text. White space in a block becomes one space; blocks are
joined by two line feeds. Character references are decoded once. What a page leaves unclosed ends
with it; paragraphs, items, cells and options end where HTML implies it. A null or empty page, or
one without text, gives an empty string. Rows are kept as they come, repeated ones too. An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
# Elements by what they are in HTML.
RAW = {"script", "style", "textarea", "title", "template", "iframe", "xmp", "noembed", "noframes", "canvas", "audio", "video"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SPECIAL = BLOCK - {"address", "div", "p"} | {"button", "object", "select", "option", "optgroup"}
ROWS = {"tr", "td", "th"}
#: For a start tag: the elements that it closes, and those that shield what is open around them.
CLOSES = {
    "li": ({"li"}, SPECIAL), "dt": ({"dt", "dd"}, SPECIAL), "dd": ({"dt", "dd"}, SPECIAL),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": (ROWS | {"caption"}, {"table"}),
    **{x: (ROWS | {"thead", "tbody", "tfoot", "caption"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: A block closes an open paragraph, but none beyond these.
SHIELDS_P = {"html", "body", "table", "td", "th", "caption", "button", "object"}
#: The penalty of the regression; the most that a name speaks for content (an element of text a fifth of it), so that what speaks against it prevails in any surroundings; the log odds from which an element is trusted.
RIDGE, MOST, TRUST = 0.01, 1.0, 2.5
#: Attributes that hide an element.
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

_W, _S = "word " * 30, "some words "
# Labelled markup: containers of articles, what stands in articles, containers of what isn't article text, what stands in those.
CONTAINERS = (
    "", "<article>", "<main>", "<main><article>", "<div class=content>", "<div id=main-content>", "<div class='post-body entry'>", "<section class=story>", "<div id=article-text>",
    "<article class='post page'>", "<div class='layout with-sidebar'><div class=content>", "<div role=main class=main>", "<div class=page><div class='text body'>", "<div><div>", "<table><tr><td>",
)
CONTENT = (
    f"<p>{_W}</p>", f"<h2>part of it</h2><p>{_W}</p>", f"<ul><li>{_S}</li><li><a>link</a></li></ul>", f"<p>{_W}<a>link</a> <b>word</b> <i>word</i> <em>word</em> <strong>word</strong> <code>word</code></p>", f"<div>{_W}</div>",
    f"<section><h3>part</h3><p>{_W}</p></section>", f"<table><caption>{_S}</caption><tr><th>key</th><td>{_S}</td></tr></table>", f"<blockquote>{_S}<p>{_W}</p></blockquote>", f"<pre>{_S}</pre>", f"<dl><dt>term</dt><dd>{_S}</dd></dl>",
    f"<figure><img><figcaption>{_S}</figcaption></figure>", f"<ol><li><p>{_S}</p></li></ol>", f"<p><span>{_W}</span><br>{_W}</p>", f"{_W}", f"<details><summary>{_S}</summary><p>{_W}</p></details>", f"<center>{_W}</center>", f"<div><p>{_W}</p></div>", f"<div class=section id=part>{_W}</div>",
    f"<p>{_W}<a>linked words</a> {_W}</p>",
)
FURNITURE = tuple(
    ["<nav>", "<footer>", "<aside>", "<form>", "<dialog>", "<menu>", "<button>", "<label>", "<select><option>", "<div hidden>", "<div style='display:none'>", "<div aria-hidden=true>"]
    + [f"<div role={w}>" for w in "navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split()]
    + [
        f"<{('div', 'section', 'p', 'ul', 'li', 'span', 'dd', 'td')[k % 8]} {('class', 'id')[k % 5 == 4]}='{w}'>"
        for k, w in enumerate(
            "ad|ads|adv ins|advert|advertisement|sponsored|sponsor|promo|banner|nav|navbar|main-nav|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|side|rail|widget|footer|page-footer|header|site-header masthead|comments|comment|comment-body|commentlist|"
            "disqus|reply|replies|respond|cookie|cookies|cookie-consent|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|related-posts|related-articles|recommended|pagination|pager|toolbar|copyright|"
            "legal|disclaimer|skip|hidden|search|toc".split("|")
        )
    ]
    + ["<nav class=toc>", "<aside class=widget>", "<footer class=footer>", "<article class=comment>", "<section class=comments><article>", "<div id=comments><div class=comment>", "<div class=sidebar><div class=widget>", "<form class=search>"]
)
FILLS = (f"{_S}", f"<p>{_S}</p>", "<ul><li><a>one</a></li><li><a>two words</a></li></ul>", f"<h3>more</h3><p>{_W}</p>", f"<div><p>{_W}</p></div>", f"<a>one</a> <a>two</a>", f"<li>{_S}</li>", f"<span>{_S}</span><p>{_W}<b>word</b></p>")
HEADS = ("<h1>title words here</h1>", f"<header><h1>title words</h1><p>{_S}</p></header>", "", "<div><h1>title</h1></div>")
TOPS = ("<header><a>home</a><p>slogan</p></header>", "<header class=header><h1>name</h1><nav><a>x</a></nav></header>", "<div><a>home</a> <a>about</a></div>", "<table><tr><td><a>one</a></td><td><a>two</a></td></tr></table>")


def _closed(opened: str, inside: str) -> str:
    return opened + inside + "".join(f"</{name}>" for name in reversed(re.findall(r"<(\w+)", opened)))


def labelled_pages(rounds: int = 12) -> list[str]:
    """Pages of every container in `rounds` layouts, dealt so that all markup meets; [[ and ]] enclose the article, {{ and }} what in it isn't its text."""
    out, k = [], 0

    def furniture():
        nonlocal k
        k += 1
        return _closed(FURNITURE[k * 7 % len(FURNITURE)], FILLS[(k + k // len(FURNITURE)) % len(FILLS)])

    for n in range(rounds):
        out += [f"[[{_W}]]", f"<body>[[{_W}<br>{_W}<b>{_S}</b> <a>{_S}</a>]]</body>", f"[[{''.join(CONTENT[n : n + 4])}]]"] * 3  # fragments without any container
        for c, container in enumerate(CONTAINERS):
            at = n * 5 + c * 3
            parts = [HEADS[(n + c) % 4]]
            for j in range(4):
                parts += [CONTENT[(at + j) % len(CONTENT)], "{{" + furniture() + "}}" if j < 3 else "", CONTENT[(at + 7 * j) % len(CONTENT)]]
            article = "[[" + _closed(container, "".join(parts)) + "]]"
            out.append(f"<body>{TOPS[(n + c) % 4]}{furniture()}{furniture()}{article}{furniture()}{furniture()}{furniture()}</body>")
    return out


@functools.lru_cache(1 << 14)
def features(name: str, attributes: str) -> tuple[str, ...]:
    """An element's name, the words of its class and id, its role, whether it is hidden."""
    if name in ("body", "html"):  # often left out, and named for all of the page
        return ()
    out = {f"<{name}"} if name in BLOCK or name in SPECIAL or name == "label" else set()  # links and the like only cost their tags
    if attributes:
        found = {}
        for k, *values in ATTRIBUTE.findall(attributes):
            found.setdefault(k.lower(), "".join(values))
        spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{found.get('class', '')} {found.get('id', '')}")
        out |= {f".{w}" for w in re.findall(r"[^\W\d_]+", spaced.lower())}
        out |= {f"={w}" for w in found.get("role", "").lower().split()}
        if HIDDEN.search(re.sub(r"\b(?:class|id)\s*=\s*(?:\"[^\"]*\"?|'[^']*'?)", "", attributes)):
            out.add("hidden")
    return tuple(sorted(out))


class _Open:
    """The elements that are open, what each adds to a word's log odds, and the highest of the sums on the way."""

    def __init__(self, weigh, bias):
        self.weigh, self.names, self.odds, self.at = weigh, [], [bias], {}
        self.top = [self.odds[0]]

    def push(self, name: str, attributes: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.odds.append(self.odds[-1] + self.weigh(features(name, attributes)))
        self.top.append(max(self.top[-1], self.odds[-1]))

    def cut(self, size: int) -> None:
        """Close all but the `size` outermost."""
        for name in self.names[size:]:
            if self.at[name] and self.at[name][-1] >= size:
                del self.at[name][bisect.bisect_left(self.at[name], size) :]
        del self.names[size:], self.odds[size + 1 :], self.top[size + 1 :]

    def last(self, names) -> int:
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def start(self, name: str) -> None:
        """Close what a start tag of this name ends."""
        stay = len(self.names)
        rules = [CLOSES[name]] if name in CLOSES else []
        if name in BLOCK and name not in ROWS | {"thead", "tbody", "tfoot", "caption"}:
            rules.append(({"p"}, SHIELDS_P))
        for closes, shields in rules:
            wall = self.last(shields - closes)
            beyond = [self.at[x] for x in closes if self.at.get(x) and self.at[x][-1] > wall]
            if beyond:
                outermost = closes & ROWS or name == "optgroup"
                stay = min(stay, min(x[bisect.bisect(x, wall)] for x in beyond) if outermost else max(x[-1] for x in beyond))
        self.cut(stay)

    def end(self, name: str) -> None:
        if not self.at.get(name):
            return
        if name not in BLOCK and self.last(BLOCK) > self.at[name][-1]:  # an inline end tag closes no block
            self.at[name].pop()
        else:
            self.cut(self.at[name][-1])


def tokens(page: str, weigh=lambda found: 0.0, bias=0.0) -> Iterator[tuple[str, str, float, float]]:
    """(kind, text, log odds, highest log odds around); kind is `text`, a tag's name, or /name. An element's tags are in it."""
    at, n, open_ = 0, len(page), _Open(weigh, bias)
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            yield "text", page[at:start], open_.odds[-1], open_.top[-1]
        if not m:
            return
        at = max(m.end(), start + 1)
        if m[2] is None:
            continue
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            yield "/" + name, "", open_.odds[-1], open_.top[-1]
            open_.end(name)
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = _end_of(name).search(page, at)
                at = end.end() if end else n
        else:
            open_.start(name)
            if name not in VOID and not attributes.endswith("/"):
                open_.push(name, attributes)
        yield name, "", open_.odds[-1], open_.top[-1]


@functools.lru_cache(64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)


class Weights:
    """Of features of the elements around a word, and of tags."""

    def __init__(self, bias: float, feature: dict[str, float], tag: dict[str, float]):
        self.bias, self.feature, self.tag = bias, feature, tag
        self.weigh = functools.lru_cache(1 << 14)(self._weigh)

    def _weigh(self, found: tuple[str, ...]) -> float:
        return sum(self.feature.get(f, 0.0) for f in found)

    def __reduce__(self):
        return Weights, (self.bias, self.feature, self.tag)

    def scores(self, seen: list[tuple]) -> list[float]:
        out = []
        for kind, text, odds, top in seen:
            if kind != "text":
                out.append(self.tag.get(kind.lstrip("/"), -0.5) if top < TRUST else -0.1 if odds >= 0 else 0.0)
            elif odds < 0 and top >= TRUST:
                out.append(0.0)
            else:
                out.append(math.tanh(odds / 2) * len(text.split()))
        return out


@functools.lru_cache(4)
def learn(pages: tuple[str, ...] | None = None, steps: int = 4000) -> Weights:
    """A regression on the text nodes of labelled pages, and the log odds of their tags, at most slightly negative."""
    nodes, truth, tags = [], [], {}
    for page in pages or labelled_pages():
        seen = tokens(page, lambda found: (found,), ())  # gathers the features around a text instead of summing weights
        inside = dropped = False
        for kind, text, found, _ in seen:
            if kind != "text":
                tags.setdefault(kind.lstrip("/"), [0, 0])[inside and not dropped] += 1
                continue
            for part in re.split(r"(\[\[|\]\]|\{\{|\}\})", text):
                if part in ("[[", "]]"):
                    inside = part == "[["
                elif part in ("{{", "}}"):
                    dropped = part == "{{"
                elif part.strip():
                    nodes.append({f for element in found for f in element})
                    truth.append(inside and not dropped)
    names = sorted(set().union(*nodes))
    x = np.array([[f in n for f in names] for n in nodes], float)
    y, w, b = np.array(truth, float), np.zeros(len(names)), 0.0
    step = 1 / (2 * (x.sum(0) + 1))
    most = np.array([MOST if f[0] != "<" or f in ("<article", "<main") else MOST / 5 for f in names])
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = np.minimum(w - step * (x.T @ miss + RIDGE * w), most), b - miss.mean()
    out, into = (sum(n[k] for n in tags.values()) for k in (0, 1))
    tag = {k: min(-0.1, max(-3.0, math.log((n[1] + 0.5) / (into + 1) * (out + 1) / (n[0] + 0.5)))) for k, n in tags.items()}
    return Weights(b, dict(zip(names, w.tolist(), strict=True)), tag)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of the highest sum, by one scan; empty if no score is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, span = total, (start, k + 1)
    return span


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    seen = list(tokens(page, weights.weigh, weights.bias))
    start, end = best_region(weights.scores(seen))
    blocks, now = [], []
    for kind, text, odds, _ in seen[start:end]:
        if kind == "text":
            if odds >= 0:
                now.append(text)
        elif kind.lstrip("/") in BLOCK:
            blocks.append("".join(now))
            now = []
        elif kind == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def _extract(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(functools.partial(_extract, weights=weights or learn()), "page_id long, url string, text string, n_chars long")
