"""Main text of web pages: boosted trees over DOM nodes and a decoding that respects the tree.

A page is parsed into block-level nodes. Boosted trees give each node the log odds of holding main text,
from its tag, its class and id tokens, the density of text and links in its subtree, its depth and its
siblings. Decoding maximises the sum of the log odds over the kept nodes under the rule that a node is
kept only if its parent is: no kept node stands in a dropped one, and a subtree is kept only if it gains.
The trees are fitted to pages that this module composes from a grammar of site layouts, with a seed.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import sliced, tidy

# Element names of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Cut unseen: scripts, styles, form controls, and what no reader sees. Everything else goes through the trees.
RAW = frozenset("script style title template iframe noframes textarea select option button".split())
#: Unclosed ones of these take the rest of the page with them.
_TO_THE_END = frozenset("script style title template iframe textarea".split())
BLOCK = frozenset(
    "html body article main section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "form fieldset pre blockquote figure figcaption address details summary hr hgroup search dialog center menu noscript".split()
)
#: An opening tag closes these open elements first, if nothing of the second group stands in between.
_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "tbody": ("thead tbody tr td th", {"table"}), "tfoot": ("tbody tr td th", {"table"})}
_CLOSES = {k: (frozenset(a.split()), b) for k, (a, b) in _CLOSES.items()}
_IN_PARAGRAPH = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr big".split())
#: Groups of tags and of class or id tokens that are features.
TAG_GROUPS = [{"nav", "menu"}, {"header", "hgroup"}, {"footer", "address"}, {"aside", "dialog"}, {"article", "main"}, {"section"}, {"div", "center"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"form", "fieldset", "search"}, {"pre", "blockquote", "figure", "figcaption"}, {"html", "body"}]
TOKEN_GROUPS = [
    set("nav navigation navbar menu breadcrumb breadcrumbs topbar pagination pager toc tabs skip".split()),
    set("header masthead banner logo hero branding".split()),
    set("footer foot copyright legal colophon imprint".split()),
    set("sidebar side aside widget related recommended trending popular rail".split()),
    set("ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted dfp outbrain taboola".split()),
    set("cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall signup toast".split()),
    set("comment comments reply replies respond discussion disqus feedback review reviews".split()),
    set("share sharing social follow tags tag meta byline author".split()),
    set("form search login signin contact input".split()),
    set("article content main post entry story body text maincontent prose markdown".split()),
]
_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""", re.S)
_STOPS = re.compile("[>\"']")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MARK = re.compile(r"\sdata-main(?=[\s=>]|$)")
_TOKENS = re.compile(r"[a-z]+")


class _Tags:
    """The tags of a source in order, in time linear in it, however many tags never end."""

    def __init__(self, source: str) -> None:
        self.source, self.last = source, source.rfind(">")
        self.stops: list[int] | None = None
        self.unclosed: set[str] = set()

    def _ends(self, at: int) -> bool:
        """Whether a tag that begins at ``at`` ends: some ``>`` after it stands outside quotes.

        For every quote or ``>`` it is noted, from the last to the first, whether reading on from it outside quotes meets an end.
        """
        if self.stops is None:
            self.stops = [m.start() for m in _STOPS.finditer(self.source)]
            self.ending = [False] * (len(self.stops) + 1)
            ahead: dict[str, int] = {}
            for k in range(len(self.stops) - 1, -1, -1):
                mark = self.source[self.stops[k]]
                self.ending[k] = mark == ">" or (mark in ahead and self.ending[ahead[mark] + 1])
                ahead[mark] = k
        return self.ending[bisect_left(self.stops, at)]

    def next(self, at: int) -> re.Match | None:
        while (at := self.source.find("<", at)) >= 0:
            if at > self.last and not self.source.startswith("<!--", at):
                return None
            if (self.stops is None or self._ends(at) or self.source[at + 1 : at + 2] in ("!", "?", "/")) and (m := _TAG.match(self.source, at)):
                return m
            if self.source[at + 1 : at + 2].isalpha():
                self._ends(at)  # from now on it is known beforehand
            at += 1
        return None

    def after(self, name: str, at: int) -> int:
        """Where the element's closing tag ends, -1 if there is none."""
        if name not in self.unclosed:
            if m := re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.source, at):
                return m.end()
            self.unclosed.add(name)
        return -1


class Page:
    """Block-level nodes of a page in order: tag, tokens, parent (-1: none), and the text pieces with their node and block.

    The stack of open elements is indexed by name and by block, so each tag costs the same however deep the page is.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.tokens, self.parent, self.links, self.inputs, self.mark = ["html"], [frozenset()], [-1], [0], [0], [False]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.open: dict[str, list[int]] = {"html": [0]}
        self.open_blocks: list[int] = [0]
        self.block, self.anchors = 0, 0
        tags, at = _Tags(source), 0
        while at < len(source):
            m = tags.next(at)
            upto = m.start() if m else len(source)
            if upto > at:
                self.pieces.append((self.stack[-1][1], self.block, source[at:upto], self.anchors > 0))
            if not m:
                break
            at = m.end()
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["end"]:
                if name != "html" and self.open.get(name):
                    self._close(self.open[name][-1])
            elif name in RAW:
                self.inputs[self.stack[-1][1]] += name in ("select", "textarea", "button", "option")
                if not m["rest"].endswith("/"):
                    end = tags.after(name, at)
                    at = end if end >= 0 else (len(source) if name in _TO_THE_END else at)
            elif name == "xmp":  # its content is text as it stands
                end = tags.after(name, at)
                self._open("pre", "")
                said = source[at : end if end >= 0 else len(source)]
                self.pieces.append((self.stack[-1][1], self.block, entities.escape(said[: said.rfind("</")] if end >= 0 else said), False))
                self._close(len(self.stack) - 1)
                at += len(said)
            elif not (name in ("html", "body") and self.open.get(name)):
                self._open(name, m["rest"])

    def _close(self, k: int) -> None:
        """Closes the open element at place ``k`` of the stack and those in it."""
        while len(self.stack) > k:
            name, _ = self.stack.pop()
            self.open[name].pop()
            self.anchors -= name == "a"
            if name in BLOCK:
                self.open_blocks.pop()
                self.block += 1

    def _open(self, name: str, rest: str) -> None:
        if name == "input":
            self.inputs[self.stack[-1][1]] += 1
        if name in BLOCK and name not in _IN_PARAGRAPH and self.stack[self.open_blocks[-1]][0] == "p":
            self._close(self.open_blocks[-1])
        if name in _CLOSES:
            ends, fences = (max((self.open[t][-1] for t in names if self.open.get(t)), default=0) for names in _CLOSES[name])
            if ends > fences:
                self._close(ends)
        if name in VOID:
            if name == "br":
                self.pieces.append((self.stack[-1][1], self.block, " ", False))
            self.block += name == "hr"
            return
        if rest.endswith("/") and name not in BLOCK:
            return
        node = self.stack[-1][1]
        if name in BLOCK:
            self.block += 1
            self.open_blocks.append(len(self.stack))
            self.parent.append(node)
            node = len(self.tag)
            self.tag.append(name)
            self.tokens.append(frozenset(x for v in _NAMED.findall(rest) for x in _TOKENS.findall(v.lower())) if rest else frozenset())
            self.links.append(0)
            self.inputs.append(0)
            self.mark.append(bool(_MARK.search(rest)))
        elif name == "a":
            self.anchors += 1
            self.links[node] += 1
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, node))

    def blocks(self, kept: np.ndarray) -> list[str]:
        """Text of the blocks of kept nodes: references decoded, white space collapsed and trimmed, empty ones left out."""
        out: list[str] = []
        now, parts = None, []
        for node, block, text, _ in [*self.pieces, (0, -1, "", False)]:
            if block != now:
                if parts and (joined := " ".join(entities.unescape("".join(parts)).split())):
                    out.append(joined)
                now, parts = block, []
            if block >= 0 and kept[node]:
                parts.append(text)
        return out


def features(page: Page) -> np.ndarray:
    """A row per node."""
    n = len(page.tag)
    own, linked, stops, words, chunks = ([0.0] * n for _ in range(5))
    before = [0.0] * n
    seen = 0.0
    first = [None] * n
    for node, _, text, in_link in page.pieces:
        size = len(text) - text.count(" ")
        own[node] += size
        if in_link:
            linked[node] += size
        stops[node] += text.count(".") + text.count(",")
        words[node] += text.count(" ") + 1 if size else 0
        chunks[node] += size > 0
        if first[node] is None and size:
            first[node] = seen
        seen += size
    children, place = [0] * n, [0] * n
    for k in range(1, n):
        place[k] = children[page.parent[k]]
        children[page.parent[k]] += 1
    total, total_link, total_stops, nodes, paragraphs, inputs, links = own[:], linked[:], stops[:], [1.0] * n, [float(t == "p") for t in page.tag], [float(i) for i in page.inputs], [float(i) for i in page.links]
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        for column in (total, total_link, total_stops, nodes, paragraphs, inputs, links):
            column[up] += column[k]
        if first[k] is not None and (first[up] is None or first[k] < first[up]):
            first[up] = first[k]
    depth = [0] * n
    tags = [[float(t in g) for g in TAG_GROUPS] for t in page.tag]
    marks = [[float(bool(t & g)) for g in TOKEN_GROUPS] for t in page.tokens]
    above = [[0.0] * 3 for _ in range(n)]
    rows = []
    for k in range(n):
        up = page.parent[k]
        if k:
            depth[k] = depth[up] + 1
            good = tags[up][4] or marks[up][9]
            bad = any(tags[up][:4]) or tags[up][13] or any(marks[up][:9])
            above[k] = [1.0 if good else above[up][0] * (not bad), 1.0 if bad else above[up][1], float(bad)]
        siblings = children[up] if k else 1
        parent_total = total[up] if k else total[k]
        rows.append(
            [
                *tags[k],
                *marks[k],
                *above[k],
                math.log1p(own[k]),
                math.log1p(total[k]),
                total_link[k] / max(total[k], 1),
                total[k] / nodes[k] / 100,
                total_stops[k] / max(total[k], 1) * 10,
                paragraphs[k],
                min(inputs[k], 5),
                min(links[k], 50),
                depth[k],
                children[k],
                siblings,
                place[k] / max(siblings, 1),
                (parent_total - total[k]) / max(siblings - 1, 1) / 100,
                total[k] / max(parent_total, 1),
                total[k] / max(seen, 1),
                (first[k] if first[k] is not None else before[k]) / max(seen, 1),
            ]
        )
    return np.array(rows)


def decode(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """The best set of kept nodes in which every kept node's parent is kept; the root always is."""
    gain = np.asarray(log_odds, float).copy()
    for k in range(len(gain) - 1, 0, -1):
        if gain[k] > 0:
            gain[page.parent[k]] += gain[k]
    kept = np.zeros(len(gain), bool)
    kept[0] = True
    for k in range(1, len(gain)):
        kept[k] = kept[page.parent[k]] and gain[k] > 0
    return kept


# ---- training pages

_SYLLABLES = "ba con de er fi ga hi in jo ka le mi no or pu que ra si ta un ver wa xi yo zen th ing ed ly".split()


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n))


def _element(rng: random.Random, tag: str, inner: str, names: list[str] | None = None, main: bool = False) -> str:
    attributes = ""
    if names and rng.random() < 0.85:
        attributes = f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'
    return f"<{tag}{attributes}{' data-main' if main else ''}>{inner}</{tag}>"


def _links(rng: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_words(rng, rng.randint(1, 3))}</a></li>' for k in range(n)) + "</ul>"


def _boiler(rng: random.Random, where: str) -> str:
    """A piece of a page that is not main text; ``where``: top, side, inside or bottom."""
    text = lambda a, b: _words(rng, rng.randint(a, b))
    top = [
        lambda: _element(rng, "nav", _links(rng, rng.randint(2, 9)), rng.choice([None, ["nav", "main-menu", "navbar"]])),
        lambda: _element(rng, "header", f"<h1>{text(1, 4)}</h1>" * rng.randint(0, 1) + f"<p>{text(1, 8)}</p>", rng.choice([None, ["site-header", "masthead"]])),
        lambda: _element(rng, "div", _links(rng, rng.randint(2, 8)), ["menu", "topbar nav", "breadcrumbs"]),
        lambda: _element(rng, "div", f"<p>{text(5, 25)}</p>", ["cookie-notice", "consent", "alert", "notice"]),
        lambda: _element(rng, "div", text(2, 30), ["ad", "ads", "advert", "banner ad", "promo"]),
        lambda: _element(rng, "form", f'<p>{text(1, 5)}</p><input name="q"><button>{text(1, 1)}</button>', ["search", "login-form"]),
    ]
    side = [
        lambda: _element(rng, "aside", f"<h3>{text(1, 4)}</h3>" + rng.choice([_links(rng, 5), f"<p>{text(5, 60)}</p>"]), rng.choice([None, ["sidebar", "related"]])),
        lambda: _element(rng, "div", f"<h3>{text(1, 4)}</h3>" + rng.choice([_links(rng, 4), f"<p>{text(5, 60)}</p>", text(4, 40)]), ["sidebar", "widget", "related", "side-rail", "trending"]),
        top[4],
    ]
    inside = [
        top[4],
        lambda: _element(rng, "aside", f"<p>{text(4, 30)}</p>", rng.choice([None, ["promo", "related"]])),
        lambda: _element(rng, "div", _links(rng, 3), ["share", "social", "tags"]),
        lambda: _element(rng, "form", f'<p>{text(3, 12)}</p><input type="email"><button>{text(1, 1)}</button>', ["newsletter", "subscribe"]),
        lambda: _element(rng, "div", f"<p>{text(4, 20)}</p>", ["notice", "newsletter", "paywall", "ad-slot advert"]),
        lambda: _element(rng, "nav", _links(rng, 3), rng.choice([None, ["toc"]])),
    ]
    comment = lambda: _element(rng, "div", "".join(_element(rng, rng.choice(["div", "li"]), f"<p>{text(3, 60)}</p>" * rng.randint(1, 2), ["comment", "reply"]) for _ in range(rng.randint(1, 5))), ["comments", "comment-list", "discussion", "responses comments"])
    bottom = [
        lambda: _element(rng, "footer", rng.choice([f"&copy; {text(3, 25)}", f"<p>{text(3, 25)}</p>", _links(rng, 4)]), rng.choice([None, ["site-footer", "footer"]])),
        lambda: _element(rng, "div", f"<p>&copy; {text(3, 25)}</p>", ["footer", "copyright", "legal"]),
        comment,
        lambda: _element(rng, "section", f"<h2>{text(1, 2)}</h2>" + "".join(f"<p>{text(3, 50)}</p>" for _ in range(rng.randint(1, 4))), ["comments", "reviews", "replies"]),
    ]
    return rng.choice({"top": top, "side": side, "inside": inside + [comment], "bottom": bottom}[where])()


def sample_page(rng: random.Random) -> str:
    """A page of some layout; elements of main text carry the attribute ``data-main``."""

    def paragraph() -> str:
        kind, n = rng.random(), rng.choice([rng.randint(1, 6), rng.randint(5, 40), rng.randint(30, 150)])
        text = _words(rng, n)
        if rng.random() < 0.2:
            text = re.sub(r"(\w+)", lambda m: rng.choice(["<b>{}</b>", '<a href="/x">{}</a>', "<i>{}</i>"]).format(m[1]), text, count=1)
        if rng.random() < 0.1:
            text = " ".join(w + rng.choice(["***", "&amp;&amp;", "|", "!!"]) for w in text.split())
        if kind < 0.75:
            return f"<p data-main>{text}</p>"
        if kind < 0.8:
            return f"<p data-main><b>{text}<br>"
        if kind < 0.86:
            return rng.choice(["<h2 data-main>{}</h2>", "<h3 data-main>{}</h3>"]).format(_words(rng, rng.randint(1, 7)))
        if kind < 0.9:
            return "<ul data-main>" + "".join(f"<li data-main>{_words(rng, rng.randint(1, 20))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote data-main><p data-main>{text}</p></blockquote>"
        if kind < 0.96:
            return f"<pre data-main>{text}</pre>"
        return "<table data-main>" + "".join("<tr data-main>" + "".join(f"<td data-main>{_words(rng, rng.randint(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"

    body = [f"<h1 data-main>{_words(rng, rng.randint(1, 9))}</h1>"] * (rng.random() < 0.85) + [paragraph() for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 15]))]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        body.insert(rng.randint(0, len(body)), _boiler(rng, "inside"))
    inner = "".join(body)
    kind = rng.random()
    if kind < 0.5:
        core = _element(rng, "article", inner, rng.choice([None, ["post", "entry-content", "story"]]), main=True)
    elif kind < 0.65:
        core = _element(rng, "main", inner, rng.choice([None, ["content"]]), main=True)
    else:
        core = f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "post-body", "article", "main", "entry", "story-text"])}" data-main>{inner}</div>'
    if rng.random() < 0.35:
        core = _element(rng, rng.choice(["div", "main", "section"]), core + "".join(_boiler(rng, "side") for _ in range(rng.randint(0, 2))), ["container", "wrapper", "page", "layout", "content"])
    page = "".join(_boiler(rng, "top") for _ in range(rng.randint(0, 3))) + core + "".join(_boiler(rng, "side") for _ in range(rng.choice([0, 0, 1, 2]))) + "".join(_boiler(rng, "bottom") for _ in range(rng.randint(0, 2)))
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 4)}</title><style>p{{}}</style></head><body>{page}" + "</body></html>" * (rng.random() < 0.9)


def _labels(page: Page) -> np.ndarray:
    """1 for nodes that are marked or hold a marked one."""
    out = np.array(page.mark, float)
    for k in range(len(out) - 1, 0, -1):
        if out[k]:
            out[page.parent[k]] = 1
    return out


@lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 11) -> BoostedTrees:
    """The trees, fitted to ``pages`` composed pages."""
    rng = random.Random(seed)
    parsed = [Page(sample_page(rng)) for _ in range(pages)]
    return BoostedTrees().fit(np.concatenate([features(p) for p in parsed]), np.concatenate([_labels(p) for p in parsed]))


def extract(sources: list[str | None], model: BoostedTrees) -> list[str]:
    """Main text of each page, blocks joined by newlines."""
    parsed = [Page(s or "") for s in sources]
    if not parsed:
        return []
    rows = [features(p) for p in parsed]
    odds = np.split(model.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
    return ["\n".join(p.blocks(decode(p, o))) for p, o in zip(parsed, odds, strict=True)]


def main_text(pages: DataFrame, model: BoostedTrees, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url``, ``text`` and ``n_chars`` per input row.

    A null or empty page gives an empty text, as does one without main text. Broken markup (tags that never
    close, text that merely looks like a tag) is parsed as far as it goes. Repeated rows are extracted each;
    ids and urls may be null; other columns are ignored; an empty table gives no rows.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1 << 18):
            texts = extract([t.as_py() for t in part.column(2)], shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(tidy(run), f"`{id_col}` {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
