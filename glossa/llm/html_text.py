"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a sequence of text blocks. The log-odds of a logistic classifier (length, links, punctuation, kind of element, and,
with little weight, what enclosing elements, class and id words name) are the capacities between a block and the two terminals, content and
boilerplate. Neighbouring blocks and blocks near in the DOM are joined by edges whose strength is the log-odds
that two blocks so many steps apart have one label. The maximum flow from one terminal to the other gives the labelling of least
cost; the blocks still reached from the content terminal are the main text.

Weights of the classifier and strengths of the edges are fitted on at most ``SAMPLE`` pages and ``BLOCKS`` blocks of each (rows
of the least hashes; blocks at equal steps), labelled where the pages' own names (article, nav, ..) tell. As the names are the labels, their
own weights are held near the prior, one unit of log-odds, and the others are fitted on blocks without them too: content and
neighbours decide, also on pages whose names say nothing or mislead. ``WEIGHTS`` and ``TIES`` are the prior, and all there is where
no page of the sample tells.

Defined cases: a null or empty page, or one without content, has the empty text; unclosed and stray tags are repaired as
browsers do, and however deep they nest, time grows with the page's length; character references are decoded once; runs of
white space become one space; equal rows give equal rows; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import spread, staged, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")

# Names of elements, roles and class words (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr"}, "tbody": {"tr", "thead", "tbody"}, "tfoot": {"tr", "tbody"},
}
TABLE = frozenset("tr td th tbody thead".split())
SCOPE = frozenset("html body div article section main nav aside header footer form table tr td th ul ol dl li dd blockquote figure".split())
AWAY_TAGS = frozenset("nav aside form footer button select menu dialog head".split())
AWAY_ROLES = frozenset("navigation contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
HOME_TAGS = frozenset("article main".split())
HOME_WORDS = frozenset("article content post entry story main maincontent articlebody".split())
AWAY_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar side aside rail widget ad ads adv advert adverts advertisement advertising adbox "
    "adsense adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login form search share sharing social related recommended comments comment commentlist reply replies respond disqus copyright legal "
    "toolbar pagination pager skip hidden teaser".split()
)
#: Class words that send a block away even beside a home word, and those that do so outside an article only.
ALWAYS = frozenset("comments comment commentlist disqus ad ads advert advertisement sponsored cookie consent newsletter share sharing related nav menu sidebar footer".split())
TOP = frozenset("header masthead banner".split())
#: Class words of what reads like the main text but is the readers' own.
READERS = frozenset("comments comment commentlist disqus reply replies respond".split())

#: Prior weights of the classifier by feature, and prior strength of edges by steps apart in the DOM (the last one: so many or more).
WEIGHTS = {"always": -2.5, "log of words": 1.0, "share of links": -6.0, "ends a sentence": 1.5, "commas a word": 1.0, "heading": 1.0, "item or cell": -1.0, "paragraph": 1.0, "legal mark": -3.0,
           "named content": 1.0, "named boilerplate": -1.0, "outside of the article": -1.0, "named against its place": -60.0}
TIES = (3.0, 2.0, 1.5, 0.6, 0.4, 0.2, 0.1, 0.1, 0.0)
FAR = len(TIES) - 1
KIND, NAMES = slice(5, 8), slice(9, 13)
#: Strength of the priors (L2 penalty of weights, and of those of names; rows).
PENALTY, NAMES_PENALTY, TIE_ROWS = 1.0, 10_000.0, 20
#: Capacity of one unit of log-odds; pages of the fit, and blocks of each.
UNIT, SAMPLE, BLOCKS = 16, 400, 1_000


def _kind(tag: str, attributes: str, home: bool) -> tuple[int, bool]:
    """(away, home) of an element by itself, away 2 for what is hidden or the readers'; ``home``: whether it lies in an article."""
    away, here, apart = tag in AWAY_TAGS or (tag == "header" and not home), tag in HOME_TAGS, False
    if attributes and tag not in ("html", "body"):
        words: set[str] = set()
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), ""), name.lower()
            if name in ("class", "id"):
                words.update(w.lower() for w in SPLIT.split(value) if w)
            elif name == "role":
                away, here = away or value.lower() in AWAY_ROLES or (value.lower() == "banner" and not home), here or value.lower() == "main"
            elif name == "itemprop":
                here = here or value.lower() == "articlebody"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                away = apart = True
        if words:
            named = bool(words & HOME_WORDS)
            apart = apart or bool(words & READERS)
            away = away or bool(words & (ALWAYS if named else AWAY_WORDS)) or bool(not named and not home and words & TOP)
            here = here or (named and not away)
    return away + (away and apart), here


class Page:
    """Blocks of a page: (text, node, tag, away, home, letters in links); nodes have a parent and a depth.

    The open elements are kept in levels, each begun by an element that repairs do not cross, with counts of what is open in
    it, so that a stray end tag costs no walk and deep or broken nesting takes linear time.
    """

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, str, int, bool, int]] = []
        self.parent, self.depth = [0], [0]
        self.stack: list[tuple[str, int, str, int, bool, bool]] = [("", 0, "", 0, False, False)]
        self.levels: list[tuple[str, int, Counter]] = [("", 0, Counter())]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                _, node, tag, away, home, _ = self.stack[-1]
                self.blocks.append((text, node, tag, away, home, self.linked))
            self.parts.clear()
            self.linked = 0

    def _cut(self, i: int) -> None:
        """Close the elements from place ``i`` of the stack on."""
        own = len(self.stack)
        while self.levels[-1][1] >= i:
            own = self.levels.pop()[1]
        for entry in self.stack[i:own]:
            self.levels[-1][2][entry[0]] -= 1
        self.open.subtract(entry[0] for entry in self.stack[i:])
        del self.stack[i:]

    def _open(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        if not inline:
            self._flush()
            self._imply(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, node, block, away, home, link = self.stack[-1]
        if not inline:
            own_away, own_home = _kind(tag, attributes, home)
            away, home, block = max(away, own_away), home or own_home, tag
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            node = len(self.parent) - 1
        if tag in SCOPE:
            self.levels.append((tag, len(self.stack), Counter()))
        else:
            self.levels[-1][2][tag] += 1
        self.open[tag] += 1
        self.stack.append((tag, node, block, away, home, link or tag == "a"))

    def _topmost(self, tags: set[str]) -> int:
        return next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] in tags)

    def _imply(self, tag: str) -> None:
        """Close what ends where ``tag`` begins: paragraphs, and items, rows and cells before their next."""
        ends = CLOSES.get(tag, frozenset())
        back = 1
        while back <= min(len(self.levels), 8):
            opener, start, held = self.levels[-back]
            if inner := {t for t in ("p", "option") if held[t] > 0 and (t == "p" or t in ends)}:
                self._cut(self._topmost(inner))
                if not ends:
                    return
                back = 1
            elif opener in ends:
                self._cut(start)
                back = 1
            elif ends and opener in TABLE:
                back += 1
            else:
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
            if self.open[tag] > 0:
                self._cut(self._topmost({tag}))
        elif self.levels[-1][2][tag] > 0:
            self._cut(self._topmost({tag}))

    def _read(self, source: str) -> None:
        at, end, last_tag, last_data = 0, len(source), source.rfind(">"), source.rfind("]]>")
        while at < end:
            if at > last_tag:  # no tag can end any more
                self._text(source[at:])
                return
            if source.startswith("<![CDATA[", at) and at < last_data:
                close = source.index("]]>", at)
                self.parts.append(source[at + 9 : close])
                at = close + 3
                continue
            m = TOKEN.match(source, at)
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0][0] != "<" or m[0] == "<":
                    self._text(m[0])
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._close(tag)
            elif tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else end
            else:
                self._open(tag, m[3] or m[6] or "")

    def _text(self, text: str) -> None:
        self.parts.append(text)
        if self.stack[-1][5]:
            self.linked += len(text)

    def has_home(self) -> bool:
        return any(home and not away for _, _, _, away, home, _ in self.blocks)

    def seeds(self) -> list[int | None]:
        """What the page's own names say of each block: 1 main text, 0 boilerplate, None nothing."""
        has_home = self.has_home()
        return [0 if away or (has_home and not home) else 1 if home else None for _, _, _, away, home, _ in self.blocks]

    def apart(self, a: int, b: int) -> int:
        """Steps in the DOM between two nodes, counted up to FAR."""
        steps = 0
        while a != b and steps < FAR:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps

    def edges(self) -> list[tuple[int, int, int]]:
        """(i, j, steps apart) of following blocks, the last one of the same parent, and once the last one of its parent."""
        found, last = [], {}
        for i, block in enumerate(self.blocks):
            node = block[1]
            up = self.parent[node]
            near = {i - 1} if i else set()
            if (j := last.get(up)) is not None:
                near.add(j)
            if (j := last.pop(self.parent[up], None) if up else None) is not None:  # else a block would be tied to each of its nephews
                near.add(j)
            found += [(j, i, self.apart(node, self.blocks[j][1])) for j in near]
            last[node] = last[up] = i
        return found


def features(page: Page) -> np.ndarray:
    """A row for each block of a page: see WEIGHTS."""
    has_home = page.has_home()
    rows = np.zeros((len(page.blocks), len(WEIGHTS)))
    for row, (text, _, tag, away, home, linked) in zip(rows, page.blocks, strict=True):
        words = text.count(" ") + 1
        row[0] = 1
        row[1] = np.log1p(words)
        row[2] = min(linked, len(text)) / len(text)
        row[3] = text[-1] in ".!?…\"”»。"
        row[4] = sum(map(text.count, ",;:")) / words
        row[5] = tag in ("h1", "h2", "h3")
        row[6] = tag in ("li", "dt", "dd", "td", "th")
        row[7] = tag in ("p", "blockquote", "pre")
        row[8] = text[0] in "©®™"
        row[9] = home and not away
        row[10] = away > 0
        row[11] = has_home and not home and not away
        row[12] = (away and home) or away > 1
    return rows


def fitted_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of most posterior probability, WEIGHTS being the mean of a normal prior, by Newton's method.

    Every block counts twice, once without its kind of element and its names, so that length and links are weighed for pages of plain divisions.
    """
    plain = x.copy()
    plain[:, KIND] = plain[:, NAMES] = 0
    x, y = np.concatenate([x, plain]), np.concatenate([y, y])
    prior, penalty = np.array(list(WEIGHTS.values())), np.full(len(WEIGHTS), PENALTY)
    penalty[NAMES] = NAMES_PENALTY

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + np.sum(penalty * (w - prior) ** 2) / 2)

    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        before, size = loss(w), 1.0
        while loss(w - size * step) > before and size > 1e-9:  # a whole step may go too far
            size /= 2
        w = w - size * step
        if np.abs(step).max() * size < 1e-6:
            break
    return w


def fitted_ties(near: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Strength of an edge by its steps: the log-odds that both blocks have one label, never less than 0."""
    prior = 1 / (1 + np.exp(np.array(TIES)))
    share = (differ + TIE_ROWS * prior) / (near + TIE_ROWS)
    return np.maximum(np.log((1 - share) / share), 0)


class Model(NamedTuple):
    weights: np.ndarray
    ties: np.ndarray


UNFITTED = Model(np.array(list(WEIGHTS.values())), np.array(TIES, float))


def costs(page: Page, model: Model = UNFITTED) -> list[tuple[int, int]]:
    """(cost of not taking, cost of taking) of every block: the classifier's log-odds."""
    score = np.rint(features(page) @ model.weights * UNIT).astype(int)
    return list(zip(np.maximum(score, 0).tolist(), np.maximum(-score, 0).tolist(), strict=True))


def links(page: Page, model: Model = UNFITTED) -> list[tuple[int, int, int]]:
    ties = np.rint(model.ties * UNIT).astype(int).tolist()
    return [(i, j, ties[steps]) for i, j, steps in page.edges() if ties[steps]]


def least_cut(capacities: list[tuple[int, int]], links: list[tuple[int, int, int]]) -> list[bool]:
    """Side of the source for every node, by blocking flows (levels, then augmenting paths along them)."""
    n = len(capacities)
    # what goes straight through a node is pushed first: a node keeps room to one terminal only
    room = [a - b for a, b in capacities]
    around: list[list[int]] = [[] for _ in range(n)]
    to, left = [], []
    for i, j, strength in links:
        around[i].append(len(to))
        around[j].append(len(to) + 1)
        to += [j, i]
        left += [strength, strength]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if room[i] > 0)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or room[i] < 0
            for e in around[i]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in range(n):
            path: list[int] = []
            at = start
            while room[start] > 0:
                if room[at] < 0:
                    amount = min(room[start], -room[at], *(left[e] for e in path)) if path else 0
                    for e in path:
                        left[e] -= amount
                        left[e ^ 1] += amount
                    room[start] -= amount
                    room[at] += amount
                    path, at = [], start
                    continue
                while turn[at] < len(around[at]):
                    e = around[at][turn[at]]
                    if left[e] and level[to[e]] == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(around[at]):
                    path.append(e)
                    at = to[e]
                elif path:
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break


def main_text(source: str | None, model: Model = UNFITTED) -> str:
    if not source:
        return ""
    page = Page(source)
    kept = least_cut(costs(page, model), links(page, model))
    return " ".join(b[0] for b, keep in zip(page.blocks, kept, strict=True) if keep)


def fit(pages: DataFrame, sample: int = SAMPLE, most: int = BLOCKS) -> Model:
    """The model of a bounded sample of ``pages``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                seeds = page.seeds()
                told = [i for i, s in enumerate(seeds) if s is not None]
                told = told[:: -(-len(told) // most)] if told else told
                ties = [(steps, seeds[i] != seeds[j]) for i, j, steps in page.edges() if seeds[i] is not None and seeds[j] is not None]
                steps = np.array([t[0] for t in ties], np.int64)
                same = np.bincount(steps, minlength=FAR + 1), np.bincount(steps, weights=[t[1] for t in ties], minlength=FAR + 1)
                rows.append((features(page)[told].ravel().tolist(), [seeds[i] for i in told], *(s.astype(float).tolist() for s in same)))
            kinds = [pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["x", "y", "near", "differ"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.concatenate([np.empty(0), *pdf[c]]) for c in "xy")
        near, differ = (np.sum([np.zeros(FAR + 1), *pdf[c]], axis=0) for c in ("near", "differ"))
        return pd.DataFrame({"value": [[*fitted_weights(x.reshape(-1, len(WEIGHTS)), y), *fitted_ties(near, differ)]]})

    rows = spread(pages.select("page_id", "url", "html"), ["page_id", "url"], sample).select("html")
    found = staged(rows.mapInArrow(scan, "x array<double>, y array<int>, near array<double>, differ array<double>").groupBy().applyInPandas(fitted, "value array<double>"), "html-model").collect()
    return Model(np.array(found[0].value[: len(WEIGHTS)]), np.array(found[0].value[len(WEIGHTS) :])) if found else UNFITTED


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, by ``model`` or one fitted on a sample of ``pages``."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    model = model or fit(pages)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(scan, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10_html_text(spark, sf_dir):
    """Main text of all ``pages``."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_text": op10_html_text}
ORACLE_SQL: dict[str, str] = {}
