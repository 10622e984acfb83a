"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and the text runs under them are the nodes. Each node has a unary potential
from its own tag, names, length and links, and shares a potential with its parent that
favours equal labels. Messages go up the tree and down again (sum-product), which gives each
text run its exact marginal probability of being content. Weights are fitted by
maximum likelihood on labelled pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their part in a page (fixed values of the HTML vocabulary).
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea".split())
CLOSES_PARAGRAPH = BLOCKS - frozenset("html body button option optgroup legend summary caption".split())
#: A start tag that ends an open sibling, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}

#: Words in class, id and role names, by what they suggest (fixed values).
NAMES = {
    "body": "article articlebody content post entry main story text page blogpost prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "top": "header masthead topbar banner branding logo hero toolbar",
    "bottom": "footer copyright contentinfo legal colophon bottom",
    "side": "sidebar aside widget related recommended complementary rail popular trending teaser",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense outbrain taboola",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert privacy paywall toast disclaimer",
    "reply": "comment comments commentlist reply replies respond disqus discussion feedback thread responses",
    "form": "form subscribe newsletter search login signup register contact",
    "share": "share sharing social follow meta byline tags tag author",
}
#: What short or first texts of a part say of it, whatever its names (fixed values).
SAYS = {
    "notice": r"\b(?:we|site|website|page|our|accept|allow|by)\b[^.]{0,60}\bcookies\b|cookie (?:policy|settings|consent|preferences|notice)|\bgdpr\b|our privacy policy|we value your privacy|allow notifications",
    "reply": r"^\W*(?:\d+\s+)?(?:comments?|repl(?:y|ies)|responses?)\b(?:\W*\(?\d+\)?)?\W*$|leave a (?:reply|comment)|join the (?:discussion|conversation)|^\W*(?:show|view|load|add|post) (?:a |all |more )?comments?\b",
    "advert": r"^\W*(?:advertisement|sponsored|promoted|anzeige|publicidad|publicité)\b|sponsored (?:content|by)|paid (?:content|partnership)|special offer|limited time offer",
    "side": r"^\W*(?:related|popular|trending|recommended|most read|latest|more from|you may also|you might also|read more|see also|also on)\b",
    "form": r"subscribe (?:to|now|for)|newsletter|sign up|log ?in\b|enter your e-?mail|your e-?mail address|search this site",
    "share": r"^\W*(?:share|follow|tweet|posted (?:on|by|in)|filed under|tagged|tags)\b|share (?:this|on)|follow us",
    "menu": r"^\W*(?:skip to|home|menu|main menu|navigation|table of contents)\W*$",
}
_SAYS = {group: re.compile(pattern, re.I) for group, pattern in SAYS.items()}
_GROUP = {word: group for group, words in NAMES.items() for word in words.split()}
TAGS = "p h li td div article main nav header footer aside form figure figcaption pre blockquote list table section control body #text".split()
_TAG = {t: t for t in TAGS} | {f"h{i}": "h" for i in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "th": "td", "tr": "table", "tbody": "table", "button": "control", "select": "control", "option": "control", "fieldset": "form", "legend": "control"}
PARTS = "article main nav header footer aside form".split()
#: Groups that a title names, and characters of a title at most.
TITLES, TITLE = frozenset("reply side share menu".split()), 60
#: Characters of a part's first text that are looked at, those of a part that its texts may speak for whole, and what may stand above a longer one.
SAID, SHORT, HEADED = 160, 500, ("reply", "side")
CONTROLS = frozenset("button input select option textarea".split())
FEATURES = {name: i for i, name in enumerate(["bias", *(f"in {t}" for t in [*PARTS, "none"]), *(f"under {g}" for g in [*NAMES, "hidden", "none"]), *(f"tag {t}" for t in [*TAGS, "other"]), *(f"name {g}" for g in NAMES), *(f"length {k}" for k in range(5)), *(f"links {k}" for k in range(4)), *(f"says {g}" for g in SAYS), "control inside", "title alone", "title inside", "sentence", "hidden", "rights", *(f"{t} inside an article" for t in ("header", "footer", "other")), "header outside"])}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?]['\")»”]?(?:\s|$)")


#: Raw elements whose text a browser reads to their end tag, or to the end of the page.
TO_THE_END = frozenset("script style title textarea".split())


def attributes_of(source: str) -> dict[str, str]:
    """Names, lower case, and values of a start tag's attributes; of a name that occurs twice the first."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def is_hidden(attributes: dict[str, str]) -> bool:
    """Whether an element is not shown, by its own attributes."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(attributes.get("style", "")))


def said(text: str) -> list[str]:
    """Groups that a text names as its part of a page."""
    return [group for group, pattern in _SAYS.items() if (len(text) <= TITLE or group not in TITLES) and pattern.search(text)]


class Page:
    """Nodes in document order (a parent before its children), the last of them text runs or elements alike."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.attributes = [-1], ["body"], [""]
        self.text: list[str] = [""]
        self.linked: list[int] = [0]
        self._open = [0]
        self._depths: dict[str, list[int]] = {}  # where in _open each tag stands
        self._buffer: list[str] = []
        self._links = self._in_link = 0
        self._ends: dict[str, dict[int, int]] = {}
        self._read(source)

    def _node(self, tag: str, attributes: str, text: str = "", linked: int = 0) -> int:
        self.parent.append(self._open[-1])
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _flush(self) -> None:
        text = " ".join("".join(self._buffer).split())
        if text:
            self._node("#text", "", text, min(self._links, len(text)))
        self._buffer, self._links, self._in_link = [], 0, 0

    def _close(self, names: set[str] | frozenset[str], until: set[str]) -> None:
        """Close the innermost open element of these names, unless one of `until` stands inside it."""
        depth = max((self._depths[t][-1] for t in names if self._depths.get(t)), default=0)
        if depth and all(self._depths[t][-1] < depth for t in until if t not in names and self._depths.get(t)):
            for node in self._open[depth:]:
                self._depths[self.tag[node]].pop()
            del self._open[depth:]

    def _enter(self, tag: str, attributes: str) -> None:
        self._depths.setdefault(tag, []).append(len(self._open))
        self._open.append(self._node(tag, attributes))

    def _data(self, text: str) -> None:
        if text:
            text = html.unescape(text)
            self._buffer.append(text)
            if self._in_link:
                self._links += len(text.strip())

    def _end_of(self, tag: str, at: int, source: str) -> int | None:
        """Where the element whose start tag ends at `at` ends; none if it is never closed. Elements of one name lie within each other; found once for a page."""
        if tag not in self._ends:
            ends: dict[int, int] = {}
            open_: list[int] = []
            for m in re.finditer(f"<(/?){tag}(?=[\\s/>])[^>]*>", source, re.I):
                if not m[1]:
                    open_.append(m.end())
                elif open_:
                    ends[open_.pop()] = m.end()
            self._ends[tag] = ends
        return self._ends[tag].get(at)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _MARKUP.search(source, at)
            if not found:
                self._data(source[at:])
                break
            self._data(source[at : found.start()])
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag, closing, attributes = tag.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
            if tag in RAW and not closing:
                if tag in TO_THE_END:
                    stop = re.compile(f"</{tag}[^>]*>", re.I).search(source, at)
                    at = stop.end() if stop else end
                elif not attributes.endswith("/"):
                    at = self._end_of(tag, at, source) or at  # what is never closed holds nothing
                self._buffer.append(" " if tag not in ("svg", "math") else "")
            elif tag == "a":
                self._in_link = 0 if closing else 1
            elif tag == "br":
                self._buffer.append(" ")
            elif tag in ("html", "head", "body"):
                self._flush()
            elif tag in BLOCKS:
                self._flush()
                if closing:
                    self._close({tag}, set())
                else:
                    if tag in CLOSES_PARAGRAPH:
                        self._close({"p"}, {"td", "th", "button"})
                    if tag in ENDS:
                        self._close(*ENDS[tag])
                    if tag not in VOID:
                        self._enter(tag, attributes)
        self._flush()

    def active(self) -> list[list[int]]:
        """Feature numbers of each node."""
        n = len(self.tag)
        size, linked = [len(t) for t in self.text], list(self.linked)
        stops = [1 if t and _SENTENCE.search(t) else 0 for t in self.text]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            size[p] += size[i]
            linked[p] += linked[i]
            stops[p] |= stops[i]
        controls, titled, first, alone = [t in CONTROLS for t in self.tag], [t in ("h1", "main") for t in self.tag], [t[:SAID] for t in self.text], [True] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            controls[p] = controls[p] or controls[i]
            titled[p] = titled[p] or titled[i]
            if first[i]:  # of the children the first one that has text; whether that has no other
                first[p], alone[p] = first[i], len(first[i]) == size[i]
        out: list[list[int]] = []
        inside = [False] * n  # of an article or main element
        part, under = ["none"] * n, ["none"] * n  # the nearest telling element above, and the nearest telling name
        for i in range(n):
            tag = self.tag[i]
            if i:
                above = self.parent[i]
                inside[i] = inside[above] or self.tag[above] in ("article", "main")
                part[i] = self.tag[above] if self.tag[above] in PARTS else part[above]
                under[i] = "hidden" if under[above] == "hidden" else named[above] or under[above]
            else:
                named: list[str] = [""] * n
            row = [0, FEATURES[f"in {part[i]}"], FEATURES[f"under {under[i]}"], FEATURES[f"tag {_TAG.get(tag, 'other')}"], FEATURES[f"length {_bin(size[i], (1, 30, 100, 300))}"], FEATURES[f"links {_bin(linked[i] / max(size[i], 1), (0.01, 0.25, 0.6))}"]]
            place = tag if tag in ("header", "footer") else part[i]
            if inside[i]:
                row.append(FEATURES[f"{place if place in ('header', 'footer') else 'other'} inside an article"])
            elif place == "header":
                row.append(FEATURES["header outside"])
            if stops[i]:
                row.append(FEATURES["sentence"])
            if first[i] and not titled[i] and alone[i]:
                says = said(first[i])
                if size[i] > SHORT:  # a heading above a longer part
                    says = [g for g in says if g in HEADED]
                row += [FEATURES[f"says {g}"] for g in says]
                named[i] = says[0] if says else ""
            if controls[i] and size[i] <= SHORT and not titled[i]:
                row.append(FEATURES["control inside"])
            if titled[i] and tag not in ("h1", "main"):
                row.append(FEATURES["title alone" if alone[i] and len(first[i]) == size[i] else "title inside"])
            if self.attributes[i]:
                held = attributes_of(self.attributes[i])
                groups = {g for a in ("class", "id", "role") for w in _SPLIT_NAME.findall(held.get(a, "")) if (g := _GROUP.get(w.lower()))}
                row += [FEATURES[f"name {g}"] for g in sorted(groups)]
                named[i] = min(groups, key=lambda g: (g == "body", g), default=named[i])
                if is_hidden(held):
                    row.append(FEATURES["hidden"])
                    named[i] = "hidden"
            if tag == "#text" and ("©" in self.text[i] or "all rights reserved" in self.text[i].lower()) and size[i] < 300:
                row.append(FEATURES["rights"])
            out.append(row)
        return out


def _bin(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


class Forest:
    """The trees of some pages side by side; messages pass one depth of all of them at a time."""

    def __init__(self, pages: list[Page]) -> None:
        parents, depths, runs, nodes, features, at = [], [], [], [], [], 0
        for page in pages:
            depth = [0] * len(page.tag)
            for i, p in enumerate(page.parent):
                if p >= 0:
                    depth[i] = depth[p] + 1
            parents += [p + at for p in page.parent]
            depths += depth
            runs += [t == "#text" for t in page.tag]
            for i, row in enumerate(page.active(), at):
                nodes += [i] * len(row)
                features += row
            at += len(page.tag)
        self.n, self.parent, self.run = at, np.array(parents, np.int64), np.array(runs, bool)
        self.nodes, self.features = np.array(nodes, np.int64), np.array(features, np.int64)
        depth = np.array(depths, np.int64)
        order, cuts = np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth)) if at else []
        self.levels = np.split(order, cuts)[1:-1] if at else []  # without the roots
        self.inner = np.flatnonzero(depth > 0)

    def messages(self, unary: np.ndarray, bond: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of each node from below, of its message up, and of its marginal."""
        below, up = unary.copy(), np.zeros(self.n)
        for level in reversed(self.levels):
            up[level] = _through(below[level], bond[level])
            np.add.at(below, self.parent[level], up[level])
        total = below.copy()
        for level in self.levels:
            parent = self.parent[level]
            total[level] = below[level] + _through(total[parent] - up[level], bond[level])
        return below, up, total


def _through(odds: np.ndarray, bond: np.ndarray) -> np.ndarray:
    """Log odds that a node with these odds sends over a bond: +bond for equal labels, -bond for unequal."""
    return np.logaddexp(0, odds + 2 * bond) - np.logaddexp(0, odds - 2 * bond) - 2 * bond


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


@dataclass(frozen=True)
class TreeModel:
    """Unary weights by feature; the bonds of elements and of text runs with their parents."""

    weights: np.ndarray
    element: float
    run: float

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of content of each node of each page."""
        forest = Forest(pages)
        unary = np.bincount(forest.nodes, weights=self.weights[forest.features], minlength=forest.n)
        chance = _chance(forest.messages(unary, np.where(forest.run, self.run, self.element))[2])
        return np.split(chance, np.cumsum([len(p.tag) for p in pages])[:-1])


def _labels(page: Page, runs: list[int]) -> list[int]:
    """An element is content if at least half of the characters under it are."""
    n = len(page.tag)
    content, size, given = [0] * n, [len(t) for t in page.text], iter(runs)
    for i in range(n):
        if page.tag[i] == "#text":
            content[i] = size[i] * next(given)
    for i in range(n - 1, 0, -1):
        content[page.parent[i]] += content[i]
        size[page.parent[i]] += size[i]
    return [int(size[i] > 0 and 2 * content[i] >= size[i]) for i in range(n)]


def fit_tree(pages: list[tuple[Page, list[int]]], rounds: int = 150, ridge: float = 1e-4) -> TreeModel:
    """Maximum likelihood with exact marginals. pages: parsed pages with the label of each text run in order."""
    forest = Forest([page for page, _ in pages])
    y = np.array([x for page, runs in pages for x in _labels(page, runs)], float)
    sign, inner, parent, k = 2 * y - 1, forest.inner, forest.parent[forest.inner], len(FEATURES)
    run = forest.run[inner]
    w = np.zeros(k + 2)
    w[-2:] = 0.5
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        bond = np.where(forest.run, w[-1], w[-2])
        below, up, total = forest.messages(np.bincount(forest.nodes, weights=w[forest.features], minlength=forest.n), bond)
        above, under, tie = (total[parent] - up[inner]) / 2, below[inner] / 2, bond[inner]
        equal = np.logaddexp(above + under, -above - under) + tie
        agree = np.tanh((equal - np.logaddexp(above - under, under - above) + tie) / 2)
        excess = agree - sign[inner] * sign[parent]
        slope = np.concatenate([np.bincount(forest.features, weights=(_chance(total) - y)[forest.nodes], minlength=k), [excess[~run].sum(), excess[run].sum()]]) / forest.n + ridge * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return TreeModel(w[:-2], float(w[-2]), float(w[-1]))


def default_model(pages: int = 600) -> TreeModel:
    """The model fitted on labelled sample pages."""
    from .sample_pages import labelled_pages

    fitted = []
    for source, labels in labelled_pages(pages):
        page = Page(source)
        runs = [t for t, tag in zip(page.text, page.tag, strict=True) if tag == "#text"]
        fitted.append((page, [labels[t] for t in runs]))
    return fit_tree(fitted)


def main_texts(sources: list[str | None], model: TreeModel, threshold: float = 0.5) -> list[str]:
    """Content blocks of each page in order, one to a line."""
    pages = [Page(source or "") for source in sources]
    return ["\n".join(t for t, tag, p in zip(page.text, page.tag, chance, strict=True) if tag == "#text" and p >= threshold) for page, chance in zip(pages, model.marginals(pages), strict=True)]


def extract(pages: DataFrame, model: TreeModel | None = None, threshold: float = 0.5) -> DataFrame:
    """pages -> (page_id, url, text, n_chars), one row per page row.

    A block is the text directly under a block element; white space in it, line-break tags
    included, becomes one space. Null and empty html, and pages without content, give the
    empty string. Repeated rows stay, null ids and urls too; an empty table gives an empty result.
    Other columns are not looked at. Pages are read whole; time grows with a page's length, and
    with its nesting depth as far as levels are passed one by one. A tag that is never closed runs to
    the end of what holds it, a script, style, title or textarea to the end of the page; any other element whose text is not shown (video, svg and the like) counts only where it is closed.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sources = batch["html"].tolist()
            text = [x for at in range(0, len(sources), 256) for x in main_texts(sources[at : at + 256], shared.value, threshold)]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return source.mapInPandas(run, "page_id long, url string, text string, n_chars long")
