"""Main text of web pages: flat text blocks with features of themselves and their neighbours, judged by a decision tree.

A page is cut at block-level tags into flat blocks of text. Each block's features are its number of words and its link
density, those of the blocks before and after it, and what encloses it: a sectioning element or a class or id name that
tells content or boilerplate, and whether it lies outside the page's content elements. A decision tree (Gini splits,
trained here when first used) keeps or drops each block. Its small labelled table has the blocks of pages made by rule,
a third of them without any sectioning element or name, so that sizes and links of neighbours decide where markup says
nothing. Script, style and the like have no text at all.

Kept blocks are joined in page order by one space, with character references decoded and white space made single.

Defined results: null or empty html, and pages without main text, give an empty text; repeated rows get equal results;
null ids and urls are allowed; an empty table gives an empty table. Markup that is cut short or wrongly nested ends where
the page ends. Other columns pass; columns named as the new ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerbrook.llm.common import bounded_batches, lean, slices, without

#: Fixed values of HTML: elements whose content is no text, elements that end a block, elements without content.
SILENT = "script style noscript template svg math head iframe object canvas audio video select textarea button datalist".split()
BLOCK = (
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Elements and parts of class and id names that tell what encloses a block.
AWAY = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "foot", "header": "head", "form": "form", "dialog": "notice", "fieldset": "form", "label": "form"}
CONTENT = {"article", "main"}
AWAY_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|foot|header\w*|masthead|topbar|toolbar"
    r"|comments?\w*|discuss\w*|disqus\w*|repl(?:y|ies)|respond|cookies?\w*|consent|gdpr|notice|popup|modal|overlay|newsletter\w*|subscri\w*|signup|login|search\w*"
    r"|share\w*|sharing|social\w*|related\w*|recommend\w*|widgets?|pagination|pager|copyright|legal|disclaimer|skip|tags?)(?:$|[\s_-])",
    re.I,
)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story\w*|content|main|body|text|prose)(?:$|[\s_-])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
SPACE = re.compile(r"\s+")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "away", "content", "outside", "heading", "title"]
#: Lessons that make the labelled table, depth of the tree and blocks of a leaf.
LESSONS, DEPTH, LEAF = 480, 11, 4
#: What stands around main text: the element it is written with, if there is one, and a usual class name.
PARTS = {
    "head": ("header", "site-header"), "menu": ("nav", "nav-links"), "notice": (None, "cookie-notice"), "ad": (None, "advert"), "text": ("article", "post-content"), "share": (None, "share"),
    "related": (None, "related"), "side": ("aside", "sidebar"), "form": ("form", "newsletter"), "comments": (None, "comments"), "foot": ("footer", "site-footer"),
}


class Lesson:
    """A page made by rule, whose main words are all ``m`` and whose other words are all ``o``.

    ``manner`` 0 marks parts by elements, 1 by class names, 2 not at all: there only the blocks' sizes and links, and those
    of their neighbours, tell them apart.
    """

    def __init__(self, rng: np.random.Generator, manner: int):
        self.rng, self.manner = rng, manner

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def some(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high + 1))

    def words(self, low: int, high: int, word: str = "o") -> str:
        return " ".join([word] * self.some(low, high))

    def part(self, kind: str, inner: str) -> str:
        element, name = PARTS[kind]
        if self.manner == 0 and element:
            return f"<{element}>{inner}</{element}>"
        return f'<div class="{name}">{inner}</div>' if self.manner == 1 or (self.manner == 0 and self.chance(0.5)) else f"<div>{inner}</div>"

    def links(self, low: int, high: int, widest: int = 3) -> str:
        return "<ul>" + "".join(f"<li><a href=x>{self.words(1, widest)}</a></li>" for _ in range(self.some(low, high))) + "</ul>"

    def paragraph(self) -> str:
        n = self.some(1, 12) if self.chance(0.25) else self.some(12, 120)
        text = ["m"] * n
        if self.chance(0.3):
            k = self.some(0, n - 1)
            text[k] = f"<a href=x>{text[k]}</a>"
        return f"<p>{' '.join(text)}</p>"

    def main(self) -> str:
        out = [f"<h1>{self.words(2, 12, 'm')}</h1>"]
        for _ in range(self.some(1, 10)):
            out.append(self.paragraph())
            if self.chance(0.15):
                out.append(f"<h2>{self.words(1, 6, 'm')}</h2>{self.paragraph()}")
            if self.chance(0.12):
                out.append("<ul>" + "".join(f"<li>{self.words(1, 15, 'm')}</li>" for _ in range(self.some(2, 6))) + "</ul>")
            if self.chance(0.08):
                out.append(f"<blockquote>{self.words(5, 40, 'm')}</blockquote>")
            if self.manner != 2 and self.chance(0.06):
                out.append(f"<p><a href=x>{self.words(1, 5, 'm')}</a></p>{self.paragraph()}")
            if self.chance(0.06):
                out.append(self.part("related", self.links(3, 6, 8)) + self.paragraph())
            if self.manner == 1 and self.chance(0.06):
                out.append(self.part("ad", self.words(3, 30)) + self.paragraph())
        return "".join(out)

    def page(self) -> str:
        if self.chance(0.15):  # a text by itself, or links by themselves
            alone = "".join(self.paragraph() for _ in range(1 if self.chance(0.6) else self.some(2, 4)))
            return alone if self.chance(0.7) else self.links(1, 6)
        out = [f"<head><title>{self.words(2, 10)}</title></head>"]
        if self.chance(0.6):
            out.append(self.part("head", f"<a href=x>{self.words(1, 3)}</a>" + (f"<p>{self.words(2, 8)}</p>" if self.chance(0.4) else "")))
        out.append(self.part("menu", self.links(3, 12)))
        if self.chance(0.3):
            out.append(self.part("notice", f"<p>{self.words(6, 25)}</p><p><a href=x>{self.words(1, 3)}</a></p>"))
        if self.chance(0.4):
            out.append(self.part("ad", self.words(3, 20) if self.chance(0.5) else f"<a href=x>{self.words(3, 15)}</a>"))
        out.append(self.part("text", self.main()))
        if self.chance(0.4):
            out.append(self.part("share", self.links(2, 5, 2)))
        if self.chance(0.4):
            out.append(self.part("related", f"<h3>{self.words(1, 3)}</h3>" + self.links(3, 6, 9)))
        if self.chance(0.4):
            out.append(self.part("side", f"<h3>{self.words(1, 3)}</h3>" + (self.links(3, 8, 6) if self.chance(0.6) else f"<p>{self.words(6, 20)}</p>")))
        if self.chance(0.3):
            out.append(self.part("form", f"<p>{self.words(4, 15)}</p><label>{self.words(1, 2)}</label><input>"))
        if self.manner != 2 and self.chance(0.4):
            said = "".join(f"<p>{self.words(2, 4)}</p><p>{self.words(3, 60)}</p><a href=x>{self.words(1, 1)}</a>" for _ in range(self.some(1, 4)))
            out.append(f'<div class="comments"><h2>{self.words(1, 3)}</h2>{said}</div>' if self.chance(0.7) or self.manner == 1 else self.part("side", said))
        out.append(self.part("foot", f"<p>{self.words(3, 12)}</p>" + (self.links(2, 8) if self.chance(0.6) else "") + (f"<p>{self.words(8, 30)}</p>" if self.chance(0.2) else "")))
        return "<html>" + "".join(out) + "</html>"


def labelled() -> np.ndarray:
    """The labelled table: a row of ``FEATURES`` for each block of the lessons, and whether it is main text."""
    rows = []
    for k in range(LESSONS):
        found = blocks(Lesson(np.random.default_rng([11, k]), k % 3).page())
        rows += [(*row, float(b.text.startswith("m"))) for row, b in zip(features(found), found, strict=True)]
    return np.array(rows)


class Tree:
    """A decision tree: the threshold split with the least Gini impurity, until leaves are pure or small."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
        self.leaf, self.at = float(y.mean()), None
        if depth == 0 or self.leaf in (0.0, 1.0):
            return
        best = (np.inf, 0, 0.0)
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, hits = x[order, k], np.cumsum(y[order])
            n = np.arange(1, len(v))
            can = (v[1:] > v[:-1]) & (n >= LEAF) & (len(v) - n >= LEAF)
            if not can.any():
                continue
            low, high = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(v) - n)
            cost = np.where(can, n * low * (1 - low) + (len(v) - n) * high * (1 - high), np.inf)
            i = int(cost.argmin())
            best = min(best, (round(float(cost[i]), 9), k, float(v[i] + v[i + 1]) / 2))
        if best[0] < np.inf:
            self.at, self.cut = best[1:]
            low = x[:, self.at] < self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, row) -> float:
        node = self
        while node.at is not None:
            node = node.low if row[node.at] < node.cut else node.high
        return node.leaf


@cache
def tree() -> Tree:
    table = labelled()
    return Tree(table[:, :-1], table[:, -1])


class Block:
    """A flat block of text: its characters and how many of them are in links, and what encloses it.

    ``content`` is 2 inside an article, 1 inside some other element that tells content, else 0.
    """

    __slots__ = ("away", "content", "heading", "letters", "linked", "text", "title", "words")

    def __init__(self, text, linked, letters, away, content, heading, title):
        self.text, self.linked, self.letters, self.away, self.content, self.heading, self.title = text, linked, letters, away, content, heading, title
        self.words = text.count(" ") + 1


def blocks(html: str) -> list[Block]:
    """The page's flat text blocks in order."""
    out: list[Block] = []
    open_: list[tuple[str, int, int, bool]] = []  # tag, what it adds to away and content, hidden
    held: Counter = Counter()  # how many of each are open; "away", "content" and "hidden" count elements of that kind
    parts, linked, total = [], 0, 0

    def finish():
        nonlocal parts, linked, total
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            tags = [t for t, *_ in open_[-3:]]
            content = 0 if not held["/content"] else 2 if held["article"] else 1
            out.append(Block(text, linked, max(total, 1), held["/away"] > 0, content, any(t in HEADINGS for t in tags), held["title"] > 0))
        parts, linked, total = [], 0, 0

    def add(text: str):
        nonlocal linked, total
        if held["/hidden"]:
            return
        text = unescape(text)
        parts.append(text)
        n = len(text) - text.count(" ")
        total += n
        if held["a"]:
            linked += n

    def close(upto: int):
        while len(open_) > upto:
            name, a, c, h = open_.pop()
            held[name] -= 1
            held["/away"] -= a
            held["/content"] -= c
            held["/hidden"] -= h

    at = 0
    while m := TAG.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[1]:
            add(m[1])
        name = (m[3] or "").lower()
        if not name:
            continue
        ends = name in BLOCK_SET
        if ends:
            finish()
        if m[2]:
            found = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None) if held[name] > 0 else None
            if found is not None and (ends or not any(t in SECTIONS for t, *_ in open_[found + 1 :])):
                close(found)
            continue
        if name in VOID_SET:
            continue
        if name in RAW:
            stop = RAW[name].search(html, at)
            at = stop.end() if stop else len(html)
            continue
        attrs = m[4] or ""
        names = " ".join(x or y or z for x, y, z in NAMED.findall(attrs)) if "=" in attrs else ""
        if ends and name != "title" and held["head"] > 0:
            for i, (t, *_) in enumerate(open_):
                if t == "head":  # text has begun
                    close(i)
                    break
        for i in range(len(open_) - 1, -1, -1) if name in IMPLIED and any(held[x] > 0 for x in IMPLIED[name]) else ():  # a new one ends the last of its kind
            if open_[i][0] in IMPLIED[name]:
                close(i)
                break
            if open_[i][0] in SECTIONS:
                break
        inner = held["article"] + held["main"] > 0
        is_away = (name in AWAY and not (name == "header" and inner)) or bool(names and name not in WHOLE and AWAY_NAMES.search(names))
        is_away = is_away or (name == "article" and held["article"] > 0)  # an article's own articles are its comments
        is_content = not is_away and (name in CONTENT or (name in ("div", "section") and bool(CONTENT_NAMES.search(names))))
        hidden = name in SILENT_SET or bool(HIDDEN.search(attrs))
        open_.append((name, int(is_away), int(is_content), int(hidden)))
        held[name] += 1
        held["/away"] += is_away
        held["/content"] += is_content
        held["/hidden"] += hidden
    if at < len(html):
        add(html[at:])
    finish()
    return out


HEADINGS = {f"h{i}" for i in range(1, 7)}
WHOLE = {"html", "body", "article", "main"}
BLOCK_SET, VOID_SET, SILENT_SET = set(BLOCK), set(VOID), set(SILENT)
RAW = {x: re.compile(rf"</{x}[^>]*(?:>|$)", re.I) for x in ("script", "style", "textarea", "noscript", "iframe")}
SECTIONS = {"article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "td", "ul", "ol", "dl", "blockquote"}
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """A row of ``FEATURES`` for each block of a page.

    A block is outside if it isn't in the kind of element that holds the page's content: articles, if a third at least of
    all words in content elements are in them.
    """
    inside = [sum(b.words for b in found if b.content == k and not b.away) for k in (0, 1, 2)]
    kind = 2 if inside[2] and 2 * inside[2] >= inside[1] else 1 if inside[1] or inside[2] else 0
    links = [min(1.0, b.linked / b.letters) for b in found]
    out = []
    for i, b in enumerate(found):
        near = [(found[j].words, links[j]) if 0 <= j < len(found) else (0, 0.0) for j in (i, i - 1, i + 1)]
        out.append((*near[0], *near[1], *near[2], float(b.away), float(b.content > 0), float(b.content < kind), float(b.heading), float(b.title)))
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found, judge = blocks(html), tree()
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if judge.predict(row) >= 0.5)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars (its code points)."""
    bounded_batches(pages.sparkSession)
    rest = [c for c in without(pages, ["text", "n_chars"]).columns if c != html_col]
    sent = pages.select([f"`{c}`" for c in [*rest, html_col]])
    schema = T.StructType([*sent.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                html = part.column(part.num_columns - 1).to_pylist()
                for a, b in slices(html):
                    texts = [main_text(x) for x in html[a:b]]
                    own = part.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return sent.mapInArrow(lean(run), schema)
