"""Main text of web pages by tag-path ratios.

A tolerant reader walks a page's tags and gives its text blocks in order, each with the path of tags (and of their
classes and ids) from the root. Per path, text length, punctuation and number of nodes are summed; their ratios are
smoothed along the page, fused, and compared with a threshold, so a path is taken or left as a whole and short
paragraphs stay with the long ones of their kind; text in links counts nothing. Paths through navigation, headers,
footers, sidebars, forms, notices, adverts and comments are left out. On pages with ``article`` or ``main`` only what
stands in these counts. Beside taken paths, in their content element (on other pages: below the element that holds them
all), short blocks go along. Paths that are mostly links, or are named as promotion or related matter, do so only
between taken blocks; else their score decides.

White space inside a block becomes one space, character references are decoded, blocks are joined by newlines.
Unclosed and misnested tags are closed as browsers do for paragraphs, list items, rows and cells; what never closes
ends with the page. Null and empty pages, and pages without text, give an empty text; repeated rows are read each;
other columns are not kept.
"""

from __future__ import annotations

import html
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches

# The elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg select annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mpadded semantics".split())
CLOSED_BY_BLOCK = frozenset(("p",))
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot body html article section main div blockquote aside nav footer header form td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("nav header footer aside form button dialog menu".split())
CONTENT = frozenset("article main".split())
BEFORE = r"(?:(?:site|page|main|global|primary|secondary|top|bottom|left|right|cookie|cookies|social|post|user|google|text|sub|mobile)[-_])*"
AFTER = (
    r"(?:[-_](?:area|banner|bar|block|box|buttons?|container|content|form|inner|items?|links?|list|main|menu|notice|panel|popup|posts?|section|slot|thread|unit|"
    r"widgets?|wrap|wrapper|left|right|top|bottom|[0-9]+))*"
)
BEFORE = r"(?:(?:site|page|main|global|primary|secondary|top|bottom|left|right|cookie|cookies|social|post|user|google|text|sub|mobile)[-_])*"
AFTER = (
    r"(?:[-_](?:area|banner|bar|block|box|buttons?|container|content|form|inner|items?|links?|list|main|menu|notice|panel|popup|posts?|section|slot|thread|unit|"
    r"widgets?|wrap|wrapper|left|right|top|bottom|[0-9]+))*"
)
#: Whole classes, ids and roles of menus, headers, footers, sidebars, notices, adverts and reader comments: a word, with
#: words of place before and of form after.
NOISE = re.compile(
    BEFORE + r"(?:ads?|advert\w*|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|nav(?:bar|igation)?|notices?|"
    r"pagination|replies|sidebar|sponsor(?:s|ed)?|toolbar)" + AFTER,
    re.I,
)
#: Those of parts that may be main text or not: their paths score half, and have to be taken or enclosed to stay.
DOUBTFUL = re.compile(BEFORE + r"(?:banner|modal|newsletter|popup|promo(?:s|tions?)?|related|share|sharing|social|subscribe|widget)" + AFTER, re.I)
#: Elements whose classes say something about the page or the text, not that it is something else.
NEVER_NOISE = CONTENT | {"html", "body"}
TOKEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*))")
DELIMITER = re.compile("[>\"']")
MARKS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、？！؟،¿¡]")
RAW_END = {name: re.compile(rf"</{name}\s*(?:>|\Z)", re.I) for name in RAW}


def tag_end(page: str, at: int, unclosed: set[int]) -> int:
    """The end of a tag, whose quoted values may hold ``>``; 0 if a quote never closes or the tag does not end.

    ``unclosed`` keeps the quotes from which no end is reached, so a page is not searched from them again.
    """
    opened = []
    while m := DELIMITER.search(page, at):
        if m[0] == ">":
            return m.end()
        opened.append(m.start())
        at = 0 if m.start() in unclosed else page.find(m[0], m.end()) + 1
        if not at:
            break
    unclosed.update(opened)
    return 0


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    clean: bool  # the path is free of parts that are not main text
    linked: int  # characters in links, as written
    doubtful: bool


def blocks(page: str) -> list[Block]:
    """Text blocks in order."""
    # Name, label; of it and what holds it: clean but for noise, noise, doubtful, in a content element, in a link.
    stack: list[tuple[str, str, bool, tuple[int, ...], bool, bool, bool]] = []
    texts: list[str] = []
    links, unclosed = 0, set()
    owner: tuple[tuple[str, ...], bool, tuple[int, ...], bool] | None = None
    waiting: list[tuple[tuple[str, ...], str, bool, tuple[int, ...], int, bool]] = []
    # Elements with words of noise are numbered. Those that hold all content elements only wrap the text: as to them,
    # contents that are themselves noise, as comments often are, and those within other content elements do not count.
    noisy, wrappers = 0, None

    def place() -> tuple[tuple[str, ...], bool, tuple[int, ...], bool]:
        path = tuple(label for name, label, *_ in stack if name not in INLINE)
        return path, *(stack[-1][2:5] if stack else (True, (), False))

    def flush() -> None:
        nonlocal owner, links
        text = SPACE.sub(" ", html.unescape("".join(texts))).strip()
        if text and owner:
            waiting.append((owner[0], text, owner[1], owner[2], links, owner[3]))
        texts.clear()
        owner, links = None, 0

    def add(text: str) -> None:
        nonlocal owner, links
        if text:
            if owner is None and text.strip():
                owner = place()
            texts.append(text)
            if stack and stack[-1][6]:
                links += len(text.strip())

    def close(depth: int) -> None:
        if any(name not in INLINE for name, *_ in stack[depth:]):
            flush()
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            break
        add(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = size if end < 0 else end + 3
            continue
        end = (tag_end(page, m.end(), unclosed) if m[4] else 0) or page.find(">", m.end()) + 1
        at = end or size
        if not m[4]:
            continue
        name, attributes = m[4].lower(), page[m.end() : at - 1]
        if m[3]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if name == "br":
            texts.append(" ")
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
            if stack:
                closing = SIBLINGS.get(name, CLOSED_BY_BLOCK)
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in closing:
                        close(depth)
                        break
                    if stack[depth][0] in SCOPES and stack[depth][0] not in closing:
                        break
        marks = " ".join(a or b or c for a, b, c in MARKS.findall(attributes)) if attributes else ""
        within, link = stack[-1][5:] if stack else (False, False)
        own_header = name == "header" and within
        noise = bool(marks) and any(map(NOISE.fullmatch, marks.split()))
        clean, inside = (not stack or stack[-1][2]) and (name not in LEFT_OUT or own_header), stack[-1][3] if stack else ()
        if name in CONTENT and clean and not noise and not within:
            wrappers = set(inside) if wrappers is None else wrappers & set(inside)
        if noise and name not in NEVER_NOISE and not own_header:
            inside, noisy = (*inside, noisy), noisy + 1
        doubtful = name not in NEVER_NOISE and (bool(stack) and stack[-1][4] or bool(marks) and any(map(DOUBTFUL.fullmatch, marks.split())))
        if not attributes.endswith("/"):
            stack.append((name, f"{name}.{marks}" if marks and name not in INLINE else name, clean, inside, doubtful, within or name in CONTENT, link or name == "a"))
    add(page[at:] if at < size else "")
    flush()
    return [
        Block(path, text, clean and all(x in (wrappers or ()) for x in noise), links, doubtful)
        for path, text, clean, noise, links, doubtful in waiting
    ]


def smoothed(values: np.ndarray) -> np.ndarray:
    """Values along the page, averaged with their neighbours by a Gaussian of width 1."""
    weights = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    padded = np.pad(values, 2, mode="edge")
    return np.convolve(padded, weights / weights.sum(), "valid")


def part_of(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path down to its content element."""
    for k, label in enumerate(path):
        if label.split(".")[0] in CONTENT:
            return path[: k + 1]
    return path


def main_text(page: str, threshold: float = 0.5) -> str:
    """The text of the blocks whose paths score at least ``threshold`` standard deviations, and what goes with them."""
    clean = [b for b in blocks(page) if b.clean]
    if not clean:
        return ""
    index = {p: k for k, p in enumerate(dict.fromkeys(b.path for b in clean))}
    which = np.array([index[b.path] for b in clean])
    nodes = np.bincount(which).astype(float)
    length = np.bincount(which, weights=[len(b.text) for b in clean])
    links = np.bincount(which, weights=[min(b.linked, len(b.text)) for b in clean])
    marks = np.bincount(which, weights=[len(PUNCTUATION.findall(b.text)) for b in clean])
    doubtful = np.bincount(which, weights=[b.doubtful for b in clean]) > 0
    heading = np.array([p[-1].split(".")[0] in HEADINGS if p else False for p in index])
    inside = np.array([any(x.split(".")[0] in CONTENT for x in p) for p in index])
    plain = length - links if (length > links).any() else length
    # Text outside links and punctuation per node of a path, each smoothed along the page and fused by their product.
    text_ratio, mark_ratio = smoothed((plain / nodes)[which]), smoothed((marks / nodes)[which])
    fused = np.bincount(which, weights=text_ratio * (1 + mark_ratio)) / nodes * np.log1p(plain) * np.where(doubtful, 0.5, 1)
    fused[heading] = 0
    if inside.any():
        fused[~inside] = 0
    limit = min(threshold * fused.std(), fused.max())
    taken = (fused >= limit) & (fused > 0)
    if not taken.any():
        taken = inside if inside.any() else heading
    # What may go with the taken paths: what stands in a content element with one of them, and on pages without such
    # elements what stands below the element that holds them all.
    if inside.any():
        parts = [part_of(p) for p in index]
        chosen = {parts[k] for k in np.flatnonzero(taken)}
        near = np.array([part in chosen for part in parts])
    else:
        shared = os.path.commonprefix([p[:-1] for p, k in index.items() if taken[k]])
        near = np.array([p[: len(shared)] == shared for p in index])
    # Headings, lists, quotations and tables go; lists of links and doubtful parts only where the text goes on after them.
    apart = (2 * links > length) | doubtful
    at = np.flatnonzero(taken[which])
    enclosed = (np.arange(len(which)) >= at[0]) & (np.arange(len(which)) <= at[-1]) if len(at) else np.zeros(len(which), bool)
    kept = taken[which] | near[which] & (~apart[which] | enclosed)
    return "\n".join(b.text for b, k in zip(clean, kept, strict=True) if k)


def extract(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [main_text(h or "", threshold) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
