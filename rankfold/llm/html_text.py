"""Main text of web pages: flat text blocks, classified by a small decision tree."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .words import slices

MAIN, CHROME, LASTING, FORM, DROP = 1, 2, 4, 8, 16
TREE_DEPTH = 8
NAMES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "main", "chrome", "form", "heading", "page_has_main",
)

# Element names of HTML and the words by which pages name their parts.
BREAKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head svg math template object canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = frozenset("p li dd dt td th tr option".split())
CHROME_NAMES = frozenset("nav menu header noscript dialog".split())
LASTING_NAMES = frozenset("aside footer".split())
FORM_NAMES = frozenset("form fieldset button search".split())
MAIN_WORDS = frozenset("article articlebody articletext main content maincontent story storybody post postbody entry".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager header masthead banner"
    " cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription paywall disclaimer"
    " ad ads advert adverts advertisement advertising sponsor sponsored promo promotion share sharing social login signin signup".split()
)
LASTING_WORDS = frozenset(
    "sidebar aside widget widgets related recommended recommendations trending footer copyright complementary contentinfo"
    " comment comments discussion disqus reply replies respond".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_HIDDEN = re.compile(r"display\s*+:\s*+none", re.I)
_ABSENT = re.compile(r"\b(?:has|with|no|without)[-_ ]?+\w++", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    context: int
    heading: bool


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Index of the ``>`` that ends the tag at ``at``, or of the page's end; quoted values may hold one.

    A quote without a partner is an ordinary character. ``missing`` remembers quotes that
    the rest of the page lacks, so a page is scanned a bounded number of times.
    """
    while found := _STOP.search(page, at):
        mark, at = found.group(), found.end()
        if mark == ">":
            return at - 1
        if mark not in missing and page[at - 2] in "= \t\n\r\f":
            close = page.find(mark, at)
            if close < 0:
                missing.add(mark)
            else:
                at = close + 1
    return len(page)


def _context(name: str, attributes: str, outer: int) -> int:
    """What an element's text is part of: its own name and labels within those of ``outer``."""
    own = MAIN if name in ("article", "main") else 0
    if name in DROPPED:
        own |= DROP
    if name in CHROME_NAMES and not (name == "header" and outer & MAIN):
        own |= CHROME
    if name in LASTING_NAMES:
        own |= LASTING
    if name in FORM_NAMES:
        own |= FORM
    labels = set()
    if attributes and name not in ("html", "body"):
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
                own |= DROP
            elif key in ("class", "id", "role", "itemprop"):
                value = _ABSENT.sub(" ", value)
                labels.update(re.split(r"[^a-z0-9]+", value.lower()), re.split(r"[^a-z0-9]+", _CAMEL.sub(" ", value).lower()))
    if labels & LASTING_WORDS:
        own |= LASTING
    elif labels & CHROME_WORDS and name not in ("article", "main"):
        own |= CHROME
    elif labels & MAIN_WORDS:
        own |= MAIN
    if own & MAIN and not own & LASTING and name in ("article", "main"):
        outer &= ~(CHROME | FORM)  # a container that was never closed, or one around the whole page
    return outer | own


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order, with what they are part of; scripts, styles and the like have none.

    Block-level tags separate blocks, other tags are dropped. Comments, declarations and
    raw text elements end where HTML ends them, at the latest with the page. Character
    references are decoded, white space runs become one space. Elements may be left open
    or closed out of order. Every character is looked at a bounded number of times.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    missing: set[str] = set()
    context, heading, link = 0, False, False
    text: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        whole = " ".join("".join(text).split())
        if whole and not context & DROP:
            out.append(Block(whole, whole.count(" ") + 1, len("".join(linked).split()), context, heading))
        text.clear()
        linked.clear()

    def add(piece: str) -> None:
        if context & DROP:
            return
        piece = entities.unescape(piece)
        text.append(piece)
        linked.append(piece if link else " ")

    def close() -> None:
        nonlocal context
        name, context = stack.pop()
        opened[name] -= 1

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            add(page[at:])
            break
        follow = page[mark + 1 : mark + 2]
        ending = follow == "/" and page[mark + 2 : mark + 3].isascii() and page[mark + 2 : mark + 3].isalpha()
        if not (follow in ("!", "?", "/") or (follow.isascii() and follow.isalpha())):
            add(page[at : mark + 1])
            at = mark + 1
            continue
        if mark > at:
            add(page[at:mark])
        if page.startswith("<!--", mark):
            short = page.startswith((">", "->"), mark + 4)
            end = page.find(">", mark + 4) if short else page.find("-->", mark + 4)
            at = size if end < 0 else end + (1 if short else 3)
            continue
        if follow in ("!", "?") or (follow == "/" and not ending):
            end = page.find(">", mark + 1)
            at = size if end < 0 else end + 1
            continue
        word = _NAME.match(page, mark + 1 + ending)
        name, end = word.group().lower(), _tag_end(page, word.end(), missing)
        attributes, at = page[word.end() : end], end + 1
        if end == size:
            break  # a tag that the page's end cuts is no text
        if not ending and name in RAW:
            stop = _RAW_END[name].search(page, at)
            at = size if stop is None else _tag_end(page, stop.end(), missing) + 1
            if name == "textarea" or name == "iframe":
                flush()
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            link = not ending
            continue
        if name not in BREAKS and name not in DROPPED:
            continue
        flush()
        heading = not ending and name in HEADINGS
        if name not in SELF_CLOSING:
            link = False
        if ending:
            if opened[name]:
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if name in VOID or (attributes.endswith("/") and name in DROPPED):
            continue
        if name == "body":
            while stack:
                close()
        while stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in SELF_CLOSING)):
            close()
        stack.append((name, context))
        opened[name] += 1
        context = _context(name, attributes, context)
    flush()
    return out


def features(pages: list[list[Block]]) -> np.ndarray:
    """One row of NAMES per block of the pages; words of a missing neighbour are 0, its link density is 0."""
    rows = [block for page in pages for block in page]
    sizes = np.array([len(page) for page in pages], dtype=np.int64)
    page = np.repeat(np.arange(len(pages)), sizes)
    joined = page[1:] == page[:-1]
    words = np.array([b.words for b in rows], dtype=np.float64)
    density = np.array([min(b.linked, b.words) / b.words for b in rows], dtype=np.float64)
    context = np.array([b.context for b in rows], dtype=np.int64)
    heading = np.array([b.heading for b in rows], dtype=np.float64)
    out = np.zeros((len(rows), len(NAMES)))
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1] * joined, density[:-1] * joined
    out[:-1, 4], out[:-1, 5] = words[1:] * joined, density[1:] * joined
    out[:, 6] = (context & (MAIN | CHROME | LASTING | FORM)) == MAIN
    out[:, 7] = (context & (CHROME | LASTING)) > 0
    out[:, 8] = (context & FORM) > 0
    out[:, 9] = heading
    out[:, 10] = np.bincount(page, out[:, 6], len(pages))[page] > 0
    return out


# The labelled table: pages as runs of blocks. A block is part, words, linked words; capital parts are main text.
LABELLED = (
    "nav 1 1; nav 1 1; nav 2 2; ad 6 0; MAIN-H 9 0; MAIN 30 0; MAIN 64 0; MAIN 1 0; MAIN 3 0; MAIN 120 2; foot 12 0",
    "nav 1 1; ad 12 0; MAIN-H 1 0; MAIN 1 0; foot 4 0",
    "head 4 0; nav 2 2; MAIN-H 6 0; MAIN 4 4; MAIN 80 8; notice 25 1; MAIN 45 0; comment 60 0; comment 3 0; foot 30 4",
    "notice 40 2; nav 1 1; MAIN-H 4 0; MAIN 15 0; ad 20 20; MAIN 200 0; side 5 5; side 40 0; form 3 0; form 14 0; foot 5 1",
    "head 2 2; MAIN 7 0; MAIN 2 0; MAIN 90 1; main 2 2; main 3 3; main 2 2; foot 60 0",
    "body 3 3; body 2 0; MAIN 40 0; MAIN-H 3 0; MAIN 8 0; comment 30 0; MAIN 25 0; body 7 0; foot 9 2",
    "plain 1 1; plain 2 2; plain 1 1; PLAIN-H 8 0; PLAIN 45 1; PLAIN 70 0; PLAIN 5 0; PLAIN 38 3; plain 3 3; plain 4 4; plain 5 0",
    "plain 2 2; plain 3 0; plain 1 1; PLAIN-H 5 0; PLAIN 25 0; PLAIN 12 0; PLAIN 33 0; plain 9 6; plain 2 2",
    "head 3 0; nav 1 1; nav 3 3; PLAIN-H 7 0; PLAIN 18 0; PLAIN 9 0; PLAIN 60 5; PLAIN 2 0; PLAIN 31 0; side 30 0; foot 14 0",
    "notice 18 0; plain 1 1; plain 1 1; PLAIN 150 0; PLAIN 16 0; PLAIN 80 10; comment 50 0; comment 22 0; foot 8 0; plain 4 0",
    "plain 1 1; plain 1 1; form 2 0; form 20 0; PLAIN-H 6 0; PLAIN 55 0; PLAIN 41 0; form 5 0; plain 6 6; plain 3 3; foot 40 0",
    "FORM-H 6 0; FORM 60 0; FORM 90 2; FORM 75 0; form 2 0; form 1 0; form 12 0; form 2 2",
    "plain 2 2; plain 12 12; plain 14 14; plain 11 11; plain 1 0; PLAIN 20 2; PLAIN 50 0; PLAIN 35 1; plain 15 15; plain 13 13",
    "nav 8 8; head 12 0; MAIN 3 0; MAIN 11 1; MAIN 1 1; MAIN 10 0; side 9 0; foot 22 0",
    "plain 1 0; plain 2 2; plain 1 1; PLAIN 28 0; PLAIN 22 0; PLAIN 7 0; PLAIN 90 0; plain 1 1; plain 1 1; plain 6 0",
    "MAIN 5 0",
    "MAIN-H 3 0; MAIN 1 0; MAIN 2 0",
    "nav 1 1; nav 2 2; MAIN 3 0",
    "MAIN 2 0; nav 2 2; nav 1 1",
    "nav 3 3; MAIN 1 0; ad 8 8; MAIN 2 1; side 4 4; MAIN 4 0; nav 3 3",
    "MAIN 6 2; MAIN 2 1; MAIN 14 5; MAIN 30 12; MAIN 1 0",
    "side 90 0; MAIN-H 2 0; MAIN 7 0; comment 120 3",
    "MAIN-H 5 0; main 2 2; main 3 3; main 2 2; MAIN 4 0; MAIN 70 0; MAIN 6 6; MAIN 50 0; side 3 3",
    "MAIN 60 0; MAIN 5 5; foot 12 0",
    "PLAIN 60 0",
    "PLAIN 4 0",
    "PLAIN 1 0",
    "PLAIN 30 0; PLAIN 4 0; PLAIN 50 0",
    "form 30 0; MAIN 5 0; form 9 0; form 45 0; MAIN 3 0",
)
_PARTS = {
    "main": MAIN, "plain": 0, "body": 0, "nav": CHROME, "head": CHROME, "ad": CHROME, "notice": CHROME,
    "side": LASTING, "comment": LASTING, "foot": LASTING, "form": FORM,
}


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the blocks of LABELLED."""
    pages, labels = [], []
    for page in LABELLED:
        own = []
        for entry in page.split("; "):
            part, words, linked = entry.split()
            name, _, heading = part.partition("-")
            own.append(Block("", int(words), int(linked), _PARTS[name.lower()], bool(heading)))
            labels.append(int(name.isupper()))
        pages.append(own)
    return features(pages), np.array(labels)


class Tree(NamedTuple):
    """Nodes of a decision tree; a leaf has feature -1. Values up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        for _ in range(TREE_DEPTH):
            inner = self.feature[at] >= 0
            low = rows[np.arange(len(rows)), np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
        return self.label[at]


def _best_split(rows: np.ndarray, labels: np.ndarray) -> tuple[float, int, float]:
    """(impurity left, feature, threshold) of the split with the least Gini impurity; of equal ones the last feature.

    What a block is part of comes last in NAMES, so it wins over an equally good count of words.
    """
    best = (float("inf"), -1, 0.0)
    for j in range(rows.shape[1]):
        order = np.argsort(rows[:, j], kind="stable")
        values, hits = rows[order, j], np.cumsum(labels[order])
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        n, total = cuts + 1.0, len(labels)
        left, right = hits[cuts], hits[-1] - hits[cuts]
        impurity = left * (1 - left / n) + right * (1 - right / (total - n))
        i = int(np.argmin(impurity))
        if impurity[i] <= best[0] + 1e-12:
            best = (float(impurity[i]), j, float((values[cuts[i]] + values[cuts[i] + 1]) / 2))
    return best


def train(rows: np.ndarray, labels: np.ndarray, depth: int = TREE_DEPTH) -> Tree:
    """A decision tree of at most ``depth`` splits by Gini impurity, grown until leaves are pure."""
    nodes: list[list] = []

    def grow(part: np.ndarray, left: int) -> int:
        own = len(nodes)
        share = labels[part].mean() if len(part) else 0.0
        nodes.append([-1, 0.0, -1, -1, int(share >= 0.5)])
        if left and 0.0 < share < 1.0:
            _, feature, threshold = _best_split(rows[part], labels[part])
            if feature >= 0:
                low = rows[part, feature] <= threshold
                nodes[own][:4] = [feature, threshold, grow(part[low], left - 1), grow(part[~low], left - 1)]
        return own

    grow(np.arange(len(labels)), depth)
    return Tree(*[np.array(column) for column in zip(*nodes)])


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    found = [blocks(page) for page in pages]
    if not any(found):
        return [""] * len(pages)
    chosen = iter(tree.predict(features(found)).tolist())
    return ["\n".join([block.text for block in page if next(chosen)]) for page in found]


def extractor(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__html"):
                texts = main_texts(batch.column(batch.num_columns - 1).to_pylist(), tree)
                added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """The columns of ``pages`` but html, with text, the page's main text, and n_chars, its code points.

    Blocks are judged by their words and link density, those of the blocks before and
    after, and the parts of the page they lie in, by a tree trained on LABELLED or the
    given one. All blocks judged main text are joined by newlines in page order, whole.
    White space is what Unicode counts as such, no-break spaces included.

    A null or empty html, or one without text, gives an empty text. Repeated rows and null
    ids are rows like others, an empty table gives no rows. Pages of any length are read
    in one pass. Columns named text or n_chars give way to the new ones.
    """
    tree = tree or train(*labelled())
    keep = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    own = pages.select(*[F.col(f"`{c}`") for c in keep], F.col("html").cast("string").alias("__html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema[: len(keep)])
    return own.mapInArrow(extractor(tree), f"{schema}text string, n_chars long")


@query()
def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
