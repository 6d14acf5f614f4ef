"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TEXT_BATCH_ROWS, only, rows_below

# Lines per window, and text a window needs before a page without marked-up content counts as having surged.
WINDOW, SURGE_CHARS = 3, 80
# A line of rights that is longer is text.
RIGHTS_CHARS = 100

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "tfoot thead tr ul".split()
)
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LOOSE = frozenset("p li dd dt tr td th option tbody thead tfoot colgroup".split())  # may lack an end tag
PLAIN = frozenset("html body".split())
SKIPPED = frozenset("nav header footer aside form menu head noscript template svg math canvas button select object dialog".split())
MARKED = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark what is not the article; the second list also as a prefix.
NOISE = frozenset(
    "ad ads adsense banner sidebar navigation nav navbar menu masthead header footer respond reply replies disqus consent notice notices alert "
    "popup modal overlay subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
    "pagination pager toolbar copyright disclaimer complementary contentinfo search skip teaser".split()
)
NOISE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "promo", "sidebar", "sponsor")
# Words for bars of links and fields; a part of marked content so called that holds a whole paragraph is no bar.
BARS = frozenset("social share sharing search skip pagination pager toolbar menu nav navbar navigation widget widgets".split())
UNLESS_AFTER = frozenset("has with no without".split())
# Reasons of skips whose text no reader sees; it is no text of the page.
UNSEEN = frozenset("hidden head noscript template svg math canvas object".split())
# Parts in which an article element is still not the article of the page.
CLOSED = ("comment", "respond", "repl", "disqus", "related", "recommend", "teaser", "aside", "footer")


def noise_word(attributes: str, spared: frozenset[str] = frozenset()) -> str:
    """The word of class, id or role that marks an element as noise and is not ``spared``, else an empty text."""
    for m in _NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = _SPLIT.split(name)
            for k, word in enumerate(words):
                if (word in NOISE or word.startswith(NOISE_STARTS)) and word not in spared and not (k and words[k - 1] in UNLESS_AFTER):
                    return word
    return "hidden" if is_hidden(attributes) else ""


def is_hidden(attributes: str) -> bool:
    """Whether an element has the attribute ``hidden``, is hidden from readers by ``aria-hidden``, or is not displayed by its style."""
    if "hidden" not in (lower := attributes.lower()) and "display" not in lower:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def strip_markup(html: str) -> list[tuple[str, int, bool]]:
    """Lines of a page in order: (text, characters outside of links, inside marked content).

    Every block is a line. Scripts, styles, comments, and elements that are noise by name or by class leave an empty line
    where they stood, so that the text around them stays apart. On a page without marked content, a class word under which
    most of the page's text outside of links stands (``widget`` on a page built of widgets) is no noise there; inside marked
    content, a word for bars of links is none if a block of ``SURGE_CHARS`` outside of links stands below it.
    """
    spared: frozenset[str] = frozenset()
    while True:
        lines, held, total, prose = _lines(html, spared)
        found = prose & BARS if any(inside for _, _, inside in lines) else {w for w, n in held.items() if 2 * n > total}
        if not found:
            return lines
        spared |= found


def _lines(html: str, spared: frozenset[str]) -> tuple[list[tuple[str, int, bool]], Counter[str], int, set[str]]:
    """Lines of a page; characters outside of links below each noise word that is not ``spared``, and in all; noise words inside
    marked content with a long block below them."""
    lines: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int]] = []  # (tag, 0 plain, 1 skipped, 2 marked content, 3 header in content: headings only)
    why: list[str] = []  # reason of each skip on the stack
    named: list[str] = []  # noise word of each skip, empty for one by tag
    held: Counter[str] = Counter()
    total = block = 0
    prose: set[str] = set()
    buffer: list[str] = []
    links: list[str] = []
    marked = headings_only = heading = in_link = 0
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal block
        if marked and block >= SURGE_CHARS:
            prose.update(named)
        block = 0
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                lines.append((text, max(0, len(text) - len(" ".join(unescape("".join(links)).split()))), marked > 0))
            buffer.clear()
            links.clear()

    def take(text: str) -> None:
        nonlocal total, block
        if not in_link and UNSEEN.isdisjoint(why):
            n = len(text.strip())
            total += n
            block += n
            for word in set(named):
                held[word] += n
        if not why and (not headings_only or heading):
            buffer.append(text)
            if in_link:
                links.append(text)

    def pop(to: int) -> None:
        nonlocal marked, headings_only
        while len(stack) > to:
            _, kind = stack.pop()
            if kind == 1:
                why.pop()
                named.pop()
                lines.append(("", 0, False))
            elif kind == 2:
                marked -= 1
            elif kind == 3:
                headings_only -= 1

    while at < size:
        m = _TAG.search(html, at)
        if not m:
            take(html[at:])
            break
        if m.start() > at:
            take(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCKS:
            flush()
            in_link = 0
        elif tag in ("br", "td", "th"):
            take(" ")
        if closing:
            if tag in HEADINGS:
                heading = 0
            elif tag == "a":
                in_link = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in HEADINGS:
            heading = 1
        elif tag == "a":
            in_link = 1
        if stack and stack[-1][0] in LOOSE and (tag == stack[-1][0] or stack[-1][0] == "p" and tag in BLOCKS):
            pop(len(stack) - 1)
        if tag == "body" and stack and stack[-1][0] == "head":
            pop(len(stack) - 1)
        word = "" if tag in PLAIN else noise_word(attributes, spared)
        kind = 0
        if tag in MARKED and not word:
            if why and not any(w.startswith(CLOSED) for w in why):
                pop(0)  # an open menu or banner that was never closed, or one that wraps the page
            kind = 0 if why else 2
        elif tag in ("header",) or word == "header":
            kind = 3 if marked else 1
        elif tag in SKIPPED or word:
            kind = 1
        if kind or tag in BLOCKS and tag not in LOOSE and tag not in HEADINGS:
            stack.append((tag, kind))
            if kind == 1:
                why.append(word or tag)
                named.append(word if word != "hidden" else "")
            marked += kind == 2
            headings_only += kind == 3
    flush()
    del held[""]
    return lines, held, total, prose


def keep_between(lines: list[tuple[str, int, bool]], window: int = WINDOW, surge: int = SURGE_CHARS) -> list[str]:
    """Lines between the points where the text of sliding windows surges and where it dives.

    A window's weight is the sum of its lines' characters outside of links, short copyright lines at the page's end aside;
    where a page marks its content, only those lines weigh, and any weight is a surge. A run begins with the first line that
    weighs of the first window that reaches ``surge`` (on a page that never does: of its largest) and ends with the last line
    that weighs before a window has nothing left; lines in between are kept whatever they weigh, if not outside of marked content.
    """
    content = any(inside for _, _, inside in lines)
    weights = [(len(t) if inside else 0) if content else free for t, free, inside in lines]
    for k in range(len(lines) - 1, -1, -1):
        if weights[k] and (content or len(lines[k][0]) > RIGHTS_CHARS or not _RIGHTS.match(lines[k][0])):
            break
        weights[k] = 0
    sums = [0, *accumulate(weights)]
    blocks = [sums[min(k + window, len(weights))] - sums[k] for k in range(len(weights))]
    if not blocks or not max(blocks):
        return []
    enough = 1 if content else min(surge, max(blocks))
    kept, light, inside, begun = [], [], False, False  # light: lines without weight since the last that weighs
    for (text, _, _), weight, block in zip(lines, weights, blocks, strict=True):
        inside = block > 0 and (inside or block >= enough)
        begun = inside and (begun or weight > 0)
        if not begun:
            light = []
        elif weight:
            kept += [*light, text]
            light = []
        elif text and not content:
            light.append(text)
    return kept


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE_CHARS) -> str:
    return "\n\n".join(keep_between(strip_markup(html), window, surge)) if html else ""


def extract_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: int = SURGE_CHARS
) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``.

    Markup is stripped to lines, and the lines between surge and dive of the windowed text lengths are kept, joined by
    an empty line. The whole page is read; one row in, one row out, no shuffle, small batches.

    A null or empty page, or one without content, gives an empty text. Unclosed elements end with their parent; repeated
    rows are extracted each; an empty table gives an empty result; other columns are not carried along.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_below(batches, TEXT_BATCH_ROWS):
            texts = [main_text(html.as_py(), window, surge) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return only(df, page_id=f"{id_col}:long", url=f"{url_col}:string", html=f"{html_col}:string").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long"
    )
