"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  The first pass classifies each
block on its own: by the region it stands in (menus, headers, footers, sidebars,
forms, notices, adverts and comments are never main text; an article is), by link
density, length and stop-word density.  Blocks too short to tell stay undecided;
in the second pass each takes the label of its nearest decided neighbours.

One linear scan of the tags; a malformed page gives what can be read of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?[A-Za-z][A-Za-z0-9:-]*)[^>]*>?", re.S)
_ATTR = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

# Element names of HTML.
RAW = frozenset("script style noscript template textarea iframe svg math canvas object select head title".split())
LITERAL = frozenset("script style textarea title iframe".split())  # whose content is not markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("nav footer aside form menu dialog button".split())
INSIDE = frozenset("article main".split())
# Words of class, id and role names that mark what is not main text.
MARKS = frozenset(
    "ad ads advert advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget footer masthead toolbar share sharing social related recommended recommendations comment comments disqus respond replies reply discussion search login skip hidden".split()
)
# Those of them that an article's own parts may be named by (search results, a discussion, notices): inside an article they count as a whole name only.
WEAK = frozenset("search discussion menu notice notices banner widget social skip login reply replies respond hidden overlay modal share sharing signup related navigation pager toolbar".split())
# Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber "
    "le la les de des du un une et est en que qui dans pour pas sur au par plus avec ne se ce il sont ou son mais nous vous cette elle leur être ont aux "
    "el los las y que del se por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue".split()
)

LINKS = 0.5
SHORT = 70
LONG = 200
STOP_LOW, STOP_HIGH = 0.15, 0.3


@dataclass
class Block:
    """A block's text (white space made one space), the share of it in links, and its region."""

    text: str
    links: float
    region: int  # 1 in an article, -1 in what is never main text, 0 elsewhere
    heading: bool


def _outside(name: str, attrs: str, in_article: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not in_article):
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if key in ("class", "id", "role", "data-role") and name not in ("html", "body", "article", "main"):
            if not (MARKS - WEAK if in_article else MARKS).isdisjoint(re.split(r"[^a-z]+", value)) or not WEAK.isdisjoint(value.split()):
                return True
            if value in ("complementary", "contentinfo", "search", "alert", "alertdialog"):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, and the region they make
    region, link, parts, linked, heading = 0, 0, [], 0, False
    at, n = 0, len(page)
    unclosed: set[str] = set()  # names that no end tag follows any more

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            parts.append(piece)
            if link:
                linked += len(piece.strip())

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            whole = _SPACE.sub(" ", "".join(parts)).strip()
            if whole:
                out.append(Block(whole, min(1.0, linked / len(whole)), region, heading))
        parts, linked = [], 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        name = m[1] or m[3]
        if not name:
            continue
        closing = m[0][1] == "/"
        name = name.lstrip("/").lower()
        if name in RAW:
            if closing:
                continue
            if name in LITERAL or name not in ("head",):
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end is None:
                    unclosed.add(name)
                flush() if name not in ("svg", "math") else None
                at = end.end() if end else (n if name in LITERAL else at)
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        attrs = m[2] or ""
        is_block = name in BLOCK
        if is_block:
            flush()
            if name[0] == "h" and name[1:].isdigit():
                heading = not closing
            elif name in ("p", "div", "li", "td"):
                heading = False
        if name in VOID or attrs.endswith("/"):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    region = stack[-1][1] if stack else 0
                    break
        elif is_block or name in OUTSIDE or name in ("span", "ins", "section"):
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()  # a paragraph ends where the next begins
                region = stack[-1][1] if stack else 0
            if region >= 0:
                before = region
                if _outside(name, attrs, region == 1):
                    new = -1
                else:
                    new = 1 if name in INSIDE else region
                if new != before and not is_block:
                    flush()
                region = new
            stack.append((name, region))
    flush()
    return out


def stop_share(text: str) -> float:
    """The share of a block's words that are stop words."""
    words = text.split()
    return sum(w.strip(".,;:!?()\"'").lower() in STOP for w in words) / len(words)


def first_pass(b: Block, telling: bool = True) -> int:
    """1 main text, -1 not, 0 undecided: short, mostly links inside an article, or of middling stop-word density.

    ``telling`` is whether stop words say anything on this page: where no block has enough of them, in
    languages that the list lacks, long blocks count by length and links alone.
    """
    if b.region < 0:
        return -1
    stops = stop_share(b.text)
    if b.region > 0:  # an article's blocks are never rejected, only left to their neighbours in it
        return 1 if b.links <= LINKS and (len(b.text) >= SHORT or stops >= STOP_LOW) else 0
    if b.links > LINKS:
        return -1
    if not telling and len(b.text) >= SHORT and not b.heading:
        return 1 if b.links <= LINKS / 2 else 0
    if len(b.text) < SHORT or b.heading:
        return -1 if b.links > LINKS / 2 else 0
    if stops >= STOP_HIGH:
        return 1 if len(b.text) >= LONG or b.links < 0.1 else 0
    if stops >= STOP_LOW:
        return 1 if len(b.text) >= LONG else 0
    return -1


def second_pass(labels: list[int], fallback: int = -1) -> list[int]:
    """Undecided blocks take the label of the nearest decided neighbour; between two as near, main text only if both say so."""
    n = len(labels)
    left, right = [(0, n + 1)] * n, [(0, n + 1)] * n
    for order, side, step in ((range(n), left, -1), (range(n - 1, -1, -1), right, 1)):
        for k in order:
            other = k + step
            if 0 <= other < n:
                side[k] = (labels[other], 1) if labels[other] else (side[other][0], side[other][1] + 1)
    out = []
    for k, label in enumerate(labels):
        if label:
            out.append(label)
            continue
        (a, da), (b, db) = left[k], right[k]
        near = a if not b or (a and da < db) else b if not a or db < da else min(a, b)
        out.append(near or fallback)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by one space; empty for a null, empty or all-boilerplate page.

    A page of which the first pass decides nothing (all blocks short) is all main text
    but for its links: nothing speaks against it.  Blocks inside an article look at neighbours
    inside it alone, whatever stands beside the article.
    """
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, k in zip(found, labelled(found), strict=True) if k > 0)


def labelled(found: list[Block]) -> list[int]:
    """Both passes over a page's blocks: 1 main text, -1 not."""
    telling = any(b.region >= 0 and stop_share(b.text) >= STOP_HIGH for b in found)
    labels = [first_pass(b, telling) for b in found]
    inside = [k for k, b in enumerate(found) if b.region > 0]
    for k, label in zip(inside, second_pass([labels[k] for k in inside], 1), strict=True):
        labels[k] = label
    return second_pass(labels, 1 if 1 not in labels and -1 not in labels else -1)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` for every row, from the whole page.

    Null and empty pages give an empty text and 0; repeated rows stay; null ids and
    urls pass through; extra columns are ignored; an empty table gives an empty table.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
