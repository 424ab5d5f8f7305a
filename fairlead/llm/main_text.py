"""Main text of web pages by two passes of block rules.

A page is read once into blocks: runs of text between block-level tags, each with its length, the share of it inside links,
its share of stop words, the kind of element and the part of the page it stands in. The first pass decides a block from its
part of the page (menus, headers, footers, sidebars, notices, adverts, forms, reader comments), link density, stop-word density
and length. Short blocks stay undecided; in the second pass they take the label of the nearest decided neighbours, within the
article where the page has one. Inside an article, links make a block a menu only in a list.

Null and empty pages give an empty text. Broken markup is read as far as it goes: unclosed elements end with the page, stray
end tags and unfinished tags are ignored. Time and memory are linear in the page. Equal rows stay equal rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the rules.
#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template textarea title svg math iframe object canvas audio video map applet noframes xmp".split())
#: Elements that are a part of the page other than the article.
APART = frozenset("nav footer header aside form menu dialog select button fieldset datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that name a part of the page other than the article.
APART_WORDS = re.compile(
    r"(ad|ads|adbox|adslot|advert\w*|adsense|sponsor\w*|promo\w*|banner|navigation|nav|navbar|menu|menubar|breadcrumbs?|sidebar|aside|widget|footer|header|masthead|toolbar|cookies?|consent|gdpr|notice|notification|alert|newsletter|subscribe|subscription|signup|signin|login|popup|modal|overlay|share|sharing|social|related|recommended|recommendations|comments?|commentlist|replies|respond|disqus|discussion|pagination|pager|search|contentinfo|complementary|hidden)"
)
#: Compound names of wrappers around content and a part beside it, such as content-sidebar-wrap and has-sidebar.
LAYOUT = re.compile(rf"(?:[a-z]+[^a-z]+)*?(?:(?:has|with|without|no)[^a-z]+{APART_WORDS.pattern}(?:[^a-z].*)?|(?:content|main|page|site|layout|primary|article|body)[^a-z]+{APART_WORDS.pattern}[^a-z]+(?:wrap\w*|container|layout|grid|row|inner|outer))")
#: Why a block stands apart: a form, which an article or main part inside ends; a name, which a main part inside ends; for good.
FORM, NAMED, HARD = 1, 2, 3
STOP_WORDS = frozenset(
    "the and of to in a is it that was for on with as be at by this are or from an not have but they you his her der die das und in von zu mit den dem ist nicht ein eine auf für im des als auch sich le la les de des et un une est en que qui dans pour pas sur au par avec ce il el los las y del por con para una no lo se su".split()
)
#: Lengths (characters) of short and long blocks, stop-word densities, and the link density of a menu.
SHORT, LONG, FEW_STOPS, MANY_STOPS, LINKED = 70, 140, 0.1, 0.25, 0.5

#: Longer names (characters) of a class are not looked at as names of wrappers.
LONG_NAME = 100

#: Comments and declarations, which the page may end; after the page's last ``>`` there are no tags beside them.
_REMARK = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
_REMARKS, _STARTS = re.compile(_REMARK, re.S), re.compile(_REMARK + r"|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOPS = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    apart: bool
    article: bool
    heading: bool
    listed: bool = False
    good: bool | None = None


def _stands_apart(name: str, attributes: str) -> int:
    if name in APART and name != "form":
        return HARD
    found = FORM if name == "form" else 0
    for key, *values in _NAMED.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HARD
        if key in ("class", "id", "role"):
            words = {w for w in re.split(r"[^a-z]+", value) if APART_WORDS.fullmatch(w)}
            if words and any(words & set(re.split(r"[^a-z]+", v)) and not (len(v) <= LONG_NAME and LAYOUT.fullmatch(v)) for v in value.split()):
                found = max(found, HARD if key == "role" or "hidden" in words else NAMED)
    return found


def _end_of_tag(page: str, at: int, open_ended: set[int]) -> int:
    """Place of the ``>`` that ends the tag whose name ends at ``at``: the first outside quotes, or the first of all where a quote stays open.

    ``open_ended`` remembers the quotes from which no end was found. A quote is opened once in vain at most, so all calls for a
    page together take time linear in it.
    """
    tried, here = [], at
    while stop := _STOPS.search(page, here):
        if stop[0] == ">":
            return stop.start()
        if stop.start() in open_ended:
            break
        tried.append(stop.start())
        here = page.find(stop[0], stop.end()) + 1
        if not here:
            break
    open_ended.update(tried)
    return page.find(">", at)


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order. One pass over its tags with a stack of the open elements."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # name, why it stands apart, in an article
    around: list[int] = []  # places of block elements in the stack
    depth: dict[str, int] = {}
    parts: list[str] = []
    linked = links = at = beside = 0
    open_ended: set[int] = set()
    titles = True

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            top = stack[-1] if stack else ("", 0, False)
            heading = any(depth.get(h) for h in HEADINGS)
            listed = any(depth.get(e) for e in ("ul", "ol", "dl"))
            out.append(Block(text, linked, bool(top[1]) and not (heading and top[2] and not beside), top[2], heading, listed))
        parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal beside
        while len(stack) > to:
            name, apart, _ = stack.pop()
            depth[name] -= 1
            beside -= bool(apart) and name != "header"
        while around and around[-1] >= to:
            around.pop()

    end, last = len(page), page.rfind(">")
    while at < end:
        tag = (_STARTS if at <= last else _REMARKS).search(page, at)
        if tag and tag.start() > last:
            tag = _REMARKS.search(page, at)
        piece = page[at : tag.start() if tag else end]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if not tag:
            break
        at = tag.end()
        if tag.re is _REMARKS or not tag[2]:
            continue
        name, closing = tag[2].lower(), tag[1]
        stop = _end_of_tag(page, at, open_ended)
        attributes, at = page[at:stop], stop + 1
        if name in SKIPPED:
            if not closing and not attributes.rstrip().endswith("/") and (titles or name != "title"):
                shut = re.compile(rf"</{name}\b", re.I).search(page, at)
                stop = page.find(">", shut.end()) if shut else -1
                if stop >= 0:
                    at = stop + 1
                elif name == "title":
                    titles = False  # none of the page's other titles ends either
                else:
                    at = end
            continue
        if name in BLOCKS or name == "hr":
            flush()
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if closing:
            if depth.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if bool(stack[k][1]) != bool(k and stack[k - 1][1]):
                    flush()
                close(k)
                links = depth.get("a", 0)
            continue
        if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option") or name in HEADINGS:
            if around and stack[around[-1]][0] in (name, "p"):  # an open paragraph, item or cell ends where the next one begins
                close(around[-1])
                links = depth.get("a", 0)
        above = stack[-1] if stack else ("", 0, False)
        main = name == "main" or 'role="main"' in attributes
        apart = _stands_apart(name, attributes) if name not in ("html", "body", "article", "main") else 0
        if above[1] > (NAMED if main else FORM if name == "article" else 0):
            apart = max(apart, above[1])
        if bool(apart) != bool(above[1]):
            flush()
        if name in BLOCKS:
            around.append(len(stack))
        stack.append((name, apart, above[2] or main or name == "article"))
        beside += bool(apart) and name != "header"
        depth[name] = depth.get(name, 0) + 1
        links = depth.get("a", 0)
    flush()
    return out


def classify(blocks: list[Block]) -> list[Block]:
    """Both passes; sets ``good`` of every block."""
    for b in blocks:
        words = _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if b.apart or b.linked > LINKED * len(b.text) and (b.listed or not b.article):
            b.good = False
        elif b.article and (b.heading or len(b.text) >= SHORT or stops >= MANY_STOPS):
            b.good = True
        elif len(b.text) >= LONG and stops >= FEW_STOPS or len(b.text) >= SHORT and stops >= MANY_STOPS:
            b.good = True
        elif len(b.text) >= LONG and not b.heading:
            b.good = b.article or stops >= FEW_STOPS / 2
    article = any(b.article and not b.apart for b in blocks)
    region = [b for b in blocks if not b.apart and (b.article or not article)]  # what stands apart is no neighbour
    members = {id(b) for b in region}
    near: dict[int, list[tuple[int, bool]]] = {}
    for order in (range(len(region)), range(len(region) - 1, -1, -1)):
        last: tuple[int, bool] | None = None
        for i in order:
            if region[i].good is not None:
                last = (i, region[i].good)
            elif last:
                near.setdefault(i, []).append((abs(i - last[0]), last[1]))
    settled = [(b, near.get(i, [])) for i, b in enumerate(region) if b.good is None]
    for b, seen in settled:
        labels = {good for _, good in seen}
        if not seen or len(labels) == 1 and (True in labels or b.article):
            b.good = True  # nothing else is decided, or an article's own short line
        elif len(labels) == 1:
            b.good = False
        else:
            seen.sort()
            b.good = seen[0][1] if seen[0][0] < seen[1][0] else b.article or b.heading
    for b in blocks:
        if id(b) not in members and b.good is None or article and not b.article:
            b.good = False
    return blocks


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks_of(page or "")) if b.good)


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text string``, map-only."""
    source = pages.select(*keep, pages[html_column].alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", text string"

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py()) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(body, schema)
