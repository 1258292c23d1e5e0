"""HTML extraction with two-pass block rules.

The page is cut into tokens by one scan (comments, tags, text), which needs no well-formed markup. Block tags end a
block; every block knows the containers it lies in. Pass 1 decides blocks alone, from stop-word density, length and link density:
blocks with mostly linked text are boilerplate; blocks that are long or rich in stop words are text; short blocks are left
undecided. What elements, classes and ids say is a feature beside these: containers named as menus, notices and the like
are boilerplate, and where the page's own article elements hold most of its long, dense text, blocks outside of them are. Pass 2
gives every undecided block the label of the nearest decided neighbour, counted in blocks; neighbours of its own container come
first, and at equal distance text wins. What is then left undecided in an article element is text.

Defined results: null or empty html gives an empty text; markup cut off at the end is read as far as it goes; an unclosed
tag at the very end is dropped; repeated rows give repeated rows; extra columns are ignored; nothing is cut or capped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arborspark.llm.common import arrow_rows

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Elements whose content is never text (fixed values).
SILENT = frozenset("script style noscript template svg math iframe object canvas select button textarea head title video audio".split())
#: Elements of which the content is boilerplate (fixed values).
AROUND = frozenset("nav header footer aside form menu dialog".split())
#: Elements that hold the article (fixed values).
ARTICLE = frozenset("article main".split())
#: Elements that end a block (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in class, id or role that name boilerplate (fixed values).
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|newsletter|subscribe"
    r"|signup|login|popup|modal|overlay|side-?bar|widget|menu|nav\w*|breadcrumbs?|pagination|pager|toolbar|masthead|site-?header|page-?header"
    r"|foot(?:er)?|site-?footer|copyright|disclaimer|comments?|comment-?list|disqus|respond|replies|reply|share|sharing|social|related|recommended|tags?"
    r"|hidden|skip-?link|contentinfo|complementary|navigation|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Class words that say what a page has, not what an element is, and names that an article element itself may be left out for (fixed values).
STATES = re.compile(r"\b(?:has|with|without|no|js|is)[-_][\w-]+")
NOT_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|ads?|advert\w*|sponsor\w*|promo\w*|related|recommended|teaser)(?:$|[\s_-])", re.IGNORECASE)
#: Common words of the languages at hand (fixed values).
STOP = frozenset(
    "the of and to in is that for it with as was on be by this are or from at not have an he she they which you we his her"
    " de la le et les des un une du en que qui dans pour pas sur au par est avec il elle ne se ce plus"
    " der die und das den von zu mit sich ist im dem nicht ein eine auf für als auch es an werden aus er hat dass"
    " el los del las por con para una su al lo como más pero sus o este sí porque".split()
)
MAX_LINK_DENSITY, STOP_DENSITY, SHORT, LONG = 0.5, 0.25, 25, 140

#: A quote opens an attribute's value right after ``=`` only.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<(?=/?[a-zA-Z!?])[^>]*\Z", re.DOTALL)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "linked", "around", "article", "container", "label")

    def __init__(self, text: str, linked: int, around: bool, article: bool, container: int):
        self.text, self.linked, self.around, self.article, self.container = text, linked, around, article, container
        self.label: bool | None = None


def boilerplate_name(attrs: str, names: re.Pattern = NAMES) -> bool:
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            if names.search(STATES.sub("", value)):
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked_parts: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, around, article, container
    n_open: Counter[str] = Counter()
    unclosed: set[str] = set()
    around, article, container, links, n_containers = False, False, 0, 0, 0

    def end_block() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, len(SPACE.sub(" ", "".join(linked_parts)).strip()), around, article, container))
            parts.clear()
            linked_parts.clear()

    def say(text: str) -> None:
        text = entities.unescape(text)  # a reference does not go on behind a tag
        parts.append(text)
        if links:
            linked_parts.append(text)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        tag, attrs = tag.lower(), m.group(3)
        if m.group(1):  # an end tag closes up to its own element, if that is open
            if tag in BLOCK:
                end_block()
            elif tag == "a":
                links = max(0, links - 1)
            if n_open[tag]:
                closed = ""
                while closed != tag:
                    closed = stack.pop()[0]
                    n_open[closed] -= 1
                _, around, article, container = stack[-1] if stack else ("", False, False, 0)
            continue
        if tag in SILENT:
            if not attrs.endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                if close is None:
                    unclosed.add(tag)  # nor will it be closed further on
                # an unclosed head or title must not swallow the page
                at = close.end() if close else (at if tag in ("head", "title", "object", "svg", "math", "select", "button") else end)
            continue
        if tag == "br" or tag == "img":
            parts.append(" ")
            continue
        if tag in BLOCK:
            end_block()
        elif tag == "a":
            links += 1
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in AROUND or tag in ARTICLE or (attrs and tag not in ("html", "body") and boilerplate_name(attrs)):
            end_block()
            n_containers += 1
            container = n_containers
            if tag in ARTICLE:
                around = around or boilerplate_name(attrs, NOT_ARTICLE)
                article = True
            else:
                around = around or not (tag == "header" and article)
            stack.append((tag, around, article, container))
            n_open[tag] += 1
        elif tag in BLOCK and tag != "p" and tag != "li":
            stack.append((tag, around, article, container))
            n_open[tag] += 1
    end_block()
    return out


def _telling(b: Block) -> bool:
    """Whether a block's length, links and stop words say that it is text."""
    words = b.text.split()
    dense = sum(w.strip(".,;:!?\"'()#*$%&|<>").lower() in STOP for w in words) / len(words)
    return len(b.text) >= LONG and (dense >= STOP_DENSITY / 2 or b.linked == 0) or len(b.text) >= SHORT and dense >= STOP_DENSITY


def classify(blocks: list[Block]) -> None:
    """Both passes; every block has a label then."""
    for b in blocks:
        b.label = False if b.around or b.linked > MAX_LINK_DENSITY * len(b.text) else True if _telling(b) else None
    text = [(len(b.text), b.article) for b in blocks if b.label]
    inside = sum(n for n, article in text if article)
    if inside * 2 >= sum(n for n, _ in text) and any(b.article and b.label is not False for b in blocks):
        for b in blocks:
            if not b.article:
                b.label = False
    first = [b.label for b in blocks]
    for pool in (True, False):  # neighbours in the same container first, then any
        last: dict = {}
        n = len(blocks)
        left: list[tuple[int, bool] | None] = [None] * n
        for direction in (range(n), range(n - 1, -1, -1)):
            last.clear()
            for i in direction:
                key = blocks[i].container if pool else 0
                if first[i] is not None:
                    last[key] = (i, first[i])
                elif blocks[i].label is None and key in last:
                    j, label = last[key]
                    if left[i] is None:
                        left[i] = (abs(i - j), label)
                    else:
                        d, other = left[i]
                        left[i] = min((d, other), (abs(i - j), label), key=lambda x: (x[0], not x[1]))
        for i in range(n):
            if blocks[i].label is None and left[i] is not None:
                blocks[i].label = left[i][1]
        if pool:
            for b in blocks:
                if b.label is None and b.article:
                    b.label = True
    for b in blocks:
        if b.label is None:
            b.label = True


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def make():
        def each(row: dict) -> Iterator[tuple]:
            text = extract(row["html"])
            yield row["page_id"], row["url"], text, len(text)

        return each

    return arrow_rows(pages.select("page_id", "url", "html"), SCHEMA, make, out_rows=2_000)
