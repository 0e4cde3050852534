"""Main text of web pages by two-pass block rules.

A page is read once by the standard HTML parser and cut into blocks (the text
between block-level tags).  Regions that are never article text (navigation,
headers, footers, sidebars, forms, adverts, notices, reader comments, scripts,
styles) are skipped by tag, role, class or id.  Pass one decides the other
blocks by link density, length and density of stop words; pass two lets
ambiguous blocks inherit the label of the nearest decided neighbours.  Where the
page marks its article, blocks outside it are not article text and undecided
ones inside it stay.

Runs in ``mapInArrow`` page by page: no shuffle, memory bound by one Arrow
batch.  Defined results: a null or empty page has the empty text; null ids and
urls are carried; repeated rows each get a row; an empty table gives an empty
result; pages of any length are read whole; other columns take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .quality_rules import ALL_STOP_WORDS, TRAIL

# HTML element names by role.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                 "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
                 "section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = set("aside audio button canvas datalist dialog embed footer head iframe input label map menu nav noembed "
                   "noframes noscript object optgroup option script select style svg template textarea title video".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark a region as no article text.
REGION_WORDS = set("ad ads advert advertisement advertising adverts alert announcement banner breadcrumb breadcrumbs "
                   "comment comments commentlist complementary consent contentinfo cookie cookies disclaimer discussion "
                   "disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice "
                   "notices notification outbrain pager pagination paywall popup promo promoted promotion recommended "
                   "related replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored "
                   "subscribe subscription taboola toolbar topbar trending widget widgets".split())
# Words that turn the one after them into a mere layout hint ("has-sidebar").
LAYOUT_WORDS = {"has", "no", "with", "without", "is", "not"}
# Words before "header" that make it the article's own.
ARTICLE_WORDS = {"article", "entry", "post", "story", "content", "page"}

_WORD = re.compile(r"[^\W_]+")
_STOP = frozenset(ALL_STOP_WORDS)
SHORT, LONG, MAX_LINKS, STOP_LOW, STOP_HIGH = 70, 140, 0.5, 0.12, 0.2


@dataclass
class Block:
    tag: str
    inside: bool  # of the marked article
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _is_region(attrs) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and value:
            for token in value.split():
                ws = [w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", token).replace("_", "-"))]
                for i, w in enumerate(ws):
                    before = ws[i - 1] if i else ""
                    if w in REGION_WORDS and before not in LAYOUT_WORDS and not (w == "header" and before in ARTICLE_WORDS):
                        return True
    return False


class _Page(HTMLParser):
    """Collects blocks; ``stack`` holds (tag, state before it was opened)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, tuple]] = []
        self.open: Counter[str] = Counter()    # of every tag on the stack
        self.around: list[str] = []            # the block tags on the stack
        self.skip = ""       # tag or "class" that hides what follows
        self.inside = False  # of article or main
        self.article = False
        self.link = 0
        self.now: Block | None = None

    def flush(self):
        if self.now and self.now.parts:
            self.blocks.append(self.now)
        self.now = None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "br":
            self.handle_data("\n")
        if tag in VOID_TAGS:
            return
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self._pop()
        self.stack.append((tag, (self.skip, self.inside, self.article, self.link)))
        self.open[tag] += 1
        if tag in BLOCK_TAGS:
            self.around.append(tag)
        if tag in ("article", "main"):
            if self.skip in ("class", "form"):
                self.skip = ""
            if not self.skip and (tag == "article" and self.article or tag == "article" and _is_region(attrs)):
                self.skip = "comment"
            self.inside, self.article = True, self.article or tag == "article"
        elif not self.skip:
            if tag in DROPPED_TAGS or tag == "header" and not self.inside:
                self.skip = tag
            elif tag == "form":
                self.skip = "form"
            elif attrs and tag not in ("html", "body") and (tag in BLOCK_TAGS - HEADINGS or not self.inside) and _is_region(attrs):
                self.skip = "class"
        if tag == "a":
            self.link += 1

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                if tag not in BLOCK_TAGS and self.stack[-1][0] in BLOCK_TAGS:
                    return  # an inline end tag closes no block
                self._pop()
            self._pop()

    def _pop(self):
        tag, state = self.stack.pop()
        self.skip, self.inside, self.article, self.link = state
        self.open[tag] -= 1
        if tag in BLOCK_TAGS:
            self.around.pop()

    def handle_data(self, data):
        if self.skip:
            return
        if self.now is None:
            if not data.strip():
                return
            self.now = Block(self.around[-1] if self.around else "body", self.inside)
        self.now.parts.append(data)
        if self.link:
            self.now.linked += len(data)


def _first_pass(b: Block, text: str) -> bool | None:
    """True: article text, False: not, None: ambiguous."""
    links = b.linked / max(1, sum(map(len, b.parts)))
    if b.tag in HEADINGS:
        return None
    if links > MAX_LINKS:
        return None if b.inside and b.tag == "p" else False
    if len(text) < SHORT:
        return None
    ws = text.lower().split()
    stop = sum(w.rstrip(TRAIL) in _STOP for w in ws) / len(ws)
    if stop >= STOP_HIGH or stop >= STOP_LOW and len(text) >= LONG:
        return True
    return None if b.inside or stop >= STOP_LOW else False


def main_text(html: str) -> str:
    """The article's blocks, one line each."""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    blocks = page.blocks
    if any(b.inside for b in blocks):
        blocks = [b for b in blocks if b.inside]
    texts = [b.text for b in blocks]
    blocks, texts = zip(*[(b, t) for b, t in zip(blocks, texts) if t]) if any(texts) else ((), ())
    first = [_first_pass(b, t) for b, t in zip(blocks, texts)]
    n = len(first)
    before, after = [None] * n, [None] * n  # nearest decided block on either side
    for i in range(1, n):
        before[i] = i - 1 if first[i - 1] is not None else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if first[i + 1] is not None else after[i + 1]
    keep = []
    for i, label in enumerate(first):
        if label is None:
            p, q = before[i], after[i]
            near = [j for j in (p, q) if j is not None]
            if not near:
                label = True
            elif blocks[i].tag in HEADINGS and q is not None:
                label = first[q]  # a heading goes with what follows it
            elif len({first[j] for j in near}) == 1:
                label = first[near[0]]
            else:
                label = first[p] if i - p < q - i else first[q] if q - i < i - p else True
        keep.append(label)
    return "\n".join(t for t, k in zip(texts, keep) if k)


def _extract(batches):
    for b in batches:
        text = [main_text(h.as_py() or "") for h in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
            names=[*b.schema.names[:2], "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars``, one row per page."""
    src = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    kinds = [f.dataType.simpleString() for f in src.schema]
    return map_arrow(src, _extract, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
