"""Main text of web pages by two passes of block rules.

A page is read once into blocks: text between block-level tags, with the
characters in links counted, and with the kinds of container around it. The
first pass classifies each block by its stop-word density, length and link
density. Containers are evidence: inside an ``article`` or ``main`` element, or one
whose class or id has the words of an article, half the stop words are enough
and headings count; elsewhere the full thresholds hold. Only containers that are
never content (navigation, adverts, reader comments, hidden ones ...) decide at
once, by whole names in class, id or role, not by parts of them (``tag-spark``,
``has-sidebar`` and ``nav-open`` say nothing). Of these the uncertain ones (forms,
notices, menus by name) don't hold against an ``article`` inside them, nor where
no other block of the page is good: then the density rules decide inside them
too. The second pass gives blocks that stayed open (short ones, and ones without
stop words) the label of their nearest decided neighbours; outside the page's
article only text outside vouches for a block.

Stop words are learned from the pages themselves: the ``STOP_WORDS`` commonest
words of all visible text, counted in Spark, so no language list is needed.

Defined results: null and empty pages have empty text; comments, scripts,
styles, markup and the page's head never give text; a tag cut off at the page's
end is no text; unclosed elements end where their parent does; extra columns
are ignored; repeated rows each give a row.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOP_WORDS = 300
#: Longer words are not counted as stop words.
LONGEST_STOP_WORD = 12
#: First-pass thresholds.
MAX_LINK_DENSITY = 0.33
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30

# Element names of the HTML standard.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video head select button".split())
_UNSEEN = frozenset("script style noscript template".split())
_NEVER = frozenset("nav footer aside menu dialog".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# Words in class, id or role that mark a container as no content.
_CERTAIN = re.compile(
    r"ads?|adsby\w*|advert\w*|adsense|breadcrumb\w*|comment\w*|consent|cookie\w*|copyright|disqus\w*|footer\w*|gdpr|hidden|modal|"
    r"newsletter\w*|overlay|popup\w*|repl(?:y|ies)|respond|signup|sponsor\w*|subscri\w*")
_UNCERTAIN = re.compile(
    r"announcement\w*|banner\w*|complementary|contentinfo|disclaimer\w*|foot|legal|login\w*|masthead\w*|menu\w*|nav\w*|notices?|"
    r"notification\w*|pager|pagination|promo\w*|recommend\w*|related\w*|search|shar(?:e|ing)\w*|sidebar\w*|skip|social\w*|tags?|"
    r"toolbar|topbar|widgets?")
#: First parts of names that tell a state or a topic, and last parts that only say it is a container.
_STATE = frozenset("has no with without is show hide hidden category tag type status format template author post page single".split())
_HOLDER = frozenset(
    "area bar block body bottom box buttons card container content feed footer form group header holder inner item items left link links "
    "list menu outer panel posts right section slot text thread title top unit widget wrap wrapper".split())
_HEADER = re.compile(r"(?:^|[^a-z])header(?:$|[^a-z])")
_CONTENT = re.compile(r"(?:^|[^a-z])(?:article|articlebody|main|content|post|entry|story|body-?text)(?:$|[^a-z])")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w:.-])(class|id|role|style|hidden|aria-hidden)(?![\w:.-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_BREAK = "\n"
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
_MARKUP = re.compile(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


class Block:
    """Text of one block: its raw pieces, characters inside links, and where it
    stands (never: in a container that is no content, 1 perhaps, 2 certainly;
    inside: 2 an article element, 1 a container named like one, 0 neither)."""

    __slots__ = ("pieces", "linked", "never", "inside", "heading")

    def __init__(self, never: int, inside: int, heading: bool):
        self.pieces, self.linked, self.never, self.inside, self.heading = [], 0, never, inside, heading

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.pieces)).strip()


def names_no_content(names: str) -> int:
    """Whether names of class, id and role mark a container as no content: 2
    certainly, 1 perhaps, 0 no. A name counts by all of it, by its last part, or by
    its first where the last only says that it holds something."""
    found = 0
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not parts or (len(parts) > 1 and parts[0] in _STATE and not name.startswith("post-comment")):
            continue
        whole = "".join(parts)
        told = [parts[-1], whole if whole in ("sidebar", "topbar") else ""] + parts[:1] * (parts[-1] in _HOLDER)
        found = max(found, *(2 if _CERTAIN.fullmatch(x) else 1 if _UNCERTAIN.fullmatch(x) else 0 for x in told))
    return found


def _container(name: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """Whether an element is no content (2 certainly, 1 perhaps), and whether it
    is the article."""
    values, hidden = "", False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif key in ("class", "id", "role"):
            values += " " + value
    article = name in ("article", "main") or name in ("div", "section") and bool(values) and bool(_CONTENT.search(values))
    never = 2 if hidden or name in _NEVER else 1 if name == "form" or name == "header" and not in_article else 0
    if never < 2 and values and name not in ("html", "body", "main"):
        page_header = not in_article and not article and bool(_HEADER.search(values))
        told = names_no_content(values)
        never = max(never, int(page_header), 0 if name == "article" and told < 2 else told)
    return never, article and not never


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. The stack holds (name, never content, how far in the article)."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []
    now = Block(0, 0, False)
    links = 0
    at, end = 0, len(page)

    def turn():
        nonlocal now
        if now.pieces:
            out.append(now)
        _, never, inside = stack[-1] if stack else ("", 0, 0)
        now = Block(never, inside, any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in stack[-2:]))

    def add(raw: str):
        nonlocal now
        if raw:
            text = html.unescape(raw)
            if not (text.isspace() and now.pieces and now.pieces[-1] == _BREAK):
                now.pieces.append(text)
            if links:
                now.linked += len("".join(text.split()))

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            cut = re.search(r"<[/!?a-zA-Z][^>]*\Z", rest)
            add(rest[: cut.start()] if cut else rest)
            break
        add(page[at: m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag
            if any(x[0] == name for x in stack):
                if name in _BLOCK:
                    while stack.pop()[0] != name:
                        pass
                    links = sum(x[0] == "a" for x in stack)
                    turn()
                else:
                    i = max(k for k, x in enumerate(stack) if x[0] == name)
                    if not any(x[0] in _BLOCK for x in stack[i + 1:]):
                        _, was, _ = stack[i]
                        del stack[i:]
                        links = sum(x[0] == "a" for x in stack)
                        if was != (stack[-1][1] if stack else 0):
                            turn()
            elif name == "p":
                turn()
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>|<body\b" if name == "head" else rf"</{name}\s*>", re.I).search(page, at)
            if close is None:
                at = at if name == "head" else end
            else:
                at = close.start() if close[0].lower().startswith("<body") else close.end()
            if name in _BLOCK:
                turn()
            elif name not in _UNSEEN:
                now.pieces.append(" ")
            continue
        if name in _BLOCK:
            if any(x[0] == "p" for x in stack[-4:]):
                while stack[-1][0] != "p" and stack[-1][0] not in _BLOCK:
                    stack.pop()
                if stack and stack[-1][0] == "p":
                    stack.pop()
            if name in _SIBLINGS and stack and stack[-1][0] in _SIBLINGS[name]:
                stack.pop()
            links = sum(x[0] == "a" for x in stack)
        if name in _VOID:
            if name in _BLOCK:
                turn()
            elif name == "br" and now.pieces and now.pieces[-1] == _BREAK:
                turn()  # two line breaks end a block, one is white space in it
            elif name != "wbr":
                now.pieces.append(_BREAK if name == "br" else " ")
            continue
        attributes = m[3] or m[6] or ""
        if not attributes.rstrip().endswith("/") or name in _BLOCK:
            _, never, inside = stack[-1] if stack else ("", 0, 0)
            own, article = _container(name, attributes, inside > 0) if attributes.strip() or name in _NEVER or name in ("article", "main", "header", "form") else (0, False)
            level = 2 if name in ("article", "main") else int(article)
            if level == 2 and never == 1:
                never = 0  # an article is one in whatever wrapper
            stack.append((name, max(never, own), 0 if own else max(inside, level)))
            links += name == "a"
            if name in _BLOCK or own > never:
                turn()
    if now.pieces:
        out.append(now)
    return [b for b in out if b.text()]


GOOD, BAD, OPEN = 1, 0, 2


def first_pass(block: Block, text: str, stop: frozenset[str], doubt: int = 0) -> int:
    """GOOD, BAD or OPEN by link density, stop words and length, with lower
    thresholds inside an article. ``doubt`` 1: containers that are perhaps no
    content count as any other."""
    if block.never > doubt:
        return BAD
    solid = len("".join(text.split()))
    linked = block.linked / max(solid, 1)
    if linked > MAX_LINK_DENSITY:
        return OPEN if block.inside and linked <= 0.8 else BAD
    found = _WORD.findall(text.lower())
    dense = sum(w in stop for w in found) / max(len(found), 1)
    if block.inside:
        return GOOD if dense >= STOP_LOW / 2 or block.heading else OPEN
    if len(text) < LENGTH_LOW:
        return BAD if linked > 0 else OPEN
    if dense >= STOP_HIGH or dense >= STOP_LOW and len(text) > LENGTH_HIGH:
        return GOOD
    return OPEN if dense >= STOP_LOW or len(text) > LENGTH_HIGH else BAD


def second_pass(labels: list[int], lone: int) -> list[int]:
    """Open blocks take the label of the nearest decided neighbour; between a
    good and a bad one equally near, the good; with none at all, ``lone``."""
    n = len(labels)
    before, after, last = [None] * n, [None] * n, None
    for i in range(n):
        last = i if labels[i] != OPEN else last
        before[i] = last
    last = None
    for i in reversed(range(n)):
        last = i if labels[i] != OPEN else last
        after[i] = last
    out = []
    for i, label in enumerate(labels):
        if label == OPEN:
            near = [(abs(i - k), -labels[k]) for k in (before[i], after[i]) if k is not None]
            label = -min(near)[1] if near else lone
        out.append(label)
    return out


def main_text(page: str | None, stop: frozenset[str]) -> str:
    """The page's article: its good blocks, one to a line."""
    found = blocks(page or "")
    texts = [b.text() for b in found]
    doubt = 0
    first = [first_pass(b, t, stop) for b, t in zip(found, texts, strict=True)]
    if not any(k != BAD for k in first) and any(b.never == 1 for b in found):
        doubt = 1  # nothing else can be the page's text
        first = [first_pass(b, t, stop, doubt) for b, t in zip(found, texts, strict=True)]
    if not any(b.inside and b.never <= doubt for b in found):
        labels = second_pass(first, BAD if doubt else GOOD)
    else:
        labels = [BAD] * len(found)
        for inside in (True, False):
            at = [i for i, b in enumerate(found) if b.never <= doubt and (b.inside > 0) == inside]
            own = [first[i] for i in at]
            if not inside and all(k == OPEN for k in own):  # the longer ones decide
                own = [GOOD if len(texts[i]) >= LENGTH_LOW else OPEN for i in at]
            for i, k in zip(at, second_pass(own, GOOD if inside else BAD), strict=True):
                labels[i] = k
    return "\n".join(t for t, k in zip(texts, labels, strict=True) if k == GOOD)


def stop_words(pages: DataFrame, html_col: str = "html", most: int = STOP_WORDS) -> frozenset[str]:
    """The commonest words of all pages' visible text; ties by the word itself."""
    def count(batches):
        for batch in batches:
            total: dict[str, int] = {}
            for page in batch.column("html").to_pylist():
                for w in _WORD.findall(_MARKUP.sub(" ", page or "").lower()):
                    if len(w) <= LONGEST_STOP_WORD:
                        total[w] = total.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], ["word", "n"])

    rows = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(count, "word string, n bigint")
    top = rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return frozenset(r["word"] for r in top.collect())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    stop = stop_words(pages, html_col)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            text = [main_text(page, stop) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
