"""Main text of web pages as a maximum-scoring subsequence of their tokens.

A page is a row of tokens, and each token has a class: a word by the block it
stands in, by whether it is a link, or by what its element is (menus, forms,
adverts and so on); a tag by its name. Words score above 0 and tags below; words
in elements that are never content, or whose names say boilerplate, score below
0 too. Weights are log odds of the classes in and out of the article, counted on
pages whose own markup says where it is (an article or main element). One linear
scan finds the contiguous region of the greatest score, and that region's words,
without those of boilerplate, are the text, block by block. Where a page marks
its article, the mark is part of its tokens' classes, and the scan decides there
as it does on pages without marks.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import with_text
from .scratch import bounded_batches

#: Attributes up to the end of a tag; a < outside of quotes ends the attempt, so that broken markup takes linear time.
_ATTRS = r"[^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes)\b{_ATTRS}>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/><]*)(?P<attrs>{_ATTRS})>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[A-Za-z][^<>]*\Z"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_PIECE = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head nav footer aside form button select option datalist dialog menu svg math canvas object audio video map".split())
SECTIONS = frozenset("article main section div body html td blockquote".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav widget widgets menu navbar nav navigation breadcrumb breadcrumbs"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond"
    " related recommended recommendations footer masthead topbar toolbar pagination pager copyright search contentinfo complementary alert hidden skip".split()
)
HEADER = frozenset("header".split())
BOUNDS = SECTIONS | frozenset("ul ol table dl tbody".split())
# End of the fixed values.


#: Tags with a class of their own; all others share one, so that classes are bounded.
KNOWN = VOID | INLINE | NEVER | SECTIONS | CLOSES_P | HEADER | frozenset("html caption dd dt li option summary tbody td tfoot th thead tr".split())
MARKS = ("article", "main")


@dataclass
class _Element:
    tag: str
    parent: int
    never: bool = False
    named: bool = False


@dataclass
class Page:
    """Elements, and tokens: (element, tag or None, number of words, block). A block is a list of (element, text)."""

    elements: list[_Element] = field(default_factory=lambda: [_Element("", -1)])
    events: list[tuple[int, str | None, int, int]] = field(default_factory=list)
    blocks: list[list[tuple[int, str]]] = field(default_factory=lambda: [[]])


def _says_boilerplate(tag: str, attrs: str, in_article: bool) -> str | None:
    """"never" if the element is never content, "named" if only its names say so."""
    if tag in NEVER or (tag == "header" and not in_article):
        return "never"
    if tag in ("html", "body", "article", "main") and "omment" not in attrs:
        return None
    if not attrs:
        return None
    named = None
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "never"
        if name != "aria-label":
            words = {p.lower() for p in _PIECE.findall(value)}
            if words & BOILERPLATE or (not in_article and words & HEADER):
                named = "named"
    return named


def parse(text: str) -> Page:
    """The page's elements and tokens. Unclosed and misnested tags are taken as a browser would, roughly."""
    page, stack = Page(), [0]
    elements, events = page.elements, page.events
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    bounds = [0]  # where in the stack implied ends stop
    broke = False

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            places[elements[stack.pop()].tag].pop()
        while bounds[-1] >= depth:
            bounds.pop()

    for m in _TOKEN.finditer(text):
        part = m["text"]
        if part is not None:
            part = html.unescape(part)
            if broke and page.blocks[-1]:
                page.blocks.append([])
            broke = False
            page.blocks[-1].append((stack[-1], part))
            n = len(part.split())
            if n:
                events.append((stack[-1], None, n, len(page.blocks) - 1))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m["close"])
        if tag not in INLINE:
            broke = True
        elif tag == "br" and page.blocks[-1] and not broke:
            page.blocks[-1].append((stack[-1], " "))
        if closing:
            if places[tag]:
                at = places[tag][-1]
                events.append((stack[at], "/" + tag, 0, -1))
                pop_to(at)
            continue
        if tag in CLOSES_P or tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            same = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else ("p",) if tag in CLOSES_P else (tag,)
            at = max((places[x][-1] for x in same if places[x]), default=-1)
            if at >= bounds[-1]:
                pop_to(at)
        parent = stack[-1]
        events.append((parent, tag, 0, -1))
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        says = _says_boilerplate(tag, m["attrs"], any(places[x] for x in MARKS))
        elements.append(_Element(tag, parent, elements[parent].never or says == "never", says == "named"))
        places[tag].append(len(stack))
        if tag in BOUNDS:
            bounds.append(len(stack))
        stack.append(len(elements) - 1)
    return page


@dataclass
class Layout:
    """What a page's structure says of each element: a link or in one, boilerplate, in its marked article (None: the page marks none), and its block's tag."""

    linked: list[bool]
    junk: list[str | None]
    inside: list[bool] | None
    block: list[str]


def layout(page: Page) -> Layout:
    """A named element is boilerplate unless it is rich: it holds an article, or else more than half of the unlinked words of its article, or of a page that has none.

    A page marks its article if its article elements, or else its main elements,
    hold at least half of the unlinked words that aren't boilerplate.
    """
    elements, n = page.elements, len(page.elements)
    words, articles, scope, linked, block = [0] * n, [0] * n, [0] * n, [False] * n, [""] * n
    for i, e in enumerate(elements[1:], 1):
        up = e.parent
        linked[i] = e.tag == "a" or linked[up]
        scope[i] = up if elements[up].tag in MARKS else scope[up]
        articles[i] = int(e.tag in MARKS and not e.never and not e.named)
        block[i] = block[up] if e.tag in INLINE else e.tag
    own = [0] * n
    for e, _, count, _ in page.events:
        own[e] += 0 if linked[e] or elements[e].never else count
    words = list(own)
    for i in range(n - 1, 0, -1):
        words[elements[i].parent] += words[i]
        articles[elements[i].parent] += articles[i]
    junk: list[str | None] = [None] * n
    for i, e in enumerate(elements[1:], 1):
        rich = articles[i] or ((scope[i] or not articles[0]) and 2 * words[i] > words[scope[i]])
        junk[i] = "never" if e.never else "named" if (e.named and not rich) or junk[e.parent] == "named" else None
    clean = sum(own[i] for i in range(n) if not junk[i])
    for mark in MARKS:
        inside = [False] * n
        for i, e in enumerate(elements[1:], 1):
            inside[i] = inside[e.parent] or (e.tag == mark and not junk[i])
        held = sum(own[i] for i in range(n) if inside[i] and not junk[i])
        if held and 2 * held >= clean:
            return Layout(linked, junk, inside, block)
    return Layout(linked, junk, None, block)


def _classes(page: Page, of: Layout, marks: bool = True) -> Iterator[tuple[str, int]]:
    """(token class, count) of each token; ``marks``: the page's own article, if it marks one, is looked at."""
    marked = of.inside if marks else None
    for e, tag, n, _ in page.events:
        junk = of.junk[e]
        if tag:
            name = tag.lstrip("/")
            within = marked[e] and name not in MARKS if marked else False
            kind = ("inner junk" if within else "junk tag") if junk else ("article tag" if within else "beside tag") if marked else f"tag {tag if name in KNOWN else 'other'}"
            yield kind, 1
        elif junk:
            yield "inner junk" if marked and marked[e] else f"{junk} word", n
        elif marked:
            yield "article word" if marked[e] else "beside word", n
        else:
            yield f"{'link' if of.linked[e] else 'word'} {of.block[e] if of.block[e] in KNOWN else 'other'}", n


#: Weights of kinds of tokens; a class without a weight of its own has that of its first word.
DEFAULT_WEIGHTS = {"word": 1.0, "link": -0.2, "tag": -0.5, "never word": -0.5, "named word": -0.5, "junk tag": -0.5, "inner junk": -0.01, "article word": 1.0, "article tag": -0.01, "beside word": -3.0, "beside tag": -3.0}
#: What words, tags and boilerplate weigh at least and at most. Boilerplate may stand amid the text, so it costs less than what is beside an article.
WORD_RANGE, TAG_RANGE, JUNK_RANGE = (-3.0, 1.0), (-3.0, -0.01), (-0.5, 1.0)


def token_weights(page: Page, of: Layout, weights: dict[str, float]) -> list[float]:
    """The score of each token of a page."""
    return [n * (weights[name] if name in weights else weights[name.partition(" ")[0]]) for name, n in _classes(page, of)]


def best_region(scores: list[float]) -> tuple[int, int] | None:
    """First and last token of the region with the greatest sum above 0, the earliest and shortest of several; None without one."""
    best, found, total, start = 0.0, None, 0.0, 0
    for i, w in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += w
        if total > best:
            best, found = total, (start, i)
    return found


def main_text(source: str | None, weights: dict[str, float] = DEFAULT_WEIGHTS) -> str:
    """Blocks of the main text joined by newlines, white space inside a block as one space; empty without any.

    Of boilerplate inside the region nothing is taken, if its words weigh below 0.
    """
    if not source:
        return ""
    page = parse(source)
    of = layout(page)
    region = best_region(token_weights(page, of, weights))
    if region is None:
        return ""
    out_of_place = {k.split()[0] for k in ("never word", "named word") if weights.get(k, 0.0) < 0}
    blocks = sorted({b for _, tag, _, b in page.events[region[0] : region[1] + 1] if not tag})
    texts = (" ".join("".join(t for e, t in page.blocks[b] if of.junk[e] not in out_of_place).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def class_counts(source: str) -> Counter:
    """{(token class, in the article): count} of a page that marks its article; empty for others.

    Each token counts in its class with the mark, in that without it, and in its kind.
    """
    out: Counter = Counter()
    page = parse(source)
    of = layout(page)
    if of.inside is None:
        return out
    for (e, tag, n, _), (marked, _), (plain, _) in zip(page.events, _classes(page, of), _classes(page, of, False), strict=True):
        n, inside = n or 1, of.inside[e] and not of.junk[e] and (tag or "").lstrip("/") not in MARKS
        kind = ("tag" if tag else "link" if of.linked[e] else "word") if not of.junk[e] or of.linked[e] else None
        for name in {marked, plain, kind} - {None, "inner junk"}:
            out[name, inside] += n
    return out


def learn_weights(pages: DataFrame, html_column: str = "html") -> dict[str, float]:
    """Log odds of each token class in and out of the article, over all pages that mark theirs.

    Classes are counted by the executors and summed up; a row for each class, of
    which there are a few hundred at most, reaches the driver. Words weigh within
    ``WORD_RANGE``, tags within ``TAG_RANGE``, boilerplate down to ``JUNK_RANGE``. What no page tells keeps its default.
    """
    bounded_batches(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source in batch.column("html").to_pylist():
                total.update(class_counts(source))
        if total:
            names, inside = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(inside), pa.array(list(total.values()), pa.int64())], ["name", "inside", "n"])

    marked = pages.select(F.col(f"`{html_column}`").cast("string").alias("html")).where(F.col("html").rlike(r"(?i)<(?:article|main)[\s>]"))
    rows = marked.mapInArrow(count, "name string, inside boolean, n bigint").groupBy("name", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r["name"], r["inside"]): r["n"] for r in rows})


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights from the counts of ``class_counts``; words and tags are weighed each among themselves."""
    out = dict(DEFAULT_WEIGHTS)
    is_tag = lambda name: name == "tag" or name.startswith("tag ") or name.endswith(" tag")
    for tags, (least, most) in ((False, WORD_RANGE), (True, TAG_RANGE)):
        names = sorted({name for name, _ in counts if is_tag(name) == tags})
        total = [sum(counts.get((name, inside), 0) for name in names) + len(names) for inside in (False, True)]
        for name in names:
            n_in, n_out = counts.get((name, True), 0) + 1, counts.get((name, False), 0) + 1
            least_here = JUNK_RANGE[0] if name in ("never word", "named word", "junk tag") else least
            out[name] = min(most, max(least_here, math.log(n_in / total[1]) - math.log(n_out / total[0])))
    return out


def extract(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(row, got): the kept columns, and text and n_chars (code points).

    Null and empty pages, and pages without a word that scores above 0, have an
    empty text. Repeated rows have equal texts, and an empty table gives an empty
    one. Any markup is read in linear time. Other columns pass through.
    """
    weights = learn_weights(pages, html_column) if weights is None else weights

    def run(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(x, weights) for x in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_text(pages, run, "text: string, n_chars: bigint", text=html_column, keep=keep)
