"""Main text of web pages by paths that the pages of a host agree on.

A page is read into block elements, each with a generalised path (tags with their classes, digits cut
out), and blocks of text. Every container of a page gets a score: the characters of its own blocks
outside links, and a share of what its inner containers hold. A page casts its scores, as shares of
their sum, as votes for paths; votes are summed per host in Spark. A page's text is then taken from all its
elements on the host's strongest path that the page has; a page with none uses its own best path, so a
host's odd page is not lost. From there it climbs to the parent while that adds headings, paragraphs or
sections of its own beside the container, or boxes before it, mostly outside links and no more text than the container has; of the
body, only its own blocks and sections are added, not those of its other containers.

A host's `LISTED` strongest paths travel with its pages; a page that has none of them gets its strongest path by a join of its own
paths with all votes of the host, so no path of a host is left out.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are dropped. Elements that mean these are
(a header, aside or menu within an article is not, nor a form or dialog with more than half of the page's text outside links, as some servers put one round the whole
page; a button goes without cutting the sentence round it). A page with no text but that of noscript elements keeps that. A word of class, id or role that may mean them, unless it is negated (has-, no-), lowers the
score of what it marks and keeps it from being climbed to. Inside the winning container it drops only what is named by such words alone, or, of boxes,
by such words and those of boxes (`share-buttons`, not `related-work`). Words never drop an element that
holds the page's largest article, or else most of its text outside links; words of comments and adverts need a
h1 in the latter case too. A page where nothing is left keeps what only the elements drop. Character references are decoded once, white space in a block becomes one space, blocks are joined
by line ends in page order; nothing is cut off.

A null or empty page gives an empty text, an empty table no rows. A url without a host votes with all others like it. Rows that
repeat give the same text each. Other columns, whatever their names, are ignored. Very long pages are read whole, in batches of bounded bytes. Votes are
integers and ties go to the first path by name, so results do not depend on order.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

HELD_UP = 0.8
FAINT = 0.25
LISTED = 16
VOTES = 1_000_000
BROADCAST_ROWS = 100_000

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea title select canvas button".split())
UNTIL_CLOSED = frozenset("script style textarea".split())
DROPPED = frozenset("head nav header footer aside menu".split())
IN_ARTICLE = frozenset("header aside menu".split())  # parts of an article inside one
UNLESS_MOST = frozenset("form dialog".split())  # dropped, unless they hold most of the page's text
BLOCKS = frozenset("html head body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot caption tr td th section article main figure figcaption address details summary nav header footer aside form fieldset menu dialog center hgroup".split())
CONTAINERS = frozenset("body div section article main td blockquote center fieldset".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head", "p"}}
INLINE_SAFE = BLOCKS - frozenset("li dt dd tr td th tbody thead tfoot caption summary figcaption html head body".split())
NOISE = frozenset("ad ads adbox adsense nav navbar menu header footer masthead notice alert popup modal overlay consent gdpr share sharing social related recommended recommendations respond reply replies login signup search pagination pager widget widgets toolbar sponsor disclaimer banner contentinfo complementary".split())
NOISE_PREFIXES = ("advert", "comment", "cookie", "sidebar", "breadcrumb", "newsletter", "subscri", "promo", "sponsor", "navigation", "disqus")
BOXES = frozenset("area bar block body box btn button buttons container content form inner item items link links list main meta outer panel posts row section site text title top bottom wrap wrapper".split())
OF_PAGE = frozenset("article blog entry global page post site story".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())
HOLDS = frozenset("html body main".split())
BESIDE_ARTICLE = frozenset("ad ads related recommended reply replies respond".split())
NEGATED = frozenset("has no not non with without".split())
LEAST_ARTICLE = 0.25
BESIDE_PREFIXES = ("comment", "advert", "promo", "sponsor")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)|[^<]+|<", re.S)
PATH_CHARS = 400
_CLASS = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SAME = {tag: re.compile(rf"<(/?){tag}(?![a-z0-9:-])", re.I) for tag in RAW}
HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


@dataclass
class Element:
    tag: str
    path: str
    parent: int
    dropped: bool
    noise: bool  # hidden, or within what is; once the page is read, also by words
    word: bool  # a word of noise of its own
    only: bool  # and no word beside it that may mean something else
    beside: bool  # and one of comments, adverts and the like
    sure: bool = False  # noise that is dropped from the winning container too


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[str, int, int]] = field(default_factory=list)  # text, characters in links, element


def host_of(url: Column) -> Column:
    """Host of a url in lower case, empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1))


def _noisy(words: list[str], of_noise: frozenset, prefixes: tuple) -> list[bool]:
    """Which words of a class are of noise and not negated, as in has-sidebar and ad-free."""
    return [(w in of_noise or w.startswith(prefixes)) and not NEGATED.intersection(words[:k]) and words[k + 1 : k + 2] != ["free"] for k, w in enumerate(words)]


def _named_only(words: list[str], noisy: list[bool], tag: str) -> bool:
    """Whether a class with noise means nothing else: text by words of noise alone, a box also by those of boxes, and before them those of the page."""
    if tag in TEXTS:
        return all(noisy)
    first = noisy.index(True)
    return all(n or w in BOXES or (k < first and w in OF_PAGE) for k, (w, n) in enumerate(zip(words, noisy)))


@lru_cache(4096)
def _marks(attributes: str, tag: str) -> tuple[str, bool, bool, bool, bool]:
    """Generalised classes, and whether the attributes speak of something hidden, beside the article, of nothing else, and of comments or adverts.

    An article is beside another one only by the narrower list of words, as layouts name their articles freely.
    """
    words_of_noise, prefixes = (BESIDE_ARTICLE, BESIDE_PREFIXES) if tag == "article" else (NOISE, NOISE_PREFIXES)
    classes, noise, word, only, beside = [], False, False, False, False
    for name, *values in _CLASS.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "style":
            noise |= "display:none" in value.lower().replace(" ", "")
        elif name in ("hidden", "aria-hidden"):
            noise |= name == "hidden" or value.lower() == "true"
        else:
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                noisy = _noisy(words, words_of_noise, prefixes)
                if any(noisy):
                    word, only = True, only or _named_only(words, noisy, tag)
                beside |= any(_noisy(words, BESIDE_ARTICLE, BESIDE_PREFIXES))
        if name == "class":
            classes = sorted({re.sub(r"\d+", "", c) for c in value.lower().split()})
    return "".join("." + c for c in classes if c), noise, word, only, beside


def _step(above: str, tag: str, classes: str) -> str:
    """An element's path below another's. Long ones go on from a digest, so that a path's length does not grow with the depth, nor a page with its square."""
    if len(above) > PATH_CHARS:
        above = "#" + hashlib.blake2b(above.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return f"{above}/{tag}{classes}"


def read(source: str, raw: frozenset = RAW) -> Page:
    """Block elements and text blocks of a page, cut-off and badly nested ones included. raw: elements without text."""
    page, stack, text, linked, link = Page(), [-1], [], 0, False
    opened: Counter = Counter()  # tags on the stack

    def leave(at: int) -> None:
        for i in stack[at:]:
            opened[page.elements[i].tag] -= 1
        del stack[at:]

    skip: str | None = None
    closed = True  # whether what is skipped has an end tag

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                page.blocks.append((joined, min(linked, len(joined)), stack[-1]))
            text.clear()
        linked = 0

    for found in _TOKEN.finditer(source):
        tag = found[2]
        if tag is None:
            piece = found[0]
            if skip or piece.startswith(("<!", "<?")):
                continue
            text.append(piece)
            if link:
                linked += len(piece)
            continue
        tag, closing = tag.lower(), bool(found[1])
        if skip:
            if closed or tag not in BLOCKS:
                skip = None if closing and tag == skip else skip
                continue
            skip = None
        if tag in raw:
            skip = None if closing or found[3].rstrip().endswith("/") else tag
            if skip:
                same = None if tag in UNTIL_CLOSED else _SAME[tag].search(source, found.end())
                closed = tag in UNTIL_CLOSED or bool(same and same[1])
        elif tag == "a":
            link = not closing
        elif tag == "br":
            text.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            link = False
            if closing:
                if opened[tag]:
                    leave(next(k for k in range(len(stack) - 1, 0, -1) if page.elements[stack[k]].tag == tag))
                continue
            if tag in INLINE_SAFE and stack[-1] >= 0 and page.elements[stack[-1]].tag == "p":
                leave(len(stack) - 1)
            while stack[-1] >= 0 and page.elements[stack[-1]].tag in CLOSED_BY.get(tag, ()):
                leave(len(stack) - 1)
            above = page.elements[stack[-1]] if stack[-1] >= 0 else None
            classes, noise, word, only, beside = _marks(found[3], tag) if found[3] else ("", False, False, False, False)
            free = tag in HOLDS
            classes = "" if tag in ("html", "body") else classes  # those speak of the page, not of the host
            dropped = tag in DROPPED and not (tag in IN_ARTICLE and opened["article"])
            hidden = not free and noise or bool(above and above.noise)
            page.elements.append(Element(tag, _step(above.path if above else "", tag, classes), stack[-1], dropped or bool(above and above.dropped), hidden, word and not free, only, beside, hidden))
            stack.append(len(page.elements) - 1)
            opened[tag] += 1
    flush()
    _drop_forms(page)
    _drop_by_words(page)
    return page


def parsed(source: str) -> Page:
    """The page; that of its noscript elements too if it has no other text."""
    page = read(source)
    return page if _kept(page) or "<noscript" not in source.lower() else read(source, RAW - {"noscript"})


def _drop_forms(page: Page) -> None:
    """Marks forms and dialogs, and all within, unless one holds more than half of the text outside links that stands in no dropped element."""
    elements = page.elements
    if not any(e.tag in UNLESS_MOST for e in elements):
        return
    worth, total = [0] * len(elements), 0
    for text, linked, at in page.blocks:
        if at < 0 or not elements[at].dropped:
            total += len(text) - linked
            if at >= 0:
                worth[at] += len(text) - linked
    for i in range(len(elements) - 1, -1, -1):
        if elements[i].parent >= 0:
            worth[elements[i].parent] += worth[i]
    for i, e in enumerate(elements):
        e.dropped |= e.tag in UNLESS_MOST and 2 * worth[i] <= total or e.parent >= 0 and elements[e.parent].dropped


def _drop_by_words(page: Page) -> None:
    """Marks what words of noise drop, and all within. Not dropped is what holds the article, or most of the text."""
    elements = page.elements
    if not any(e.word for e in elements):
        return
    worth, titled = [0.0] * len(elements), [e.tag == "h1" for e in elements]
    total = 0.0
    for text, linked, at in page.blocks:
        if at < 0 or not (elements[at].dropped or elements[at].noise):
            total += len(text) - linked
            if at >= 0:
                worth[at] += len(text) - linked
    for i in range(len(elements) - 1, -1, -1):
        if (above := elements[i].parent) >= 0:
            worth[above] += worth[i]
            titled[above] |= titled[i]
    articles = [i for i, e in enumerate(elements) if e.tag in ("article", "main") and not e.word and worth[i] and worth[i] >= LEAST_ARTICLE * total]
    article = max(articles, key=lambda i: (worth[i], -i), default=-1)
    above, at = set(), article
    while at >= 0:
        above.add(at)
        at = elements[at].parent
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = i == article or e.parent >= 0 and inside[e.parent]
        most = 2 * worth[i] > total and (article < 0 or inside[i]) and (titled[i] or not e.beside)
        marked = e.word and i not in above and not most
        e.noise |= marked or e.parent >= 0 and elements[e.parent].noise
        e.sure |= marked and e.only or e.parent >= 0 and elements[e.parent].sure


def _kept(page: Page) -> list[tuple[str, int, int]]:
    """Blocks outside what is dropped. Classes count unless they leave nothing."""
    plain = [b for b in page.blocks if b[2] < 0 or not page.elements[b[2]].dropped]
    return [b for b in plain if b[2] < 0 or not page.elements[b[2]].sure] or plain


def container_scores(page: Page) -> dict[str, float]:
    """Score of each path that holds text in the page: what its containers hold, passed up from the innermost ones."""
    held = [0.0] * len(page.elements)
    for text, linked, at in _kept(page):
        if at >= 0:
            held[at] += max(0.0, len(text) - 2.0 * linked) * (FAINT if page.elements[at].noise else 1.0)
    scores: dict[str, float] = {}
    for i in range(len(held) - 1, -1, -1):
        element, worth = page.elements[i], held[i]
        if worth and element.tag in CONTAINERS:
            scores[element.path] = scores.get(element.path, 0.0) + worth * (1.25 if element.tag in ("article", "main") else 1.0)
            worth *= HELD_UP
        if element.parent >= 0:
            held[element.parent] += worth
    return scores


def votes(source: str | None) -> dict[str, int]:
    scores = container_scores(parsed(source)) if source else {}
    total = sum(scores.values())
    return {path: int(VOTES * s / total) for path, s in scores.items()} if total else {}


def _climb(page: Page, blocks: list[tuple[str, int, int]], taken: set[int]) -> set[int]:
    """The elements, and those of the parents that hold further parts of the same article. `taken`: whole subtrees. A step looks only at what it adds and what
    steps before it left out."""
    elements = page.elements
    held: dict[int, list[int]] = {}  # element -> characters, those in links
    for text, linked, at in blocks:
        if at in taken or at >= 0 and not elements[at].noise:
            sums = held.setdefault(at, [0, 0])
            sums[0] += len(text)
            sums[1] += linked
    end = list(range(len(elements)))
    for i in range(len(elements) - 1, -1, -1):
        if elements[i].parent >= 0:
            end[elements[i].parent] = max(end[elements[i].parent], end[i])
    direct_tag = lambda i: elements[i].tag not in CONTAINERS or elements[i].tag in ("section", "blockquote")
    got = sum(held[i][0] - held[i][1] for i in held if i in taken)
    roots = {i for i in taken if elements[i].parent not in taken}
    first = min(roots)
    left: list[tuple[int, bool]] = []  # what is under the root and was not taken, and whether no container lies between
    while True:
        tops = {elements[i].parent for i in roots}
        if len(tops) != 1 or (top := tops.pop()) < 0:
            return taken
        within = elements[top].tag == "body"
        under, before = {top: True}, {top}  # under: whether no container lies between but sections; before: nor boxes before what is taken
        if left:
            (root,) = roots
            under.update((i, d and direct_tag(root)) for i, d in left if not elements[root].noise)
        i = top + 1
        while i <= end[top]:
            if i in roots:
                i = end[i] + 1
                continue
            e = elements[i]
            if not e.noise and e.parent in under and e.parent not in taken:
                under[i] = under[e.parent] and direct_tag(i)
                if e.parent in before and i < first:
                    before.add(i)
            i += 1
        parts = {k for k, d in under.items() if d} if within else set(under)
        more = [k for k in parts if k in held]
        if not within and not any(under[k] or elements[k].tag == "h1" for k in more):
            parts = before
            more = [k for k in more if k in before]
        length, linked = sum(held[k][0] for k in more), sum(held[k][1] for k in more)
        if not more and any(k in held for k in under):
            return taken
        if 2 * linked > length or length - linked > got:
            return taken
        taken |= parts
        got += length - linked
        left = [(k, d) for k, d in under.items() if k not in parts]
        roots, first = {top}, top
        if within or elements[top].tag == "html":
            return taken


def extract(source: str | None, paths: list[str]) -> str:
    """Text on the first of the paths that the page has, or else on its own best one; all that is kept if it has none."""
    if not source:
        return ""
    page = parsed(source)
    blocks = _kept(page)
    own = container_scores(page)
    best = next((p for p in paths if own.get(p)), None) or min(own, key=lambda p: (-own[p], p), default=None)
    if best is None:
        return "\n".join(text for text, _, _ in blocks)
    inside: dict[int, bool] = {-1: False}
    for i, element in enumerate(page.elements):
        inside[i] = inside[element.parent] or element.path == best
    taken = _climb(page, blocks, {i for i, held in inside.items() if held})
    return "\n".join(text for text, _, at in blocks if at in taken)


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(host, key, path, n) for host, key, source in zip(pdf["host"], pdf["key"], pdf["html"]) for path, n in votes(source).items()]
        yield pd.DataFrame(rows, columns=["host", "key", "path", "votes"])


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [extract(source, list(paths) if paths is not None else []) for source, paths in zip(pdf["html"], pdf["paths"])]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def page_votes(pages: DataFrame) -> DataFrame:
    """pages -> host, key (names the page's html), path, votes: a row for each path of a page."""
    small_batches(pages.sparkSession, 1000)
    keyed = pages.where(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("host"), F.md5(F.col("html").cast("binary")).alias("key"), "html")
    return keyed.mapInPandas(_vote, "host string, key string, path string, votes long")


def host_votes(cast: DataFrame) -> DataFrame:
    """host, path, votes."""
    return cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def host_paths(summed: DataFrame, listed: int = LISTED) -> DataFrame:
    """host, path, votes -> host, paths: the strongest `listed`, strongest first."""
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    strongest = summed.withColumn("_n", turn).where(F.col("_n") <= listed)
    return strongest.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("_n", "path"))).alias("r")).select("host", F.col("r.path").alias("paths"))


def odd_pages(cast: DataFrame, summed: DataFrame, winners: DataFrame) -> DataFrame:
    """host, key, path of the pages that have none of their host's listed paths: the strongest that each has."""
    met = cast.join(winners.select("host", F.explode("paths").alias("path")), ["host", "path"], "left_semi").select("host", "key").distinct()
    left = cast.select("host", "key", "path").join(met, ["host", "key"], "left_anti").join(summed, ["host", "path"])
    return left.groupBy("host", "key").agg(F.min_by("path", F.struct((-F.col("votes")).alias("v"), "path")).alias("path"))


def extract_pages(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS, listed: int = LISTED) -> DataFrame:
    """pages -> page_id, url, text, n_chars, a row for each input row. Hosts, and odd pages, are broadcast only up to `broadcast_rows` rows."""
    cast = stored(page_votes(pages), "page-votes")
    summed = stored(host_votes(cast), "host-votes")
    winners = stored(host_paths(summed, listed), "host-paths")
    odd = stored(odd_pages(cast, summed, winners), "odd-pages")
    placed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    few = winners.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = placed.join(F.broadcast(winners) if few else winners, "host", "left")
    if n_odd := odd.limit(broadcast_rows + 1).count():
        joined = joined.withColumn("key", F.md5(F.col("html").cast("binary"))).join(F.broadcast(odd) if n_odd <= broadcast_rows else odd, ["host", "key"], "left")
        joined = joined.withColumn("paths", F.when(F.col("path").isNotNull(), F.array("path")).otherwise(F.col("paths")))
    return joined.select("page_id", "url", "html", "paths").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
