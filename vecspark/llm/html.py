"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Subtrees that announce themselves as furniture
(navigation, page header and footer, asides, adverts, forms, notices, comments, scripts)
are taken out and count as tags; of the rest words score positive and tags negative, with
weights from labelled pages: log-odds of each kind of token inside and outside the main
text. One linear scan finds the contiguous region with the largest sum; its words are the
text. The labelled pages are made by a fixed rule, besides a few written by hand, so the weights
are the same everywhere.

A name (class, id, role) takes a subtree out only while the page has a text without it: one
that holds nearly all words outside links, with no main text elsewhere, keeps them whatever
it is called (``spared``). An element that is furniture by its tag always goes.

Pages are independent rows: no shuffle, memory of one page. The reader is forgiving:
unclosed, stray and cut tags are allowed, and every pattern is linear in the page.

Defined results: null, empty and text-free html give an empty text; html without any tag
is text; repeated rows give repeated results; null url and page_id stay null; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

#: Elements whose content is no markup: it goes, up to the end of the page where they are not closed.
RAW = ("script", "style", "textarea")
#: Elements without text of their own to read: their content goes where they are closed, else the tag alone. Those of NESTED hold their like.
INERT = frozenset(("noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "datalist", "title"))
NESTED = frozenset(("template", "svg", "math", "object"))
#: Elements of a page's head; any other ends it.
HEAD = frozenset(("title", "meta", "link", "base", "basefont", "bgsound", "noscript", "template", "object"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements inside a line: they end no word.
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that an opening block tag closes when they are still open.
LOOSE = frozenset(("p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "option"))
FURNITURE_TAGS = {"nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "dialog": "notice", "header": "header"}
MAIN_TAGS = frozenset(("article", "main"))
#: Words of class, id and role that name furniture.
FURNITURE_NAMES = {
    "nav": ("nav", "navbar", "navigation", "navigator", "menu", "menubar", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip", "sitemap"),
    "header": ("masthead", "topbar", "sitehead", "siteheader", "pageheader", "mainheader", "globalheader", "banner", "logo"),
    "footer": ("footer", "colophon", "copyright", "sitefooter"),
    "aside": ("sidebar", "aside", "rail", "widget", "widgets", "related", "recommended", "recommendations", "recirc", "trending", "popular", "promo", "promotion", "teaser", "teasers", "complementary", "outbrain", "taboola", "readmore"),
    "ad": ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "adslot", "adbox", "adsense", "sponsor", "sponsored", "sponsors", "dfp"),
    "comments": ("comment", "comments", "commentlist", "discussion", "disqus", "respond", "replies", "reply", "reactions", "guestbook"),
    "form": ("form", "search", "searchbox", "newsletter", "subscribe", "subscription", "signup", "signin", "login", "register", "contactform"),
    "notice": ("notice", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "alert", "disclaimer", "paywall", "toast", "announcement", "privacy"),
    "share": ("share", "sharing", "social", "addtoany"),
}
NAMED = {w: kind for kind, names in FURNITURE_NAMES.items() for w in names}
#: Words of class, id and role that name the main text.
MAIN_NAMES = frozenset(("article", "articlebody", "articletext", "post", "postbody", "entry", "story", "storybody", "main", "maincontent", "content", "contentbody"))

#: Words after which a label tells what a page has or lacks, and words that make a label one of the layout.
LAYOUT_BEFORE = frozenset(("no", "non", "not", "has", "have", "with", "without", "hide"))
LAYOUT = frozenset(("layout", "template", "free", "enabled", "disabled"))
#: Elements of prose: in the main text only adverts among them go by name.
PROSE = frozenset(("p", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"))

MILD, NEAR, LEAST = -0.02, -0.2, 0.2

_RAW = "|".join(RAW)
_TOKEN = re.compile(
    r"<!--(?:(?!-->).)*+(?:-->|$)"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])(?>[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>(?:(?!</(?P=raw)(?=[\s/>]|$)).)*+(?:</(?P=raw)[^>]*+>?|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?>[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^<>]*+)>"
    r"|<[!?/][^>]*+(?:>|$)|<[a-zA-Z][^<>]*+$",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|(?<![\w-])(hidden)(?![\w=-])""", re.I)
_NAMES = re.compile(r"[a-z]+")


def naming(attrs: str, ids: bool = True) -> tuple[str | None, bool]:
    """(kind of furniture or None, whether it names the main text) from a tag's attributes.

    A label that is a name of furniture comes first, then one of the main text, then one that
    has a name of furniture among others; its kind begins with "?".
    """
    whole, part, main = None, None, False
    for m in _ATTR.finditer(attrs):
        if m[5]:
            return "hidden", False
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "role") or key == "id" and ids:
            for label in value.split():
                words = _NAMES.findall(label)
                words = [] if LAYOUT & {*words} else words[: next((k for k, w in enumerate(words) if w in LAYOUT_BEFORE), len(words))]
                joined = "".join(words)
                kind = "header" if words == ["header"] else next((NAMED[w] for w in (*words, joined) if w in NAMED), None)
                if kind is None:
                    main = main or any(w in MAIN_NAMES for w in (*words, joined))
                elif words == ["header"] or joined in NAMED or all(w in NAMED for w in words):
                    whole = whole or kind
                else:
                    part = part or f"?{kind}"
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or key == "aria-hidden" and value == "true" or key == "hidden":
            return "hidden", False
    return (whole, False) if whole else (None, True) if main else (part, False)


def closed(tags: list[re.Match]) -> set[int]:
    """Where the opening tags of inert elements stand that have an end tag."""
    found, waiting = set(), defaultdict(list)
    for m in tags:
        name = (m["name"] or m["name2"] or "").lower()
        if name not in INERT:
            continue
        if m["end"] or m["end2"]:
            if waiting[name]:
                found.add(waiting[name].pop())
        elif name in NESTED:
            if not (m["attrs"] or m["attrs2"] or "").endswith("/"):
                waiting[name].append(m.start())
        else:
            waiting[name] = [m.start()]
    return found


class Page:
    """Words and tags of a page outside furniture: (kind of token, word or None, ends a word)."""

    def __init__(self, source: str, spared: frozenset[int] = frozenset(), survey: bool = False):
        self.spared, self.survey = spared, survey
        self.records: list[Named] = []
        self.words = self.main_words = 0
        self.tokens: list[tuple[str, str | None]] = []
        self.text: list[tuple[str, str]] = []
        stack: list[tuple[str, str | None, bool, bool, int]] = []  # name, furniture, main, link, place in records of the innermost furniture by name
        at = 0
        tags = list(_TOKEN.finditer(source))
        inert = closed(tags)
        for m in tags:
            self._words(source[at : m.start()], stack)
            at = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                if m["raw"]:
                    self._gap()
                continue
            name, end = name.lower(), bool(m["end"] or m["end2"])
            if name not in INLINE:
                self._gap()
            if end:
                self._close(name, stack)
            elif name in INERT:
                self._hide(name, m.start() in inert, stack)
            else:
                self._open(name, m["attrs"] or m["attrs2"] or "", m.start(), stack)
        self._words(source[at:], stack)

    def _gap(self) -> None:
        self.text.append(("", " "))

    def _hide(self, name: str, ends: bool, stack: list) -> None:
        if stack and stack[-1][0] == "head" and name not in HEAD:
            stack.pop()
        if ends:
            stack.append((name, "hidden", *(stack[-1][2:] if stack else (False, False, -1))))

    def _open(self, name: str, attrs: str, place: int, stack: list) -> None:
        if name == "head":
            stack.append((name, "hidden", False, False, -1))
            return
        if stack and stack[-1][0] == "head" and name not in HEAD:
            stack.pop()
        if name == "body":
            while stack and stack[-1][0] != "html" and stack[-1][1] == "hidden":
                stack.pop()
        if name not in INLINE:
            while stack and stack[-1][0] in LOOSE and (name == stack[-1][0] or stack[-1][0] == "p" or stack[-1][0][0] == "h"):
                stack.pop()
        kind, main, link, record = (stack[-1][1:] if stack else (None, False, False, -1))
        if kind and (name == "main" and kind != "hidden" or name == "article" and (kind == "form" or kind[0] == "?" and kind != "?comments")):
            kind = None  # what holds the main text is no furniture
        if kind is None:
            self.tokens.append(("<main>" if main else f"<{name}>", None))
            named, names_main = naming(attrs, name not in HEADINGS) if attrs else (None, False)
            if name == "body" or name == "html" or place in self.spared:
                named, names_main = None, False
            if name in MAIN_TAGS and named not in ("comments", "hidden", "aside", "ad"):
                named = None
            if main and name in PROSE and named not in ("hidden", "ad", "?ad"):
                named = None
            kind = FURNITURE_TAGS.get(name)
            if kind == "header" and main:
                kind = "byline"  # the head of an article: its headings are text, its other words are not
            kind = named if named and kind != "byline" else kind
            if kind in ("header", "?header") and main:
                kind = "byline"
            if kind and kind == named != "hidden" and name not in FURNITURE_TAGS:
                self.records.append(Named(place, kind, main, record))
                record = len(self.records) - 1
                kind = None if self.survey else kind
            main = main or name in MAIN_TAGS or names_main
            if kind == "byline":
                kind = None
                stack.append((name, "byline", main, link, record))
                return
        elif kind == "byline" and name in HEADINGS:
            stack.append((name, None, main, link, record))
            return
        if name not in VOID:
            stack.append((name, kind, main, link or name == "a", record))

    def _close(self, name: str, stack: list) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                if stack[k][1] is None:
                    self.tokens.append(("<main>" if stack[k][2] else f"</{name}>", None))
                del stack[k:]
                return
            if name in INLINE and stack[k][0] not in INLINE or name in LOOSE and stack[k][0] in ("div", "section", "article", "main", "table", "ul", "ol"):
                return

    def _words(self, raw: str, stack: list) -> None:
        if not raw:
            return
        _, gone, main, link, record = stack[-1] if stack else ("", None, False, False, -1)
        if not link and gone != "hidden" and (gone is None or record >= 0):
            n = len(raw.split())
            self.words += n
            self.main_words += n * main
            if record >= 0:
                self.records[record].words += n
                self.records[record].main_words += n * main
        if gone is not None:
            return
        kind = "main" if main else "link" if link else "word"
        self.text.append((kind, references.unescape(raw)))
        self.tokens.append((kind, str(len(self.text) - 1)))


@dataclass
class Named:
    """A subtree that is furniture by its name: where it opens, its kind, whether it stands in the main text, and the record around it."""

    place: int
    kind: str
    inside: bool
    around: int
    words: int = 0
    main_words: int = 0


#: A subtree is spared when it has so many times the words of the rest of the page: a label that only has a furniture word in it, and one that is a furniture word or names comments.
PART_SHARE, WHOLE_SHARE = 3, 9


def spared(page: Page) -> frozenset[int]:
    """Where the named subtrees open that hold nearly all words outside links, with no main text elsewhere (or in the main text themselves)."""
    for r in reversed(page.records):
        if r.around >= 0:
            page.records[r.around].words += r.words
            page.records[r.around].main_words += r.main_words
    found = set()
    for r in page.records:
        part = r.kind[0] == "?" and r.kind != "?comments"
        alone = r.main_words == page.main_words or r.inside and part
        if r.words and alone and r.words > (PART_SHARE if part else WHOLE_SHARE) * (page.words - r.words):
            found.add(r.place)
    return frozenset(found)


def read(source: str) -> Page:
    """The page without furniture. Only where a name would take nearly all of it, names are surveyed first."""
    page = Page(source)
    if page.records and spared(page):
        page = Page(source, spared(Page(source, survey=True)))
    return page


def region(page: Page, weights: dict[str, float]) -> tuple[int, int]:
    """Places in ``page.text`` (begin, end) of the best contiguous region; (0, 0) without a positive one.

    Words of one run of text count together; a run is never cut.
    """
    best = total = 0.0
    begin = best_begin = best_end = 0
    for kind, place in page.tokens:
        if place is None:
            total += weights.get(kind, weights["<>"])
        else:
            n = len(page.text[int(place)][1].split())
            if total <= 0:
                total, begin = 0.0, int(place)
            total += n * weights[kind]
            if total > best:
                best, best_begin, best_end = total, begin, int(place) + 1
        total = max(total, 0.0)
    return best_begin, best_end


def main_text(source: str | None, weights: dict[str, float]) -> str:
    if not source:
        return ""
    page = read(source)
    begin, end = region(page, weights)
    return " ".join("".join(t for _, t in page.text[begin:end]).split())


def learn(pages: tuple[tuple[str, str], ...]) -> dict[str, float]:
    """Weight of each kind of token from labelled (html, main text) pages.

    A run of text is inside when the main text holds it; a tag is inside when it stands
    between the first and the last such run. A token scores its log-odds, as a share of all
    tokens inside and outside; only the signs are fixed: words outside links count at least
    LEAST, tags and words of links at most NEAR, and tags of the main element MILD.
    """
    inside, outside = Counter(), Counter()
    for source, text in pages:
        page = read(source)
        runs = {place: " ".join(page.text[int(place)][1].split()) for _, place in page.tokens if place is not None}
        marks = [i for i, (_, place) in enumerate(page.tokens) if place is not None and runs[place] and runs[place] in text]
        low, high = (marks[0], marks[-1]) if marks else (0, -1)
        for i, (kind, place) in enumerate(page.tokens):
            own = inside if low <= i <= high else outside
            own[kind] += 1 if place is None else len(runs[place].split())
            own["<>"] += place is None and kind != "<main>"
    kinds = {*inside, *outside, "main", "word", "link", "<main>", "<>"}
    n_in, n_out = (sum(own.values()) - own["<>"] + 1 for own in (inside, outside))
    odds = {k: math.log((inside[k] + 0.5) / n_in) - math.log((outside[k] + 0.5) / n_out) for k in kinds}
    return {k: MILD if k == "<main>" else max(v, LEAST) if k in ("main", "word") else min(v, NEAR) for k, v in odds.items()}


#: Hand-labelled pages: html and its main text.
LABELLED = (
    (
        "<html><body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a> <a href=/w>Weather</a></div><div><h1>River rises after a week of rain</h1><p>The river rose again on Monday, and the lower meadow is under water for the third time this year.</p><p>Farmers moved their sheep to the hill in good time, the council said, and no house was reached.</p></div><div><a href=1>Bridge closed</a><a href=2>School opens</a><a href=3>Market day</a></div></body></html>",
        "River rises after a week of rain The river rose again on Monday, and the lower meadow is under water for the third time this year. Farmers moved their sheep to the hill in good time, the council said, and no house was reached.",
    ),
    (
        "<html><body><header><h2>The Daily Page</h2></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><main><h1>How to bake bread</h1><p>Mix flour, water, salt and yeast, and let the dough rest for an hour in a warm place.</p><ul><li>500 g of flour</li><li>7 g of yeast</li></ul><p>Bake it hot for forty minutes.</p></main><aside><h3>More</h3><a>Soup</a></aside><footer>All rights reserved</footer></body></html>",
        "How to bake bread Mix flour, water, salt and yeast, and let the dough rest for an hour in a warm place. 500 g of flour 7 g of yeast Bake it hot for forty minutes.",
    ),
    (
        "<html><body><article><h1>A short note</h1><p>Only one paragraph, with a <a href=x>link</a> in it.</p></article><div class=comments><p>First!</p><p>I do not agree with this at all.</p></div><div class='cookie-notice'>We use cookies.</div></body></html>",
        "A short note Only one paragraph, with a link in it.",
    ),
    (
        "<table><tr><td><a>Index</a><br><a>Archive</a><br><a>Contact</a></td><td><font><b>Letter from the coast</b><br><br>We arrived late in the evening, when the boats were already in, and the whole harbour smelled of tar and salt.<br>In the morning the wind had turned.</font></td><td><a>Links</a><br><a>Guests</a></td></tr></table>",
        "Letter from the coast We arrived late in the evening, when the boats were already in, and the whole harbour smelled of tar and salt. In the morning the wind had turned.",
    ),
    (
        "<body><div><span><a>Sign in</a></span><span><a>Help</a></span></div><div><div><p>The museum shows forty drawings from the last century, most of them for the first time, and some have never been framed before.</p><blockquote>They were in a box under the stairs.</blockquote><p>It is open daily except on Mondays.</p></div></div><div><span>Tags:</span><a>art</a><a>museum</a></div><div><a>Terms</a><a>Privacy</a></div></body>",
        "The museum shows forty drawings from the last century, most of them for the first time, and some have never been framed before. They were in a box under the stairs. It is open daily except on Mondays.",
    ),
)


VOCABULARY = "river rain meadow farmer sheep hill council house bread flour water salt yeast oven note letter coast evening boat harbour tar morning wind museum drawing century frame box stairs road bridge school market".split()
CAPTIONS = ("Tags", "Credit", "Views", "Page", "Section", "Updated", "Author", "Shop")
#: Layouts of the made pages: block, heading, paragraph and item tags of the text; the tags of a list of links and of its items.
TEXT_TAGS = (("div", "h1", "p", "li"), ("div", "h2", "p", "li"), ("section", "h1", "p", "blockquote"), ("td", "b", "p", "li"), ("div", "h1", "div", "div"), ("span", "h3", "p", "pre"))
LINK_TAGS = (("ul", "li"), ("div", "span"), ("table", "td"), ("div", "div"), ("p", "b"), ("ol", "li"))
MADE_PAGES = 300


def made(n: int = MADE_PAGES, seed: int = 7) -> tuple[tuple[str, str], ...]:
    """Labelled pages made by a rule: a text in one of several layouts among lists of links, short captions and lines of credit."""
    draw, out = random.Random(seed), []
    sentence = lambda low, high: " ".join(draw.choices(VOCABULARY, k=draw.randint(low, high))).capitalize() + "."
    for _ in range(n):
        block, heading, para, item = draw.choice(TEXT_TAGS)
        parts, text = [], []

        def put(tag: str, words: str, inner: str | None = None) -> None:
            parts.append(f"<{tag}>{inner or words}</{tag}>")
            text.append(words)

        put(heading, sentence(3, 8))
        for _ in range(draw.randint(1, 12)):
            words = sentence(8, 60)
            turn = draw.random()
            if turn < 0.15:
                first, rest = words.split(" ", 1)
                put(para, words, f"<a href=x>{first}</a> {rest}" if turn < 0.1 else f"<em>{first}</em> {rest}")
            elif turn < 0.25:
                put(item, sentence(2, 8))
            elif turn < 0.32:
                put("h2", sentence(2, 5))
            else:
                put(para, words)

        def links() -> str:
            around, each = draw.choice(LINK_TAGS)
            return f"<{around}>" + "".join(f"<{each}><a href=x>{' '.join(draw.choices(VOCABULARY, k=draw.randint(1, 6)))}</a></{each}>" for _ in range(draw.randint(2, 12))) + f"</{around}>"

        def caption() -> str:
            tag = draw.choice(("div", "span", "td", "h3", "li"))
            return f"<div><{tag}>{' '.join(draw.choices(CAPTIONS, k=draw.randint(1, 3)))}</{tag}></div>"

        def blurb() -> str:
            return "".join(f"<div><div><a href=x>{sentence(3, 8)}</a></div><div><span>{' '.join(draw.choices(CAPTIONS, k=draw.randint(1, 12)))}</span></div></div>" for _ in range(draw.randint(1, 5)))

        def margin() -> str:
            return "".join(f"<div>{draw.choice((links, links, blurb, caption))()}</div>" for _ in range(draw.randint(1, 4)))

        name = draw.choice(("", "", " class=box", " id=c1", " class=col-8"))
        out.append((f"<html><body>{margin()}<{block}{name}>{''.join(parts)}</{block}>{margin()}</body></html>", " ".join(text)))
    return tuple(out)


@cache
def learned() -> dict[str, float]:
    """The weights of the operator, from the made pages and the hand-labelled ones."""
    return learn((*made(), *LABELLED))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``."""
    weights = learned()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
