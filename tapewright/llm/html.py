"""Main text of web pages, without what their site repeats.

Every page is parsed into elements (unclosed and stray tags are put right the
way browsers do for the common cases).  Container elements are hashed as
subtrees, and Spark counts in how many different articles of a host each hash
recurs; subtrees that recur in many are the host's template and are deleted.
Besides those, elements whose tag, or whole role, class name or id, says that
they are no article text (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, comments) are left out; articles and what holds them
are never left out by class, nor headings and paragraphs by id, and inside an
article words like notice or share say nothing of paragraphs and sections.  An
article's own header stays if it holds a heading.  If a page has article
elements, or else a main element, only these count.

Paragraphs, list items and the like are hashed as well as containers.  What
recurs with 3 different articles of a host is template, but inside an article
or main element only a sentence at its edge, or else what at least 5 and at
least half of the host's articles have: "Yes." may well stand in a few.
Headings are never template.  Articles
count as different by their first h1 or h2, or else by their longest block
other than the one counted (without one, by their text), so copies and near
copies of an article are no template of their host.

A page is parsed once: what is kept of it whatever its host repeats, and where
in it which subtrees stand, is written down; templates are then cut out of
that, so no page is shuffled with its markup.  Subtrees are hashed from one
running sum over the page, however deep they are nested.

Edge cases: null and empty pages have an empty text; pages that share a
page_id are each extracted, with the templates of their own host; pages
without page_id or host lose no template subtrees; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import mix64, powers, signed, slices
from ._spark import BitFilter, map_batches, settle

_ATTRS = r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})>|<[!?/][^>]*+>|<[a-zA-Z][^<>]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""", re.I)
_OPEN = re.compile(r"\bopen\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")

RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea input dialog menu head title".split())
CONTAINERS = frozenset("div section aside ul ol dl table form figure nav header footer menu details fieldset center".split())
#: Blocks that are hashed as well, where they hold no other block.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote address pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp math object audio video canvas map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("table td th button article section div ul ol dl body html".split())
#: Whole class names, ids or roles that mark an element as no article text.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs
footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments
disqus respond reply replies login signup toolbar pagination pager widget widgets complementary contentinfo search skip site-header site-footer site-nav main-nav nav-menu ad-banner ad-slot cookie-banner cookie-notice cookie-consent
share-buttons social-share related-posts related-articles comments-area comment-list skip-link""".split())
#: Marks that are plain words, too: inside an article they don't mark these elements.
WORDS = frozenset("notice notices share sharing social search skip promo promotion sponsor related recommended recommendations comment comments reply replies respond login signup subscribe subscription banner header footer menu menus navigation widget widgets modal overlay popup pager toolbar".split())
PROSE = frozenset("p section blockquote li dl dt dd ul ol table td th tr figure figcaption pre address span b i em strong".split())
#: Never marked; the second ones not by their id, which names what they are about.
UNMARKED, BY_CLASS = frozenset("html body main article".split()), frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Marks that hold also around articles, if another one stands outside.
AROUND = frozenset("comment comments comments-area comment-list disqus replies related related-posts related-articles recommended recommendations".split())


#: Words of a block that hardly recurs by chance.
SENTENCE = 5
#: Template subtrees that are sent to all workers at most (32 MB); more are joined by shuffling.
MOST_SENT = 2**21


@dataclass(frozen=True)
class Template:
    """A subtree is template if it stands with at least `articles` different articles of its host; inside an article or main element, but for a sentence at its edge, with `inside` and `share` of the host's."""

    articles: int = 3
    inside: int = 5
    share: float = 0.5


class Page:
    """Elements as (tag, parent, first piece, end piece, start, end, left out), and pieces of text; a piece that is None is a block's edge."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#"]
        self.parents: list[int] = [-1]
        self.spans: list[list[int]] = [[0, 0]]
        self.places: list[list[int]] = [[0, len(source)]]
        self.out: list[bool] = [False]
        self.hid: list[bool] = [False]
        self.marks: dict[int, frozenset[str]] = {}
        self.pieces: list[str | None] = []
        self.source = source
        self._parse(source)

    def _parse(self, source: str) -> None:
        at, n, stack = 0, len(source), [0]

        def close(to: int, where: int) -> None:
            while len(stack) > to:
                e = stack.pop()
                self.spans[e][1], self.places[e][1] = len(self.pieces), where
                if self.tags[e] not in INLINE:
                    self.pieces.append(None)

        def find(names, until=frozenset()) -> int:
            for i in range(len(stack) - 1, 0, -1):
                if self.tags[stack[i]] in names:
                    return i
                if self.tags[stack[i]] in until:
                    break
            return 0

        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self.pieces.append(source[at:])
                break
            if m.start() > at:
                self.pieces.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                i = find((tag,))
                if i:
                    close(i, at)
                elif tag in ("p", "br"):
                    self.pieces.append(None)
                continue
            if tag in CLOSES_P and (i := find(("p",), SCOPES)):
                close(i, m.start())
            if (names := SIBLINGS.get(tag)) and (i := find(names, ("table", "ul", "ol", "dl", "select"))):
                close(i, m.start())
            if tag not in INLINE:
                self.pieces.append(None)
            if tag in VOID:
                continue
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.spans.append([len(self.pieces), 0])
            self.places.append([m.start(), n])
            hidden, marks = self._marked(m[3], tag) if m[3] else (False, frozenset())
            if marks and tag in PROSE and any(self.tags[e] in ("article", "main") for e in stack):
                marks -= WORDS
            if marks:
                self.marks[len(self.out)] = marks
            self.hid.append(hidden)
            self.out.append(hidden or bool(marks) or tag in LEFT_OUT and not (tag == "dialog" and _OPEN.search(m[3])))
            stack.append(len(self.tags) - 1)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else n
                close(len(stack) - 1, at)
        close(1, n)
        self.spans[0][1] = len(self.pieces)
        self._keep_headings()
        if self.marks:
            self._unmark_wrappers()

    @staticmethod
    def _marked(attrs: str, tag: str) -> tuple[bool, frozenset[str]]:
        """Whether the element is hidden, and its marks."""
        marks = set()
        for name, value in _NAMED.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if (name == "hidden" or name == "aria-hidden" and value == "true") and tag not in ("html", "body", "main"):
                return True, frozenset()
            if name in ("class", "role") or name == "id" and tag not in BY_CLASS:
                marks |= MARKS.intersection(value.split())
        return False, frozenset(marks) if tag not in UNMARKED else frozenset()

    def _keep_headings(self) -> None:
        """An article's own header with a heading in it is left in, unless it is marked or hidden."""
        for e, tag in enumerate(self.tags):
            if tag in HEADINGS:
                above = list(self._above(e))
                at = next((i for i, a in enumerate(above) if self.tags[a] == "header"), None)
                if at is not None and any(self.tags[a] == "article" for a in above[at + 1 :]) and above[at] not in self.marks and not self.hid[above[at]]:
                    self.out[above[at]] = False

    def _unmark_wrappers(self) -> None:
        """Marks say nothing of what holds an article or main element, but for comments and links beside another one."""
        held = [e for e, t in enumerate(self.tags) if t in ("article", "main")]
        holders = {a for e in held for a in self._above(e)} & self.marks.keys()
        for a in holders - {a for a in holders if self.marks[a] & AROUND}:
            self.out[a] = self.tags[a] in LEFT_OUT
        hidden = self.hidden()
        if all(hidden[e] for e in held):
            for a in holders:
                self.out[a] = self.tags[a] in LEFT_OUT

    def roots(self) -> list[int]:
        """Elements whose text counts: articles, or else main elements, or else everything."""
        hidden = self.hidden()
        for tag in ("article", "main"):
            if found := [e for e, t in enumerate(self.tags) if t == tag and not hidden[e]]:
                every = set(found)
                return [e for e in found if not any(a in every for a in self._above(e))]
        return [0]

    def _above(self, e: int):
        while (e := self.parents[e]) >= 0:
            yield e

    def hidden(self) -> list[bool]:
        out = list(self.out)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parents[e]]
        return out

    def subtrees(self) -> dict[int, int]:
        """Hash by container element, over its tags and text with white space evened out; none for those that hold an article."""
        holds = {a for e in range(1, len(self.tags)) if self.tags[e] in ("article", "main") for a in self._above(e)}
        parts = {self.parents[e] for e, tag in enumerate(self.tags) if tag in CONTAINERS or tag in LEAVES}
        hashed = [e for e, tag in enumerate(self.tags) if (tag in CONTAINERS or tag in LEAVES and e not in parts) and e not in holds]
        return dict(zip(hashed, _slice_hashes(self.source, [self.places[e] for e in hashed]))) if hashed else {}

    def longest(self, hashes: dict[int, int]) -> list[int]:
        """By hash, what near copies of an article mostly share: its first h1 or h2, or else its two longest leaf blocks."""
        hidden, found = self.hidden(), self.roots()
        roots = [self.places[r] for r in found]
        if found != [0]:
            for e in sorted(hashes):
                if self.tags[e] in ("h1", "h2") and not hidden[e] and any(a <= self.places[e][0] < b for a, b in roots):
                    return [hashes[e]] * 2
        size = lambda e: self.places[e][1] - self.places[e][0]
        own = {h: size(e) for e, h in hashes.items() if self.tags[e] in LEAVES and not hidden[e] and any(a <= self.places[e][0] < b for a, b in roots)}
        return sorted(own, key=lambda h: (-own[h], h))[:2]

    def guarded(self, hashes: dict[int, int]) -> set[int]:
        """Hashes that stand inside an article or main element, but for a sentence that is its first or last block."""
        held = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            held[e] = held[self.parents[e]] or self.tags[e] in ("article", "main")
        hidden, free = self.hidden(), set()
        leaves = [e for e in sorted(hashes) if held[e] and self.tags[e] in LEAVES and self.tags[e] not in HEADINGS and not hidden[e]]
        for r in self.roots():
            a, b = self.places[r]
            own = [e for e in leaves if a <= self.places[e][0] < b]
            free |= {e for e in (own[:1] + own[-1:]) if self._words(e) >= SENTENCE}
        return {h for e, h in hashes.items() if held[e] and e not in free}

    def _words(self, e: int) -> int:
        return len(" ".join(p or " " for p in self.pieces[slice(*self.spans[e])]).split())

    def kept(self, hashes: dict[int, int]) -> tuple[str, list[int], list[int], list[int]]:
        """The roots' text without what is left out, raw, and where in it (hash, begin, end) the hashed subtrees stand, if they hold any of it."""
        gone = np.zeros(len(self.pieces) + 1, np.int32)
        for e, out in enumerate(self.out):
            if out:
                gone[self.spans[e][0]] += 1
                gone[self.spans[e][1]] -= 1
        gone = (np.cumsum(gone[:-1]) > 0).tolist()
        parts, at = [], np.zeros(len(self.pieces) + 1, np.int64)
        inside, length = np.zeros(len(self.pieces) + 1, bool), 0
        for r in self.roots():
            a, b = self.spans[r]
            parts.append(" ")
            length += 1
            for i in range(a, b):
                at[i] = length
                piece = " " if self.pieces[i] is None else "" if gone[i] else self.pieces[i]
                parts.append(piece)
                length += len(piece)
            at[b], inside[a : b + 1] = length, True
        text, found = "".join(parts), ([], [], [])
        for e, h in hashes.items():
            a, b = self.spans[e]
            if self.tags[e] not in HEADINGS and inside[a] and inside[b] and text[at[a] : at[b]].strip():
                for values, x in zip(found, (h, int(at[a]), int(at[b]))):
                    values.append(x)
        return text, *found

    def text(self, template: set[int] = frozenset()) -> str:
        raw, hashes, begins, ends = self.kept(self.subtrees() if template else {})
        return plain(raw, [(a, b) for h, a, b in zip(hashes, begins, ends) if h in template])


def plain(raw: str, cuts: list[tuple[int, int]] = ()) -> str:
    """Raw text without the given stretches, character references decoded and white space evened out."""
    if cuts:
        parts, at = [], 0
        for a, b in sorted(cuts):
            parts.append(raw[at : max(at, a)])
            at = max(at, b)
        raw = "".join([*parts, raw[at:]])
    return _SPACE.sub(" ", entities.unescape(raw)).strip(" ")


def _slice_hashes(source: str, places: list[list[int]]) -> list[int]:
    """64-bit hashes of parts of a text, runs of white space counting as one space, from one running sum."""
    codes = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    count = np.ones(len(codes), bool)
    count[1:] = ~(space[1:] & space[:-1])
    place = np.concatenate([[0], np.cumsum(count)])
    up, down = powers(len(codes) + 1)
    terms = np.where(count, mix64(np.where(space, np.uint64(33), codes.astype(np.uint64) + np.uint64(1))), np.uint64(0)) * up[place[:-1]]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    begins, ends = np.array(places).T
    sizes = (place[ends] - place[begins]).astype(np.uint64)
    return mix64((sums[ends] - sums[begins]) * down[place[begins]] + sizes * np.uint64(0x9E3779B97F4A7C15)).tolist()


def _parsed(pages: DataFrame) -> DataFrame:
    """Of each page its raw text, where subtrees stand in it (hs, begins, ends), which article it is, and all subtrees' hashes."""

    def work(batch: pa.RecordBatch):
        for first, last, sources in slices(batch.column(4)):
            part = batch.slice(first, last - first)
            rows = []
            for source in sources:
                page = Page(source.decode("utf-8", "replace"))
                hashes = page.subtrees()
                raw, hs, begins, ends = page.kept(hashes)
                longest = page.longest(hashes)
                article = xxhash.xxh64_intdigest(plain(raw).encode("utf-8", "replace"))
                trees = sorted(set(hashes.values()))
                # A block that tells articles apart doesn't tell what it is itself.
                articles = [longest[0] if longest and longest[:1] == longest[1:] else next((x for x in longest if x != h), article) for h in trees]
                inside = page.guarded(hashes)
                story = longest[0] if longest else article
                rows.append((raw, _longs(hs), begins, ends, _longs(trees), _longs(articles), [h in inside for h in trees], int(_longs([story])[0])))
            names = ("raw", "hs", "begins", "ends", "trees", "articles", "inside", "story")
            yield {c: part.column(i) for i, c in enumerate(("rid", "page_id", "url", "host"))} | dict(zip(names, map(list, zip(*rows))))

    schema = "rid long, page_id long, url string, host long, raw string, hs array<long>, begins array<int>, ends array<int>, trees array<long>, articles array<long>, inside array<boolean>, story long"
    return map_batches(pages.select("rid", "page_id", "url", "host", "html"), work, schema)


def _longs(hashes: list[int]) -> np.ndarray:
    return signed(np.array(hashes, np.uint64))


def _repeated(trees: DataFrame, wanted: BitFilter) -> DataFrame:
    """trees without most of those whose hash h is not wanted."""
    shared = trees.sparkSession.sparkContext.broadcast(wanted)

    def work(batch: pa.RecordBatch):
        part = batch.filter(pa.array(shared.value.may_hold(batch.column(3).to_numpy())))
        yield dict(zip(part.schema.names, part.columns))

    return map_batches(trees.select("rid", "host", "article", "h", "inside"), work, "rid long, host long, article long, h long, inside boolean")


def extract(pages: DataFrame, t: Template = Template()) -> DataFrame:
    """page_id, url, text and n_template (subtrees deleted as template) for each row of pages."""
    named = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    pages = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("host", F.when(F.col("page_id").isNotNull() & (named != ""), F.xxhash64(named)))
    parsed = settle(_parsed(pages), "parsed", "zstd")
    trees = parsed.filter("host is not null").select("rid", "host", F.inline(F.arrays_zip(F.col("trees").alias("h"), F.col("articles").alias("article"), "inside")))
    # Few subtrees are on so many pages; the others needn't be told apart by article.
    often = settle(trees.groupBy("host", "h").agg(F.count("*").alias("pages")).filter(F.col("pages") >= t.articles).select("host", "h"), "often")
    trees = _repeated(trees, BitFilter(often.select("h").distinct()))
    held = trees.groupBy("host", "h", "article").agg(F.max("inside").alias("inside")).groupBy("host", "h").agg(F.count("*").alias("held"), F.max("inside").alias("inside")).filter(F.col("held") >= t.articles)
    stories = parsed.filter("host is not null").select("host", "story").distinct().groupBy("host").agg(F.count("*").alias("stories"))
    enough = ~F.col("inside") | (F.col("held") >= t.inside) & (F.col("held") >= t.share * F.col("stories"))
    template = settle(held.join(stories, "host").filter(enough).select("host", "h"), "template")
    columns = ["page_id", "url", "raw", "hs", "begins", "ends", "trees"]
    schema = "page_id long, url string, text string, n_template long"
    if template.count() <= MOST_SENT:
        shared = parsed.sparkSession.sparkContext.broadcast(_Keys(template))
        own = lambda part: shared.value.among(part.column(7), part.column(6))
        return map_batches(parsed.select(*columns, "host"), _cutting(own), schema)
    found = trees.join(template, ["host", "h"]).groupBy("rid").agg(F.collect_set("h").alias("template"))
    own = lambda part: [set(x or ()) for x in part.column(7).to_pylist()]
    return map_batches(parsed.select("rid", *columns).join(found, "rid", "left").select(*columns, "template"), _cutting(own), schema)


class _Keys:
    """Template subtrees (host, h), of a checked number, in order of their hosts."""

    def __init__(self, template: DataFrame):
        rows = template.select("host", "h").toArrow()
        host, h = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        order = np.argsort(host, kind="stable")
        self.host, self.h = host[order], h[order]

    def among(self, hosts: pa.Array, trees: pa.Array) -> list[set[int]]:
        """Which of each page's subtrees are its host's templates."""
        out, known = [], {}
        for host, own in zip(hosts.to_pylist(), trees.to_pylist()):
            if host not in known:
                a, b = (0, 0) if host is None else (np.searchsorted(self.host, host, side) for side in ("left", "right"))
                known[host] = set(self.h[a:b].tolist())
            out.append(known[host].intersection(own))
        return out


def _cutting(templates):
    """Work on batches whose columns are as in extract(); `templates` gives each page's."""

    def work(batch: pa.RecordBatch):
        for first, last, _ in slices(batch.column(2)):
            part = batch.slice(first, last - first)
            texts, n = [], []
            for raw, hs, begins, ends, own in zip(*(part.column(i).to_pylist() for i in range(2, 6)), templates(part)):
                texts.append(plain(raw, [(a, b) for h, a, b in zip(hs, begins, ends) if h in own]))
                n.append(len(own))
            yield {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_template": n}

    return work
