"""Main texts of web pages by composite text density.

A tolerant reader builds the tree of a page in one pass. Elements that are no article text by their tag, role, class or
id (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are marked, a
class or id counting only where all of its words are boilerplate. A marked element is left out, unless it is the wrapper
of the page: it holds most of the text, and an article, a main element or a first-level heading besides. Of one that is
never ended only its own text is left out, as nobody knows what it was to hold.

An element is suspect if a class or id of it begins or ends with a word of reader comments or adverts ('comment-thread',
'google-ads'), unless another word only states whether there are any ('comments-open', 'ad-free'). A suspect one goes as
well, but not if it holds nine tenths of the page's text, nor if a heading in it has another word of the same class or
id, as then that is the subject ('ad-hoc-networks'). An article can be suspect of being a comment, and then isn't a heart
of the page that would save what is around it.

For every node that stays the characters per tag are computed and lowered by the share of links among them; a node's
density sum is the sum of its children's densities. The node with the greatest sum is the core of the article, and the
least density on its path to the body is the threshold: of every subtree that is as dense as the threshold the node of
the greatest sum is taken. On the way up from the core, a parent below the body is taken in as long as what it adds is
as dense as the threshold or hardly linked, and a heading right before anything taken is taken, too. What is taken is
joined in page order, whole. Density alone decides; no element is taken for its tag.

White space in a block becomes one space, character references are decoded, and blocks are joined by an empty line.
A null or empty page, and one without text, has an empty text. Very long pages, deep ones and ones with thousands of
unended tags or quotes take time in proportion to their length.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaywise.llm import textkit
from quaywise.llm.tables import text_of

# Fixed values of HTML and of common usage in pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes svg math".split())
#: Raw elements whose content runs to the end of the page where they are never ended.
TO_THE_END = frozenset("script style title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form button select option optgroup datalist dialog menu object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbygoogle adsense banner banners cookie cookies consent gdpr notice notices notification "
    "popup popups modal overlay newsletter subscribe subscription promo promos promotion promoted sponsor sponsored sponsors sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer footers topbar toolbar comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended recommendations widget widgets pagination pager login signup masthead skip tags".split()
)
#: Words that say nothing of what an element holds: a token of these and of boilerplate words is boilerplate as a whole.
FILLERS = frozenset("area bar block bottom box center col column container content footer global header inner item left link links list main nav outer page panel primary right section secondary site top wrap wrapper".split())
#: The words that a paragraph is left out for.
ADVERTS = frozenset(w for w in NAMES if w.startswith(("ad", "sponsor")))
#: Words of reader comments, which an element is suspect for, and words that say only whether there are comments or adverts.
COMMENTS = frozenset("comment comments commenter commenters commentlist disqus replies reply respond".split())
STATES = frozenset("allowed closed disabled enabled free has hide no not off on open show with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never left out by class or id.
NAMED_FREELY = HEADINGS | {"main", "article"}
#: Elements that a page's wrapper holds.
HEARTS = frozenset("article main h1".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements whose end tag may be left out.
OPTIONAL = frozenset(("p", *CLOSES))

#: What a class or id says of an element, and what its tag, role or style says.
BY_NAME, BY_KIND, HIDDEN, SUSPECT = 1, 2, 3, 4

_MARKUP = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_NO_VALUES = re.compile(r"[^>=\"']*>")
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)


def _is_boilerplate(token: str, names: frozenset[str]) -> bool:
    """Whether all of a class or id is boilerplate: 'sidebar', 'top-menu', 'AdBox', but not 'with-sidebar' or 'social-impact'."""
    words = [w.lower() for w in _WORD.findall(token) if not w.isdigit()]
    return any(w in names for w in words) and all(w in names or w in FILLERS for w in words)


def _suspect(token: str, names: frozenset[str]) -> set[str] | None:
    """If a class or id begins or ends with one of the names (fillers aside), its other words; else None."""
    words = [w.lower() for w in _WORD.findall(token) if not w.isdigit()]
    core = [w for w in words if w not in FILLERS]
    if not core or not STATES.isdisjoint(words) or not (core[0] in names or core[-1] in names):
        return None
    return set(core) - names


def _suspicion(tag: str, attrs: dict[str, str]) -> set[str] | None:
    """What else the classes and ids say that make an element suspect, or None."""
    names = COMMENTS if tag == "article" else ADVERTS if tag == "p" else COMMENTS | ADVERTS
    found = [s for key in ("class", "id") for token in attrs.get(key, "").split() if (s := _suspect(token, names)) is not None]
    return set().union(*found) if found else None


def _mark(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """Why an element is to be left out, or 0; inside: within an article or main element, where a header belongs to the article."""
    if tag in DROPPED or tag == "header" and not inside:
        return BY_KIND
    if not attrs:
        return 0
    if "hidden" in attrs and attrs["hidden"].lower() != "until-found" or attrs.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(attrs.get("style", "")):
        return HIDDEN
    if tag == "article" and _suspicion(tag, attrs) is not None:
        return SUSPECT
    if tag in NAMED_FREELY:
        return 0
    if attrs.get("role", "").lower() in ROLES:
        return BY_KIND
    names = ADVERTS if tag == "p" else NAMES if inside else NAMES | {"header"}
    if any(_is_boilerplate(token, names) for key in ("class", "id") for token in attrs.get(key, "").split()):
        return BY_NAME
    return 0 if _suspicion(tag, attrs) is None else SUSPECT


class Page:
    """The tree of a page in document order; node 0 is the body.

    Open elements are found by tag and by kind through lists of their places in the stack, so that reading takes time in
    proportion to the page, however deep or broken it is.
    """

    def __init__(self, page: str) -> None:
        self.tags, self.parents, self.marks, self.ended = ["body"], [-1], [0], [True]
        self.subjects: dict[int, set[str]] = {}  # of suspect nodes: the words that say what else they may be of
        self.events: list[tuple[int, str | None]] = []  # node and text, None at the edge of a block
        self.first, self.past = [0], [0]
        self._stack, self._at = [0], {}
        self._blocks, self._inside = [0], 0
        self._unended: set[str] = set()  # quotes and raw elements that no later place of the page ends
        self._read(page)
        while self._stack:
            self._pop(False)
        self._leave_out()

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _MARKUP.search(page, at)
            if m is None:
                self._text(page[at:])
                return
            if m.start() > at:
                self._text(page[at : m.start()])
            if m[2] is None:
                close = "-->" if m[0] == "<!--" else ">"
                end = page.find(close, m.end())
                at = n if end < 0 else end + len(close)
                continue
            attrs, at = self._attributes(page, m.end())
            tag = m[2].lower()
            if tag in ("html", "head", "body"):
                continue
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                self.events.append((self._stack[-1], " "))
                at = self._behind_raw(page, at, tag)
            else:
                self._open(tag, attrs)

    def _attributes(self, page: str, at: int) -> tuple[dict[str, str], int]:
        """The attributes of a tag whose name ends there (the first of each name counts), and the position behind the tag."""
        found: dict[str, str] = {}
        if m := _NO_VALUES.match(page, at):
            inner = m[0][:-1]
            return (dict.fromkeys(inner.lower().replace("/", " ").split(), "") if inner else found), m.end()
        n = len(page)
        while (at := _GAP.match(page, at).end()) < n:
            if page[at] == ">":
                return found, at + 1
            m = _NAME.match(page, at)
            name, value, at = m[0].lower(), "", m.end()
            if m := _EQUALS.match(page, at):
                at = m.end()
                quote = page[at : at + 1]
                end = page.find(quote, at + 1) if quote in ("'", '"') and quote not in self._unended else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    if quote in ("'", '"'):
                        self._unended.add(quote)
                    m = _BARE.match(page, at)
                    value, at = m[0], m.end()
            found.setdefault(name, html.unescape(value) if "&" in value else value)
        return found, n

    def _behind_raw(self, page: str, at: int, tag: str) -> int:
        if tag not in self._unended:
            if m := re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at):
                return self._attributes(page, m.end())[1]
            self._unended.add(tag)
        return len(page) if tag in TO_THE_END else at

    def _text(self, text: str) -> None:
        self.events.append((self._stack[-1], html.unescape(text) if "&" in text else text))

    def _last(self, tags: tuple[str, ...]) -> int:
        """The highest place in the stack of an open element of these tags, or -1."""
        return max((places[-1] for t in tags if (places := self._at.get(t))), default=-1)

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BLOCK and self._blocks[-1] and self.tags[self._stack[self._blocks[-1]]] == "p":
            self._pop_to(self._blocks[-1], False)
        if tag in CLOSES and (place := self._last(CLOSES[tag])) > self._last(LISTS[tag]):
            self._pop_to(place, False)
        parent = self._stack[-1]
        if tag in VOID:
            self.events.append((parent, None if tag == "hr" else " " if tag == "br" else ""))
            return
        mark = _mark(tag, attrs, self._inside > 0)
        if tag in BLOCK:
            self.events.append((parent, None))
        elif mark:
            self.events.append((parent, " "))
        self.tags.append(tag)
        self.parents.append(parent)
        self.marks.append(mark)
        if mark == SUSPECT:
            self.subjects[len(self.tags) - 1] = _suspicion(tag, attrs) or set()
        self.ended.append(False)
        self.first.append(len(self.events))
        self.past.append(0)
        place = len(self._stack)
        self._at.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self._blocks.append(place)
        self._inside += tag in ("article", "main")
        self._stack.append(len(self.tags) - 1)

    def _pop(self, ended: bool) -> None:
        node = self._stack.pop()
        tag = self.tags[node]
        self.past[node] = len(self.events)
        self.ended[node] = ended or tag in OPTIONAL
        if not self._stack:
            return
        self._at[tag].pop()
        if self._blocks[-1] == len(self._stack):
            self._blocks.pop()
            self.events.append((self._stack[-1], None))
        self._inside -= tag in ("article", "main")

    def _pop_to(self, place: int, ended: bool) -> None:
        while len(self._stack) > place + 1:
            self._pop(False)
        self._pop(ended)

    def _close(self, tag: str) -> None:
        place = self._last((tag,))
        if place > 0 and (tag in BLOCK or place > self._blocks[-1]):
            self._pop_to(place, True)

    def _leave_out(self) -> None:
        """Settles which nodes are out with all that they hold, and which are mute: without their own text."""
        n = len(self.tags)
        own = [0] * n
        for node, text in self.events:
            if text:
                own[node] += len(text) - text.count(" ")
        held, heart = own[:], [t in HEARTS and m != SUSPECT for t, m in zip(self.tags, self.marks, strict=True)]
        for i in range(n - 1, 0, -1):
            held[self.parents[i]] += held[i]
            heart[self.parents[i]] = heart[self.parents[i]] or heart[i] and self.marks[i] != HIDDEN
        self.out, self.mute = [False] * n, [False] * n
        named = self._named()
        for i in range(1, n):
            if self.out[self.parents[i]]:
                self.out[i] = True
            elif self.marks[i]:
                if not self.ended[i]:
                    self.mute[i] = True
                elif self.marks[i] == SUSPECT:
                    self.out[i] = i not in named and 10 * held[i] <= 9 * held[0] and (2 * held[i] <= held[0] or not heart[i])
                elif self.marks[i] == HIDDEN or 2 * held[i] <= held[0] or not heart[i]:
                    self.out[i] = True

    def _named(self) -> set[int]:
        """The suspect nodes that have a heading (of those in no other suspect node inside) with a word of their subject."""
        if not self.subjects:
            return set()
        n = len(self.tags)
        near, heading = [-1] * n, [-1] * n
        for i in range(1, n):
            p = self.parents[i]
            near[i] = i if i in self.subjects else near[p]
            heading[i] = i if self.tags[i] in HEADINGS else heading[p]
        return {near[node] for node, text in self.events if text and heading[node] >= 0 and near[node] >= 0 and not self.subjects[near[node]].isdisjoint(w.lower() for w in _WORD.findall(text))}

    def densities(self) -> tuple[list[float], list[float], list[int], list[int], list[int]]:
        """Of each node its density and density sum, and the characters, linked characters and tags it holds."""
        n = len(self.tags)
        chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
        is_link = [t == "a" for t in self.tags]
        for i in range(1, n):
            is_link[i] = is_link[i] or is_link[self.parents[i]]
        for node, text in self.events:
            if text and not self.out[node] and not self.mute[node]:
                size = len("".join(text.split()))
                chars[node] += size
                if is_link[node]:
                    linked[node] += size
        for i in range(n - 1, 0, -1):
            if not self.out[i]:
                p = self.parents[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                tags[p] += tags[i] + 1
                links[p] += links[i] + (self.tags[i] == "a")
        part = linked[0] / max(chars[0], 1)

        def density(i: int) -> float:
            c, lc, t, lt = chars[i], linked[i], max(tags[i], 1), max(links[i], 1)
            if not c:
                return 0.0
            base = math.log(c / max(c - lc, 1) * lc + part * c + math.e)
            share = c / max(lc, 1) * t / lt
            return c / t * (math.log(share + 1e-9, base) if base > 1 else math.log(max(share, 1.0) + 1e-9))

        dense = [density(i) for i in range(n)]
        sums = [0.0] * n
        for i in range(1, n):
            sums[self.parents[i]] += dense[i]
        return dense, sums, chars, linked, tags

    def article(self) -> list[tuple[int, int]]:
        """The first and the past-the-end event of each part of the article, in page order."""
        dense, sums, chars, linked, tags = self.densities()
        n = len(self.tags)
        if not chars[0]:
            return []
        core = max(range(n), key=lambda i: (sums[i], -i)) if n > 1 else 0
        path = [core]
        while path[-1]:
            path.append(self.parents[path[-1]])
        least = min(dense[i] for i in path)
        best = core
        for up in path[1:-1]:
            more, more_linked, more_tags = chars[up] - chars[best], linked[up] - linked[best], tags[up] - tags[best]
            if more and more / max(more_tags, 1) < least and more_linked > 0.3 * more:
                break
            best = up
        top = list(range(n))  # of each subtree, the node with the greatest sum
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            if (sums[top[i]], -top[i]) > (sums[top[p]], -top[p]):
                top[p] = top[i]
        kept = [False] * n
        kept[best] = True
        for i in range(n):
            if chars[i] and dense[i] >= least and not self.out[i]:
                kept[top[i]] = True
        for i in range(1, n):  # within what is kept
            kept[i] = kept[i] or kept[self.parents[i]]
        holds = list(kept)
        for i in range(n - 1, 0, -1):
            holds[self.parents[i]] = holds[self.parents[i]] or holds[i]
        follows: dict[int, bool] = {}  # by parent: whether the next child holds a part of the article
        for i in range(n - 1, 0, -1):
            if self.out[i]:
                continue
            p = self.parents[i]
            if self.tags[i] in HEADINGS and follows.get(p, False):
                kept[i] = True
            else:
                follows[p] = holds[i]
        if kept[0]:
            return [(self.first[0], self.past[0])]
        return [(self.first[i], self.past[i]) for i in range(1, n) if kept[i] and not kept[self.parents[i]]]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tree = Page(page)
    blocks, now = [], []
    for node, text in [e for a, b in tree.article() for e in [*tree.events[a:b], (0, None)]]:
        if text is None:
            if block := " ".join("".join(now).split()):
                blocks.append(block)
            now = []
        elif not tree.out[node] and not tree.mute[node]:
            now.append(text)
    return "\n\n".join(blocks)


@F.arrow_udf(T.StringType())
def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array((main_text(p) for some in textkit.sliced(pages) for p in some), pa.string())


def extracted(page: str = "html") -> Column:
    return _main_texts(text_of(page))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages."""
    rows = pages.select("page_id", "url", extracted().alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
