"""Main text of web pages by deducing each host's template from equivalence classes.

A token is an element's place in a page (its tag and names below its
parents'), or a block of text in such a place. A host's tokens with the same occurrence vector (how often each occurs on
each page) form an equivalence class. Vectors are never built and classes never listed: a token's vector is
named by a sum of hashes of (page, count), and what is asked of its class (pages,
least and most a page, different texts) is added up beside it before the shuffle,
so a host with a third of all pages is no large group. The class of the vector
(1, 1, ..., 1) is what all pages have; a class that occurs once on each page of a
part of the pages is the template of a layout. A layout counts with two pages of different
texts and RARE of its host's pages. Other classes are nested in it: a place includes
its parents', so they keep their nesting. Of those on SHARE of the pages of the article or body's part around
them, whatever their vectors, elements of link text are menus and
blocks with the same words, as often on each of their pages, are template; both go. Pages without elements count nowhere. The template
slot that holds the main text is an article or main element, or else the deepest one with nearly
all the text, of the pages that have it, that no menu, header, footer, advert or the like has. Pages then
yield what that slot holds, whatever it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import batches as arrow
from rostrum.plans import scratch

# Fixed values of HTML: elements without content, elements that aren't part of a text, and elements that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("aside button dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key closes an open element of these, not looking past the barrier.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role by which authors mark what isn't the text.
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline-share|comments?|comment-list|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|related|replies|share|sharing|sidebar|side-bar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)

#: Elements whose ids are made from titles.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p section".split())

#: What stands in a tag: no other tag's beginning, unless in quotes. No part is read twice, so the time is linear in the page.
_INSIDE = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<(script|style)\b{_INSIDE}>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/<>]*+)({_INSIDE})>|<[!?/][^>]*+(?:>|$)|[^<]+|<", re.S | re.I)
_ENDS = re.compile(r"</([a-zA-Z][^\s/<>]*+)")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
_SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=])", re.I)
#: Share of the text that a slot without an article must hold, and of link text that makes a list a menu.
MOST, LINKS = 0.8, 0.9
#: Share of link text that drops what has a hint among other words of its name.
HINTED_LINKS = 0.5
#: A slot must be on this share of its host's pages, and on two pages with different texts; rarer layouts are judged page by page.
#: So a host has at most 1 / RARE slots a level of nesting, whatever its size.
RARE = 0.05
#: Menus and constant blocks of text must be on this share of the pages with what they are anchored in, on FEW pages where that has different texts.
SHARE, FEW = 0.5, 4
#: Hosts up to this many send their templates to all executors; beyond, pages meet them by a shuffle.
BROADCAST_HOSTS = 50_000
ROOT = 0
#: In place of a tag for blocks of text.
TEXT = "#"
#: A form with this share of the page's text is what the page lies in.
WRAPS = 0.5
#: Elements that authors forget to close before the main text.
LEFT_OPEN = ("nav", "aside", "form", "header", "menu")


#: What a hint is: among other words in an id or in a class or role, the whole id of a section, the whole of another name.
ID, CLASS, SECTION, WHOLE = 1, 2, 3, 4


def _hint(tag: str, names: list[tuple[str, str]]) -> int:
    """How far an element's names say that it isn't text; ids of headings and paragraphs, made from titles, don't."""
    best = 0
    if tag in ("html", "body", "article", "main"):
        return best
    for kind, value in names:
        titled = kind == "id" and tag in TITLED
        plain = tag in TITLED and tag != "section"
        for x in value.split():
            if titled and tag != "section" or not HINT.search(x):
                continue
            # separators are doubled so that neighbours don't share one; a paragraph with another class beside it is text
            if not (plain and len(value.split()) > 1) and (HINT.fullmatch(x) or not HINT.sub("", re.sub(r"[_-]", r"\g<0>\g<0>", x)).strip("_-")):
                best = max(best, SECTION if titled else WHOLE)
            else:
                best = max(best, ID if kind == "id" else CLASS)
    return best


def _hidden(attributes: str) -> bool:
    """Whether an attribute is named hidden; what values say is no matter."""
    return "hidden" in attributes.lower() and bool(HIDDEN.search(_VALUE.sub("=", attributes)))


class _Page:
    """One reading of a page: its elements, and its texts with the element that holds each."""

    def __init__(self, source: str):
        #: element: [token, tag, parent element, not text, text length, link text length, depth, anchor: outermost article or main, else the body's child, articles and mains around it, hint, hint on it or around it]
        self.elements = [[ROOT, "", -1, False, 0, 0, 0, ROOT, 0, 0, False]]
        #: text: (element, block, text)
        self.texts: list[tuple[int, int, str]] = []
        stack, block, links = [0], 0, 0
        #: places in the stack of the open elements of a tag, and of those that break lines
        self.open: dict[str, list[int]] = {}
        lines: list[int] = []
        last = lambda tags: max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        ends = Counter(x.lower() for x in _ENDS.findall(source))
        for m in _TOKEN.finditer(source):
            tag = m[3]
            if tag is None:
                t = m[0]
                if m[1] is None and (t[0] != "<" or t == "<"):
                    at = stack[-1]
                    self.texts.append((at, block, t))
                    n = len(t.strip())
                    e = self.elements[at]
                    e[4] += n
                    e[5] += n if links else 0
                continue
            tag = tag.lower()
            if m[2]:
                ends[tag] -= 1
                if k := last((tag,)):
                    links -= self._close(stack, k, lines)
                block += tag in BLOCK
                continue
            block += tag in BLOCK
            if tag in BLOCK and lines and self.elements[stack[lines[-1]]][1] == "p":  # a paragraph ends where another block begins
                links -= self._close(stack, lines[-1], lines)
            if tag in CLOSES:
                these, barrier = CLOSES[tag]
                if (k := last(these)) > last(barrier):
                    links -= self._close(stack, k, lines)
            if tag in ("article", "main"):  # what has fewer ends to come than are open was left open before the main text
                forgotten = [self.open[t][0] for t in LEFT_OPEN if self.open.get(t) and not ends[t]]
                if forgotten:
                    links -= self._close(stack, min(forgotten), lines)
            up = self.elements[stack[-1]]
            named = [(k.lower(), a or b or c) for k, a, b, c in _NAMED.findall(m[4])] if m[4] else []
            names = " ".join(x for _, x in named)
            hint = _hint(tag, named) if named else 0
            out = tag in NOT_TEXT or hint == WHOLE or _hidden(m[4])
            token = xxhash.xxh64_intdigest(f"{tag} {names}", seed=up[0] & (1 << 63) - 1) >> 1
            if tag in VOID or m[4].endswith("/"):
                if tag == "br":
                    self.texts.append((stack[-1], block, " "))
                continue
            anchor = up[7]
            if tag in ("article", "main") and self.elements[stack[-1]][8] == 0 or anchor == ROOT and tag not in ("html", "body"):
                anchor = token
            self.elements.append([token, tag, stack[-1], out, 0, 0, up[6] + 1, anchor, up[8] + (tag in ("article", "main")), hint, up[10] or hint > 0])
            stack.append(len(self.elements) - 1)
            self.open.setdefault(tag, []).append(len(stack) - 1)
            if tag in BLOCK:
                lines.append(len(stack) - 1)
            links += tag == "a"
        self._mark()
        for e in reversed(self.elements[1:]):  # children come after their parents
            up = self.elements[e[2]]
            if not e[3] and not e[9]:
                up[4] += e[4]
                up[5] += e[5]

    def _mark(self) -> None:
        """What lies in an element that isn't text isn't either; a form around an article or half the page is no form."""
        held, main = [e[4] for e in self.elements], [e[1] in ("article", "main") for e in self.elements]
        if any(e[1] == "form" for e in self.elements):
            for i in range(len(held) - 1, 0, -1):
                up = self.elements[i][2]
                held[up] += held[i]
                main[up] |= main[i]
        for i, e in enumerate(self.elements):
            if e[1] == "form" and e[9] != WHOLE and (main[i] or held[i] >= WRAPS * held[0]):
                e[3] = False
            e[3] = e[3] or e[2] >= 0 and self.elements[e[2]][3]

    def _close(self, stack: list[int], k: int, lines: list[int]) -> int:
        """Close the open elements from place k of the stack; how many of them are links."""
        n = 0
        for x in reversed(stack[k:]):
            tag = self.elements[x][1]
            self.open[tag].pop()
            n += tag == "a"
        while lines and lines[-1] >= k:
            lines.pop()
        del stack[k:]
        return n

    def blocks(self) -> dict[int, tuple[int, int]]:
        """Each block of text's first element, and its token: of this element and the words."""
        runs: dict[int, list[str]] = {}
        at: dict[int, int] = {}
        for e, block, t in self.texts:
            if not self.elements[e][3]:
                runs.setdefault(block, []).append(t)
                if block not in at and t.strip():
                    at[block] = e
        return {b: (e, xxhash.xxh64_intdigest(" ".join("".join(runs[b]).split()), seed=self.elements[e][0]) >> 1) for b, e in at.items()}

    def slot(self, slots: list[int]) -> int | None:
        """The first of the host's slots that the page has once; else its own only article or main element."""
        often = Counter(e[0] for e in self.elements)
        found = next((t for t in slots if often[t] == 1), None)
        if found is not None:
            return found
        for tag in ("article", "main"):
            own = [e[0] for e in self.elements if e[1] == tag and not e[3]]
            if len(own) == 1 and often[own[0]] == 1:
                return own[0]
        return None

    def text(self, slots: list[int], menus: set[int], fixed: set[int]) -> str:
        """The slot's text in blocks; the whole page's if it has none once."""
        slot = self.slot(slots)
        holds = [slot is not None and e[0] == slot for e in self.elements]
        everywhere = slot is None
        inside, bad = [False] * len(holds), [False] * len(holds)
        for i, e in enumerate(self.elements):
            up = e[2]
            inside[i] = everywhere or holds[i] or up >= 0 and inside[up]
            bad[i] = e[3] or e[0] in menus or everywhere and e[9] >= CLASS or up >= 0 and bad[up]
        gone = {b for b, (_, token) in self.blocks().items() if token in fixed} if fixed else ()
        blocks: dict[int, list[str]] = {}
        for at, block, t in self.texts:
            if inside[at] and not bad[at] and block not in gone:
                blocks.setdefault(block, []).append(t)
        lines = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks.values())
        return "\n".join(x for x in lines if x)


_STATS = "host string, page long, token long, tag string, parent long, depth int, out boolean, n int, text long, links long, whole long, look long, anchor long, hint int, marked boolean"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page key, host, html) in; a row per page and token out."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    for b in batches:
        rows = []
        for key, host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            page = _Page(source.as_py())
            elements = page.elements
            if len(elements) == 1:  # without elements there is no layout to learn from
                continue
            said: dict[int, list[str]] = {}
            for at, _, t in page.texts:
                said.setdefault(elements[at][7], []).append(t)
            look = {k: 1 << xxhash.xxh64_intdigest("".join(v)) % 63 for k, v in said.items()}  # bits to tell different texts of anchors apart
            seen: dict[int, list] = {}
            for e in elements:
                s = seen.get(e[0])
                if s is None:
                    seen[e[0]] = [host, key, e[0], e[1], elements[e[2]][0] if e[2] >= 0 else -1, e[6], e[3], 1, e[4], e[5], elements[0][4], look.get(e[7], 1), e[7], e[9], e[10]]
                else:
                    s[7] += 1
                    s[8] += e[4]
                    s[9] += e[5]
            for at, token in page.blocks().values():
                s = seen.get(token)
                if s is None:
                    e = elements[at]
                    seen[token] = [host, key, token, TEXT, e[0], e[6] + 1, False, 1, 0, 0, 0, look.get(e[7], 1), e[7], 0, e[10]]
                else:
                    s[7] += 1
            rows.append(seen.values())
        flat = [s for r in rows for s in r]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in flat], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _STATS.split(", ")])


def templates(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """From (key, host, html): host, slots (tokens of the main text's element, best first), menus and fixed (tokens of elements and blocks of text left out)."""
    rows = pages.select("key", "host", html_col).mapInArrow(_stats, _STATS)
    tokens = rows.groupBy("host", "token").agg(
        F.sum(F.xxhash64("page", "n") % (1 << 40)).alias("vector"),
        F.count("*").alias("pages"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.bit_count(F.bit_or("look")).alias("looks"),
        F.sum("text").alias("text"),
        F.sum("links").alias("links"),
        F.sum("whole").alias("whole"),
        *[F.first(c).alias(c) for c in ("tag", "parent", "depth", "out", "anchor", "hint", "marked")],
    )
    tokens = scratch.keep(tokens, "tokens")
    # the page itself occurs once on each page: its vector names the class of what is on all pages
    root = tokens.where(F.col("token") == ROOT).select("host", F.col("vector").alias("ones"), F.col("pages").alias("of"))
    anchors = tokens.select("host", F.col("token").alias("anchor"), F.col("pages").alias("held"))
    of = tokens.where(F.col("out") | (F.col("tag") != TEXT) | (F.col("looks") >= FEW)).join(root, "host").join(anchors, ["host", "anchor"])
    # an element that is on some pages only is judged by these pages alone: they are a layout of the host
    everywhere = F.col("vector") == F.col("ones")
    enough = everywhere | (F.col("looks") >= 2) & (F.col("pages") >= F.col("of") * RARE)
    in_template = (F.col("most") == 1) & enough & ~F.col("out") & ~F.col("tag").isin("", "html", "body", TEXT)  # the whole page is no slot
    rank = F.when(F.col("tag") == "article", 3).when(F.col("tag") == "main", 2).when(~F.col("marked") & (F.col("text") >= F.col("whole") * MOST), 1).otherwise(0)
    slot = F.when(in_template & (rank > 0) & (F.col("text") > 0), F.struct(rank.alias("rank"), F.when(rank > 1, F.col("text") / F.col("pages")).otherwise(F.col("depth")).alias("size"), "token"))
    # nested classes, whatever their vectors: of link text, or of the same words as often on each page
    often = (F.col("pages") >= F.col("held") * SHARE) & (F.col("looks") >= FEW) & (F.col("pages") >= F.col("of") * RARE)
    menu = F.col("tag").isin("ul", "ol", "div", "section", "table") & (F.col("links") >= F.col("text") * LINKS) & (F.col("links") > 0) & (everywhere | often)
    # a hint in a name that could be made from a title needs a place that most pages have, and link text unless it is all of the name
    placed = often | everywhere & (F.col("pages") >= 2)
    hinted = placed & ((F.col("hint") == SECTION) | F.col("hint").isin(ID, CLASS) & (F.col("links") > 0) & (F.col("links") >= F.col("text") * HINTED_LINKS))
    fixed = (F.col("tag") == TEXT) & often & (F.col("least") == F.col("most"))
    made = of.groupBy("host").agg(F.sort_array(F.collect_list(slot), asc=False).alias("s"), *[F.collect_set(F.when(c, F.col("token"))).alias(x) for c, x in ((menu | hinted, "menus"), (fixed, "fixed"))])
    return made.select("host", F.col("s.token").alias("slots"), "menus", "fixed")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_Page(s.as_py()).text(slots or [], set(menus or ()), set(fixed or ())) for s, slots, menus, fixed in zip(b.column(2), *[b.column(k).to_pylist() for k in (3, 4, 5)], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null html is as empty and gives an empty text. Pages without url, or with one
    that has no host, share a host. Repeated rows count as often as they occur. A
    page that has none of its host's slots once yields its only article or main
    element, or else its whole body without what is marked as not text. An empty table gives an empty result; other columns
    are ignored.
    """
    arrow.bound(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    made = scratch.settle(pages.sparkSession, lambda: templates(rows.select(F.xxhash64("page_id", "url", F.crc32(F.col("html").cast("binary"))).alias("key"), "host", "html")), "templates")
    met = F.broadcast(made) if made.count() <= BROADCAST_HOSTS else made
    out = rows.join(met, "host", "left").select("page_id", "url", "html", "slots", "menus", "fixed")
    kind = rows.schema["page_id"].dataType.simpleString()
    return out.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
