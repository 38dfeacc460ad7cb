"""Main text of web pages by template deduction: equivalence classes of tokens over the pages of a host.

A token is an element in its place (the names and classes on the way from the root), or the text of a block in its place.  Its occurrence vector over
the pages of a host is summed up by a 64-bit signature (a sum of hashes of page and count), the number of pages and the smallest and
largest count, all of which are merged where pages are read; tokens with equal ones are one equivalence class.  A class is valid if it holds an
element and is on most pages of a host with enough of them; places nest the valid classes into a template.  Its elements are the frames of
slots: the main slot is the deepest frame that still holds most of the words outside navigation and the like, an article or main element first.  Block
texts that are tokens of the template are dropped, unless they are so much of the slot that the pages rather are copies of each other.
What is left of the slot, block by block, is the result.  Pages outside any template (few pages, no host, an unlike page) are judged by their own places.

Defined cases: null and empty html have no text; a null url, or one without a host, is a page without a host; rows that repeat, and rows with a null
page_id, are rows of their own; an empty table gives an empty result; other columns may have any name.  Elements deeper than DEPTH count as in
the place at that depth, their text is kept.  Rows are read one after another: a page of n bytes needs some 20 n bytes of working memory.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.shared import meet, slices, staged

#: Pages that a host needs, the share of them that a class of the template is on, and how deep places tell elements apart.
PAGES, SHARE, DEPTH = 4, 0.8, 64
#: Shares of a host's words that a semantic and any other frame must hold to be the main slot, and that dropped texts may have of it.
SEMANTIC, PLAIN, FIXED = 0.5, 0.7, 0.2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Formatting that pages leave open; it carries no place.
FORMAT = frozenset("b big em font i s small strike strong tt u".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("nav footer aside form script style noscript template button select textarea iframe svg dialog menu object canvas head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter subscribe subscription signup share sharing social related recommended comment comments disqus reply replies respond discussion widget login search pagination pager toolbar skip".split()
)
#: The only ones that count on an article element itself.
REMARKS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, and what stops the search for it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("html body div article section main aside header footer nav table ul ol dl blockquote form td th li dd figure".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _signed(*parts: object) -> int:
    """A 64-bit hash as a signed number."""
    h = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


#: What an element says of its content: nothing, that it is not the article's, or that only its headings are.
KEPT, TITLES, OUT = 0, 1, 2


def _kind(tag: str, given: str) -> tuple[int, str]:
    """How an element bears on its content, and its class names."""
    state = OUT if tag in OUTSIDE else TITLES if tag == "header" else KEPT
    if not given:
        return state, ""
    names, words = "", set()
    for m in _ATTRIBUTE.finditer(given):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names += " " + value
            words.update(w.lower() for w in _WORD.findall(value))
        elif (name == "role" and value.lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            state = OUT
    if tag not in ("html", "body", "main") and words & (REMARKS if tag == "article" else MARKS):
        state = OUT
    elif "header" in words and state == KEPT and tag not in ("html", "body", "main", "article"):
        state = TITLES
    return state, re.sub(r"\d+", "#", names.strip().lower())


class Page:
    """Elements in their places, and the blocks of a page in page order."""

    def __init__(self, source: str) -> None:
        #: place: (depth, 2 for article, 1 for main, 0, places above and itself)
        self.places: dict[int, tuple[int, int, tuple[int, ...]]] = {}
        self.counts: dict[int, int] = defaultdict(int)
        #: (text, places, kept, words in links)
        self.blocks: list[tuple[str, tuple[int, ...], bool, int]] = []
        self._stack: list[tuple[str, int, tuple[int, ...]]] = []
        self._text: list[str] = []
        self._linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                block = next((x for x in reversed(self._stack) if x[0] not in INLINE), ("", KEPT, ()))
                state, way = block[1], block[2]
                titled = state == KEPT or (state == TITLES and any(t in HEADINGS for t, _, _ in self._stack))
                self.blocks.append((text, way, titled, min(self._linked, text.count(" ") + 1)))
            self._text, self._linked = [], 0

    def _say(self, text: str) -> None:
        inline = next((k for k, (t, _, _) in enumerate(reversed(self._stack)) if t not in INLINE), len(self._stack))
        around = self._stack[len(self._stack) - inline :]
        block = self._stack[-inline - 1][1] if inline < len(self._stack) else KEPT
        if around and around[-1][1] > block:
            return  # an inline element that is not the article's, within a block that may be
        self._text.append(entities.unescape(text) if "&" in text else text)
        if any(t == "a" for t, _, _ in around):
            self._linked += len(text.split())

    def _open(self, tag: str, given: str) -> None:
        above, way = (self._stack[-1][1], self._stack[-1][2]) if self._stack else (KEPT, ())
        state, names = _kind(tag, given)
        if tag not in INLINE and len(way) < DEPTH:
            place = _signed(way[-1] if way else "", tag, names)
            self.counts[place] += 1
            way = (*way, place)
            if place not in self.places:
                self.places[place] = (len(way), 2 if tag == "article" else 1 if tag == "main" or "role=\"main\"" in given else 0, way)
        self._stack.append((tag, max(state, above), way))

    def _close(self, tags: set[str] | frozenset[str], stops: frozenset[str]) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in tags:
                del self._stack[k:]
                return
            if self._stack[k][0] in stops:
                return

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.match(source, at)
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                if source[m.start()] != "<" or at == m.start() + 1:
                    self._say(m[0])
                continue
            tag, given = tag.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:  # an end tag
                if tag in FORMAT:
                    continue
                if tag not in INLINE:
                    self._flush()
                self._close({tag}, frozenset() if tag not in INLINE else STOPS)
            elif tag in RAW:
                if close := _CLOSE[tag].search(source, at):
                    at = close.end()
                else:
                    at = end
            elif tag in VOID:
                if tag in ("br", "wbr", "img", "input"):
                    self._text.append(" " if tag != "wbr" else "")
                else:
                    self._flush()
            elif tag in FORMAT and "class" not in given and "style" not in given and "hidden" not in given:
                continue
            else:
                if tag not in INLINE:
                    self._flush()
                    self._close({"p"}, STOPS)
                    if tag in CLOSES:
                        self._close(CLOSES[tag], frozenset({"ul", "ol", "dl", "table", "select", "menu", "body"}))
                if not given.endswith("/") or tag in INLINE:
                    self._open(tag, given)
        self._flush()

    def masses(self) -> dict[int, int]:
        """Words outside links and of kept blocks, by the place right around them."""
        found: dict[int, int] = defaultdict(int)
        for text, way, kept, linked in self.blocks:
            if kept and way:
                found[way[-1]] += max(0, text.count(" ") + 1 - linked)
        return found

    def main(self) -> int | None:
        """The main slot by this page alone: the choice that _mains makes for a host."""
        total: dict[int, int] = defaultdict(int)
        for place, n in self.masses().items():
            for up in self.places[place][2]:
                total[up] += n
        most = max(total.values(), default=0)
        fit = [(self.places[p][1], self.places[p][0], n, p) for p, n in total.items() if n and n >= (SEMANTIC if self.places[p][1] else PLAIN) * most]
        return max(fit)[3] if fit else None

    def text(self, main: int | None, fixed: frozenset[int]) -> str:
        own = [b for b in self.blocks if main in b[1]] if main is not None else []
        if not any(b[2] for b in own):
            fixed, main = frozenset(), self.main()
            own = [b for b in self.blocks if main in b[1]] if main is not None else self.blocks if not self.places else []
        return "\n\n".join(b[0] for b in own if b[2] and not (fixed and _signed(b[1][-1], b[0]) in fixed))


def host(url: Column) -> Column:
    """The host of an address, lower-cased, without its port; null if there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


_SHAPE = "host string, token long, element boolean, pages long, least int, most int, sign long, words long, depth int, semantic int, way array<bigint>"


def tokens(pages: DataFrame) -> DataFrame:
    """(host, token, element, pages, least, most, sign, words, depth, semantic, way) of pages (host, html), summed up within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                sums: dict[tuple[str, int], list] = {}
                for own, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not source:
                        continue
                    page, name = Page(source), xxhash.xxh64_intdigest(source)
                    words = page.masses()
                    seen = [(p, n, True, words.get(p, 0), *page.places[p]) for p, n in page.counts.items()]
                    texts: dict[int, list[int]] = {}
                    for text, way, kept, _ in page.blocks:
                        if way:
                            x = texts.setdefault(_signed(way[-1], text), [0, 0, way])
                            x[0] += 1
                            x[1] += kept * (text.count(" ") + 1)
                    seen += [(p, n, False, w, 0, 0, way) for p, (n, w, way) in texts.items()]
                    for token, n, element, w, depth, semantic, way in seen:
                        x = sums.get((own, token))
                        if x is None:
                            x = sums[own, token] = [element, 0, n, n, 0, 0, depth, semantic, way]
                        x[1] += 1
                        x[2], x[3] = min(x[2], n), max(x[3], n)
                        x[4] += xxhash.xxh64_intdigest(name.to_bytes(8) + n.to_bytes(4)) & 0xFFFFFFFF
                        x[5] += w
                keys = list(sums)
                columns = [[k[0] for k in keys], [k[1] for k in keys], *([x[i] for x in sums.values()] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8))]
                types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c) if k < 10 else [list(w) for w in c], t) for k, (c, t) in enumerate(zip(columns, types, strict=True))], [n.split()[0] for n in _SHAPE.split(", ")])

    own = pages.filter("host IS NOT NULL AND html IS NOT NULL").select("host", "html").mapInArrow(run, _SHAPE)
    return own.groupBy("host", "token").agg(
        F.first("element").alias("element"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("sign").alias("sign"), F.sum("words").alias("words"),
        F.first("depth").alias("depth"), F.first("semantic").alias("semantic"), F.first("way").alias("way"),
    )


def templates(pages: DataFrame) -> DataFrame:
    """One row a host with a template: host, main (the place of its main slot), fixed (hashes of block texts that belong to the template) and n, its pages."""
    found = staged(tokens(pages), "tokens")
    hosts = pages.filter("host IS NOT NULL AND html <> ''").groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES)
    # Texts of one page are most tokens and no template's; what is left of a large host stays where it is.
    often = meet(found.filter(F.col("pages") >= SHARE * PAGES), hosts.withColumn("size", F.col("n")), ["host"], "size").filter(F.col("pages") >= SHARE * F.col("n"))
    vector = ["host", "pages", "least", "most", "sign"]
    valid = often.groupBy(*vector).agg(F.bool_or("element").alias("framed"), F.count("*").alias("size")).filter("framed")
    often = staged(often.join(valid, vector), "classes")
    held = found.filter("element AND words > 0").select("host", F.explode("way").alias("token"), "words").groupBy("host", "token").agg(F.sum("words").alias("mass"))
    frames = often.filter("element").select("host", "token", "depth", "semantic").join(held, ["host", "token"])
    most = frames.groupBy("host").agg(F.max("mass").alias("all"))
    fit = frames.join(most, "host").filter(F.col("mass") >= F.col("all") * F.when(F.col("semantic") > 0, SEMANTIC).otherwise(PLAIN))
    mains = fit.groupBy("host").agg(F.max(F.struct("semantic", "depth", "mass", "token")).alias("m")).select("host", "m.token", "m.mass")
    texts = often.filter("NOT element AND size > 1").join(mains.withColumnRenamed("token", "main"), "host").filter(F.array_contains("way", F.col("main")))
    # Texts of a place that each page has are the template's, but not if they are the better part of the slot.
    fixed = texts.groupBy("host").agg(F.collect_list("token").alias("fixed"), F.sum("words").alias("said"), F.first("mass").alias("mass")).filter(F.col("said") <= FIXED * F.col("mass"))
    return mains.select("host", F.col("token").alias("main")).join(fixed.select("host", "fixed"), "host", "left").join(hosts, "host")


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by empty lines) and n_chars of every page."""
    own = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html].alias("html"), host(pages[url]).alias("host"))
    known = staged(templates(own), "templates")
    both = meet(own, known, ["host"], "n", "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                sets: dict[tuple, frozenset] = {}
                texts = []
                for source, main, fixed in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True):
                    key = tuple(fixed or ())
                    texts.append(Page(source).text(main, sets.setdefault(key, frozenset(key))) if source else "")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return both.select("page_id", "url", "html", "main", "fixed").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
