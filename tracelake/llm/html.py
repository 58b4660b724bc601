"""Main text of web pages: a host suffix array, then structure.

Pages become streams of blocks: all visible text, menus and footers too. The token streams of a host's pages are
ordered by suffix to the depth of a window; windows that stand on a large share of the host's distinct pages
are boilerplate, and what they cover is taken out. Windows in marked articles count among themselves, as a menu
line is no evidence against a sentence. Of the rest, structure keeps the main text: menus, headers,
footers, sidebars, notices, adverts, forms and comments go by their elements, roles, classes and ids. If a page
marks its article (article, main), the blocks in there are its text and only blocks that are covered from end to
end go; on other pages the runs that nothing covers are kept. A page that would lose all its text keeps it.

The array is built chunk by chunk, within a scan. A window on the needed share of a host's pages has that share in
one chunk at least, so the chunks name all candidates, and only candidates are counted across chunks: the
unique windows of articles never leave their task.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _bytes as B
from tracelake.llm._spark import drop_shared, write_shared

#: Tokens of a window (shorter blocks are one window); pages and share of a host's distinct pages that make it boilerplate.
WINDOW, PAGES, SHARE = 8, 2, 0.5
#: Pages at least within marked articles, where a line may stand on two pages by chance.
ARTICLE_PAGES = 4
#: Tokens of a chunk of the suffix array; candidate or boilerplate windows that are broadcast (8 bytes each), more are joined.
CHUNK, HELD = 1 << 21, 1 << 20
#: Bits of the map of main texts that stand in more than one row.
_BITS = 1 << 23
#: Kinds of blocks: outside any article, in an article, given up by structure.
PLAIN, ARTICLE, ASIDE = 0, 1, 2

# fixed values of HTML: void elements, elements that begin a new block, raw text elements
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
_SILENT = frozenset("head script style noscript template svg math iframe canvas object audio video select textarea datalist map".split())
_DROP = _SILENT | frozenset("nav aside footer form button dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# words of class and id names for what is no main text, and words that may stand beside them in a name
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social "
    "related recommended recommendations comment comments commentlist respond replies disqus footer masthead toolbar widget widgets skip".split()
)
_BESIDE = frozenset(
    "site page main global top bottom left right primary secondary box bar block list wrapper wrap container section area panel inner outer item items link links button buttons "
    "form content message text title unit slot zone row col column group post posts body".split()
)
_KEEP = frozenset("html body article main".split())
_CLOSED_BY = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option", "optgroup"])}
_TAG = re.compile(r"""<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[^a-z0-9]+")
# white space of HTML and of text: what str.split() splits at
_HOLDS = re.compile(r"<(?:article|main)(?=[\s>])", re.I)
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def _marked(value: str) -> bool:
    """Whether one of the names in a class or id attribute is made of mark words, with at most neutral words beside them."""
    for name in value.split():
        parts = [x for x in _PART.split(name) if x and not x.isdigit()]
        if parts and not _MARKS.isdisjoint(parts) and all(x in _MARKS or x in _BESIDE for x in parts):
            return True
    return False


def _dropped(tag: str, attrs: str, in_article: bool) -> int:
    """0: stays; 1: goes; 2: goes unless it holds the page's article."""
    if tag in ("form", "dialog"):
        return 2
    if tag in _DROP or tag == "header" and not in_article:
        return 1
    if tag in _KEEP or not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES or name in ("class", "id") and _marked(value):
            return 2
    return 0


def _end_of(page: str, tag: str, at: int) -> int:
    """Where the element ends whose start tag ends at `at`; the page's end if it is not closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.start()
    return len(page)


def blocks(page: str) -> tuple[list[str], bool]:
    """(texts, marked): the blocks of the page's marked article, or of its whole body if it marks none."""
    return main_blocks(all_blocks(page))


def main_blocks(found: list[tuple[str, int]]) -> tuple[list[str], bool]:
    marked = any(k == ARTICLE for _, k in found)
    return [t for t, k in found if k == (ARTICLE if marked else PLAIN)], marked


def all_blocks(page: str, strict: bool = True) -> list[tuple[str, int]]:
    """(text, kind) of every block of visible text, in page order. If structure leaves no main text, forms and marks count as neutral."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    side: list[str] = []  # text within a dropped element
    article = 0  # depth of article and main elements
    skip, depth = "", 0  # the dropped element that we are in, and how deep its own kind is nested
    holds = [m.start() for m in _HOLDS.finditer(page)]

    def flush(parts: list[str], kind: int) -> None:
        if parts:
            t = "".join(parts)
            if "&" in t:
                t = html.unescape(t)
            t = " ".join(t.split())
            if t:
                out.append((t, kind))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not skip:
                text.append(page[at:lt])
            elif skip not in _SILENT:
                side.append(page[at:lt])
        if lt == n:
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:  # a bare sign, or a tag that the end of the page cuts off
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                break
            if not skip:
                text.append("<")
            at = lt + 1
            continue
        if m.re is _TAG and not m[3]:
            close = "-->" if not m[1] else ">"
            end = page.find(close, lt + (4 if not m[1] else 2))
            at = n if end < 0 else end + len(close)
            continue
        ends, tag, attrs = (m[2], m[3].lower(), m[4]) if m.re is _TAG else (m[1], m[2].lower(), m[3])
        at = m.end()
        if skip:
            if tag in _BLOCK or tag == "br":
                flush(side, ASIDE)
            if tag == skip:
                depth += -1 if ends else (0 if attrs.endswith("/") else 1)
            implied = not ends and tag in _CLOSED_BY.get(skip, ())
            if depth <= 0 or implied or ends and tag in ("html", "body"):
                flush(side, ASIDE)
                skip = ""
                if not implied:
                    continue
            else:
                if not ends and tag in _RAW:
                    at = _after_raw(page, tag, at)
                continue
        if ends:
            if tag in _BLOCK:
                flush(text, ARTICLE if article else PLAIN)
            if tag in ("article", "main"):
                article = max(0, article - 1)
            continue
        if tag in _BLOCK:
            flush(text, ARTICLE if article else PLAIN)
        if tag == "br":
            text.append(" ")
        goes = _dropped(tag, attrs, article > 0)
        if goes == 2 and not strict:
            goes = 0
        if goes == 2 and not article and holds and holds[0] > at and tag not in _VOID:
            goes = 0 if holds[-1] < _end_of(page, tag, at) else 1  # a frame around the article is no mark
        if goes:
            if tag in _RAW:
                at = _after_raw(page, tag, at)
            elif tag not in _VOID and not attrs.endswith("/"):
                skip, depth = tag, 1
                if tag not in _BLOCK:
                    text.append(" ")
            continue
        if tag in _RAW:
            at = _after_raw(page, tag, at)
        elif tag in ("article", "main"):
            article += 1
    flush(side, ASIDE)
    flush(text, ARTICLE if article else PLAIN)
    if strict and out and all(k == ASIDE for _, k in out):
        return all_blocks(page, False)
    return out


def _after_raw(page: str, tag: str, at: int) -> int:
    """Behind the end tag of a raw text element, the page's end if there is none."""
    m = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return m.end() if m else len(page)


def _windows(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first token, tokens) of the windows of a page's token stream; windows do not cross blocks, a shorter block is one."""
    data, offs = B.column_bytes(pa.array([t.encode() for t in texts], pa.binary()))
    s, e, first = B.words(data, offs, ~B.byte_table((0x20, 0x20)))
    h = B.word_hashes(data, s, e)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        k = min(window, int(b - a))
        if k:
            w = B.combine(h[a:b], k) + np.uint64(k)
            out.append((w, np.arange(a, b - k + 1), np.full(len(w), k)))
    if not out:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, content, texts, kinds) of (page_id, url, html, host): every row's blocks, and a hash of host and main text (null without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds, content = [], [], []
            for page, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = all_blocks(page or "")
                main, _ = main_blocks(found)
                texts.append([t for t, _ in found])
                kinds.append(bytes(k for _, k in found))
                h = hashlib.blake2b("\n\n".join(main).encode(), digest_size=8, key=host.to_bytes(8, "little", signed=True))
                content.append(int.from_bytes(h.digest(), "little", signed=True) if main else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(content, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.binary())], names=["page_id", "url", "host", "content", "texts", "kinds"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html", "host").mapInArrow(run, f"page_id {kind}, url string, host long, content long, texts array<string>, kinds binary")


def suffix_groups(tokens: np.ndarray, block: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, group) of every window: suffixes ordered to the depth of a window by doubling their known prefix.

    tokens are hashes, block numbers the block of each token. Windows stay within a block; a block shorter than
    a window is one window. Equal windows have equal group numbers, which follow the order of suffixes.
    """
    n = len(tokens)
    last = np.flatnonzero(np.r_[block[1:] != block[:-1], True]) if n else np.zeros(0, np.int64)
    left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1  # tokens up to the block's end
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    depth = 1
    while depth < window:
        step = min(depth, window - depth)
        after = np.zeros(n, np.int64)  # the suffix behind the known prefix; nothing beyond the block
        inside = np.flatnonzero(left > step)
        after[inside] = rank[inside + step]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    first = np.r_[True, block[1:] != block[:-1]] if n else np.zeros(0, bool)
    start = np.flatnonzero((left >= window) | first)
    return start, rank[start]


def _tokens(host: pa.Array, lists: pa.Array, kinds: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash tied to the host, block, page, whether in an article) of each token of lists of block texts; blocks are numbered through."""
    data, offs = B.column_bytes(lists.flatten())
    page_of = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
    s, e, first = B.words(data, offs, ~B.byte_table((0x20, 0x20)))
    block = B.owner(first)
    page = page_of[block]
    article = (B.column_bytes(kinds)[0] == ARTICLE)[block]
    salt = B.mix(np.asarray(host).view(np.uint64)[page] + article.astype(np.uint64))
    return B.mix(B.word_hashes(data, s, e) ^ salt), block, page, article


@dataclass
class _Chunk:
    """Pages of distinct main text, at least one, and their token streams."""

    need: np.ndarray  # a page: pages that make a window of its host boilerplate
    total: np.ndarray  # a page: pages of its host
    host: np.ndarray
    content: np.ndarray
    tokens: np.ndarray
    block: np.ndarray
    page: np.ndarray
    article: np.ndarray

    def names(self, window: int, start: np.ndarray) -> np.ndarray:
        return _window_names(self.tokens, self.block, self.article, start, window)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Chunks of (host, texts, kinds, content, need, total)."""
    held: list[tuple] = []
    size = 0

    def joined() -> _Chunk:
        pages = [np.concatenate([x[i] for x in held]) for i in range(4)]
        shift = np.cumsum([0, *[len(x[0]) for x in held[:-1]]])
        step = np.cumsum([0, *[int(x[5][-1]) + 1 if len(x[5]) else 0 for x in held[:-1]]])
        page = np.concatenate([x[6] + k for x, k in zip(held, shift)])
        once = np.zeros(len(pages[0]), bool)
        once[np.unique(pages[1], return_index=True)[1]] = True
        keep = once[page]
        number = np.cumsum(once) - 1
        tokens, block = np.concatenate([x[4] for x in held])[keep], np.concatenate([x[5] + k for x, k in zip(held, step)])[keep]
        host, content, need, total = (x[once] for x in pages)
        return _Chunk(need, total, host, content, tokens, block, number[page[keep]], np.concatenate([x[7] for x in held])[keep])

    for batch in batches:
        tokens, block, page, article = _tokens(batch.column(0), batch.column(1), batch.column(2))
        if len(tokens):
            held.append((*(np.asarray(batch.column(i)).astype(np.int64) for i in (0, 3, 4, 5)), tokens, block, page, article))
            size += len(tokens)
        if size >= CHUNK:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _starts(block: np.ndarray, window: int) -> np.ndarray:
    """Where windows start: all of a window's tokens stand in one block; a shorter block is one window."""
    n = len(block)
    first = np.r_[True, block[1:] != block[:-1]] if n else np.zeros(0, bool)
    full = np.zeros(n, bool)
    if n >= window:
        full[: n - window + 1] = block[: n - window + 1] == block[window - 1 :]
    return np.flatnonzero(full | first)


def _window_names(tokens: np.ndarray, block: np.ndarray, article: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit name of the window at each start; odd in articles, even elsewhere."""
    h = B.span_hash(B.prefix_sums(tokens), start, _ends(block, start, window)).view(np.int64)
    return h & np.int64(-2) | article[start]


def _ends(block: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    return np.minimum(start + window, np.searchsorted(block, block[start], "right"))


def _on_pages(name: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one, name's number) of each distinct (name, page), in the order of names."""
    o = np.lexsort((page, name))
    a, b = name[o], page[o]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    new = np.r_[True, a[1:] != a[:-1]] if len(a) else fresh
    return o[fresh], (np.cumsum(new) - 1)[fresh]


def _boilerplate(parsed: DataFrame, window: int, min_pages: int, share: float, held: int) -> DataFrame:
    """(w): the windows that stand on so many pages of distinct main text, and so large a share of these, of their host."""
    sc = parsed.sparkSession.sparkContext
    contents = write_shared(parsed.where("content is not null").groupBy("host", "content").agg(F.count(F.lit(1)).alias("n")), "page-contents")
    need = F.greatest(F.lit(min_pages), F.ceil(F.count(F.lit(1)) * share)).cast("bigint")
    hosts = write_shared(contents.groupBy("host").agg(F.count(F.lit(1)).alias("total"), need.alias("need")).where("total >= need"), "hosts")
    # a bit map of bounded size over main texts that more than one row has; a false hit costs a row, not the result
    words = contents.where("n > 1").groupBy(F.expr(f"pmod(content, {_BITS}) div 64").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(content & 63 as int))")).alias("b")).collect()
    copied = np.zeros(_BITS // 64, np.int64)
    for r in words:
        copied[r.i] = r.b
    copies = sc.broadcast(copied)
    source = parsed.where("content is not null").join(hosts, "host").select("host", "texts", "kinds", "content", "need", "total")

    def shared_text(c: _Chunk) -> np.ndarray:
        at = c.content & (_BITS - 1)
        return (copies.value[at >> 6] >> (at & 63)) & 1 == 1

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            start, group = suffix_groups(c.tokens, c.block, window)
            one, number = _on_pages(group, c.page[start])
            pages = np.bincount(number)
            at = start[one[np.r_[True, number[1:] != number[:-1]]]]
            host_no = np.unique(c.host, return_inverse=True)[1]
            own = np.bincount(host_no, weights=~shared_text(c), minlength=host_no.max() + 1)[host_no]
            p = c.page[at]
            keep = pages * c.total[p] >= own[p] * np.where(c.article[at], np.maximum(c.need[p], ARTICLE_PAGES), c.need[p])
            yield pa.RecordBatch.from_arrays([pa.array(c.names(window, at[keep]))], names=["w"])

    found = write_shared(source.mapInArrow(candidates, "w long").distinct(), "boilerplate-candidates")
    few = found.limit(held + 1).count() <= held
    known = sc.broadcast(_sorted_windows(found) if few else None)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            start = _starts(c.block, window)
            w = c.names(window, start)
            if known.value is not None:
                hit = _among(w, known.value)
                start, w = start[hit], w[hit]
            one, number = _on_pages(w, c.page[start])
            p = c.page[start[one]]
            copy = shared_text(c)[p]
            plain = np.bincount(number[~copy], minlength=number.max(initial=-1) + 1)
            first = one[np.r_[True, number[1:] != number[:-1]]] if len(one) else one
            some = plain > 0
            w_ = np.r_[w[first][some], w[one][copy]]
            c_ = pa.array(np.r_[np.zeros(some.sum(), np.int64), c.content[p[copy]]], mask=np.r_[np.ones(some.sum(), bool), np.zeros(copy.sum(), bool)])
            host = c.host[c.page[start]]
            yield pa.RecordBatch.from_arrays([pa.array(w_), c_, pa.array(np.r_[plain[some], np.ones(copy.sum(), np.int64)]), pa.array(np.r_[host[first][some], host[one][copy]])], names=["w", "c", "n", "host"])

    counted = source.mapInArrow(counts, "w long, c long, n long, host long")
    if not few:
        counted = counted.join(found, "w", "left_semi")
    # a copied main text counts once, whatever the chunks it stands in
    by_text = counted.groupBy("host", "w", "c").agg(F.sum("n").alias("n"))
    total = by_text.groupBy("host", "w").agg(F.sum(F.when(F.col("c").isNull(), F.col("n")).otherwise(1)).alias("pages"))
    enough = F.when(F.col("w").bitwiseAND(1) == 1, F.greatest("need", F.lit(ARTICLE_PAGES))).otherwise(F.col("need"))
    out = write_shared(total.join(hosts, "host").where(F.col("pages") >= enough).select("w"), "boilerplate")
    copies.destroy()
    known.destroy()
    for x in (contents, hosts, found):
        drop_shared(x)
    return out


def _sorted_windows(table: DataFrame) -> np.ndarray:
    return np.sort(np.asarray(table.select("w").toArrow().column("w").combine_chunks()))


def _among(w: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, w), len(table) - 1)] == w if len(table) else np.zeros(len(w), bool)


def extract_text(pages: DataFrame, window: int = WINDOW, min_pages: int = PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, held: int = HELD) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages.

    Character references are decoded, white space within a block becomes one space, blocks are trimmed and
    joined by two line breaks in page order. Null, empty and blank pages give the empty text. Pages of equal
    main text count as one page of their host, which needs two for anything to repeat; pages without a host
    in their url share one host. Other columns are ignored.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))
    parsed = write_shared(_parsed(p.withColumn("host", host)), "page-blocks")
    boiler = _boilerplate(parsed, window, min_pages, share, held)
    few = boiler.limit(held + 1).count() <= held
    known = p.sparkSession.sparkContext.broadcast(_sorted_windows(boiler) if few else None)
    rows = parsed if few else parsed.withColumn("rid", F.monotonically_increasing_id())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index
            lists = batch.column(i("texts"))
            if known.value is not None:
                tokens, block, _, article = _tokens(batch.column(i("host")), lists, batch.column(i("kinds")))
                start = _starts(block, window)
                start = start[_among(_window_names(tokens, block, article, start, window), known.value)]
                end = _ends(block, start, window)
            else:
                _, block, page, _ = _tokens(batch.column(i("host")), lists, batch.column(i("kinds")))
                spans = batch.column(i("spans"))
                row = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths().fill_null(0)))
                flat = spans.flatten()
                start = np.searchsorted(page, row) + np.asarray(flat.field("first")).astype(np.int64)
                end = start + np.asarray(flat.field("n"))
            gone = np.zeros(len(block) + 1, np.int64)
            np.add.at(gone, start, 1)
            np.add.at(gone, end, -1)
            gone = np.cumsum(gone[:-1]) > 0
            first = np.searchsorted(block, np.arange(len(lists.flatten()) + 1))
            texts, at = [], 0
            for found, kinds in zip(lists.to_pylist(), batch.column(i("kinds")).to_pylist()):
                texts.append("\n\n".join(_kept(found, kinds, [gone[first[at + k] : first[at + k + 1]] for k in range(len(found))])))
                at += len(found)
            yield pa.record_batch([batch.column(i("page_id")), batch.column(i("url")), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    out = f"page_id {p.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    if few:
        return rows.mapInArrow(finish, out)

    def covering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, block, page, article = _tokens(batch.column(0), batch.column(1), batch.column(2))
            start = _starts(block, window)
            at = page[start]
            yield pa.record_batch([batch.column(3).take(pa.array(at)), pa.array(_window_names(tokens, block, article, start, window)), pa.array((start - np.searchsorted(page, at)).astype(np.int32)), pa.array((_ends(block, start, window) - start).astype(np.int32))], names=["rid", "w", "first", "n"])

    rows = write_shared(rows, "page-rows")
    windows = rows.select("host", "texts", "kinds", "rid").mapInArrow(covering, "rid long, w long, first int, n int")
    spans = windows.join(boiler, "w", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return rows.join(write_shared(spans, "page-spans"), "rid", "left").mapInArrow(finish, out)


def _kept(texts: list[str], kinds: bytes, gone: list[np.ndarray]) -> list[str]:
    """The main text of a page whose covered tokens are known: what nothing covers, of the blocks that structure keeps."""
    marked = ARTICLE in kinds
    kind = ARTICLE if marked else PLAIN
    main = [i for i, k in enumerate(kinds) if k == kind]
    out = []
    for i in main:
        if not gone[i].any():
            out.append(texts[i])
        elif marked and not gone[i].all():
            out.append(texts[i])
        elif not marked:
            if rest := " ".join(x for x, g in zip(texts[i].split(" "), gone[i]) if not g):
                out.append(rest)
    return out or [texts[i] for i in main]
