"""Main text of pages by nearest-URL page differencing (operator 6).

A page is read into lines (the text of its blocks, in order), each marked as lying in an element
that names itself a menu, footer, advert and so on (``chrome``), in the page's article element
(``article``), or in neither (``open``). Pages of one host that have the same lines are one
representative; these are ordered by URL path, and each is paired with the one before it and the one
after it, so a page is never compared with a copy of itself. The lines of a pair are aligned by
longest common subsequence, and open lines that both pages share are deleted, whether or not the
page has an article element. What such an element holds is kept as it is: two pages may rightly
carry the same article. A page's text is its article's and the open lines that are left, in page
order; a page with no other to compare with keeps all of both.
"""

from __future__ import annotations

import array
import bisect
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import ensure_scratch, only, small, stored
from churnlens.operators.ranking import previous_in_group

CHROME, ARTICLE, OPEN = 0, 1, 2

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CHROME_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "svg", "canvas", "object", "audio",
                "video", "head", "datalist", "fieldset"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
           "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "script", "small", "span", "strike", "strong", "style", "sub",
           "sup", "time", "tt", "u", "var", "wbr", "br"}
_CLOSES_P = re.compile(r"address|article|aside|blockquote|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|"
                       r"footer|form|h[1-6]|header|hr|li|main|menu|nav|ol|p|pre|section|table|ul")
# Words in a class, id or role by which an element says that it is not the article.
_SAYS_CHROME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|"
    r"notices?|alerts?|banners?|sidebars?|side-bar|menus?|nav|navbar|navigation|breadcrumbs?|footers?|site-header|masthead|"
    r"page-header|topbar|comments?|replies|respond|disqus|share|sharing|social|related|recommended|subscribe|subscription|"
    r"newsletters?|signup|sign-up|login|popups?|modals?|overlays?|widgets?|search|pagination|pager|toolbar|skip-link|"
    r"complementary|contentinfo|banner|dialog|form|tooltip)(?:$|[\s_-])", re.I)
_SAYS_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|article-body|post-content|entry-content|main-content|main)(?:$|\s)", re.I)


def _kind(tag: str, attrs: str, within: int) -> int:
    """What the text of an element is, from its name and what its attributes say."""
    if within == CHROME or tag in _CHROME_TAGS or tag == "header" and within != ARTICLE:
        return CHROME
    if attrs and tag not in ("body", "html"):
        says = " ".join(next(filter(None, m.groups()), "") for m in _NAMES.finditer(attrs))
        if _SAYS_CHROME.search(says) or _HIDDEN.search(attrs):
            return CHROME
        if _SAYS_ARTICLE.search(says):
            return ARTICLE
    return ARTICLE if tag in ("article", "main") else within


def lines(page: str) -> list[tuple[str, int]]:
    """(text, mark) of each block of a page that has text, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    kind, at = OPEN, 0

    def end_block() -> None:
        if text:
            if line := " ".join(html.unescape("".join(text)).split()):
                out.append((line, kind))
            text.clear()

    def close(tag: str) -> None:
        nonlocal kind
        if opened[tag]:
            while stack:
                name, before = stack.pop()
                opened[name] -= 1
                kind = before
                if name == tag:
                    break

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if tag == "br":
            text.append("\n")
        elif tag not in _INLINE:
            end_block()
        if m[1]:
            before = kind
            if opened[tag] and tag in _INLINE:
                # an inline element may change the mark too (an advert in a span): its text stays apart then
                if next(k for n, k in reversed(stack) if n == tag) != before:
                    end_block()
            close(tag)
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in ("p", "div", "a", "span"):
            continue
        if opened["p"] and _CLOSES_P.fullmatch(tag):
            close("p")
        if tag == "li" and opened["li"] and next(n for n, _ in reversed(stack) if n in ("li", "ul", "ol")) == "li":
            close("li")
        new = _kind(tag, m[3], kind)
        if new != kind:
            end_block()
        stack.append((tag, kind))
        opened[tag] += 1
        kind = new
    if at < len(page):
        text.append(page[at:])
    end_block()
    return out


#: Pairs of equal lines that are looked at one by one; more are halved first.
FEW_MATCHES = 200_000


def shared(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions in ``a`` and in ``b`` of a longest common subsequence.

    Equal ends are cut off. What is left goes by its pairs of equal lines if these are few; pages with many repeated lines are halved
    (Hirschberg), with the lengths of all prefixes from bit vectors, so the time is that of n x m / 64 steps and the memory linear.
    """
    left: list[int] = []
    right: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()                            # a[i:n] and b[j:m]; parts come in order
        while i < n and j < m and a[i] == b[j]:
            left.append(i)
            right.append(j)
            i, j = i + 1, j + 1
        end = n
        while i < end and j < m and a[end - 1] == b[m - 1]:
            end, m = end - 1, m - 1
        if end < n:                                        # the equal end comes after what lies between
            todo.append((end, n, m, m + n - end))
        x, y = a[i:end], b[j:m]
        if not x or not y:
            continue
        times = Counter(y)
        if sum(times[v] for v in x) <= FEW_MATCHES or len(x) == 1:
            for p, q in _by_matches(x, y):
                left.append(i + p)
                right.append(j + q)
            continue
        half = len(x) // 2
        ahead = _lengths(x[:half], y)
        behind = _lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int((ahead + behind).argmax())
        todo += [(i + half, end, j + cut, m), (i, i + half, j, j + cut)]
    return left, right


def _by_matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Longest common subsequence by its pairs of equal lines (Hunt and Szymanski: by increasing runs)."""
    where = defaultdict(list)
    for j, x in enumerate(b):
        where[x].append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect.bisect_left(tails, j)
            node = (i, j, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k], links[k] = j, node
    node, out = links[-1] if links else None, []
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``: a bit of ``b`` is cleared where the length grows."""
    places: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        places[x] |= 1 << j
    full = (1 << len(b)) - 1
    flat = full
    for x in a:
        both = flat & places.get(x, 0)
        if both:
            flat = ((flat + both) | (flat - both)) & full
    bits = np.unpackbits(np.frombuffer(flat.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def _read(pages: DataFrame) -> DataFrame:
    """Rows with their lines: ``main`` (the article's lines), ``loose`` (of pages with open lines: these and the article's),
    ``loose_at`` (where an open line stands among all, -1 for the article's), ``keys`` (all lines' hashes) and their ``digest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            main, loose, keys, at, digests = [], [], [], [], []
            for page in batch.column(2).to_pylist():
                found = lines(page) if page else []
                inner = [t for t, k in found if k == ARTICLE]
                main.append("\n".join(inner) if inner else None)
                kept = [(t, i if k == OPEN else -1) for i, (t, k) in enumerate(found) if k != CHROME] if any(k == OPEN for _, k in found) else []
                loose.append([t for t, _ in kept])
                at.append([i for _, i in kept])
                keys.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in found])
                digests.append(xxhash.xxh3_128_digest(array.array("q", keys[-1]).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(main, pa.string()), pa.array(loose, pa.list_(pa.string())),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(digests, pa.binary())],
                ["page_id", "url", "main", "loose", "keys", "loose_at", "digest"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, url string, main string, loose array<string>, keys array<long>, loose_at array<int>, digest binary")


def _shared_lines(rows: DataFrame) -> DataFrame:
    """(``host``, ``digest``, ``gone``): positions of lines that a page shares with a neighbour, for pages with open lines.

    Rows of a host with the same lines are one page, at the first of their paths; a page without a line is no neighbour.
    """
    order = stored(rows.filter("size(keys) > 0").groupBy("host", "digest")
             .agg(F.min(F.struct("path", "row")).alias("first"), F.first("keys").alias("keys"), F.max(F.size("loose") > 0).alias("open"))
             .select("host", "first.path", "first.row", F.struct("first.row", "host", "digest", "keys", "open").alias("page")), "page-copies")
    pairs = (previous_in_group(order, "host", ["path", "row"], "page", "before")
             .filter("before is not null and (page.open or before.open)")
             .select("page.row", "page.keys", F.col("before.row").alias("row_b"), F.col("before.keys").alias("keys_b")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ats = [], []
            for row, keys, row_b, keys_b in zip(*(c.to_pylist() for c in batch.columns)):
                left, right = shared(keys, keys_b)
                ids += [row, row_b]
                ats += [left, right]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.list_(pa.int32()))], ["row", "at"])

    gone = (pairs.mapInArrow(align, "row long, at array<int>").groupBy("row")
            .agg(F.flatten(F.collect_list("at")).alias("gone")))                        # two neighbours at most
    return stored(order.filter("page.open").select("row", "host", "page.digest").join(gone, "row").drop("row"), "page-shared")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``: the main text of every page, blocks joined by line feeds.

    Null and empty pages give an empty text, as do pages without any; a null URL counts as a host of its own
    with an empty path; repeated rows (and ids) stay, each with its text; pages of any length are read whole;
    an empty table gives no rows; other columns are ignored. Copies of a page within its host lose what the first
    of them by path loses. Of pages with equal paths the order is that of their stored rows.
    """
    ensure_scratch(pages.sparkSession)
    rows = stored(_read(only(pages, page_id=id_col, url=url_col, html=html_col))
                  .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
                  .withColumn("row", F.monotonically_increasing_id()), "page-lines")
    done = rows.filter("size(loose) = 0").select("page_id", "url", F.coalesce("main", F.lit("")).alias("text"))
    # stored before it is joined, so that the rows of a page with many copies can be dealt out anew
    gone = _shared_lines(rows)
    diffed = rows.filter("size(loose) > 0").join(gone, ["host", "digest"], "left").select("page_id", "url", "loose", "loose_at", "gone")

    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            kept = []
            for texts, at, out in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                out = set(out or ())
                kept.append("\n".join(t for t, i in zip(texts, at) if i not in out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return done.unionByName(diffed.mapInArrow(left_over, f"page_id {kind}, url string, text string"))
