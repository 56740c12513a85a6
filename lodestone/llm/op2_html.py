"""Main text of web pages by nearest-URL page differencing.

*Lines.*  A page is cut into block texts, its lines, each with the place it
stands in: within an article container or not, within furniture (menus, page
headers, footers, sidebars, notices, adverts, forms, comments) by tag, role,
class or id, and whether it is all link.  Scripts, styles and markup are never
lines.

*Pairs.*  Pages of a host that differ only in scheme, query, fragment or a
trailing ``/`` or ``.html`` have one path.  Each path is paired with the nearest
other one of its host: next to it in order among paths that share all but the
last three characters, else among those of its folder, else of the host.

*Differencing.*  The lines of the two pages are aligned by a longest common
subsequence, and lines that both share are deleted.  Pages that share most of
their article lines are copies of one article and not of one template; there,
and for headings and running text whose container says that it is the article,
a shared line is no furniture and stays.  What the page itself marks as
furniture goes with or without a partner.

Lines are compared by 64-bit hashes, so pairing moves small rows only; the texts
are shuffled once, to meet the hashes of their partner.

Defined results: a null or empty page has the empty text.  A null or odd URL has
an empty host or path and is paired like any other.  Repeated rows give repeated
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "object", "head", "search", "canvas", "math", "audio", "video", "map"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar", "alert", "status"}
#: Words of a class or id that mark furniture wherever they stand.
FURNITURE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus dialog feedback footer form gdpr login masthead menu modal nav navbar navigation navi newsletter notice notices notification "
    "notifications overlay pager pagination paywall popup privacy promo promoted promotion recommended recommendations related replies reply "
    "respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription teaser toc toolbar topbar "
    "widget widgets".split()
)
ARTICLE_WORDS = {"article", "articlebody", "entry", "post", "story"}
ARTICLE_PARTS = {"body", "content", "text", "main"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

ARTICLE, FURNITURE, LINKS, HEADING = 1, 2, 4, 8
#: Bits of an alignment that are held at once.
MOST_BITS = 1 << 28


def _kind(name: str, rest: str, above: int) -> int:
    """The flags of an element's inside, given those of its surroundings."""
    flags = above & (ARTICLE | FURNITURE)
    words: set[str] = set()
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            attribute, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if attribute == "role" and value.strip().lower() in FURNITURE_ROLES:
                flags |= FURNITURE
            elif attribute == "role" and value.strip().lower() in ("main", "article"):
                flags |= ARTICLE
            elif attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true":
                flags |= FURNITURE
            elif attribute == "style" and re.search(r"display\s*:\s*none", value, re.I):
                flags |= FURNITURE
            elif attribute in ("class", "id"):
                words.update(_WORDS.findall(_CAMEL.sub(" ", value).lower()))
    if name in FURNITURE_TAGS or name == "header" and not above & ARTICLE:
        flags |= FURNITURE
    if name in ("html", "body"):
        return flags & ~FURNITURE
    if words & FURNITURE_WORDS or "header" in words and not above & ARTICLE and not words & ARTICLE_WORDS:
        flags |= FURNITURE
    if name in ("article", "main") or words & ARTICLE_WORDS and words & ARTICLE_PARTS and name not in ("p", "span", "a"):
        flags |= ARTICLE
    if name == "main" and not above & ARTICLE:
        flags &= ~FURNITURE  # an element before it wasn't closed
    return flags


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The block texts of a page in order, with their flags."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    flags, texts, linked, heading = 0, [], 0, 0
    in_link = 0
    page = page or ""

    def end_line() -> None:
        nonlocal linked
        if texts:
            text = _SPACE.sub(" ", "".join(texts)).strip()
            if text:
                bare = sum(map(len, texts))
                out.append((text, flags | heading | (LINKS if linked >= 0.8 * bare else 0)))
            texts.clear()
        linked = 0

    at, size = 0, len(page)
    match = _TOKEN.match
    while at < size:
        m = match(page, at)
        at = m.end()
        group = m.lastgroup
        if group == "text" or group == "cdata":
            text = m[group]
            if "&" in text and group == "text":
                text = html.unescape(text)
            texts.append(text)
            if in_link and not text.isspace():
                linked += len(text)
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, rest = name.lower(), m["rest"] or m["rest2"] or ""
        if m["close"] or m["close2"]:
            if name == "a":
                in_link = 0
            elif name == "br":
                texts.append(" ")
            elif name == "p" and not any(x[0] == "p" for x in stack):
                end_line()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in BLOCKS or any(x[0] in BLOCKS for x in stack[depth:]):
                        end_line()
                    flags = stack[depth][1]
                    del stack[depth:]
                    if name in HEADINGS:
                        heading = 0
                    break
            continue
        if name in RAW:
            if not rest.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if name in VOID:
            if name == "br" or name == "hr":
                texts.append(" ")
            if name == "hr":
                end_line()
            continue
        if name in BLOCKS:
            end_line()
            ends = CLOSES.get(name)
            if ends or name == "p" or stack and stack[-1][0] == "p":
                for depth in range(len(stack) - 1, -1, -1):
                    inner = stack[depth][0]
                    if inner == "p" or ends and inner in ends:
                        flags = stack[depth][1]
                        del stack[depth:]
                        break
                    if inner in BLOCKS:
                        break
            heading = HEADING if name in HEADINGS else 0
        if rest.endswith("/") and name not in BLOCKS:
            continue
        if name == "a":
            in_link = 1
            continue
        now = _kind(name, rest, flags)
        if now != flags or name in BLOCKS:
            if now != flags and name not in BLOCKS:
                end_line()
            stack.append((name, flags))
            flags = now
        if name in BLOCKS:
            in_link = 0
    end_line()
    return out


def shared_places(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which places of ``mine`` a longest common subsequence with ``other`` uses.

    Equal ends are taken off and lines that the other page lacks left out first;
    the rest is bit-parallel, halved first where its rows would take much memory.
    """
    used = np.zeros(len(mine), bool)
    n = min(len(mine), len(other))
    equal = mine[:n] == other[:n]
    head = n if equal.all() else int(equal.argmin())
    used[:head] = True
    n -= head
    equal = mine[len(mine) - n :][::-1] == other[len(other) - n :][::-1]
    tail = n if equal.all() else int(equal.argmin())
    used[len(mine) - tail :] = True
    a, b = mine[head : len(mine) - tail], other[head : len(other) - tail]
    kept = np.flatnonzero(np.isin(a, b))
    if len(kept):
        b = b[np.isin(b, a)]
        used[head + kept[_subsequence(a[kept].tolist(), b.tolist())]] = True
    return used


class _Masks:
    """For an item the bits of the places it has.  Masks of items with many places are
    kept, within ``MOST_BITS`` in all; the others are made when asked for, so memory
    doesn't grow with the square of a page's lines."""

    def __init__(self, items: list[int]):
        self.places: dict[int, list[int]] = {}
        for i, x in enumerate(items):
            self.places.setdefault(x, []).append(i)
        self.kept: dict[int, int] = {}
        self.room = MOST_BITS // max(len(items), 1)

    def __getitem__(self, item: int) -> int:
        places = self.places.get(item, ())
        if len(places) < 2:
            return 1 << places[0] if places else 0
        if (mask := self.kept.get(item)) is None:
            mask = sum(1 << i for i in places)
            if len(self.kept) < self.room:
                self.kept[item] = mask
        return mask


def _rows(a: list[int], b: list[int]) -> list[int]:
    """After each item of ``b`` the bits of ``a`` where the common length doesn't grow."""
    where, full = _Masks(a), (1 << len(a)) - 1
    v, out = full, []
    for x in b:
        u = v & where[x]
        v = (v + u | v - u) & full
        out.append(v)
    return out


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """The common length of ``a[:i]`` and ``b`` for each ``i``."""
    v = full = (1 << len(a)) - 1
    where = _Masks(a)
    for x in b:
        u = v & where[x]
        v = (v + u | v - u) & full
    out = [0]
    for bit in bin(~v & full)[2:].zfill(len(a))[::-1] if a else "":
        out.append(out[-1] + (bit == "1"))
    return out


def _subsequence(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    if not a or not b:
        return []
    if len(a) * len(b) > MOST_BITS and len(b) > 1:
        half = len(b) // 2
        first, second = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])
        cut = max(range(len(a) + 1), key=lambda i: first[i] + second[len(a) - i])
        return _subsequence(a[:cut], b[:half]) + [cut + i for i in _subsequence(a[cut:], b[half:])]
    rows, out = _rows(a, b), []
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:  # a[i] adds nothing
            i -= 1
        elif j and not rows[j - 1] >> i & 1:  # nor does b[j]
            j -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def main_lines(lines: list[tuple[str, int]], hashes: np.ndarray, partner: np.ndarray | None) -> list[str]:
    """The lines that are the page's main text."""
    flags = np.array([x for _, x in lines], np.int64)
    furniture = flags & FURNITURE > 0
    article = (flags & ARTICLE > 0) & ~furniture
    shared = shared_places(hashes, partner) if partner is not None else np.zeros(len(lines), bool)
    own = article if article.any() else ~furniture
    if shared[own].sum() * 2 > own.sum():
        shared &= ~own  # a copy of the article
    if article.any():
        # the container vouches for text and headings; lists of links can be a template's
        keep = article & ~(shared & (flags & LINKS > 0))
    else:
        keep = ~furniture & ~shared & (flags & LINKS == 0)
    return [lines[i][0] for i in np.flatnonzero(keep)]


def hashes_of(lines: list[tuple[str, int]]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in lines], np.uint64).view(np.int64)


def _addressed(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` with ``host`` and ``path``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.lower(F.substring_index(bare, "/", 1)).alias("host"),
        F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(.*)$", 1), r"(?:/|/index\.html?|\.html?)$", "").alias("path"),
    )


def nearest_paths(addresses: DataFrame) -> DataFrame:
    """``host, path, partner``: the nearest other path, or null if the host has one."""
    stem = F.expr("substring(path, 1, greatest(length(path) - 3, 0))")
    paths = addresses.select("host", "path").distinct()
    paths = paths.withColumn("folder", F.regexp_extract("path", r"^(.*)/", 1)).withColumn("stem", stem)

    def beside(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("path")
        return df.select("*", F.coalesce(F.lag("path").over(order), F.lead("path").over(order)).alias("partner"), F.row_number().over(order).alias("rank"))

    first = common.materialise(beside(paths, "host", "folder", "stem"), "near_paths")
    heads = first.filter("rank = 1")
    lone = F.col("known").isNull()
    second = common.materialise(beside(heads.select("host", "folder", "path", F.col("partner").alias("known")), "host", "folder"), "near_folders")
    third = beside(second.filter("rank = 1").select("host", "path", F.coalesce("known", "partner").alias("known")), "host")
    found = first.filter("partner is not null").select("host", "path", "partner")
    found = found.unionByName(second.filter(lone & F.col("partner").isNotNull()).select("host", "path", "partner"))
    return found.unionByName(third.filter(lone & F.col("partner").isNotNull()).select("host", "path", "partner"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    spark = pages.sparkSession
    common.tune(spark)
    common.shared_dir(spark)
    addressed = _addressed(pages)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes_of(lines_of(x.as_py())) for x in batch.column(3)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["page_id", "host", "path", "hashes"])

    rows = addressed.select("page_id", "host", "path", "html").mapInArrow(thin, "page_id long, host string, path string, hashes array<long>")
    hashed = common.materialise(rows.groupBy("host", "path").agg(F.min(F.struct("page_id", "hashes")).alias("one")).select("host", "path", "one.hashes"), "page_lines")
    pairs = nearest_paths(hashed)
    partners = pairs.join(hashed.select("host", F.col("path").alias("partner"), "hashes"), ["host", "partner"]).select("host", "path", "hashes")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, other in zip(batch.column(2), batch.column(3)):  # one page at a time in Python's memory
                lines = lines_of(page.as_py())
                texts.append("\n".join(main_lines(lines, hashes_of(lines), other.values.to_numpy() if other.is_valid else None)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    # hashes are the small side; pages stream past it and are not sorted
    met = addressed.join(partners.hint("shuffle_hash"), ["host", "path"], "left").select("page_id", "url", "html", "hashes")
    return met.mapInArrow(whole, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
