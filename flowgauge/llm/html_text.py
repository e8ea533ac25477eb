"""Main text of web pages: structure first, then nearest-URL page differencing.

A page becomes lines (blocks of text), each of one kind: *article* or *main* (inside such an element), *boilerplate*
(inside menus, footers, adverts, forms, comments and the like), *hinted* (in an article, but menu, advert or notice by its
class or id) or *open* (none of these). Within each host, pages stand in the
order of their URL paths and every page is paired with the neighbour whose path is nearest. The longest common
subsequence of the two pages' lines is what a template repeats; its open lines are deleted. Lines of an article element
stay, as a passage that two articles share is still text of both.

Only hashes of lines are shuffled, by ranges of (host, path), so a host with most of the pages is spread over all tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.llm.components import _stored

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>?"  # a quote opens a value after = only
    r"|<[!?][^>]*>?",
    re.S,
)
_HINTED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {
    name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I)
    for name in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template")
}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside form svg menu dialog button select".split())
_FALLBACKS = frozenset("object canvas audio video".split())  # inside an article their text is kept
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
#: Words of class, id and role that name what is not the article.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments"
    " respond disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay"
    " widget pager pagination toolbar contentinfo complementary search skip".split()
)
_HEADERS = frozenset(("header", "masthead"))
#: Words that say nothing of what an element holds: with one of the words above they name what is not the article.
_LAYOUT = frozenset(
    "area bar bars block body bottom box btn button buttons card cards center col column container content entry entries form"
    " global group grid head heading holder icon icons inline inner item items left link links list message outer page panel"
    " post posts article articles story stories right row section site slot strip text thread title top unit wrap wrapper".split()
)
#: Of these an id may be: sections of documents get ids from their headings, and "search" or "cookies" may be a heading.
_COMMENTS = frozenset("comment comments respond disqus".split())
_ID_HINTS = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement sidebar breadcrumb breadcrumbs masthead navbar newsletter pager pagination topbar".split()
)
_CONTAINERS = frozenset("article aside details dialog div dl figure menu ol section table ul".split())
COPY_SHARE = 0.8

ARTICLE, MAIN, OPEN, BOILERPLATE, HINTED = "a", "m", "o", "b", "h"


def _hint_words(attributes: str) -> set[str]:
    words: set[str] = set()
    for _, *values in _HINTED.findall(attributes):
        words.update(re.split(r"[^a-z0-9]+", "".join(values).lower()))
    return words


def _hint_inside(name: str, attributes: str) -> str:
    """What class, id and role say of an element inside an article: a kind of lines, or nothing.

    There a name counts only if all its parts are hints or layout words: "comments-area" and "ad-slot" do, "social-impact"
    and "search-api" do not. Ids count on containers only, and articles leave only as comments.
    """
    found = ""
    for attribute, *values in _HINTED.findall(attributes):
        by_id = attribute.lower() == "id"
        if by_id and name not in _CONTAINERS:
            continue
        for word in "".join(values).lower().split():
            parts = [part for part in re.split(r"[^a-z0-9]+", word) if part]
            hints = _HINTS.intersection(parts)
            if not hints or not _LAYOUT.union(hints).issuperset(parts) or (by_id and len(hints) < 2 and not hints & _ID_HINTS):
                continue
            if hints & _COMMENTS:
                return BOILERPLATE
            if name not in ("article", "main"):
                found = HINTED
    return found


def page_lines(source: str) -> tuple[list[str], str]:
    """Lines of a page in order, and a letter for the kind of each."""
    lines: list[str] = []
    kinds: list[str] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, dropped, hinted, article or main
    open_names: dict[str, int] = {}
    dropped = hinted = article = 0
    end = len(source)

    def flush() -> None:
        if parts:
            line = " ".join("".join(parts).split())
            parts.clear()
            if line:
                lines.append(line)
                kinds.append(
                    BOILERPLATE if dropped else HINTED if hinted else MAIN if open_names.get("main") else ARTICLE if article else OPEN
                )

    def pop_to(depth: int) -> None:
        nonlocal dropped, hinted, article
        while len(stack) > depth:
            name, was_dropped, was_hinted, was_article = stack.pop()
            open_names[name] -= 1
            dropped -= was_dropped
            hinted -= was_hinted
            article -= was_article

    def text(a: int, b: int) -> None:
        if a < b:
            piece = source[a:b]
            parts.append(html.unescape(piece) if "&" in piece else piece)

    at = 0
    while at < end:
        tag = source.find("<", at)
        if tag < 0:
            text(at, end)
            break
        m = _TOKEN.match(source, tag)
        if m is None:  # a lone "<" is text
            text(at, tag + 1)
            at = tag + 1
            continue
        text(at, tag)
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif m.group(1):
            if open_names.get(name):
                flush()
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                pop_to(depth)
            elif name in _BLOCK:
                flush()
        elif name in _RAW:
            closing = _RAW[name].search(source, at)
            if name == "xmp":  # text as it stands, with no tags or references in it
                flush()
                parts.append(source[at : closing.start() if closing else end])
                flush()
            at = closing.end() if closing else end
        elif name in _VOID:
            if name in _BLOCK:
                flush()
        else:
            attributes = m.group(3)
            if name in _BLOCK:
                flush()
                if open_names.get("p"):  # a block ends an open paragraph
                    depth = len(stack) - 1
                    while stack[depth][0] != "p":
                        depth -= 1
                    pop_to(depth)
                for other in _CLOSES.get(name, ()):
                    if stack and stack[-1][0] == other:
                        pop_to(len(stack) - 1)
            drop = name in _DROPPED or (not article and name in _FALLBACKS)
            hint = ""
            if name == "header":
                drop = not article
            elif not drop and "=" in attributes and name not in ("html", "body"):
                if article or name in ("article", "main"):
                    hint = _hint_inside(name, attributes)
                    drop = hint == BOILERPLATE
                else:
                    words = _hint_words(attributes)
                    drop = bool(words & _HINTS) or bool(words & _HEADERS)
            if name in _BLOCK or drop or hint:
                if attributes.endswith("/") and name not in _BLOCK:
                    continue
                flush()
                is_article = name in ("article", "main")
                stack.append((name, drop, hint == HINTED, is_article))
                open_names[name] = open_names.get(name, 0) + 1
                dropped += drop
                hinted += hint == HINTED
                article += is_article
    flush()
    return lines, "".join(kinds)


def common_lines(mine: list[int], other: list[int]) -> list[int]:
    """Places in ``mine`` of a longest common subsequence, by bit-parallel dynamic programming."""
    head = 0
    while head < min(len(mine), len(other)) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(mine), len(other)) - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    a, b = mine[head : len(mine) - tail], other[head : len(other) - tail]
    places: dict[int, int] = {}
    for at, value in enumerate(b):
        places[value] = places.get(value, 0) | 1 << at
    full = (1 << len(b)) - 1
    row, rows = full, []
    for value in a:
        both = row & places.get(value, 0)
        row = ((row + both) | (row - both)) & full
        rows.append(row)
    found = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                found.append(head + i)
    return [*range(head), *reversed(found), *range(len(mine) - tail, len(mine))]


_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


def _place(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m.group(1).lower(), m.group(2)) if m else ("", url or "")


_LINES = "key string, host string, path string, lines binary, sizes binary, open binary"


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, url, source in zip(*(column.to_pylist() for column in batch.columns)):
            lines, kinds = page_lines(source or "")
            rows.append(
                (
                    key, *_place(url),
                    np.array([xxhash.xxh3_64_intdigest(line.encode()) for line in lines], np.uint64).tobytes(),
                    np.array([len(line) for line in lines], np.int32).tobytes(), np.array([k == OPEN for k in kinds], bool).tobytes(),
                )
            )
        if rows:
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)],
                names=["key", "host", "path", "lines", "sizes", "open"],
            )


def _nearness(path: str, other: str) -> int:
    n = 0
    while n < min(len(path), len(other)) and path[n] == other[n]:
        n += 1
    return n


def deleted_lines(page: dict, partners: list[dict]) -> list[int]:
    """Open lines of a page that its nearest partner repeats.

    A partner that repeats over four fifths of the page's open lines is a copy of it and says nothing of the template; the
    next one is asked then. Menus and the like, which most pages share anyway, do not count.
    """
    mine = np.frombuffer(page["lines"], np.uint64).tolist()
    sizes, is_open = np.frombuffer(page["sizes"], np.int32), np.frombuffer(page["open"], bool)
    for partner in sorted(partners, key=lambda p: -_nearness(page["path"], p["path"])):
        shared = np.array(common_lines(mine, np.frombuffer(partner["lines"], np.uint64).tolist()), np.int64)
        shared = shared[is_open[shared]]
        if len(shared) and sizes[shared].sum() > COPY_SHARE * sizes[is_open].sum():
            continue
        return shared.tolist()
    return []


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of part, host, path; rows lent by neighbouring parts serve as partners only."""

    def triples():
        before = now = None
        for batch in batches:
            for row in batch.to_pylist():
                if now is not None:
                    yield before, now, row
                before, now = now, row
        if now is not None:
            yield before, now, None

    keys, deleted = [], []
    for before, now, after in triples():
        if now["lent"]:
            continue
        near = [p for p in (before, after) if p is not None and (p["part"], p["host"]) == (now["part"], now["host"])]
        gone = deleted_lines(now, near)
        if gone:
            keys.append(now["key"])
            deleted.append(gone)
        if len(keys) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(deleted, pa.list_(pa.int32()))], names=["key", "deleted"])
            keys, deleted = [], []
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(deleted, pa.list_(pa.int32()))], names=["key", "deleted"])


def _key(*columns: str) -> Column:
    """128 bits of some columns, from two hashes of different seeds."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *columns)))


def template_lines(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``key, deleted``: for pages of which something is deleted, the numbers of these lines.

    ``pages`` has ``key, url, html``; equal pages have equal keys. Pages of a host with the same lines are paired once, for
    the first of their paths, so that copies of a page do not pair with each other.
    """
    lines = pages.mapInArrow(_line_hashes, _LINES)
    content = _key("host", "lines", "open")
    lines = _stored(spark, lines.withColumn("content", content), "page-lines")
    single = lines.groupBy(F.col("content").alias("key")).agg(
        *(F.first(name).alias(name) for name in ("host", "lines", "sizes", "open")), F.min("path").alias("path")
    )
    ranged = single.repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id())
    parts = _stored(spark, ranged, "page-parts")
    row = F.struct("key", "host", "path", "lines", "sizes", "open")
    order = F.struct("host", "path", "key")
    edges = parts.groupBy("part").agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))
    by_part = Window.orderBy("part")  # one row per part
    lent = edges.select(F.lag("part").over(by_part).alias("part"), F.col("first").alias("page")).unionAll(
        edges.select(F.lead("part").over(by_part).alias("part"), F.col("last").alias("page"))
    )
    columns = ["part", "key", "host", "path", "lines", "sizes", "open", "lent"]
    every = parts.withColumn("lent", F.lit(False)).select(columns).unionAll(
        lent.where("part IS NOT NULL").select("part", "page.*").withColumn("lent", F.lit(True)).select(columns)
    )
    deleted = (
        every.repartition("part")
        .sortWithinPartitions("part", "host", "path", "key")
        .mapInArrow(_difference, "key string, deleted array<int>")
        .withColumnRenamed("key", "content")
    )
    # Equal pages may stand in several rows.
    return lines.join(deleted, "content").groupBy("key").agg(F.first("deleted").alias("deleted"))


def main_lines(lines: list[str], kinds: str, deleted) -> list[str]:
    """Article lines; if more open text than that is left, the articles are teasers or parts and both are given in order.

    Without an article, or with only empty ones, the open lines. A main element always holds the text of its page. Lines of
    an article that class or id take for menus, adverts or notices are given only if nothing else is left of the page.
    """
    gone = set(deleted or ())
    kept = [at for at in range(len(lines)) if kinds[at] not in (BOILERPLATE, HINTED) and at not in gone]
    if not kept:
        return [line for line, kind in zip(lines, kinds) if kind == HINTED]
    sizes = {kind: sum(len(lines[at]) for at in kept if kinds[at] == kind) for kind in (ARTICLE, MAIN, OPEN)}
    both = sizes[OPEN] > sizes[ARTICLE] and MAIN not in kinds
    return [lines[at] for at in kept if both or kinds[at] != OPEN]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, deleted in zip(batch.column("_html").to_pylist(), batch.column("_deleted").to_pylist()):
            lines, kinds = page_lines(source or "")
            texts.append("\n\n".join(main_lines(lines, kinds, deleted)))
        keep = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n not in ("_html", "_deleted")]
        yield pa.RecordBatch.from_arrays([*(c for c, _ in keep), pa.array(texts, pa.string())], names=[*(n for _, n in keep), "text"])


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` with ``text``, the main text of ``html``.

    A null or empty page has an empty text; a null URL is a host of its own; equal rows get equal texts; other columns stay
    and one named ``text`` is replaced; an empty table gives an empty table. The page is read twice, as its text is larger
    than all that must be shuffled to pair it.
    """
    key = _key("url", "html")
    deleted = _stored(spark, template_lines(spark, pages.select(key.alias("key"), "url", "html")), "template-lines")
    carried = [f for f in pages.schema if f.name not in ("text", "html", "_html", "_deleted", "_key")]
    body = pages.select(*(F.col(f"`{f.name}`") for f in carried), F.col("html").alias("_html"), key.alias("_key"))
    body = body.join(deleted.select(F.col("key").alias("_key"), F.col("deleted").alias("_deleted")), "_key", "left").drop("_key")
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried)
    return body.mapInArrow(_texts, f"{columns}text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text and the length of that."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_texts(spark, pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
