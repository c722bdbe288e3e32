"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by path; each is paired with the nearer of its two neighbours, copies of itself passed over. The text lines of a
pair are aligned by longest common subsequence, and lines that both pages share are template and are deleted. Markup that names its own role
is taken at its word: what stands in menus, footers, adverts and the like goes, whether shared or not,
and lines inside an article element stay, though a copy of the article stands next to it, if it holds a good part of the text and is no mere teaser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import partitions, small_batches, stored, text_bytes

RAW = "script|style|noscript|template|textarea|title|iframe|svg|object|select"
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
ROLE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# HTML's element names by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "article aside blockquote body button details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
BOILERPLATE = frozenset("aside button dialog fieldset footer form menu nav".split())  # a form only if it does not hold most of the text
MAIN = frozenset("article main".split())
# Words that name, as a class, id or role, what is not main text, and those that may stand beside them in a compound.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "copyright disclaimer discussion disqus footer menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "related reply replies respond responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
BESIDE = frozenset("area bar block bottom box button buttons container footer form global left link links list main page right section site slot top unit wrapper".split())
ARTICLE_SHARE = 1 / 3  # of the characters outside boilerplate that articles hold, or they are teasers

Line = tuple[str, bool, bool]  # text, inside an article, inside boilerplate


@dataclass
class Element:
    """An element that may be main text or boilerplate, by its name or what it is called, and its lines."""

    name: str
    main: bool
    boilerplate: bool
    called: bool
    first: int
    end: int = -1


def is_role(word: str) -> bool:
    """Whether one class, id or role names boilerplate: a word of the list, alone or with words that say where or how it stands."""
    parts = [part for part in re.split(r"[-_]+", word.lower()) if part]
    return not NAMED.isdisjoint(parts) and all(part in NAMED or part in BESIDE for part in parts)


def tags_of(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text before a tag, and the tag's name, whether it ends an element, and its attributes; comments and raw content are passed over.

    The name of what is no tag of interest, and of the end of the page, is empty. One pass: an opening that is never closed takes the rest of the page.
    """
    at = 0
    last = html.rfind(">")
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            yield html[at:start], "", False, ""
            at = end + 3 if end >= 0 else len(html)
            continue
        found = TAG.match(html, start) if start < last else None
        if found is None:
            known = html[start + 1:start + 2] in ("!", "?", "/") and start < last
            end = html.find(">", start) + 1 if known else start + 1
            yield html[at:start if known else end], "", False, ""
            at = end
            continue
        name = found[2].lower()
        yield html[at:start], name, bool(found[1]), found[3]
        at = found.end()
        if name in RAW_END and not found[1] and not found[3].endswith("/"):
            closing = RAW_END[name].search(html, at)
            at = closing.end() if closing else len(html)
    yield html[at:], "", False, ""


def lines_of(html: str | None) -> list[Line]:
    """The text lines of a page in order: one for each block, character references decoded, white space folded.

    What a class, id or role says of an element does not count if it holds most of the text in articles and little else, or, on a page without
    articles, most of the text. The same holds of forms.
    """
    texts: list[str] = []
    elements: list[Element] = []
    stack: list[Element] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            texts.append(text)
        held.clear()

    for before, name, ends, attributes in tags_of(html or ""):
        held.append(before)
        if not name:
            continue
        if name in BLOCKS:
            close()
        if name in RAW_END:
            continue
        if ends:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name == name:
                    close()
                    for element in stack[depth:]:
                        element.end = len(texts)
                    del stack[depth:]
                    break
        elif name not in VOID and not attributes.endswith("/"):
            called = bool(attributes) and name not in MAIN and name not in ("html", "body") and any(
                is_role(word) for found in ROLE.findall(attributes) for word in "".join(found).split())
            if name in CONTAINERS or called:
                if name not in BLOCKS:
                    close()
                # A header inside an article holds its title; a banner at the top of a page does not.
                boilerplate = name in BOILERPLATE or (name == "header" and not any(e.main for e in stack))
                stack.append(Element(name, name in MAIN, boilerplate and name != "form", called or name == "form", len(texts)))
                elements.append(stack[-1])
    close()
    for element in stack:
        element.end = len(texts)
    return _with_roles(texts, elements)


def _with_roles(texts: list[str], elements: list[Element]) -> list[Line]:
    sizes = np.array([len(t) for t in texts], np.int64)

    def covered(chosen: list[Element]) -> np.ndarray:
        edges = np.zeros(len(texts) + 1, np.int64)
        for element in chosen:
            edges[element.first] += 1
            edges[element.end] -= 1
        return np.cumsum(edges[:-1]) > 0

    by_name = [e for e in elements if e.boilerplate]
    open_ = np.r_[0, np.cumsum(sizes * ~covered(by_name))]
    inside = np.r_[0, np.cumsum(sizes * (covered([e for e in elements if e.main]) & ~covered(by_name)))]

    def holds_most(element: Element) -> bool:
        text, main = (total[element.end] - total[element.first] for total in (open_, inside))
        return 2 * main > inside[-1] and inside[-1] >= ARTICLE_SHARE * text if inside[-1] else 2 * text > open_[-1]

    boilerplate = covered(by_name + [e for e in elements if e.called and not holds_most(e)])
    article = covered([e for e in elements if e.main]) & ~boilerplate
    if sizes[article].sum() < ARTICLE_SHARE * sizes[~boilerplate].sum():
        article[:] = False
    return list(zip(texts, article.tolist(), boilerplate.tolist()))


def outside(lines: Sequence[Line]) -> list[Line]:
    """The lines outside boilerplate: those that the comparison of pages decides on."""
    return [line for line in lines if not line[2]]


def _row_lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``, by bit vectors over ``b``."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common_lines(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal ends are cut, then ``a`` is halved and ``b`` cut where the halves have most in common, so no more than a row is held.
    """
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        middle = (a0 + a1) // 2
        there = b[b0:b1]
        total = _row_lengths(a[a0:middle], there) + _row_lengths(a[middle:a1][::-1], there[::-1])[::-1]
        cut = b0 + int(total.argmax())
        todo += [(middle, a1, cut, b1), (a0, middle, b0, cut)]
    return sorted(out)


def main_text(lines: Sequence[Line], shared: Sequence[int] = ()) -> str:
    """What is left of a page: no boilerplate; inside the article if there is one, else without the shared lines."""
    if any(article and not boilerplate for _, article, boilerplate in lines):
        return " ".join(text for text, article, boilerplate in lines if article and not boilerplate)
    template = set(shared)
    return " ".join(text for i, (text, _, boilerplate) in enumerate(lines) if i not in template and not boilerplate)


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case without ``www.``, and the path with all that follows."""
    rest = (url or "").split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    return host.lower().removeprefix("www."), slash + path


def nearness(a: str, b: str) -> int:
    """Characters that two paths have in common from the start."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def template_lines(path: str, own: Sequence[int], before: tuple[str, Sequence[int]] | None, after: tuple[str, Sequence[int]] | None) -> list[int]:
    """Shared lines with the nearer neighbour, the one before on a tie. A copy of the page, which leaves nothing of either, tells nothing of its template."""
    near = sorted((n for n in (before, after) if n is not None), key=lambda n: -nearness(path, n[0]))
    for _, lines in near:
        shared = common_lines(own, lines)
        if len(shared) < max(len(own), len(lines)):
            return shared
    return []


LINES = "k1 long, k2 long, host string, path string, page_id long, lines array<long>"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of the main text of every row.

    Null or empty html gives an empty text; a null URL is a host of its own. Repeated rows are one page to their neighbours and keep a row
    each. The neighbour on a side is the nearest page there whose lines outside boilerplate differ; pages without such lines are nobody's.
    Only hashes of those lines are sorted by host and path, in ranges: a host with a third of all pages is spread over tasks, and the pages next to
    a boundary of ranges, up to four for each range, are carried over it, however many ranges a run of copies fills. The html itself is shuffled
    once, compressed. Other columns are not carried.
    """
    spark = pages.sparkSession
    key = [F.xxhash64(F.lit(seed), page_id, url, html).alias(f"k{seed}") for seed in (1, 2)]
    rows = pages.select(*key, F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sites = [split_url(u) for u in batch.column("url").to_pylist()]
            hashes = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, *_ in outside(lines_of(h))] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array([s[0] for s in sites], pa.string()), pa.array([s[1] for s in sites], pa.string()),
                 batch.column("page_id").cast(pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["k1", "k2", "host", "path", "page_id", "lines"])

    order = ["host", "path", "page_id", "k1", "k2"]
    ranged = stored(
        stored(rows.mapInArrow(digest, LINES).where(F.size("lines") > 0).dropDuplicates(["k1", "k2"]), "lines")
        .repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")
    page, place = F.struct("host", "path", "lines"), F.struct(*order)
    sides = (("before", F.max_by, F.asc), ("after", F.min_by, F.desc))

    def other(a: Column, b: Column) -> Column:
        return (a["host"] != b["host"]) | (a["lines"] != b["lines"])

    # For either side the page that ends each range, and the nearest one to it, there or in ranges beyond, that is no copy of it.
    ends = stored(ranged.groupBy("part").agg(*[pick(page, place).alias(side) for side, pick, _ in sides]), "ends")
    unlike = {side: other(F.col(side), page) for side, *_ in sides}
    ends = ends.join(ranged.join(F.broadcast(ends), "part").groupBy("part").agg(
        *[pick(F.when(unlike[side], page), F.when(unlike[side], place)).alias(f"{side}_2") for side, pick, _ in sides]), "part")
    for side, _, order_by in sides:
        steps = Window.orderBy(order_by("part"))
        beyond = F.lag(side).over(steps)
        ends = ends.withColumn(f"{side}_2", F.coalesce(f"{side}_2", F.when(other(beyond, F.col(side)), beyond)))
        ends = ends.withColumn(f"{side}_2", F.last(f"{side}_2", ignorenulls=True).over(steps))
        ends = ends.withColumns({f"{side}_1": beyond, f"{side}_2": F.lag(f"{side}_2").over(steps)})
    ends = ends.select("part", *[f"{side}_{i}" for side, *_ in sides for i in (1, 2)])
    paired = ranged
    for side, _, order_by in sides:
        steps = Window.partitionBy("part").orderBy(*[order_by(c) for c in order])
        paired = paired.withColumn("step", F.lag(page).over(steps))
        paired = paired.withColumn("step", F.when(other(F.col("step"), page), F.col("step")))
        paired = paired.withColumn(side, F.last("step", ignorenulls=True).over(steps)).drop("step")
    beyond = {side: F.when(other(F.col(f"{side}_1"), page), F.col(f"{side}_1")).otherwise(F.col(f"{side}_2")) for side, *_ in sides}
    # One row for each range is joined.
    paired = paired.join(F.broadcast(ends), "part").select(
        "k1", "k2", "host", "path", "lines", *[F.coalesce(side, beyond[side]).alias(side) for side, *_ in sides])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = []
            for host, path, own, *near in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "lines", "before", "after"))):
                near = [(n["path"], n["lines"]) if n and n["host"] == host else None for n in near]
                found.append(template_lines(path, own, *near))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(found, pa.list_(pa.int32()))], names=["k1", "k2", "shared"])

    shared = stored(paired.mapInArrow(differ, "k1 long, k2 long, shared array<int>"), "shared")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for batch in small_batches(batches):
            packed = [press.compress(h or b"") for h in text_bytes(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "page_id", "url")), pa.array(packed, pa.binary())], names=["k1", "k2", "page_id", "url", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in small_batches(batches):
            pages_ = (unpress.decompress(p).decode() for p in text_bytes(batch.column("packed")))
            texts = [main_text(outside(lines_of(h)), s or ()) for h, s in zip(pages_, batch.column("shared").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    packed = rows.mapInArrow(compress, f"k1 long, k2 long, {schema.split(', ')[0]}, url string, packed binary")
    # Both sides are dealt by the key whatever their size, so that small and large inputs take the same way.
    joined = packed.join(shared.hint("merge"), ["k1", "k2"], "left")
    return joined.select("page_id", "url", "packed", "shared").mapInArrow(cut, schema)
