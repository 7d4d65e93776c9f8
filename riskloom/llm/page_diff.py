"""Main text of web pages by differencing neighbours.

A page is parsed once into lines (blocks of text) with what the markup says of them: main content, known furniture (menus, forms,
asides; gone at once), or nothing. Equal pages of a host count as one. The different pages of a host are put in order of URL path,
each is paired with the neighbour whose path shares the longer beginning, and their lines are aligned by longest common
subsequence. A shared line is deleted if enough pages of the host hold it; what the markup says is a weight: a line of the
article needs half of the host's pages, and none goes because of a neighbour that is a near copy of the whole page. Only
64-bit hashes of lines are ordered, paired and counted; texts stay where they were written, and a list of places to drop is joined to them.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import small, text_of, written

# Element names by role, and words that name furniture in class, id and role attributes.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "canvas", "object")
FURNITURE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head")
MAIN = ("article", "main")
BLOCKS = (
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notice|pagination|popup|promo|related|replies|reply|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: What the markup says of a line.
PLAIN, ARTICLE, DROPPED = 0, 1, 2
#: Different pages of a host that a shared line stands on at least; fewer if the host has no more.
LEAST_PAGES = 3
#: Share of the shorter page's characters from which two pages are near copies of each other.
NEAR = 0.8


def _furniture(name: str, attributes: str, in_main: bool) -> bool:
    if name in FURNITURE and not (name == "header" and in_main):
        return True
    if not attributes.strip():
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key in ("class", "id") and name not in ("html", "body", *MAIN):
            # Inside an article a header is its title.
            if any(not in_main or "header" not in x.lower() for x in NAMES.findall(value)):
                return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """Lines of a page in order, each with what the markup says of it. Broken markup is read as far as it goes: an end tag closes
    what is open inside its element, and one without a start is passed over."""
    out: list[tuple[str, int]] = []
    # Open elements: name, the main content that holds it (0, 1: an article, 2: the page's main part), whether in furniture.
    stack: list[tuple[str, int, bool]] = []
    within: list[int] = []
    held: list[str] = []

    def close_line() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                main, gone = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                out.append((text, DROPPED if gone else ARTICLE if main else PLAIN))
                within.append(0 if gone else main)

    at, n = 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            held.append(page[at:])
            break
        if found.start() > at:
            held.append(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if name in BLOCKS:
                close_line()
            if depth >= 0 and (name in BLOCKS or all(x[0] not in BLOCKS for x in stack[depth + 1 :])):
                del stack[depth:]
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in BLOCKS:
            close_line()
            if name == "p" or name in ("li", "td", "th", "tr", "dd", "dt"):
                # A new one ends an open one of its kind, if nothing but inline elements stands between.
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), -1)
                if depth >= 0 and stack[depth][0] == name:
                    del stack[depth:]
        elif name == "br":
            held.append(" ")
        if name in VOID or found[3].endswith("/"):
            continue
        main, gone = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        if not gone and (name in BLOCKS or name in FURNITURE or found[3]):
            gone = _furniture(name, found[3], main > 0)
            if gone:
                close_line()
        stack.append((name, max(main, 2 if name == "main" else name in MAIN), gone))
    close_line()
    # Where a page names its main part, an article beside it is a teaser.
    return [(t, PLAIN if w == 1 else s) for (t, s), w in zip(out, within, strict=True)] if 2 in within else out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places of ``a`` in a longest common subsequence with ``b``, by one bit vector a line: time and memory go with len(a) * len(b) / 64 words."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    ones = (1 << len(b)) - 1
    v, rows = ones, [ones]
    for line in a:
        m = where.get(line, 0)
        v = ((v + (v & m)) | (v & ~m)) & ones
        rows.append(v)
    shared, j = set(), len(b) - 1
    for i in range(len(a), 0, -1):
        # Bits are 0 where the subsequence grows: step back to where this row's last growth up to j lies.
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[i - 1] >> j & 1:
            shared.add(i - 1)
            j -= 1
    return shared


def url_parts(url: str) -> tuple[str, str]:
    """Host (lower case) and path, without scheme, query and fragment; an URL without a host is all path."""
    found = re.match(r"(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url)
    return (found[1].lower(), found[2]) if found else ("", re.split(r"[?#]", url)[0])


PARSED = "page long, url string, host string, path string, digest long, lines array<string>, says array<int>, hashes array<bigint>"


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parsed(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """A row of ``PARSED`` for each page: the lines that the markup does not drop, and a digest of these and of what it says of them."""
    longs, strings, ints = pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[x for x in lines_of(h) if x[1] != DROPPED] for h in batch.column("html").to_pylist()]
            hosts = [url_parts(u or "") for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page"), batch.column("url"), pa.array([h for h, _ in hosts], pa.string()), pa.array([p for _, p in hosts], pa.string()),
                    pa.array([line_hash("\n".join(f"{s}{t}" for t, s in x)) for x in kept], pa.int64()), pa.array([[t for t, _ in x] for x in kept], strings),
                    pa.array([[s for _, s in x] for x in kept], ints), pa.array([[line_hash(t) for t, _ in x] for x in kept], longs),
                ],
                ["page", "url", "host", "path", "digest", "lines", "says", "hashes"],
            )

    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), text_of(body).alias("html"))
    return rows.mapInArrow(run, PARSED)


def neighbours(rows: DataFrame) -> DataFrame:
    """``rows`` in order of host, path and digest, with ``before`` and ``after`` (host, path, hashes, sizes; null at the ends).

    Range partitions of even size hold the order, whatever the size of a host. The first and last row of a partition are copied into
    the ones beside it (two rows a partition), so results do not depend on where partitions end.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "digest"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    ranged = written(ranged, "pages_by_url")
    side = F.struct("host", "path", "hashes", "sizes")
    edges = ranged.groupBy("part").agg(F.min_by(side, "at").alias("first"), F.max_by(side, "at").alias("last"))
    line = Window.orderBy("part")
    edges = edges.select("part", F.lag("last").over(line).alias("last"), F.lead("first").over(line).alias("first"))
    edges = written(edges, "page_edges")
    inner = Window.partitionBy("part").orderBy("at")
    out = ranged.withColumns({"b": F.lag(side).over(inner), "a": F.lead(side).over(inner)})
    out = out.join(F.broadcast(edges), "part")
    return out.select("host", "path", "digest", "hashes", "sizes", F.coalesce("b", "last").alias("before"), F.coalesce("a", "first").alias("after"))


def _closeness(path: str, other: dict | None, host: str) -> int:
    if other is None or other["host"] != host:
        return -1
    n = 0
    for x, y in zip(path, other["path"], strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_with_nearest(row: dict) -> tuple[list[int], bool]:
    """Places of the lines that a page shares with the nearer of its neighbours, and whether the two are near copies."""
    near, far = (_closeness(row["path"], row[side], row["host"]) for side in ("before", "after"))
    if max(near, far) < 0:
        return [], False
    other = row["after"] if far > near else row["before"]
    places = sorted(common_lines(row["hashes"], other["hashes"]))
    common = sum(row["sizes"][k] for k in places)
    return places, common >= NEAR * min(sum(row["sizes"]), sum(other["sizes"]))


SHARED = "host string, digest long, place int, hash long, near boolean"


def shared_lines(pages: DataFrame) -> DataFrame:
    """A row of ``SHARED`` for each line that a page has in common with its nearest different page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                places, near = shared_with_nearest(row)
                out += [(row["host"], row["digest"], k, row["hashes"][k], near) for k in places]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "digest", "place", "hash", "near"])

    return neighbours(pages).mapInArrow(run, SHARED)


def dropped_places(rows: DataFrame) -> DataFrame:
    """``host``, ``digest`` and ``gone``: places of the lines that differencing deletes from the pages of a digest."""
    pages = rows.filter(F.size("lines") > 0).groupBy("host", "digest").agg(
        F.min("path").alias("path"), *[F.any_value(c).alias(c) for c in ("hashes", "says")], F.any_value(F.transform("lines", F.length)).alias("sizes")
    )
    pages = written(pages, "different_pages")
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    shared = written(shared_lines(pages.select("host", "path", "digest", "hashes", "sizes")), "shared_lines")
    held = pages.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).filter("n > 1")
    said = pages.select("host", "digest", F.posexplode("says").alias("place", "says"))
    seen = shared.join(held, ["host", "hash"]).join(small(written(totals, "hosts")), "host").join(said, ["host", "digest", "place"])
    most = F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.col("total") / 2)
    some = F.col("n") >= F.least(F.lit(LEAST_PAGES), F.col("total"))
    gone = F.when(F.col("says") == ARTICLE, ~F.col("near") & most).otherwise(most | (~F.col("near") & some))
    return seen.filter(gone).groupBy("host", "digest").agg(F.collect_set("place").alias("gone"))


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``page``, ``url`` and ``text`` for every row of ``pages``.

    A null html is an empty page. A page alone on its host is not differenced. Repeated rows count as one page of their host and keep the
    same text. Where the markup names an article, nothing beside it is text. Pages of any length are parsed whole, in time that grows with
    their lines squared over 64; of two neighbours equally near, the one before counts. Pages without an URL form a host of their own.
    """
    rows = written(parsed(pages, page, url, body), "parsed_pages")
    drops = small(written(dropped_places(rows), "dropped_places"))
    out = rows.join(drops, ["host", "digest"], "left").withColumn("has", F.array_contains("says", ARTICLE))
    kept = F.filter("lines", lambda x, k: ~F.coalesce(F.array_contains("gone", k), F.lit(False)) & (~F.col("has") | (F.get("says", k) == ARTICLE)))
    return out.select(F.col("page").alias(page), F.col("url").alias(url), F.array_join(kept, " ").alias("text"))
