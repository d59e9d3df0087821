"""Main text of web pages: differencing against the page with the nearest URL, then structure.

A page is cut into text lines (one per block element).  Within each host, a page is paired with the
page of the nearest URL path whose lines differ; the lines of the two are aligned by their longest
common subsequence, and shared lines are deleted: they are the site's, not the page's.  Lines inside an
``article`` or ``main`` element are the page's own even if another page has them too.  Then structure
takes what differencing left: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and comments are recognised by element, role, class and id, and the text of an ``article`` (or ``main``)
is the main text where there is one.

Defined cases: null or empty html gives an empty text; unknown URLs count as one host; copies of a page
have one partner; a page without a page that differs on its host loses nothing to differencing; repeated
rows give repeated results; pages and URLs of any length are read whole, in linear time.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import checkpointed

# Element names and the words of class, id and role that mark what is not main text.
RAW = frozenset("script style noscript template svg math iframe object canvas video audio textarea select head title".split())
CHROME = frozenset("nav footer aside form dialog menu button fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert sidebar aside comment comments reply replies respond disqus nav navbar navigation menu breadcrumb breadcrumbs footer masthead share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager widget toolbar "
    "contentinfo complementary search form dialog hidden".split()
)
#: Words that say nothing of a compound name's meaning: it is marked if all its other words are.
NEUTRAL = frozenset(
    "site page global main top bottom left right side box wrapper wrap container inner outer area section block bar unit slot list item items link links "
    "button buttons text title post posts article articles content primary secondary col column row fixed sticky widgets panel".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PARTS = re.compile(r"[a-z]+")
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

#: What a line is: in an article, in main, in neither; plus CHROME_BIT if something marks it as not main text.
PLAIN, MAIN, ARTICLE, CHROME_BIT = 0, 1, 2, 4


def _named(name: str, inside: int) -> bool:
    """Whether a class or id is the name of something that is not main text: each of its words is a mark
    or says nothing, and one is a mark ("ad-box" is, "no-sidebar" and "overflow-hidden" are not)."""
    words = set(_PARTS.findall(name))
    marks = words & MARKS
    if "header" in words and not inside and not words & {"article", "post", "content"}:
        marks.add("header")
    return bool(marks) and words - marks <= NEUTRAL


def _marked(name: str, attributes: str, inside: int) -> bool:
    if name in CHROME or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif key == "role":
            if value in MARKS or value == "banner":
                return True
        elif any(_named(x, inside) for x in value.split()):
            return True
    return False


def lines(page: str | None) -> list[tuple[str, int]]:
    """The text lines of a page with what each is."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []
    state, at, page = PLAIN, 0, page or ""

    def close() -> None:
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            text = " ".join(text.split())
            if text:
                out.append((text, state))

    while m := _TAG.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            buffer.append(_html.unescape(piece) if "&" in piece else piece)
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            continue
        close()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    state = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                end = _END[name].search(page, at)
                at = end.end() if end else (len(page) if name not in ("head", "title") else at)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "p":  # an open paragraph ends here; it never holds another block
            continue
        stack.append((name, state))
        if not state & CHROME_BIT and _marked(name, m[3], state):
            state |= CHROME_BIT
        elif name == "article":
            state |= ARTICLE
        elif name == "main" or "main" in m[3] and re.search(r"role\s*=\s*[\"']?main\b", m[3]):
            state |= MAIN
    if at < len(page):
        rest = page[at:]
        cut = rest.find("<") if re.search(r"<[/!a-zA-Z][^>]*\Z", rest) else -1
        buffer.append(_html.unescape(rest[: rest.rfind("<")] if cut >= 0 else rest))
    close()
    return out


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` on a longest common subsequence with ``b`` (bit-parallel, any length)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


def _parted(found: list[tuple[str, int]], shared: set[int]) -> tuple[list[str], int]:
    """The main text's lines, and how many differencing deleted.

    Differencing comes first: a line that the partner has too goes, unless it is inside an article or
    main element, whose text is the page's own.  Of what is left, lines marked as not main text go; then
    the article's lines are the text, else those of main, else all.
    """
    left = [(text, state) for k, (text, state) in enumerate(found) if k not in shared or (state & (ARTICLE | MAIN) and not state & CHROME_BIT)]
    own = [(text, state) for text, state in left if not state & CHROME_BIT]
    for want in (ARTICLE, MAIN):
        best = [text for text, state in own if state & want]
        if best:
            return best, len(found) - len(left)
    return [text for text, _ in own], len(found) - len(left)


def main_text(found: list[tuple[str, int]], shared: set[int]) -> str:
    """The main text of a page's lines, of which its partner has those numbered ``shared``."""
    return " ".join(_parted(found, shared)[0])


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def nearness(own: str, other: str) -> int:
    """Characters that two paths share at their beginning."""
    n = min(len(own), len(other))
    if own[:n] == other[:n]:
        return n
    low, high = 0, n  # own[:low] is shared, own[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if own[low:mid] == other[low:mid]:
            low = mid
        else:
            high = mid
    return low


def partners(contents: DataFrame) -> DataFrame:
    """``contents`` (``host``, ``path``, ``k1``, ``k2``, ``hashes``; different in host, k1 and k2) with
    ``other``, the ``hashes`` of the nearest path on the same host (of two that are equally near the one
    before in the order of paths); contents that are alone on their host are left out.

    The nearest path is next to a path in their order, so contents are sorted in ranges of (host, path),
    a large host over many, and each range is completed by the rows next to its ends.
    """
    order = ["host", "path", "k1", "k2"]
    ranges = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(contents.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    row = F.struct(*order, "hashes")
    ends = ranged.groupBy("range").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    along = Window.orderBy("range")  # two rows of each range
    ends = checkpointed(ends.select(F.lead("first").over(along).alias("after"), F.lag("last").over(along).alias("before"), "range"))
    ends = ends.select("range", F.explode(F.array("before", "after")).alias("row")).where("row is not null").select("row.*", "range", F.lit(False).alias("mine"))
    every = ranged.select(*order, "hashes", "range", F.lit(True).alias("mine")).unionByName(ends)

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = current = None  # rows (range, host, path, hashes, k1, k2, mine)

        def partner(row, before, after):
            near = [x for x in (before, after) if x is not None and x[:2] == row[:2]]
            return max(near, key=lambda x: nearness(row[2], x[2]))[3] if near else None  # the first of equals

        for part in chain(parts, [None]):
            out = []
            for row in chain(zip(*[part[c] for c in ("range", "host", "path", "hashes", "k1", "k2", "mine")]) if part is not None else [None]):
                if current is not None and current[6]:
                    other = partner(current, before, row)
                    if other is not None:
                        out.append((current[1], current[4], current[5], current[3], other))
                before, current = current, row
            yield pd.DataFrame(out, columns=["host", "k1", "k2", "hashes", "other"])

    dealt = every.repartition(ranges, "range").sortWithinPartitions("range", *order)
    return dealt.mapInPandas(choose, "host string, k1 long, k2 long, hashes array<long>, other array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``, ``n_shared`` (lines deleted as shared) per page.

    ``pages`` has ``page_id``, ``url``, ``html``; other columns are ignored.  Only hashes of lines are
    sorted; the lines travel once, compressed (pages are parsed twice, as keeping the lines in between takes
    more disk than parsing takes time).  Pages with the same lines on a host are
    copies: they share their partner, the page nearest to the first of their paths that differs from them.
    """
    pages = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"))
    types = dict(pages.dtypes)

    def parsed(kept: tuple[str, ...]):
        def parse(batches):
            import pyarrow as pa

            press = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                for s in range(0, len(batch), 64):
                    part, k1, k2, hashes, packed = batch.slice(s, 64), [], [], [], []
                    for page in part.column("html"):
                        found = lines(page.as_py())
                        body = "\n".join(f"{state}{text}" for text, state in found).encode("utf-8", "surrogatepass")
                        whole = xxhash.xxh3_128_intdigest(body)
                        k1.append((whole >> 64) - (1 << 63))
                        k2.append((whole & (1 << 64) - 1) - (1 << 63))
                        if "hashes" in kept:
                            hashes.append([xxhash.xxh3_64_intdigest(text) - (1 << 63) for text, _ in found])
                        else:
                            packed.append(press.compress(body))
                    last = pa.array(hashes, pa.list_(pa.int64())) if "hashes" in kept else pa.array(packed, pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept[:-1]), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), last], names=[*kept[:-1], "k1", "k2", kept[-1]])

        of = types | {"hashes": "array<long>", "packed": "binary"}
        return pages.mapInArrow(parse, ", ".join([*(f"{c} {of[c]}" for c in kept[:-1]), "k1 long", "k2 long", f"{kept[-1]} {of[kept[-1]]}"]))

    contents = parsed(("host", "path", "hashes")).groupBy("host", "k1", "k2").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"))

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["shared"] = [aligned(list(a), list(b)) for a, b in zip(part["hashes"], part["other"])]
            part = part.loc[part["shared"].map(len) > 0, ["host", "k1", "k2", "shared"]]
            yield part.set_axis(["shared_host", "shared_k1", "shared_k2", "shared"], axis=1)

    shared = partners(contents).mapInPandas(compare, "shared_host string, shared_k1 long, shared_k2 long, shared array<int>")

    def finish(batches):
        import pyarrow as pa

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, gone = [], []
            for packed, found in zip(batch.column("packed"), batch.column("shared")):
                body = unpress.decompress(packed.as_buffer()).decode("utf-8", "surrogatepass")
                kept, deleted = _parted([(x[1:], int(x[0])) for x in body.split("\n")] if body else [], set(found.as_py() or ()))
                texts.append(" ".join(kept).encode("utf-8", "replace").decode())
                gone.append(deleted)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_shared"])

    texts = parsed(("page_id", "url", "host", "packed"))
    out = texts.join(shared, (F.col("host") == F.col("shared_host")) & (F.col("k1") == F.col("shared_k1")) & (F.col("k2") == F.col("shared_k2")), "left")
    out = out.select("page_id", "url", "packed", "shared")
    return out.mapInArrow(finish, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, n_shared long")
