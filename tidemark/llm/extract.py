"""Main text of web pages by differencing each page with the page of the nearest URL.

1. A page is read into lines, one per block, each with what its markup says:
   chrome (menus, headers, footers, sidebars, notices, adverts, forms, comments),
   article (inside <article> or <main>) or open (neither), and whether it is
   running text (paragraphs, headings, lists, quotes, tables).
2. Pages of a host are paired with two neighbours of the nearest URL path: in the
   order of paths, those of the two pages before and the two after that share the
   longest beginning with it. Pages are dealt over tasks by ranges of this order, so
   a host of any size is spread; a page that is alone with its host in a range takes
   the host's first or last page. Pages of a host with the same lines count as one
   here, so that neighbours differ.
3. The lines of a page are aligned with each neighbour's by their longest common
   subsequence. A line that a neighbour shares is deleted, unless the other neighbour
   lacks it or it is running text inside an article: two articles that quote the same
   paragraph both keep it. A neighbour that shares NEARLY all of a page's running text
   (of all its lines but chrome, where none is running text) is a copy, and these
   lines don't count as shared.
4. What is left of the article, or, where a page marks none, of its open lines,
   is the main text.

Defined results: null html counts as empty and gives empty text; a null url is a
host of its own; repeated rows each get a row; of neighbours that are as near, those
next in the order of paths are taken; unclosed and stray tags are tolerated, in time
linear in the page; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import html as html_module
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, staged

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: HTML element names by what they are, and words that name page furniture in class, id and role.
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("head nav footer aside form button select datalist noscript template iframe svg canvas object audio video dialog menu label".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr figcaption caption".split())
BLOCKS = TEXT | frozenset("html body head title div section article main header nav footer aside form fieldset ul ol dl table thead tbody tfoot figure hr address details summary menu dialog center".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar widget widgets footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended recommendations comment comments commentlist respond replies reply disqus toolbar pagination pager skip contentinfo complementary".split()
)
CHROME, ARTICLE, OPEN = 0, 1, 2


def furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in MARKS.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name in ("class", "id", "role") and not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, CHROME, ARTICLE or OPEN, whether it is running text) of each block of a page with text."""
    out: list[tuple[str, int, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool]] = [("", OPEN, False)]
    unclosed: Counter[str] = Counter()

    def pop() -> None:
        unclosed[stack.pop()[0]] -= 1

    def flush() -> None:
        if held:
            text = " ".join(html_module.unescape("".join(held)).split())
            if text:
                out.append((text, *stack[-1][1:]))
            held.clear()

    at = 0
    while found := TAG.search(page, at):
        if found.start() > at:
            held.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in BLOCKS:
                flush()
            k = len(stack) - 1 if unclosed[tag] else 0
            while k and stack[k][0] != tag:
                k = k - 1 if tag in BLOCKS or stack[k][0] not in BLOCKS else 0  # an inline end tag closes no block
            while k and len(stack) > k:
                pop()
            if tag in ("td", "th"):
                held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            # a paragraph ends where a block begins, an item where the next one does
            closes = ("p",) if tag not in ("li", "tr", "dt", "dd") else ("p", "dt", "dd") if tag in ("dt", "dd") else ("p", tag)
            while any(unclosed[c] for c in closes) and (stack[-1][0] in closes or stack[-1][0] not in BLOCKS):
                pop()
        elif tag in ("br", "td", "th"):
            held.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or found[3].endswith("/"):
            continue
        _, where, text = stack[-1]
        if where != CHROME:
            in_article = where == ARTICLE or tag in ("article", "main")
            where = CHROME if furniture(tag, found[3], in_article) else ARTICLE if in_article else OPEN
        stack.append((tag, where, (tag in TEXT) if tag in BLOCKS else text))
        unclosed[tag] += 1
    held.append(page[at:])
    flush()
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """The positions in a of a longest common subsequence of a and b, by bit-parallel rows."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    spots: dict[int, int] = {}
    for j, v in enumerate(y):
        spots[v] = spots.get(v, 0) | (1 << j)
    full = (1 << len(y)) - 1
    rows = [full]
    for v in x:
        row, hit = rows[-1], rows[-1] & spots.get(v, 0)
        rows.append(((row + hit) | (row - hit)) & full)
    size = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j, middle = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            middle.append(first + i)
        elif size(i - 1, j) >= size(i, j - 1):
            i -= 1
        else:
            j -= 1
    return [*range(first), *middle[::-1], *range(len(a) - last, len(a))]


NEARLY = 0.9  #: a neighbour with this share of a page's body is a copy of it

PARSED = "page_id long, url string, host string, directory string, stem string, same long, marks binary, lines array<string>, at array<int>, sure array<boolean>"
MARK = np.dtype([("print", "u1", 6), ("body", "<u2")])  #: of a line: its hash, and its length if it is of the body


def _parts(url: str | None) -> tuple[str, str, str]:
    """Host, directory and last part of a URL's path, without scheme, query, fragment, ending and slash."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "")
    host, _, path = re.split(r"[?#]", rest)[0].partition("/")
    path = re.sub(r"\.\w{1,5}$", "", path.rstrip("/"))
    directory, _, stem = path.rpartition("/")
    return host.lower(), directory, stem


def _body(page: list[tuple[str, int, bool]]) -> list[int]:
    """The length of each line of the body: running text, or where there is none every line but chrome; 0 for other lines."""
    text = [place != CHROME and bool(running) for _, place, running in page]
    if not any(text):
        text = [place != CHROME for _, place, _ in page]
    return [len(x[0]) if t else 0 for x, t in zip(page, text)]


def _marks(page: list[tuple[str, int, bool]], prints: np.ndarray) -> bytes:
    out = np.zeros(len(page), MARK)
    out["print"] = prints.view(np.uint8).reshape(-1, 8)[:, :6]
    out["body"] = np.minimum(_body(page), 65535)
    return out.tobytes()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [lines(p or "") for p in batch.column("html").to_pylist()]
        where = [_parts(u) for u in batch.column("url").to_pylist()]
        flat = [t for page in found for t, *_ in page]
        prints = pd.util.hash_array(np.array(flat, object), categorize=False) if flat else np.zeros(0, np.uint64)
        ends = np.cumsum([0] + [len(p) for p in found])
        marks = [_marks(p, prints[s:e]) for p, s, e in zip(found, ends[:-1], ends[1:])]
        # what can be in the text: the article's lines, or the open ones of a page without one
        wanted = [ARTICLE if any(x[1] == ARTICLE for x in p) else OPEN for p in found]
        left = [[(i, *x) for i, x in enumerate(p) if x[1] == w] for p, w in zip(found, wanted)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), *[pa.array([w[k] for w in where], pa.string()) for k in range(3)],
                pa.array([int.from_bytes(hashlib.blake2b(m, digest_size=8).digest(), "little", signed=True) for m in marks], pa.int64()), pa.array(marks, pa.binary()),
                pa.array([[x[1] for x in p] for p in left], pa.list_(pa.string())), pa.array([[x[0] for x in p] for p in left], pa.list_(pa.int32())),
                pa.array([[x[2] == ARTICLE and x[3] for x in p] for p in left], pa.list_(pa.bool_())),
            ],
            [f.split()[0] for f in PARSED.split(", ")],
        )


def parsed(pages: DataFrame) -> DataFrame:
    return only(pages, "page_id", "url", "html").mapInArrow(_parse, PARSED)


def nearest(path: str, others: list[tuple[str, int]]) -> list[int]:
    """The two of others (path, page; the closest in order first) whose paths share the longest beginnings with path."""
    shared = lambda other: len(os.path.commonprefix([path, other[0]]))
    return [page for _, page in sorted(others, key=shared, reverse=True)[:2]]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, same, partner of sorted pages: two rows a page, one or none where there are no more of its host."""
    held: list[tuple[str, int, str]] = []  # two pages before, the page, two after

    def found(k: int) -> list[tuple[str, int, int]]:
        host, same, path = held[k]
        others = [held[j] for d in (1, 2) for j in (k - d, k + d) if 0 <= j < len(held) and held[j][0] == host]
        return [(host, same, p) for p in nearest(path, [(x[2], x[1]) for x in others])]

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "same", "partner"])

    at = 0
    for batch in batches:
        rows = []
        for host, same, directory, stem in zip(*(batch.column(c).to_pylist() for c in ("host", "same", "directory", "stem"))):
            held.append((host, same, f"{directory}/{stem}"))
            if len(held) - at == 3:
                rows += found(at)
                at += 1
            if at > 2:
                held.pop(0)
                at -= 1
        yield out(rows)
    yield out([x for k in range(at, len(held)) for x in found(k)])


def neighbours(pages: DataFrame) -> DataFrame:
    """host, same, partner: up to two neighbours of each page; pages: host, same, directory, stem, distinct by host and same."""
    order = ["host", "directory", F.length("stem"), "stem", "same"]
    near = staged(pages.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "host string, same long, partner long"), "page-pairs")
    ends = pages.groupBy("host").agg(F.min(F.struct(*order))["same"].alias("low"), F.max(F.struct(*order))["same"].alias("high")).filter("low <> high")
    alone = pages.select("host", "same").join(near, ["host", "same"], "left_anti").join(ends, "host")
    return near.unionByName(alone.select("host", "same", F.when(F.col("same") != F.col("low"), F.col("low")).otherwise(F.col("high")).alias("partner")))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for own, others in zip(batch.column("own").to_pylist(), batch.column("others").to_pylist()):
            own = np.frombuffer(own, MARK)
            prints, body = [x.tobytes() for x in own["print"]], own["body"].tolist()
            bare, full = [], []  # what neighbours share of the lines outside the body, and of the body
            for other in others:
                shared = common(prints, [x.tobytes() for x in np.frombuffer(other, MARK)["print"]])
                bare.append({i for i in shared if not body[i]})
                if sum(body[i] for i in shared) < NEARLY * sum(body):  # else it is a copy, which says nothing about the body
                    full.append({i for i in shared if body[i]})
            found.append(sorted(set.intersection(*bare) | (set.intersection(*full) if full else set())))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("same"), pa.array(found, pa.list_(pa.int32()))], ["host", "same", "shared"])


def differences(slim: DataFrame) -> DataFrame:
    """host, same, shared: the numbers of a page's lines that its neighbours share. slim: host, directory, stem, same, marks."""
    one = slim.groupBy("host", "same").agg(F.min(F.struct("directory", "stem")).alias("x")).select("host", "same", "x.*")
    marks = slim.groupBy("host", "same").agg(F.first("marks").alias("marks"))
    sent = staged(neighbours(staged(one, "page-paths")), "page-neighbours").join(marks.withColumnRenamed("same", "partner"), ["host", "partner"])
    others = sent.groupBy("host", "same").agg(F.array_sort(F.collect_list("marks")).alias("others"))
    return marks.withColumnRenamed("marks", "own").join(others, ["host", "same"]).mapInArrow(_shared, "host string, same long, shared array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    rows = parsed(pages)
    slim = staged(rows.select("host", "directory", "stem", "same", "marks"), "page-marks")
    texts = rows.select("page_id", "url", "host", "same", "lines", "at", "sure").join(staged(differences(slim), "page-shared"), ["host", "same"], "left")
    kept = F.filter(F.arrays_zip("lines", "at", "sure"), lambda x: x["sure"] | ~F.coalesce(F.array_contains("shared", x["at"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda x: x["lines"]), "\n")
    return texts.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
