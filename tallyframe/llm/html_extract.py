"""Main text of web pages by differencing against the page with the nearest URL.

A page becomes text lines, one for each block, each with what its markup says: inside an article (or main
part), inside something that is no article text (menu, header, footer, sidebar, notice, advert, form,
comments), or neither. Pages are range-sorted by host and URL path, so each stands beside those with
the nearest paths of its host. Pages are copies, and tell nothing apart, where neither has more than a little main text of its own; a
page and those after it that are each a copy of the one before are a run. A page is paired with the nearest page outside
its run, before or after, that shares the longer path prefix (a tie: the one before; a copy again: the other one). The lines
of the pair are aligned by their longest common subsequence, and shared lines are deleted, inside an article too if they
are main text in both pages. Lines that the markup marks as no article text go too, and in a page with an article all lines outside it.

One shuffle, of parsed and compressed lines; the raw HTML stays where it is read. Sorting by range splits
a host of any size over many tasks. The first and the last run of a range, with the page next to each, go to a second small pass
by host, so that the result does not depend on where ranges end. A page alone in its host, or with copies only, has no pair and is judged by its markup.

Defined cases: null html gives an empty text; null URLs have an empty host and path and are neighbours of
each other. Repeated rows each get a result. An empty table gives an empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import json
import pickle
import re
import tempfile
from bisect import bisect_left, bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.url_filter import host_of, path_of

#: Of a page's main text what it may have of its own beside a copy; or up to OWN characters, if they are a fifth of it at most.
DIFFERS, OWN = 0.05, 20
#: Bytes of pages that wait for the end of their run of copies in memory; more wait in a file.
HELD = 32_000_000
#: At most as many keys are drawn to cut the pages into ranges.
SAMPLE = 5000
#: With more matching line pairs than this, as on pages of lines much repeated, pages are halved before they are aligned, which bounds the memory.
MATCHES = 200_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(script|style|noscript|template|iframe|svg|select|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*)>
    |<[/!?a-zA-Z][^>]*(?:>|\Z)
    |[^<]+|<""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NO_TEXT = frozenset("nav footer aside form button dialog menu head fieldset".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login "
    "comment comments reply replies respond disqus masthead topbar contentinfo".split()
)
#: Words that mark what stands around an article; inside one they can be a name for its own text, and the differencing decides.
_AROUND = frozenset("promo promotion banner overlay related recommended share sharing social widget toolbar search pagination pager copyright skip complementary alert".split())
_INNER, _OUTER, _NONE = 1, 0, 2  # inside an article, neither, no article text


def _marked(attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether attributes mark an element, inside an article or not, as no article text, and as the page's article."""
    none = inner = False
    marks = _MARKS if inside else _MARKS | _AROUND
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden":
            none |= value in ("", "true", "hidden", "until-found")
        elif name == "itemprop":
            inner |= value == "articlebody"
        else:
            words = re.split(r"[^a-z0-9]+", value)
            none |= not marks.isdisjoint(words)
            inner |= name == "role" and value in ("main", "article")
    return none, inner


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(where, text) of each text block, in page order; where is 1 inside an article, 2 in what is no article text, else 0."""
    out: list[tuple[int, str]] = []
    words: list[str] = []
    # of each open element its name and the state before it; state: (inside what is no text, inside an article)
    open_: list[tuple[str, bool, bool]] = []
    none = inner = False

    def end_block():
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                out.append((_NONE if none else _INNER if inner else _OUTER, text))
            words.clear()

    for found in _TOKEN.finditer(page or ""):
        name = found[3]
        if name is None:
            token = found[0]
            if token[0] != "<" or token == "<":
                words.append(token)
            elif found[1] and found[1].lower() in ("title", "iframe", "noscript"):
                end_block()
            continue
        name = name.lower()
        if name in _BLOCKS:
            end_block()
        elif name == "br":
            words.append(" ")
        if found[2]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    _, none, inner = open_[k]
                    del open_[k:]
                    break
        elif name not in _VOID and not found[4].endswith("/"):
            if name == "p":  # a paragraph ends the one before it
                if open_ and open_[-1][0] == "p":
                    _, none, inner = open_.pop()
            open_.append((name, none, inner))
            marked, is_inner = _marked(found[4], inner) if found[4] else (False, False)
            if name in ("article", "main") or is_inner:
                inner = True
            if name in _NO_TEXT or marked and name not in ("html", "body", "article", "main"):
                none = True
            elif name == "article" and marked:
                none = True
            elif name == "header":
                none = True
            elif name in _HEADINGS and inner and open_ and any(x[0] == "header" for x in open_) and not _outer_none(open_):
                none = False
    end_block()
    return out


def _outer_none(open_: list[tuple[str, bool, bool]]) -> bool:
    """Whether the outermost open header stands in what is no article text, or outside every article."""
    _, none, inner = next(x for x in open_ if x[0] == "header")
    return none or not inner


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of a and each beginning of b, by one bit for each place in b."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks: dict = {}
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        js = places.get(x)
        if js is None:
            continue
        mask = masks.get(x)
        if mask is None:
            bits = bytearray(len(b) // 8 + 1)
            for j in js:
                bits[j >> 3] |= 1 << (j & 7)
            mask = int.from_bytes(bits, "little")
            if len(js) > 64:  # few lines are so frequent that their masks could need much memory
                masks[x] = mask
        met = row & mask
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _halved(a: list, b: list, places: dict) -> list[tuple[int, int]]:
    """A longest common subsequence in memory that grows with the pages alone: a is cut in half, b where the halves' lengths add to most."""
    if len(a) == 1:
        return [(0, places[a[0]][0])] if a[0] in places else []
    half = len(a) // 2
    at = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    return common(a[:half], b[:at]) + [(half + i, at + j) for i, j in common(a[half:], b[at:])]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of a and b as pairs of places."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    middle_a, middle_b = a[start : len(a) - end], b[start : len(b) - end]
    places: dict = {}
    for j, x in enumerate(middle_b):
        places.setdefault(x, []).append(j)
    if sum(len(places.get(x, ())) for x in middle_a) > MATCHES:
        middle = [(start + i, start + j) for i, j in _halved(middle_a, middle_b, places)]
        return [(k, k) for k in range(start)] + middle + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]
    tails: list[int] = []  # the least end in b of a subsequence of each length
    links: list[tuple] = []
    for i, x in enumerate(middle_a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    pairs = [(k, k) for k in range(start)]
    middle, link = [], links[-1] if links else None
    while link:
        middle.append((start + link[0], start + link[1]))
        link = link[2]
    pairs += middle[::-1]
    return pairs + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def shared_prefix(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return k


def _content(lines: list[tuple[int, str]]) -> int:
    """Where the main text of a page stands: inside its article, if it has one."""
    return _INNER if any(where == _INNER for where, _ in lines) else _OUTER


def shared(lines: list[tuple[int, str]], other: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """The aligned lines of two pages as pairs of places."""
    return common([text for _, text in lines], [text for _, text in other])


def copies(lines: list[tuple[int, str]], other: list[tuple[int, str]], pairs: list[tuple[int, int]]) -> bool:
    """Whether neither of two pages has text of its own worth naming, so that they tell nothing apart."""
    mine, theirs = _content(lines), _content(other)
    both = [(i, j) for i, j in pairs if lines[i][0] == mine and other[j][0] == theirs]
    same = sum(len(lines[i][1]) for i, _ in both)

    def little(all_of_it: int) -> bool:
        own = all_of_it - same
        return own <= DIFFERS * all_of_it or own <= OWN and 5 * own <= all_of_it

    return same > 0 and all(little(sum(len(text) for where, text in x if where == wanted)) for x, wanted in ((lines, mine), (other, theirs)))


def left_over(lines: list[tuple[int, str]], other: list[tuple[int, str]], pairs: list[tuple[int, int]]) -> str:
    """The text of a page without what it shares with another that is no copy."""
    theirs = _content(other)
    # a line of an article goes if it is main text there too: a sidebar that names the article takes nothing from it
    drop = {i for i, j in pairs if lines[i][0] != _INNER or other[j][0] == theirs}
    wanted = _content(lines)
    return "\n\n".join(text for k, (where, text) in enumerate(lines) if where == wanted and k not in drop)


def main_text(lines: list[tuple[int, str]], other: list[tuple[int, str]] | None) -> str:
    """The text of a page, given its lines and those of its pair."""
    pairs = shared(lines, other) if other is not None else []
    if other is None or copies(lines, other, pairs):
        return left_over(lines, [], [])
    return left_over(lines, other, pairs)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _key(host, path, page_id):
    """What pages are sorted by, as Spark does."""
    return host, path, page_id is not None, page_id or 0


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """Keys that cut the sorted pages into about as many ranges, from a sample of at most SAMPLE keys."""
    keys = rows.select("host", F.substring("path", 1, 500).alias("path"), "page_id")
    sample = sorted(_key(*r) for r in keys.orderBy(F.xxhash64("page_id", "host", "path")).limit(min(SAMPLE, 20 * parts)).collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def _numbers(spark: SparkSession, parts: int) -> list[int]:
    """A number for each range, of which each hashes to a shuffle partition of its own."""
    number = F.col("id").cast("int")
    found = spark.range(40 * parts).groupBy(F.pmod(F.hash(number), F.lit(parts)).alias("at")).agg(F.min(number).alias("number")).collect()
    numbers = sorted(r.number for r in found)
    return numbers + [40 * parts + k for k in range(parts - len(numbers))]


def _parsed(batches, bounds: list[tuple], numbers: list[int]):
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in (2, 3, 0)), strict=True)
        part = [numbers[bisect_right(bounds, _key(*k))] for k in keys]
        packed = [_PACK.compress(json.dumps(lines_of(h.as_py()), ensure_ascii=False).encode("utf-8", "surrogatepass")) for h in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(packed, pa.binary()), pa.array(part, pa.int32())], names=["page_id", "url", "host", "path", "lines", "part"])


_EDGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary()), ("part", pa.int32()), ("wanted", pa.bool_())])
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


class _Page:
    """A row of the sorted table, its lines unpacked when they are needed."""

    __slots__ = ("page_id", "url", "host", "path", "packed", "_lines")

    def __init__(self, page_id, url, host, path, packed):
        self.page_id, self.url, self.host, self.path, self.packed, self._lines = page_id, url, host, path, packed, None

    def row(self):
        return self.page_id, self.url, self.host, self.path, self.packed

    @property
    def lines(self):
        if self._lines is None:
            self._lines = json.loads(_UNPACK.decompress(self.packed).decode("utf-8", "surrogatepass"))
        return self._lines


class _Run:
    """Pages in order of which each is a copy of the one before; beyond HELD bytes they wait in a file."""

    def __init__(self, page: _Page, before: _Page | None, pairs):
        self.before, self.pairs = before, pairs  # the last page of the run before, and its lines aligned with page's
        self.first = self.last = page
        self._held: list[_Page] = []
        self._bytes = 0
        self._file = None

    def add(self, page: _Page):
        """Takes the page after the last."""
        if self.last is not self.first:
            self.last._lines = None
            if self.last.packed == page.packed:
                page.packed = self.last.packed  # kept once
            else:
                self._bytes += len(page.packed)
            self._held.append(self.last)
            if self._bytes > HELD:
                self._file = self._file or tempfile.TemporaryFile()
                for p in self._held:
                    pickle.dump(p.row(), self._file)
                self._held, self._bytes = [], 0
        self.last = page

    def pages(self):
        yield self.first
        if self._file:
            self._file.seek(0)
            while True:
                try:
                    yield _Page(*pickle.load(self._file))
                except EOFError:
                    break
            self._file.close()
        yield from self._held
        if self.last is not self.first:
            yield self.last

    def texts(self, after: _Page | None, pairs):
        """Each page with its text; after is the first page of the run after, aligned with the last page by pairs."""
        for page in self.pages():
            near = [x for x in (self.before, after) if x]
            near.sort(key=lambda x: -shared_prefix(x.path, page.path))  # a tie: the one before
            text = None
            for other in near:
                if page is self.first and other is self.before:
                    aligned = [(j, i) for i, j in self.pairs]
                elif page is self.last and other is after:
                    aligned = pairs
                else:  # the page before always stands first, as two alignments can be equally long
                    aligned = shared(page.lines, other.lines) if other is after else [(j, i) for i, j in shared(other.lines, page.lines)]
                    if copies(page.lines, other.lines, aligned):
                        continue
                text = left_over(page.lines, other.lines, aligned)
                break
            yield page, left_over(page.lines, [], []) if text is None else text
            if page is not self.last:
                page._lines = None


def _runs(batches):
    """(run, first page of the run after in its host or None, their lines aligned, whether the range's first or last run) in order."""
    run, part, at_edge = None, None, True
    for batch in batches:
        for k in range(batch.num_rows):
            page, its = _Page(*(batch.column(c)[k].as_py() for c in range(5))), batch.column(5)[k].as_py()
            if run is None or its != part:
                if run:
                    yield run, None, None, True
                run, part, at_edge = _Run(page, None, None), its, True
            elif run.last.host != page.host:
                yield run, None, None, at_edge
                run, at_edge = _Run(page, None, None), False
            else:
                pairs = shared(run.last.lines, page.lines)
                if copies(run.last.lines, page.lines, pairs):
                    run.add(page)
                else:
                    yield run, page, pairs, at_edge
                    run, at_edge = _Run(page, run.last, pairs), False
    if run:
        yield run, None, None, True


def _inner(batches):
    """Pages with their texts, but for those of the first and the last run of a range."""

    def texts():
        for run, after, pairs, at_edge in _runs(batches):
            if not at_edge:
                yield from ((page.page_id, page.url, text, len(text)) for page, text in run.texts(after, pairs))

    return _given(texts(), _OUT, lambda row: row[3])


def _edges(batches):
    """The pages of the first and the last run of each range (wanted), and the pages of its host next to them."""

    def rows():
        for run, after, _, at_edge in _runs(batches):
            if at_edge:
                if run.before:
                    yield *run.before.row(), 0, False
                yield from ((*page.row(), 0, True) for page in run.pages())
                if after:
                    yield *after.row(), 0, False

    return _given(rows(), _EDGES, lambda row: len(row[4]))


def _at_edges(batches):
    """The wanted pages of whole hosts with their texts."""
    wanted = deque()

    def marked():
        for batch in batches:
            wanted.extend(batch.column(6).to_pylist())
            yield batch

    def texts():
        for run, after, pairs, _ in _runs(marked()):
            for page, text in run.texts(after, pairs):
                if wanted.popleft():
                    yield page.page_id, page.url, text, len(text)

    return _given(texts(), _OUT, lambda row: row[3])


def _given(rows, schema, size_of):
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if len(held) >= 1000 or size > 4_000_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, numbers = _bounds(rows, parts), _numbers(pages.sparkSession, parts)
    parsed = rows.mapInArrow(lambda batches: _parsed(batches, bounds, numbers), "page_id long, url string, host string, path string, lines binary, part int")
    # ranges are a column and url and lines settle ties, so both passes see the same edges however Spark cuts its tasks
    order = ["host", "path", "page_id", "url", "lines"]
    ranges = parsed.repartition("part").sortWithinPartitions("part", *order)
    out = "page_id long, url string, text string, n_chars long"
    edges = ranges.mapInArrow(_edges, "page_id long, url string, host string, path string, lines binary, part int, wanted boolean")
    return ranges.mapInArrow(_inner, out).unionByName(edges.repartition("host").sortWithinPartitions(*order).mapInArrow(_at_edges, out))
