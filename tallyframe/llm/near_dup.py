"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct word shingles (64-bit hashes). Shingles are hashed into groups and
the counts of the groups are the document's point; of two points the summed coordinate minima bound the
overlap of the sets from above, and so do those of a point and the upper corner of a tree node. Pairs that the bound
leaves are verified on the sets themselves: 100 * intersection >= percent * union, in integers.

The tree's root level has to send no pair of links apart and yet not every point everywhere. Linked sets of a and b
shingles differ in at most D = (a + b)(100 - percent) / (100 + percent) of them, so if hash ranges cut them into more than D segments, one segment is the same in both:
the cells are the contents of a segment, and linked documents meet in a cell for certain. D depends on the size, so
sizes are cut into bands, and a document stands in the cells of its own band and, if it can link there, the next.
There are some segments more than D + 1, so each document leaves out those of its segments that hold least.

1. One pass over the texts gives each document its size, digest, point and cells; texts do not move.
   Equal sets become one class (any number of exact copies is one row from here on).
2. Cells are range-sorted by (cell, class), so a cell of any size is split over tasks; those with one class go.
3. Each class is tried with the previous class of its cells and with the first of its stretch of HUB classes in them (those with one another), so no
   class is tried with more than a few dozen others of a cell. Links found give components.
4. Cells whose classes are in several components are cut into leaves of at most LEAF points sorted by component
   and size, each with its lower and upper corner. Pairs of different components in a leaf, and of leaves that the corners
   leave, go through the bound; what remains is verified. Leaves meet by tiles of TILE leaves against TILE, so a cell of any size is many keys. Pairs within a component need no test, so a group of
   near copies costs its size, not its square, and no link between components is missed.

Defined cases: with fewer words than a shingle has, the whole sequence is the one shingle; null text and text
without words have the empty set, link with nothing and are components of their own. Repeated rows are rows of one class. A null doc_id is
never a component's smallest id unless all are null. An empty table gives an empty result. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import cut, fingerprint
from tallyframe.llm.components import components
from tallyframe.llm.shingles import mixed, shingle_set

WORDS, PERCENT = 5, 80
LEAF, NODE, TILE, HUB = 2048, 32, 32, 64
#: Documents in shared cells whose ids are broadcast to fetch their texts; with more, texts are joined by a shuffle.
BROADCAST_IDS = 250_000
HOT_SHARE = 0.001

_bands: dict[int, np.ndarray] = {}
_ranges: dict[int, np.ndarray] = {}


def bands(percent: int) -> np.ndarray:
    """Where bands of sizes begin: each is at least twice the last and wide enough that linked sizes are in one band or neighbours."""
    if percent not in _bands:
        out = [1]
        while out[-1] < 2**40:
            out.append(max(2 * out[-1], out[-1] * 100 // percent + 1))
        _bands[percent] = np.array(out)
    return _bands[percent]


def most_different(a: int, b: int, percent: int) -> int:
    """In how many shingles linked sets of a and b may differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


def segments(band: int, percent: int) -> int:
    """Segments in a band: one more than sets in it may differ in, and some to spare for those with few shingles."""
    largest = int(bands(percent)[band + 1]) - 1
    least = most_different(largest, largest, percent) + 1
    return least + max(2, least // 5)


def _range_starts(m: int) -> np.ndarray:
    if m not in _ranges:
        _ranges[m] = np.array([(j << 64) // m for j in range(1, m)], dtype=np.uint64)
    return _ranges[m]


def cells(s: np.ndarray, percent: int) -> np.ndarray:
    """The cells of a sorted set as 64-bit numbers: in its own band, and in the next if sets there can link with it.

    Of the m segments at most D spoil, so m - D are equal, and as many as m - D - 1 may be left out: those with the fewest
    shingles, which say least. Equal segments have equally many, so both sides of a link leave the same ones out or
    the side that leaves out more still has one that the other has.
    """
    n = len(s)
    starts = bands(percent)
    band = int(np.searchsorted(starts, n, side="right")) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s))])
    out = []
    for k in (band, band + 1):
        if n * 100 < percent * int(starts[k]):
            continue
        d = most_different(n, min(n * 100 // percent, int(starts[k + 1]) - 1), percent)
        if not d:  # only an equal set links, and that is the same class
            continue
        m = segments(k, percent)
        at = np.concatenate([[0], np.searchsorted(s, _range_starts(m)), [n]])
        size = np.diff(at)
        spare = m - d - 1
        fewest = int(np.partition(size, spare)[spare])  # what is smaller than this is spared
        taken = np.flatnonzero(size >= fewest)
        content = total[at[taken + 1]] - total[at[taken]]
        out.append(mixed(content ^ mixed(taken.astype(np.uint64) + np.uint64(k << 40))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def point(s: np.ndarray) -> bytes:
    """Counts of the set by the lowest bits of its hashes, a group or more for each shingle, two groups in a byte."""
    groups = 16
    while groups < len(s):
        groups *= 2
    while True:
        counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max(initial=0) <= 15:
            return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
        groups *= 2


def counts_of(p) -> np.ndarray:
    """The counts that point() has packed."""
    packed = np.frombuffer(p, np.uint8)
    out = np.empty(2 * len(packed), dtype=np.uint8)
    out[0::2], out[1::2] = packed & 15, packed >> 4
    return out


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point with fewer groups: counts of the shorter hash."""
    return p.reshape(-1, groups).sum(axis=0, dtype=np.uint16)


def may_link(bound, a, b, percent: int):
    return (100 + percent) * bound >= percent * (a + b)


_DOCS = "doc_id long, row long, fp long, n long, d1 long, d2 long, point binary, cells binary"
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("point", pa.binary()), ("cells", pa.binary())])


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    a, b = mixed(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s * np.uint64(0x9FB21C651E98DF25)), initial=np.uint64(0))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def documents(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                cols: list[list] = [[], [], [], [], []]
                for text in part.column(3):
                    s = shingle_set(text.as_py(), words)
                    d1, d2 = digests(s)
                    for column, value in zip(cols, (len(s), d1, d2, point(s) if len(s) else None, cells(s, percent).tobytes() if len(s) else None), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, t) for c, t in zip(cols, _DOCS_ARROW.types[3:], strict=True))], schema=_DOCS_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), fingerprint(F.col("text")).alias("fp"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _DOCS)


def _listed(batches):
    """(cell, cls) of every cell of every class."""
    schema = pa.schema([("cell", pa.int64()), ("cls", pa.int64())])
    for batch in batches:
        lists = [np.frombuffer(c.as_buffer(), dtype=np.int64) for c in batch.column(1)]
        if lists:
            cls = np.repeat(np.asarray(batch.column(0), dtype=np.int64), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(cls)], schema=schema)


def _shared(batches):
    """Of rows sorted by cell those whose cell has more rows, and those at the ends, whose cell may go on in another task."""
    schema = pa.schema([("cell", pa.int64()), ("cls", pa.int64())])
    cell, cls = np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = True  # the row held back is to be given out anyway: it is the first, or like the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, cls = np.append(cell, np.asarray(batch.column(0))), np.append(cls, np.asarray(batch.column(1)))
        same = cell[1:] == cell[:-1]
        keep = np.append(same, False)
        keep[1:] |= same
        keep[0] |= inside
        inside = bool(keep[-1])
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(cls[keep])], schema=schema)
        cell, cls = cell[-1:], cls[-1:]
    if len(cell):
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cls)], schema=schema)


def _tries(batches):
    """From rows sorted by (cell, cls): each class with the one before it and the first of its stretch of HUB in its cell; and of the cells at both ends of
    the task (edge) their first and last class, as their rows may go on in another task."""
    schema = pa.schema([("edge", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    edges: list[tuple[int, int, int]] = []
    open_ = None  # of the cell that goes on: itself, first and last class, first of the stretch, how many so far
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, cls = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        place = np.arange(len(cls)) - np.repeat(start, np.diff(np.append(start, len(cls))))
        before = np.concatenate([cls[:1], cls[:-1]])
        before[start] = cls[start]
        first = int(cls[start[-1]])
        end = int(start[1]) if len(start) > 1 else len(cls)
        hub_before = 0
        if open_ and open_[0] == cell[0]:
            place[:end] += open_[4]
            before[0], hub_before = open_[2], open_[3]
            if len(start) == 1:
                first = open_[1]
        elif open_ and not edges:
            edges.append(open_[:3])
        if len(start) > 1 and not edges:
            edges.append((int(cell[0]), open_[1] if open_ and open_[0] == cell[0] else int(cls[0]), int(cls[end - 1])))
        back = np.arange(len(cls)) - np.where(place > 0, (place - 1) % HUB + 1, 0)
        hub = np.where(back >= 0, cls[np.maximum(back, 0)], hub_before)
        stretch = len(cls) - 1 - int(place[-1]) % HUB
        open_ = (int(cell[-1]), first, int(cls[-1]), int(cls[stretch]) if stretch >= 0 else hub_before, int(place[-1]) + 1)
        a, b = np.concatenate([hub, before[before != hub]]), np.concatenate([cls, cls[before != hub]])
        a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], schema=schema)
    if open_:
        edges.append(open_[:3])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], schema=schema)


def tries(members: DataFrame) -> DataFrame:
    """Pairs (a, b) to try first; members is sorted by (cell, cls) over its tasks."""
    found = cut(members.mapInArrow(_tries, "edge long, a long, b long"))
    ends = Window.partitionBy("edge").orderBy("a")  # at most two rows a task
    across = found.where("edge is not null").select("a", F.array(F.first("a").over(ends), F.lag("b").over(ends)).alias("others"))
    across = across.select("a", F.explode("others").alias("other")).where("other <> a")
    both = found.where("edge is null").select("a", "b").unionByName(across.select(F.least("a", "other").alias("a"), F.greatest("a", "other").alias("b")))
    return both.distinct()


def verified(pairs: DataFrame, points: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: first by the bound of their points, then by their sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bounded(batches):
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                p, q = (counts_of(batch.column(c)[k].as_buffer()) for c in (3, 5))
                g = min(len(p), len(q))
                keep.append(bool(may_link(int(np.minimum(folded(p, g), folded(q, g)).sum()), batch.column(2)[k].as_py(), batch.column(4)[k].as_py(), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    def of(table, cls, *names):
        return table.select(F.col("cls").alias(cls), *(F.col(n).alias(f"{cls}_{n}") for n in names))

    near = pairs.join(of(points, "a", "n", "point"), "a").join(of(points, "b", "n", "point"), "b")
    near = cut(near.select("a", "b", "a_n", "a_point", "b_n", "b_point").mapInArrow(bounded, "a long, b long"))
    full = near.join(of(sets, "a", "set"), "a").join(of(sets, "b", "set"), "b")
    both = F.size(F.array_intersect("a_set", "b_set"))  # sets stay in the JVM: as Arrow batches long ones would need much memory
    return full.where(both * 100 >= (F.size("a_set") + F.size("b_set") - both) * percent).select("a", "b")


def _leaf_pairs(cls, comp, n, points, percent):
    """Pairs of one leaf that are in different components and that the bound leaves; rows are sorted by component."""
    if comp[0] == comp[-1]:
        return []
    g = min(len(p) for p in points)
    grid = np.stack([folded(p, g) for p in points])
    return _cross(cls, comp, n, grid, cls, comp, n, grid, percent, True)


def _cross(cls, comp, n, grid, cls2, comp2, n2, grid2, percent, own):
    """Bounded pairs of the points of one leaf with those of another (or its own later ones), node by node."""
    out = []
    for start in range(0, len(cls2), NODE):
        end = min(start + NODE, len(cls2))
        upper, least = grid2[start:end].max(axis=0), n2[start:end].min()
        rows = np.arange(min(end, len(cls)) if own else len(cls))
        if len(cls2) > NODE:  # the node's corner first
            rows = rows[may_link(np.minimum(grid[rows], upper).sum(axis=1, dtype=np.int64), n[rows], least, percent)]
        for i in rows.tolist():
            at = np.arange(max(start, i + 1) if own else start, end)
            at = at[comp2[at] != comp[i]]
            if len(at):
                at = at[may_link(np.minimum(grid2[at], grid[i]).sum(axis=1, dtype=np.int64), n2[at], n[i], percent)]
                out.extend((int(cls[i]), int(cls2[j])) for j in at)
    return out


_LEAVES = "a long, b long, cell long, leaf long, first long, last long, size long, corner binary, body binary"
_LEAVES_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((x, pa.int64()) for x in ("cell", "leaf", "first", "last", "size")), ("corner", pa.binary()), ("body", pa.binary())])


def _leaves(percent: int):
    """From rows sorted by cell, component, size: pairs within leaves, and those leaves whose cell has more of them."""

    def run(batches):
        rows: list[tuple] = []
        cell, number, first_cell = None, 0, True
        out: list[tuple] = []

        def pack(more: bool):
            cls, comp, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
            points = [counts_of(r[3]) for r in rows]
            out.extend((a, b, *[None] * 7) for a, b in once(_leaf_pairs(cls, comp, n, points, percent)))
            if more:
                g = min(len(p) for p in points)
                grid = np.stack([folded(p, g) for p in points])
                out.append((None, None, cell, number, int(comp[0]), int(comp[-1]), int(n.min()), grid.max(axis=0).tobytes(), _body(cls, comp, n, grid)))

        def given():
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _LEAVES_ARROW.types, strict=True)], schema=_LEAVES_ARROW)
            out.clear()
            return got

        numbered = 0
        once = _Once()
        for batch in batches:
            cells_, cls_, comp_, n_ = (batch.column(k).to_pylist() for k in range(4))
            for k in range(batch.num_rows):
                if cells_[k] != cell or len(rows) == LEAF:
                    if rows:
                        # the first cell may have begun in another task
                        pack(first_cell or numbered > 0 or cells_[k] == cell)
                        numbered += 1
                    if cells_[k] != cell:
                        first_cell = cell is None
                        numbered = 0
                    rows = []
                    cell, number = cells_[k], cls_[k]
                rows.append((cls_[k], comp_[k], n_[k], batch.column(4)[k].as_py()))
            if len(out) > 1000:
                yield given()
        if rows:
            pack(True)  # the last cell may go on in another task
        if out:
            yield given()

    return run


def _body(cls, comp, n, grid) -> bytes:
    """A leaf as compressed bytes."""
    small = grid.astype(np.uint8) if grid.max() < 256 else grid
    head = np.array([len(cls), grid.shape[1], small.itemsize])
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([head, cls, comp, n]).astype(np.int64).tobytes() + small.tobytes())


def _unpacked(body: bytes):
    body = zstandard.ZstdDecompressor().decompress(body)
    count, g, width = np.frombuffer(body, np.int64, 3).tolist()
    cls, comp, n = (np.frombuffer(body, np.int64, count, 24 + 8 * count * k) for k in range(3))
    grid = np.frombuffer(body, np.uint8 if width == 1 else np.uint16, count * g, 24 + 24 * count).reshape(count, g)
    return cls, comp, n, grid.astype(np.uint16)


class _Once:
    """Lets a pair through once; forgets at a bound, as pairs are made distinct afterwards anyway."""

    def __init__(self, most: int = 500_000):
        self.seen: set = set()
        self.most = most

    def __call__(self, pairs):
        if len(self.seen) > self.most:
            self.seen.clear()
        new = [p for p in dict.fromkeys((min(p), max(p)) for p in pairs) if p not in self.seen]
        self.seen.update(new)
        return new


def _between(percent: int):
    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        once = _Once()
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                one, two = _unpacked(x.as_py()), _unpacked(y.as_py())
                g = min(one[3].shape[1], two[3].shape[1])
                grids = [t[3].reshape(len(t[0]), -1, g).sum(axis=1, dtype=np.uint16) for t in (one, two)]
                got = once(_cross(*one[:3], grids[0], *two[:3], grids[1], percent, False))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in got], pa.int64()), pa.array([p[1] for p in got], pa.int64())], schema=schema)

    return run


def _corners_meet(percent: int):
    """Leaf pairs whose corners leave a link possible."""

    def run(batches):
        schema = pa.schema([("cell", pa.int64()), ("leaf", pa.int64()), ("leaf2", pa.int64())])
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                p, q = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint16) for c in (3, 5))
                g = min(len(p), len(q))
                # the corner of a folded leaf is at most the folded corner
                bound = np.minimum(p.reshape(-1, g).sum(axis=0, dtype=np.int64), q.reshape(-1, g).sum(axis=0, dtype=np.int64)).sum()
                keep.append(bool(may_link(int(bound), batch.column(4)[k].as_py(), batch.column(6)[k].as_py(), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(3)], schema=schema).filter(pa.array(keep, pa.bool_()))

    return run


def cross_pairs(members: DataFrame, found: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a cell, are in different components and pass the bound."""
    marked = members.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    marked = cut(marked)
    open_ = marked.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("cell")
    rows = marked.join(open_, "cell").join(points, "cls").select("cell", "cls", "component", "n", "point")
    order = ["cell", "component", "n", "cls"]
    leaves = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("cell", "cls", "component", "n", "point").mapInArrow(_leaves(percent), _LEAVES))
    inside = leaves.where("a is not null").select("a", "b")
    blocks = leaves.where("a is null")
    # a key of the join is a tile of leaves against another, so that a cell of many leaves is many keys
    own = Window.partitionBy("cell")
    tiled = blocks.select("cell", "leaf", "first", "last", "corner", "size").withColumn("tile", ((F.row_number().over(own.orderBy("first", "leaf")) - 1) / TILE).cast("int"))
    tiled = cut(tiled.withColumn("tiles", F.max("tile").over(own)))
    one = tiled.withColumn("tile2", F.explode(F.sequence("tile", "tiles"))).drop("tiles")
    two = tiled.select("cell", F.col("leaf").alias("leaf2"), F.col("first").alias("first2"), F.col("last").alias("last2"), F.col("corner").alias("corner2"), F.col("size").alias("size2"), F.col("tile").alias("tile2"))
    two = two.withColumn("tile", F.explode(F.sequence(F.lit(0), "tile2")))
    # leaves of one and the same component have nothing to find
    met = one.join(two, ["cell", "tile", "tile2"]).where("(first, leaf) < (first2, leaf2) and not (first = last and first2 = last2 and first = first2)")
    met = met.select("cell", "leaf", "leaf2", "corner", "size", "corner2", "size2").mapInArrow(_corners_meet(percent), "cell long, leaf long, leaf2 long")
    bodies = blocks.select("cell", "leaf", "body")
    both = met.join(bodies, ["cell", "leaf"]).join(bodies.select("cell", F.col("leaf").alias("leaf2"), F.col("body").alias("body2")), ["cell", "leaf2"])
    between = both.select("body", "body2").mapInArrow(_between(percent), "a long, b long")
    both = inside.unionByName(between)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, n_links (links its class was verified in, not a full degree), kept (one row of each component), fp."""
    rows = cut(documents(docs, words, percent))
    keys = ["d1", "d2", "n"]
    classes = cut(
        rows.where("n > 0").groupBy(*keys).agg(F.min(F.struct("row", "doc_id")).alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("copies"))
        .select(*keys, F.col("rep.row").alias("cls"), "least", "copies")
    )
    own = rows.select(F.col("row").alias("cls"), "doc_id", "n", "point", "cells").join(classes.select("cls"), "cls", "left_semi")
    listed = own.select("cls", "cells").mapInArrow(_listed, "cell long, cls long")
    members = cut(listed.repartitionByRange("cell", "cls").sortWithinPartitions("cell", "cls").mapInArrow(_shared, "cell long, cls long"))
    met = members.select("cls").distinct()
    points = cut(own.join(met, "cls", "left_semi").select("cls", "doc_id", "n", "point"))
    sets = cut(_sets(docs, points, classes, words))

    links = cut(verified(tries(members), points, sets, percent))
    first = components(links)
    more = cut(verified(cross_pairs(members, first, points, percent), points, sets, percent))
    links = links.unionByName(more)
    found = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))  # goes on from the components there are
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))

    linked = found.select(F.col("node").alias("cls"), "component").unionByName(found.select(F.col("component").alias("cls"), "component").distinct())
    named = linked.join(classes.select("cls", "least"), "cls")
    ids = named.groupBy("component").agg(F.min("least").alias("stays"))
    named = named.join(ids, "component").select("cls", "stays")
    result = cut(classes.join(named, "cls", "left").join(degree, "cls", "left").select(*keys, "copies", F.coalesce("stays", "least").alias("stays"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    limit = max(1000, int(rows.count() * HOT_SHARE))
    # classes with over 1/1000 of all rows, fewer than 1000 of them, go by broadcast
    ids_of = rows.select("doc_id", "row", "fp", *keys)
    hot = ids_of.join(F.broadcast(result.where(F.col("copies") > limit)), keys, "left")
    rest = hot.where("copies is null").select("doc_id", "row", "fp", *keys).join(result.where(F.col("copies") <= limit), keys, "left")
    alone = F.col("n") == 0
    names = [
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("stays.row") == F.col("row"))).alias("kept"),
        "fp",
    ]
    return hot.where("copies is not null").select(*names).unionByName(rest.select(*names))


def _sets(docs: DataFrame, points: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """cls and set (hashes) of the classes in points, from the texts of their first rows."""
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                made = []
                for text in batch.slice(start, 500).column(0):
                    s = shingle_set(text.as_py(), words)
                    made.append((*digests(s), len(s), s.view(np.int64)))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema)

    wanted = points.select("doc_id").distinct()
    if points.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("text")
    wanted_classes = classes.join(points.select("cls"), "cls", "left_semi").select("d1", "d2", "n", "cls")
    return texts.mapInArrow(run, "d1 long, d2 long, n long, set array<long>").join(wanted_classes, ["d1", "d2", "n"]).dropDuplicates(["cls"]).select("cls", "set")
