"""Nearest-neighbour imputation: an exact k-nearest-neighbour join with distances that skip what is missing.

The distance of two rows is the mean squared difference over the auxiliary columns that both have; rows without such a
column are infinitely far. Neighbours are ordered by distance, then by key.

1. What two rows have in common follows from the columns that each has. So donors of one pattern of present columns are
   laid out once for each set of columns that they share with receivers: a view, where the other columns are left out.
   Beyond PROJECTIONS such sets a pattern's receivers search the view of all its columns. A receiver searches one view
   of each pattern, and its neighbours are the nearest of what it finds there.
2. Of donors at one and the same point of a view the k with the least keys are kept, and receivers at one point are one.
3. The donors of a view are dealt into cells by a tree of median cuts, learned at the driver from about SAMPLE donors.
   Cuts only balance the work. Each cell knows its count and its bounding box; CELLS at most, and one for each view that
   the sample has not met, are what tasks are sent.
4. A receiver goes down the tree to a cell whose box is near. Its k-th distance there, or what boxes on the way promise
   if that is less, bounds the true k-th distance; it then searches every other cell whose box is not farther than that.
5. A (cell, receiver) search is cut into blocks of bounded size on both sides, so no task gathers a large cell. A block
   is cut into leaves by a tree of its own, and only leaves within the bound are compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.operators.ranges import range_count

#: Donors that the cuts are learned from, cells at most and donors in one, and rows of a block on either side.
SAMPLE, CELLS, CELL_ROWS = 20_000, 4096, 2000
BLOCK_DONORS, BLOCK_RECEIVERS = 20_000, 4000
#: Sets of columns less than its own that a pattern's donors are laid out for, and donors in a leaf of a block.
PROJECTIONS, LEAF_ROWS = 8, 256
#: Distances that a search holds at once.
HELD = 1 << 21
#: Boxes are taken to be nearer by this share, so that rounding never hides one.
SLACK = 1e-9


def auxiliary_columns(train: DataFrame, column: str, candidates: list[str], limit: int = 10) -> list[str]:
    """The column itself, then the candidates by their share of missing values and by name; `limit` in all."""
    others = sorted({c for c in candidates if c != column})
    row = train.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in others)).first() if others else {}
    return [column, *sorted(others, key=lambda c: (row[c] or 0.0, c))][:limit]


def _points(names: list[str]) -> list[str]:
    return [f"x{k}" for k in range(len(names))]


def _coordinates(columns: list[str]) -> list[Column]:
    """Finite doubles named x0, x1, ...; -0.0 becomes 0.0, so that equal points look alike."""
    cast = [F.col(c).cast("double") for c in columns]
    return [F.when(F.abs(x) < float("inf"), x + F.lit(0.0)).alias(n) for x, n in zip(cast, _points(columns), strict=True)]


def _matrix(batch: pa.RecordBatch | pa.Table, dims: int) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(f"x{k}").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(f"x{k}").to_numpy(), float) for k in range(dims)])


@dataclass
class Tree:
    """Median cuts of the points of one pattern; a node is (dimension, cut, left, right), a leaf (-1, 0, number, 0)."""

    nodes: list[tuple[int, float, int, int]]
    leaves: int

    @staticmethod
    def learn(points: np.ndarray, leaf_rows: float) -> Tree:
        nodes: list[tuple[int, float, int, int]] = []
        leaves = 0

        def grow(own: np.ndarray) -> int:
            nonlocal leaves
            at = len(nodes)
            nodes.append((-1, 0.0, leaves, 0))
            spread = np.ptp(own, axis=0) if len(own) > leaf_rows and own.shape[1] else np.zeros(1)
            k = int(spread.argmax())
            if spread[k] > 0:
                values = own[:, k]
                cut = float(np.median(values))
                if not (values > cut).any():
                    cut = float(values[values < cut].max())
                nodes[at] = (k, cut, grow(own[values <= cut]), grow(own[values > cut]))
            else:
                leaves += 1
            return at

        grow(points)
        return Tree(nodes, leaves)

    @cached_property
    def _columns(self) -> list[np.ndarray]:
        return [np.array(x) for x in zip(*self.nodes, strict=True)]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        dim, cut, left, right = self._columns
        at = np.zeros(len(points), np.int64)
        while (live := np.flatnonzero(dim[at] >= 0)).size:
            node = at[live]
            at[live] = np.where(points[live, dim[node]] <= cut[node], left[node], right[node])
        return left[at]


def _bounds(columns: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest mean squared difference from a box, from each column's (x, low, high); inf if nothing is common."""
    near, far, common = 0.0, 0.0, 0
    for x, low, high in columns:
        under, over = low - x, x - high
        both = ~np.isnan(under)
        apart, reach = np.maximum(np.maximum(under, over), 0), np.maximum(np.abs(under), np.abs(over))
        near = near + np.where(both, apart * apart, 0.0)
        far = far + np.where(both, reach * reach, 0.0)
        common = common + both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, near / common, np.inf), np.where(common > 0, far / common, np.inf)


@dataclass
class Cells:
    """Bounding boxes, counts and names of all cells."""

    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    view: np.ndarray
    leaf: np.ndarray

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest mean squared difference of each point from each cell's donors; inf if nothing is common."""
        return _bounds((points[:, [k]], self.low[:, k], self.high[:, k]) for k in range(points.shape[1]))

    def promised(self, far: np.ndarray, k: int) -> np.ndarray:
        """What the k-th distance is at most, by counts and boxes alone."""
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.cumsum(self.count[order], axis=1) >= k
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), far.shape[1] - 1)
        rows = np.arange(len(far))
        return np.where(enough[rows, at], far[rows, order[rows, at]], np.inf)


@dataclass
class Routes:
    """A view's tree with the box and the count of each node's donors; `left` and `right` are -1 at leaves."""

    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    @staticmethod
    def over(tree: Tree, cells: Cells) -> Routes:
        """`cells` are those of the tree's leaves that have donors."""
        nodes, dims = len(tree.nodes), cells.low.shape[1]
        left, right, leaf = (np.full(nodes, -1, np.int64) for _ in range(3))
        low, high, count = np.full((nodes, dims), np.nan), np.full((nodes, dims), np.nan), np.zeros(nodes, np.int64)
        held = {int(f): j for j, f in enumerate(cells.leaf)}
        for at in reversed(range(nodes)):  # children come after their parent
            dim, _, a, b = tree.nodes[at]
            if dim >= 0:
                left[at], right[at], count[at] = a, b, count[a] + count[b]
                low[at], high[at] = np.fmin(low[a], low[b]), np.fmax(high[a], high[b])
            else:
                leaf[at] = a
                if a in held:
                    low[at], high[at], count[at] = cells.low[held[a]], cells.high[held[a]], cells.count[held[a]]
        return Routes(left, right, leaf, low, high, count)

    def bounds(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As of cells, of each point from its own node."""
        return _bounds((points[:, k], self.low[at, k], self.high[at, k]) for k in range(points.shape[1]))

    def home(self, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A near leaf of each point, -1 if none is finitely far, and what the k-th distance is at most by the boxes on the way."""
        at = np.zeros(len(points), np.int64)
        near, far = self.bounds(points, at)
        bound = np.where(self.count[at] >= k, far, np.inf)
        while (live := np.flatnonzero(self.left[at] >= 0)).size:
            a, b = self.left[at[live]], self.right[at[live]]
            (near_a, far_a), (near_b, far_b) = self.bounds(points[live], a), self.bounds(points[live], b)
            second = (near_b < near_a) | ((near_b == near_a) & (far_b < far_a))
            at[live], near[live] = np.where(second, b, a), np.where(second, near_b, near_a)
            bound[live] = np.minimum(bound[live], np.where(self.count[at[live]] >= k, np.where(second, far_b, far_a), np.inf))
        return np.where(np.isfinite(near), self.leaf[at], -1), bound

    def within(self, points: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, leaf) where the leaf's box is not farther from the row's point than its limit."""
        row, at, found = np.arange(len(points)), np.zeros(len(points), np.int64), []
        while row.size:
            near, _ = self.bounds(points[row], at)
            kept = np.isfinite(near) & (near * (1 - SLACK) <= limit[row])
            row, at = row[kept], at[kept]
            ends = self.left[at] < 0
            found.append((row[ends], self.leaf[at[ends]]))
            row, at = np.repeat(row[~ends], 2), np.column_stack([self.left[at[~ends]], self.right[at[~ends]]]).ravel()
        rows, leaves = zip(*found, strict=True) if found else ((row,), (at,))
        return np.concatenate(rows), np.concatenate(leaves)


def _views(donors: Iterable[int], receivers: dict[int, int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(pattern, view, columns kept there) of donors and of receivers; patterns and columns are bits, receivers come with their number."""
    laid, asked = [], []
    for pattern in sorted(donors):
        met = Counter()
        for p, n in receivers.items():
            met[p & pattern] += n
        shared = sorted((c for c in met if c not in (0, pattern)), key=lambda c: (-met[c], c))
        kept = shared[:PROJECTIONS] + [pattern] * (pattern in met or len(shared) > PROJECTIONS)
        number = {c: len(laid) + j for j, c in enumerate(c for c in kept if c)}
        laid += [(pattern, view, c) for c, view in number.items()]
        asked += [(p, number.get(p & pattern, number.get(pattern, -1)), p & pattern) for p in sorted(receivers) if p & pattern]
    return laid, asked


def _in_views(rows: DataFrame, views: list[tuple[int, int, int]], names: list[str], prefix: str = "") -> DataFrame:
    """Rows once for each view of their pattern, with the columns kept there (null elsewhere) under their prefixed names."""
    pattern, view, kept = (pa.array(x, pa.int64()) for x in zip(*views, strict=True))
    held = rows.join(F.broadcast(rows.sparkSession.createDataFrame(pa.table({"pattern": pattern, "view": view, "kept": kept}))), "pattern")
    masked = [F.when(F.col("kept").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, F.col(n)).alias(f"{prefix}{n}") for k, n in enumerate(names)]
    return held.select(*(c for c in rows.columns if c != "pattern" and (prefix or c not in names)), "view", *masked)


def _present(names: list[str]) -> Column:
    """The columns that are not null, as bits."""
    bits = F.lit(0).cast("bigint")
    for k, n in enumerate(names):
        bits = bits + F.when(F.col(n).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
    return bits


def _dealt(donors: DataFrame, dims: int) -> tuple[DataFrame, Cells, dict[int, Routes]]:
    """The donors with their cell (view, leaf), all cells, and the views' routes."""
    total = donors.count()
    kept = donors.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 20)) + 1)
    rows = kept.select("view", *_points([""] * dims)).collect()
    sample = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float).reshape(-1, dims)
    views = np.array([r[0] for r in rows], np.int64)
    wanted = min(CELLS, max(1, total // CELL_ROWS))
    trees = {}
    for v in np.unique(views):
        own = sample[views == v]
        has = np.flatnonzero(~np.isnan(own[0]))
        trees[int(v)] = has, Tree.learn(own[:, has], max(1.0, len(sample) / wanted))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, view = _matrix(batch, dims), batch.column("view").to_numpy(zero_copy_only=False)
            leaf = np.zeros(len(points), np.int64)
            for v in np.unique(view):
                if int(v) in trees:
                    has, tree = trees[int(v)]
                    own = np.flatnonzero(view == v)
                    leaf[own] = tree.leaf(points[own][:, has])
            yield batch.append_column("leaf", pa.array(leaf, pa.int64()))

    dealt = donors.mapInArrow(deal, T.StructType([*donors.schema.fields, T.StructField("leaf", T.LongType())])).persist()
    names = _points([""] * dims)
    boxes = dealt.groupBy("view", "leaf").agg(F.count("*").alias("n"), *(F.min(c).alias(f"low_{c}") for c in names), *(F.max(c).alias(f"high_{c}") for c in names)).orderBy("view", "leaf").collect()
    read = lambda side: np.array([[np.nan if r[f"{side}_{c}"] is None else r[f"{side}_{c}"] for c in names] for r in boxes], float).reshape(-1, dims)
    column = lambda c: np.array([r[c] for r in boxes], np.int64)
    cells = Cells(read("low"), read("high"), column("n"), column("view"), column("leaf"))
    routes = {}
    for v in np.unique(cells.view):
        own = cells.view == v
        tree = trees[int(v)][1] if int(v) in trees else Tree([(-1, 0.0, 0, 0)], 1)
        routes[int(v)] = Routes.over(tree, Cells(*(x[own] for x in (cells.low, cells.high, cells.count, cells.view, cells.leaf))))
    return dealt, cells, routes


def _routed(receivers: DataFrame, routes: dict[int, Routes], dims: int, k: int, first: bool) -> DataFrame:
    """Receivers with the cells they search: at first a near one, with the promised bound; later all others within `bound`."""
    names = _points([""] * dims)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = batch.column("view").to_numpy(zero_copy_only=False)
            for v in np.unique(view):
                own, way = np.flatnonzero(view == v), routes[int(v)]
                step = max(1, HELD // len(way.count))  # as many (row, node) pairs may be open at once
                for at in range(0, len(own), step):
                    part = batch.take(pa.array(own[at : at + step]))
                    points = _matrix(part, dims)
                    if first:
                        leaf, bound = way.home(points, k)
                        row = np.flatnonzero(leaf >= 0)
                        leaf, bound = leaf[row], bound[row]
                    else:
                        home, limit = (part.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "bound"))
                        row, leaf = way.within(points, limit)
                        row, leaf = row[leaf != home[row]], leaf[leaf != home[row]]
                        bound = limit[row]
                    taken = part.select(["view", *names]).take(pa.array(row))
                    yield pa.record_batch([*taken.columns, pa.array(leaf, pa.int64()), pa.array(bound, pa.float64())], names=["view", *names, "leaf", "bound"])

    schema = ", ".join(["view bigint", *(f"{c} double" for c in names), "leaf bigint", "bound double"])
    return receivers.mapInArrow(route, schema)


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Mean squared differences over what both have, inf if that is nothing; column after column, so that all agree to the bit."""
    total, common = np.zeros((len(points), len(others))), np.zeros((len(points), len(others)))
    for k in range(points.shape[1]):
        apart = points[:, [k]] - others[:, k]
        both = ~np.isnan(apart)
        total += np.where(both, apart * apart, 0.0)
        common += both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, total / common, np.inf)


def _firsts(row: np.ndarray, chosen: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k least by (found, chosen), in that order."""
    order = np.lexsort((chosen, found, row))
    held = row[order]
    order = order[np.arange(len(held)) - np.searchsorted(held, held) < k]
    return row[order], chosen[order], found[order]


def nearest(points: np.ndarray, others: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in others, distance) of each point's k nearest of `others`, ties by place; those beyond its limit may lack.

    `others` all have the same columns."""
    row, chosen, found = (np.zeros(0, t) for t in (np.int64, np.int64, float))
    if not len(points) or not len(others):
        return row, chosen, found
    has = np.flatnonzero(~np.isnan(others[0]))
    tree = Tree.learn(others[:, has], max(LEAF_ROWS, 2 * k))
    leaf = tree.leaf(others[:, has])
    order = np.argsort(leaf, kind="stable")
    cuts = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
    low, high = (f.reduceat(others[order], cuts[:-1], axis=0) for f in (np.minimum, np.maximum))
    cells = Cells(low, high, np.diff(cuts), np.zeros(tree.leaves, np.int64), np.arange(tree.leaves))
    kept, open_ = [(row, chosen, found)], 0
    step = max(1, HELD // tree.leaves)
    for a in range(0, len(points), step):
        part, most = points[a : a + step], limit[a : a + step].copy()
        near, far = cells.bounds(part)
        if cells.count.min() < k:
            most = np.minimum(most, cells.promised(far, k))
        home = near.argmin(axis=1)
        for first in (True, False):  # the nearest leaf's k-th distance bounds what is opened afterwards
            mine = np.arange(tree.leaves) == home[:, None]
            opened = np.isfinite(near) & (near * (1 - SLACK) <= most[:, None]) & (mine if first else ~mine)
            leaves, rows = np.nonzero(opened.T)
            ends = np.searchsorted(leaves, np.arange(tree.leaves + 1))
            for j in np.unique(leaves):
                theirs = order[cuts[j] : cuts[j + 1]]
                mates = rows[ends[j] : ends[j + 1]]
                for b in range(0, len(mates), size := max(1, HELD // len(theirs))):
                    own = mates[b : b + size]
                    held = distances(part[own], others[theirs])
                    if first and len(theirs) >= k:
                        most[own] = np.minimum(most[own], np.partition(held, k - 1, axis=1)[:, k - 1])
                    r, c = np.nonzero((held <= most[own, None]) & np.isfinite(held))
                    kept.append((a + own[r], theirs[c], held[r, c]))
                    open_ += len(r)
                    if open_ > HELD:
                        kept = [_firsts(*(np.concatenate(x) for x in zip(*kept, strict=True)), k)]
                        open_ = 0
    return _firsts(*(np.concatenate(x) for x in zip(*kept, strict=True)), k)


def _found_type(key_type: str) -> str:
    return f"array<struct<distance: double, key: {key_type}, value: double>>"


def _searched(routed: DataFrame, dealt: DataFrame, cells: Cells, dims: int, k: int, key_type: str) -> DataFrame:
    """The receivers once for each block of their cell, with the k nearest donors there (`found`) as far as `bound` reaches."""
    names = _points([""] * dims)
    asked = {(r["view"], r["leaf"]): r["n"] for r in routed.groupBy("view", "leaf").agg(F.count("*").alias("n")).collect()}
    rows = [(int(v), int(f), -(-int(n) // BLOCK_DONORS), -(-asked.get((int(v), int(f)), 0) // BLOCK_RECEIVERS)) for v, f, n in zip(cells.view, cells.leaf, cells.count, strict=True)]
    columns = [pa.array([r[j] for r in rows if r[3]], pa.int64()) for j in range(4)]
    blocks = F.broadcast(routed.sparkSession.createDataFrame(pa.table(columns, names=["view", "leaf", "donor_blocks", "receiver_blocks"])))  # a row per cell
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = routed.join(blocks, ["view", "leaf"]).withColumn("r", F.pmod(F.xxhash64(*names), F.col("receiver_blocks"))).withColumn("d", every("donor_blocks"))
    right = dealt.join(blocks, ["view", "leaf"]).withColumn("d", F.pmod(F.xxhash64("key"), F.col("donor_blocks"))).withColumn("r", every("receiver_blocks"))
    unit, tasks = ["view", "leaf", "d", "r"], range_count(routed)  # searches take long for their bytes, so tasks are not joined by size

    def search(receivers: pa.Table, donors: pa.Table) -> pa.Table:
        donors = donors.sort_by("key")
        row, chosen, found = nearest(_matrix(receivers, dims), _matrix(donors, dims), receivers.column("bound").to_numpy(), k)
        theirs = donors.select(["key", "value"]).take(pa.array(chosen)).combine_chunks()
        flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in theirs.columns]
        ends = np.concatenate([[0], np.bincount(row, minlength=receivers.num_rows).cumsum()])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(found), *flat], names=["distance", "key", "value"]))
        return receivers.select(["view", *names, "leaf", "bound"]).append_column("found", lists)

    schema = ", ".join(["view bigint", *(f"{c} double" for c in names), "leaf bigint", "bound double", f"found {_found_type(key_type)}"])
    asking, held = left.select(*names, "bound", *unit).repartition(tasks, *unit), right.select(*names, "key", "value", *unit).repartition(tasks, *unit)
    return asking.groupBy(*unit).cogroup(held.groupBy(*unit)).applyInArrow(search, schema)


def _merged(k: int) -> Column:
    """The k nearest of all lists of a group."""
    return F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")


def _known(train: DataFrame, column: str, auxiliary: list[str], key: str) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """Rows that have a finite value, as points, and of each pattern of present columns their number and the values' mean."""
    value = F.col(column).cast("double")
    known = train.where(F.abs(value) < float("inf")).select(*_coordinates(auxiliary), F.col(key).alias("key"), value.alias("value"))
    rows = known.groupBy(_present(_points(auxiliary)).alias("pattern")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).collect()
    return known, {r["pattern"]: (r["n"], r["mean"]) for r in rows}


def _lists(table: DataFrame, known: DataFrame, patterns: Iterable[int], column: str, auxiliary: list[str], k: int) -> DataFrame:
    """For each distinct point of the rows that lack `column` and have a column in common with donors: its k nearest (`found`)."""
    dims, names = len(auxiliary), _points(auxiliary)
    key_type = known.schema["key"].dataType.simpleString()
    lacking = F.col(column).isNull() | ~(F.abs(F.col(column).cast("double")) < float("inf"))
    receivers = table.where(lacking).select(*_coordinates(auxiliary)).distinct().withColumn("pattern", _present(names)).persist()
    laid, asked = _views(patterns, {r["pattern"]: r["count"] for r in receivers.groupBy("pattern").count().collect()})
    if not asked:
        return receivers.where(F.lit(False)).select(*names, F.lit(None).cast(_found_type(key_type)).alias("found"))
    same = Window.partitionBy("view", *names).orderBy("key")
    donors = _in_views(known.withColumn("pattern", _present(names)), laid, names).withColumn("same", F.row_number().over(same)).where(F.col("same") <= k).drop("same").persist()
    dealt, cells, routes = _dealt(donors, dims)
    donors.unpersist()
    points = _in_views(receivers, asked, names).distinct()
    home = _routed(points, routes, dims, k, True).persist()
    near = _searched(home, dealt, cells, dims, k, key_type).groupBy("view", *names, "leaf", "bound").agg(_merged(k)).withColumn("bound", F.least("bound", F.get("found", F.lit(k - 1))["distance"])).persist()
    others = _routed(near.drop("found"), routes, dims, k, False).persist()
    within = near.select("view", *names, "found").unionByName(_searched(others, dealt, cells, dims, k, key_type).select("view", *names, "found"))
    within = within.groupBy("view", *names).agg(_merged(k)).select(F.col("view").alias("at_view"), *(F.col(c).alias(f"at_{c}") for c in names), "found")
    links = _in_views(receivers, asked, names, "in_")
    meets = F.col("view") == F.col("at_view")
    for c in names:
        meets = meets & F.col(f"in_{c}").eqNullSafe(F.col(f"at_{c}"))
    return links.join(within, meets).groupBy(*names).agg(_merged(k))


def nearest_donors(table: DataFrame, train: DataFrame, column: str, auxiliary: list[str], key: str, k: int = 5) -> DataFrame:
    """For each distinct point (x0, x1, ...: the auxiliary columns) of the rows that lack `column`: its k nearest rows of
    `train` that have it, as distance, key, value and place from 1. `key` is a unique column of train."""
    known, patterns = _known(train, column, auxiliary, key)
    names = _points(auxiliary)
    each = _lists(table, known, patterns, column, auxiliary, k).select(*names, F.posexplode("found").alias("place", "one"))
    return each.select(*names, "one.distance", "one.key", "one.value", (F.col("place") + 1).alias("place"))


def knn_impute(table: DataFrame, train: DataFrame, column: str, auxiliary: list[str], key: str, k: int = 5) -> DataFrame:
    """The table with gaps of `column` (null or not finite) filled by the mean of the k nearest training rows that have it.

    Rows that share no column with any of them get the mean over the training rows; without a training value gaps stay.
    `auxiliary` should have comparable scales; the column itself is left out of it. Fewer than k rows: all of them count.
    """
    others = [c for c in auxiliary if c != column]
    if not others:
        raise ValueError("neighbours need at least one other column")
    value = F.col(column).cast("double")
    known, patterns = _known(train, column, others, key)
    if not patterns:
        return table
    mean = sum(n * m for n, m in patterns.values()) / sum(n for n, _ in patterns.values())
    names = _points(others)
    fill = F.aggregate("found", F.lit(0.0), lambda total, one: total + one["value"]) / F.size("found")
    fills = _lists(table, known, patterns, column, others, k).where(F.size("found") > 0).select(*names, fill.alias("fill"))
    taken = {c.lower() for c in table.columns}
    prefix = next(p for p in ("at_", "at__", "at___", *(f"at_{k}_" for k in range(len(taken) + 1))) if not any(f"{p}{n}" in taken for n in (*names, "fill")))
    fills = fills.select(*(F.col(n).alias(f"{prefix}{n}") for n in names), F.col("fill").alias(f"{prefix}fill"))
    lacking = F.col(column).isNull() | ~(F.abs(value) < float("inf"))
    meets = lacking
    for x, n in zip(_coordinates(others), names, strict=True):
        meets = meets & x.eqNullSafe(F.col(f"{prefix}{n}"))
    filled = F.when(lacking, F.coalesce(F.col(f"{prefix}fill"), F.lit(float(mean)))).otherwise(value)
    joined = table.join(fills, meets, "left")
    return joined.select(*(filled.alias(c) if c == column else F.col(c) for c in table.columns))
