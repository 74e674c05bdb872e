"""Nearest vertices and closest surface points, exact, with a large specimen as many tasks.

Vertices or triangles of a specimen are dealt to cells of its bounding cube, sorted within them along a space-filling curve
and packed into blocks of some thousand, each with its box; query points likewise. Boxes alone, a few rows, say which blocks a block of queries has to see: those no farther off than the farthest that any block
can hold its nearest item at. A task gets a block of queries with these, and hands them down as queries are halved: vertices by
their distances, triangles, which may be long and lie across each other so that boxes tell nothing, by bounds from their planes
and edges. The curve only orders; the bounds decide, so results are those of comparing all with all.

Of items equally near the one with the least id is found. Points without coordinates, and triangles with such corners, are
left out, as are queries of specimens that have no items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions.tables import written
from formloom.operators.affine import XYZ

#: Items, or queries, in a block, and by how many bits of their cells' codes boxes are first looked at together.
BLOCK, TOGETHER_BITS = 4096, 9
#: Blocks in a cell, about: cells end blocks, so that those of few points each would make many small blocks.
BLOCKS_A_CELL = 4
#: Blocks of queries that a task searches, about.
BLOCKS_A_TASK = 2
#: Items in a leaf of a task's tree, and boxes below a box.
LEAF, FAN = 8, 4
#: Queries that a task searches at a time.
AT_A_TIME = 2048
#: Queries of triangles that are no longer halved, and the triangles with the least bounds, whose distances bound the others.
TOGETHER, FIRST = 32, 8
#: Every how many triangles are searched first, if they are not too few, to bound the distances to the others.
STEPS, FEW = (16, 1), 64
#: Triangles' planes are compared first where they leave one of so many pairs.
PLANES_PAY = 24
#: Distances to triangles, and bounds of them, that are computed at a time.
TESTS_AT_A_TIME, BOUNDS_AT_A_TIME = 1 << 14, 1 << 17


class Tree:
    """A tree of boxes over items in the order given, which should be near their neighbours. tests: distances computed so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        if not len(low):
            raise ValueError("a tree needs items")
        self.items, self.leaf, self.fan, self.tests, self.low, self.high = len(low), leaf, fan, 0, low, high
        #: a computed point may lie outside its box by a rounding error
        self.slack = 1e-12 * float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = leaf
        while True:
            more = -len(low) % size
            low = np.vstack([low, np.full((more, 3), np.inf)]).reshape(-1, size, 3).min(1)
            high = np.vstack([high, np.full((more, 3), -np.inf)]).reshape(-1, size, 3).max(1)
            self.levels.append((low, high))
            if len(low) == 1:
                break
            size = fan
        self.levels.reverse()

    @staticmethod
    def _gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The squared distances of points to the nearest and to the farthest point of boxes."""
        a, b = low - q, q - high
        near, far = np.maximum(np.maximum(a, b), 0), np.minimum(a, b)
        return np.einsum("ik,ik->i", near, near), np.einsum("ik,ik->i", far, far)

    def _below(self, nodes: np.ndarray, level: int) -> np.ndarray:
        """The nodes' children on a level, -1 where there is none; on the level after the last, items."""
        last = level == len(self.levels)
        size = self.leaf if last else self.fan
        found = nodes[..., None] * size + np.arange(size)
        return np.where(found < (self.items if last else len(self.levels[level][0])), found, -1)

    def search(self, queries: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray, at_a_time: int = AT_A_TIME) -> np.ndarray:
        """The item nearest to each query, of equal ones that with the least id. exact(queries, items): squared distances of pairs."""
        parts = [self._search(queries, np.arange(i, min(i + at_a_time, len(queries))), exact, ids) for i in range(0, len(queries), at_a_time)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def _search(self, queries: np.ndarray, at: np.ndarray, exact: Callable, ids: np.ndarray) -> np.ndarray:
        q, depth = queries[at], len(self.levels)
        wider = lambda squared: (np.sqrt(squared) * (1 + 1e-12) + self.slack + 1e-150) ** 2
        # down the tree with all boxes that are no farther off than the farthest point of any
        who, nodes, most = np.arange(len(at)), np.zeros(len(at), np.int64), np.full(len(at), np.inf)
        near = np.zeros(len(at))
        for level in range(1, depth):
            below = self._below(nodes, level)
            keep, child = np.nonzero(below >= 0)
            who, nodes = who[keep], below[keep, child]
            low, high = self.levels[level]
            near, far = self._gaps(q[who], low[nodes], high[nodes])
            np.minimum.at(most, who, wider(far))
            own = near <= most[who]
            who, nodes, near = who[own], nodes[own], near[own]
        # the items of the nearest leaf bound the others
        order = np.lexsort((near, who))
        first = order[np.unique(who[order], return_index=True)[1]]
        items = self._below(nodes[first], depth)
        k, j = np.nonzero(items >= 0)
        np.minimum.at(most, who[first][k], wider(exact(at[who[first][k]], items[k, j])))
        self.tests += len(k)
        own = near <= most[who]
        who, items = who[own], self._below(nodes[own], depth)
        k, j = np.nonzero(items >= 0)
        who, items = who[k], items[k, j]
        own = self._gaps(q[who], self.low[items], self.high[items])[0] <= most[who]
        who, items = who[own], items[own]
        found = exact(at[who], items)
        self.tests += len(who)
        order = np.lexsort((ids[items], found, who))
        return items[order[np.unique(who[order], return_index=True)[1]]]


def _spread(cell: Column) -> Column:
    """Ten bits with two free ones after each."""
    x = cell
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _code(point: list[Column]) -> Column:
    """A point's place on the curve within the bounds x0 to z0 of the width `span`."""
    out = F.lit(0).cast("long")
    for k, (c, axis) in enumerate(zip(point, XYZ, strict=True)):
        cell = F.least(F.greatest(F.floor((c - F.col(f"_{axis}0")) / F.col("_span") * 1024), F.lit(0)), F.lit(1023)).cast("long")
        out = out.bitwiseOR(F.shiftleft(_spread(cell), k))
    return out


_BOX = [f"{c}{k}" for k in "01" for c in XYZ]
_KEY = ["specimen_id", "cell", "part"]


def _packed(size: int, width: int):
    """Rows (specimen_id, cell, id, numbers), sorted, as blocks of a cell, `part` by part; corners are three numbers each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, key, kind = 0, [], None, None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal part, held
            ids, data = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            end = len(ids) if last else len(ids) // size * size
            for i in range(0, end, size):
                own = data[i : min(i + size, end)]
                corners = own.reshape(-1, 3)
                head = [pa.array([key[0]], kind), pa.array([key[1]], pa.int64()), pa.array([part], pa.int64()), *[pa.array([float(v)]) for v in (*corners.min(0), *corners.max(0))]]
                yield pa.RecordBatch.from_arrays([*head, pa.array([ids[i : min(i + size, end)]], pa.list_(pa.int64())), pa.array([own.ravel()], pa.list_(pa.float64()))], [*_KEY, *_BOX, "ids", "data"])
                part += 1
            held = [(ids[end:], data[end:])] if end < len(ids) else []

        for b in batches:
            if not b.num_rows:
                continue
            kind, names, cells, ids = b.column(0).type, b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            data = np.stack([c.to_numpy() for c in b.columns[3 : 3 + width]], 1)
            which = names.dictionary_encode().indices.fill_null(-1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (cells[1:] != cells[:-1])]))
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
                own = (names[i].as_py(), int(cells[i]))
                if own != key:
                    if held:
                        yield from out(True)
                    key, part = own, 0
                held.append((ids[i:j], data[i:j]))
                if sum(len(h[0]) for h in held) >= 16 * size:
                    yield from out(False)
        if held:
            yield from out(True)

    return made


def _blocks(rows: DataFrame, numbers: list[str], size: int) -> DataFrame:
    """rows (specimen_id, cell, code, id, numbers) as blocks (specimen_id, cell, part, box, ids, data).

    A block is told by its cell and its part of it in the curve's order, and so is the same whenever it is made.
    """
    specimen = rows.schema["specimen_id"].dataType.simpleString()
    ordered = rows.repartition("specimen_id", "cell").sortWithinPartitions("specimen_id", "cell", "code", "id")
    box = ", ".join(f"{b} double" for b in _BOX)
    return ordered.select("specimen_id", "cell", "id", *numbers).mapInArrow(_packed(size, len(numbers)), f"specimen_id {specimen}, cell long, part long, {box}, ids array<long>, data array<double>")


def _pruned(pairs: DataFrame) -> DataFrame:
    """Of pairs of a block of queries (q...) and another box, those that may hold a query's nearest item."""
    d = {c: (F.col(f"q{c}0"), F.col(f"q{c}1"), F.col(f"{c}0"), F.col(f"{c}1")) for c in XYZ}
    zero = F.lit(0.0)
    near = sum((F.pow(F.greatest(zero, v0 - q1, q0 - v1), 2) for q0, q1, v0, v1 in d.values()), zero)
    far = sum((F.pow(F.greatest(v1 - q0, q1 - v0), 2) for q0, q1, v0, v1 in d.values()), zero)
    most = F.min("_far").over(Window.partitionBy(*[f"q{k}" if k != "specimen_id" else k for k in _KEY]))
    return pairs.withColumns({"_near": near, "_far": far}).withColumn("_most", most).where(F.col("_near") <= F.col("_most") * (1 + 1e-9) + 1e-300).drop("_near", "_far", "_most")


def _meet(queries: DataFrame, items: DataFrame, numbers: list[str], centre: list[Column], extent: DataFrame, found: Callable, schema: str, block: int) -> DataFrame:
    """A task for each block of queries (specimen_id, id, x, y, z), with the blocks of items (specimen_id, id, numbers) that it needs.

    extent: the items' points, whose bounds and number make the cells. found(specimens, ids, points, item ids, item
    numbers): the rows to return.
    """
    sound = lambda df, columns: df.where(~sum(((F.col(c).isNull() | F.isnan(c)).cast("int") for c in columns), F.lit(0)).cast("boolean"))
    items = sound(items, numbers).select("specimen_id", F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in numbers])
    queries = sound(queries, XYZ).select("specimen_id", F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in XYZ])
    bounds = sound(extent, XYZ).groupBy("specimen_id").agg(*[F.min(c).cast("double").alias(f"_{c}0") for c in XYZ], *[F.max(c).cast("double").alias(f"_{c}1") for c in XYZ], F.count("*").alias("_n"))
    span = F.greatest(*[F.col(f"_{c}1") - F.col(f"_{c}0") for c in XYZ])
    # surfaces: cells of a level hold a quarter of the items that those of the level above hold
    level = F.least(F.lit(10), F.greatest(F.lit(0), F.ceil(F.log(4.0, F.col("_n") / (BLOCKS_A_CELL * block))))).cast("int")
    bounds = bounds.select("specimen_id", *[f"_{c}0" for c in XYZ], F.when(span > 0, span).otherwise(F.lit(1.0)).alias("_span"), level.alias("_level"))

    def placed(df: DataFrame, point: list[Column]) -> DataFrame:
        return df.join(bounds, "specimen_id").withColumn("code", _code(point)).withColumn("cell", F.expr("shiftright(code, 3 * (10 - _level))"))

    own = written(_blocks(placed(items, centre), numbers, block), "nearest-items")
    asked = written(_blocks(placed(queries, [F.col(c) for c in XYZ]), list(XYZ), block), "nearest-queries")
    boxes = own.select(*_KEY, F.shiftright("cell", TOGETHER_BITS).alias("together"), *_BOX)
    upper = boxes.groupBy("specimen_id", "together").agg(*[(F.min if b[1] == "0" else F.max)(b).alias(b) for b in _BOX])
    first = asked.select("specimen_id", F.col("cell").alias("qcell"), F.col("part").alias("qpart"), *[F.col(b).alias(f"q{b}") for b in _BOX])
    pairs = _pruned(first.join(upper, "specimen_id")).drop(*_BOX)
    pairs = _pruned(pairs.join(boxes, ["specimen_id", "together"])).select("specimen_id", "qcell", "qpart", "cell", "part")
    # by the number of blocks: what a task gets is few bytes but long to search, and few bytes would be put together
    tasks = max(1, -(-asked.count() // BLOCKS_A_TASK))
    # pairs too: where items are broadcast, tasks of pairs are those that give out the blocks' copies
    pairs = pairs.repartition(tasks, "specimen_id", "qcell", "qpart")
    seen = pairs.join(own.select(*_KEY, "ids", "data"), _KEY).select("specimen_id", F.col("qcell").alias("cell"), F.col("qpart").alias("part"), "ids", "data")

    kinds = {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    empty = [pa.field(f.split()[0], kinds.get(f.split()[1], pa.string())) for f in schema.split(", ")]

    def flat(t: pa.Table, column: str) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy() for c in t.column(column).chunks])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            # a specimen of points without faces has nothing to be near to
            return pa.table({f.name: pa.nulls(0, f.type) for f in empty})
        ids, data = flat(right, "ids"), flat(right, "data").reshape(-1, len(numbers))
        asked_ids, points = flat(left, "ids"), flat(left, "data").reshape(-1, 3)
        return found(left.column("specimen_id").take(pa.array(np.zeros(len(asked_ids), np.int64))), asked_ids, points, ids, data)

    anew, seen = (df.repartition(tasks, *_KEY) for df in (asked.select(*[F.col(c).alias(c) for c in (*_KEY, "ids", "data")]), seen))
    return anew.groupBy(*_KEY).cogroup(seen.groupBy(*_KEY)).applyInArrow(task, schema)


def _cast(made: DataFrame, like: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return made.select(*[F.col(c).cast(like[c][0].schema[like[c][1]].dataType).alias(c) if c in like else F.col(c) for c in made.columns])


def nearest_vertex(queries: DataFrame, points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(specimen_id, point_id, vertex_id): for each query point the nearest vertex of its specimen, of equal ones the first."""

    def found(specimens, ids, at, vertex_ids, vertices) -> pa.Table:
        return pa.table({"specimen_id": specimens, "point_id": ids, "vertex_id": vertex_ids[Vertices(vertices, vertex_ids).search(at)]})

    specimen = queries.schema["specimen_id"].dataType.simpleString()
    items = points.withColumnRenamed("point_id", "id")
    made = _meet(queries.withColumnRenamed("point_id", "id"), items, list(XYZ), [F.col(c) for c in XYZ], points, found, f"specimen_id {specimen}, point_id long, vertex_id long", block)
    return _cast(made, {"point_id": (queries, "point_id"), "vertex_id": (points, "point_id")})


def on_triangles(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The point of each triangle closest to each p: the foot in its plane if that lies inside, else on an edge."""
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    ab, ac, ap = b - a, c - a, p - a
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    d11, d12, d22, e1, e2 = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
    det = d11 * d22 - d12 * d12
    safe = np.where(det > 0, det, 1)
    v, w = (d22 * e1 - d12 * e2) / safe, (d11 * e2 - d12 * e1) / safe
    inside = (det > 0) & (v >= 0) & (w >= 0) & (v + w <= 1)
    best = a + v[:, None] * ab + w[:, None] * ac
    gap = np.where(inside, dot(best - p, best - p), np.inf)
    for x, y in ((a, b), (b, c), (c, a)):
        edge = y - x
        s = np.clip(dot(p - x, edge) / np.maximum(dot(edge, edge), 1e-300), 0, 1)
        at = x + s[:, None] * edge
        own = dot(at - p, at - p)
        nearer = own < gap
        best, gap = np.where(nearer[:, None], at, best), np.where(nearer, own, gap)
    return best


def triangle_tree(query: np.ndarray, corners: np.ndarray) -> tuple[Tree, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """The tree of triangles' boxes, and squared distances of queries to triangles by their numbers."""

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = on_triangles(query[a], corners[b]) - query[a]
        return np.einsum("ij,ij->i", d, d)

    return Tree(corners.min(1), corners.max(1)), exact


class Halving:
    """A search for the item nearest to each query, by bounds of distances of which items of any kind have their own.

    tests, bounds: distances and bounds of distances computed so far.
    """

    def __init__(self, items: int, scale: float):
        if not items:
            raise ValueError("a search needs items")
        self.items, self.scale, self.tests, self.bounds = items, scale, 0, 0

    def _exact(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The squared distance of each query to an item."""
        raise NotImplementedError

    def _least(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """No more than the squared distance of each query (rows) to each item (columns)."""
        raise NotImplementedError

    def _of_these(self, q: np.ndarray, t: np.ndarray, most: np.ndarray, wider: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of these items to each query, and its distance. most: what the distance to the nearest of all is at most."""
        raise NotImplementedError

    def search(self, queries: np.ndarray) -> np.ndarray:
        """The number of the item nearest to each query, of equal ones that with the least id.

        How far the nearest one is at most is found among every 16th item before all are searched.
        """
        slack = 1e-12 * max(self.scale, float(np.abs(queries).max(initial=0))) + 1e-150
        found, most = np.empty(len(queries), np.int64), np.full(len(queries), np.inf)
        for step in STEPS:
            some = np.arange(0, self.items, step)
            if step == 1 or len(some) >= FEW:
                found, most = self._down(queries, some, most, slack)
        return found

    def _down(self, queries: np.ndarray, some: np.ndarray, most: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of some items, and what its distance is at most. most: what the distance to the nearest of all is known to be at most.

        Queries are halved by place, down to a few together. An item is passed on to a part if it may be nearest to one of
        its queries: if it is no farther from their middle than any of them and its own nearest one may be.
        """
        found, most = np.empty(len(queries), np.int64), most.copy()
        todo = [(np.arange(len(queries)), some)] if len(queries) else []
        wider = lambda distance: distance * (1 + 1e-8) + slack
        while todo:
            at, t = todo.pop()
            q = queries[at]
            if len(at) > TOGETHER and len(t) > FIRST:
                middle = ((q.min(0) + q.max(0)) / 2)[None]
                apart = np.linalg.norm(q - middle, axis=1)
                least = self._least(middle, t)[0]
                far = float((apart + most[at]).max())
                if far == np.inf:
                    few = np.argpartition(least, FIRST)[:FIRST]
                    far = float(np.sqrt(self._exact(np.repeat(middle, len(few), 0), t[few]).min())) + 2 * float(apart.max())
                t = t[least <= wider(far) ** 2]
                half = np.argpartition(q[:, int(np.ptp(q, axis=0).argmax())], len(at) // 2)
                todo += [(at[half[: len(at) // 2]], t), (at[half[len(at) // 2 :]], t)]
                continue
            step = max(1, BOUNDS_AT_A_TIME // len(t))
            for i in range(0, len(at), step):
                own = at[i : i + step]
                found[own], most[own] = self._of_these(q[i : i + step], t, most[own], wider)
        return found, most


class Vertices(Halving):
    """Vertices to search for the nearest of each query, in order of id, so that the first of equally near ones has the least."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        super().__init__(len(points), float(np.abs(points).max(initial=0)))
        self.order = np.argsort(ids, kind="stable")
        self.axes = np.ascontiguousarray(points[self.order].T)

    def _exact(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        self.tests += len(t)
        d = q.T - self.axes[:, t]
        return (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2]

    def _least(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        self.bounds += len(q) * len(t)
        out = np.zeros((len(q), len(t)))
        for own, axis in zip(q.T, self.axes, strict=True):
            d = own[:, None] - axis[t]
            d *= d
            out += d
        return out

    def _of_these(self, q: np.ndarray, t: np.ndarray, most: np.ndarray, wider: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Of vertices bounds are the squared distances themselves."""
        gap = self._least(q, t)
        which = gap.argmin(1)
        return t[which], np.sqrt(gap[np.arange(len(q)), which])

    def search(self, queries: np.ndarray) -> np.ndarray:
        return self.order[super().search(queries)]


class Triangles(Halving):
    """Triangles to search for the nearest of each query; planes and edges bound distances, so they may be long and lie across each other."""

    def __init__(self, corners: np.ndarray, ids: np.ndarray):
        super().__init__(len(corners), float(np.abs(corners).max(initial=0)))
        self.corners, self.ids, self.low, self.high = corners, ids, corners.min(1), corners.max(1)
        edges = np.roll(corners, -1, 1) - corners
        lengths = np.linalg.norm(edges, axis=2)
        normal, size = np.cross(edges[:, 0], -edges[:, 2]), lengths.max(1)
        area = np.linalg.norm(normal, axis=1)
        # the plane of a sliver isn't known well enough to bound anything, so its box does; that of others may be off by a little of their size
        self.sliver = ~(area > 1e-6 * size * size)
        longest, rows = lengths.argmax(1), np.arange(len(corners))
        unit = lambda v, n: np.where(self.sliver[:, None], 0.0, v / np.where(self.sliver, 1, n)[:, None])
        normal, along = unit(normal, area), unit(edges[rows, longest], size)
        self.slivers = bool(self.sliver.any())
        outward = [np.cross(edges[:, k], normal) for k in range(3)]
        outward = [unit(o, np.linalg.norm(o, axis=1)) for o in outward]
        first, middle, half = corners[:, 0], corners[rows, longest] + edges[rows, longest] / 2, size / 2
        planes = [(normal, first, 0), (-normal, first, 0), *[(o, corners[:, k], 0) for k, o in enumerate(outward)], (along, middle, half), (-along, middle, half)]
        #: by triangle: both sides of its plane, of its edges in it the outer ones, and the ends of its longest edge, beyond which nothing lies
        self.sides = np.stack([np.hstack([n, -(np.einsum("ij,ij->i", n, at) + more + 1e-8 * size)[:, None]]) for n, at, more in planes])
        #: twice what a plane may be off
        self.thick = 2e-8 * float(size.max())

    def _exact(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The squared distance of each query to a triangle, some thousand at a time."""
        self.tests += len(t)
        out = np.empty(len(t))
        for i in range(0, len(t), TESTS_AT_A_TIME):
            own = q[i : i + TESTS_AT_A_TIME]
            d = on_triangles(own, self.corners[t[i : i + TESTS_AT_A_TIME]]) - own
            out[i : i + TESTS_AT_A_TIME] = np.einsum("ik,ik->i", d, d)
        return out

    def _least(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """No more than the squared distance of each query (rows) to each triangle (columns): to its plane and beyond its edges, or to a sliver's box."""
        self.bounds += len(q) * len(t)
        off = np.hstack([q, np.ones((len(q), 1))]) @ self.sides.take(t, 1).transpose(0, 2, 1)
        np.maximum(off, 0, out=off)
        plane, beyond = np.maximum(off[0], off[1], out=off[0]), np.maximum.reduce(off[2:], axis=0, out=off[2])
        plane *= plane
        beyond *= beyond
        plane += beyond
        thin = np.flatnonzero(self.sliver[t]) if self.slivers else ()
        if len(thin):
            gap = np.maximum(np.maximum(self.low[t[thin]] - q[:, None], q[:, None] - self.high[t[thin]]), 0)
            plane[:, thin] = np.einsum("ijk,ijk->ij", gap, gap)
        return plane

    def _least_of_pairs(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """As `_least`, of each query to a triangle of its own."""
        self.bounds += len(t)
        off = np.maximum(np.einsum("kij,ij->ki", self.sides.take(t, 1)[..., :3], q) + self.sides[:, t, 3], 0)
        least = np.maximum(off[0], off[1]) ** 2 + off[2:].max(0) ** 2
        thin = np.flatnonzero(self.sliver[t]) if self.slivers else ()
        if len(thin):
            gap = np.maximum(np.maximum(self.low[t[thin]] - q[thin], q[thin] - self.high[t[thin]]), 0)
            least[thin] = np.einsum("ik,ik->i", gap, gap)
        return least

    def _by_planes(self, q: np.ndarray, t: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Queries and triangles whose planes are near enough, unless these are, or promise to be, too many pairs to look at one by one."""
        if not most.mean() * PLANES_PAY <= float(np.ptp(q, axis=0).max()) / 2:
            return None
        self.bounds += len(q) * len(t)
        off = np.hstack([q, np.ones((len(q), 1))]) @ self.sides[0].take(t, 0).T
        near = np.flatnonzero(np.abs(off, out=off) <= (most + self.thick)[:, None])
        return np.divmod(near, len(t)) if len(near) * PLANES_PAY <= off.size else None

    def _of_these(self, q: np.ndarray, t: np.ndarray, most: np.ndarray, wider: Callable) -> tuple[np.ndarray, np.ndarray]:
        pairs, most = self._by_planes(q, t, wider(most)), most.copy()
        if pairs is None:
            least = self._least(q, t)
            most = np.minimum(most, np.sqrt(self._exact(q, t[least.argmin(1)])))
            who, which = np.nonzero(least <= (wider(most) ** 2)[:, None])
        else:
            who, which = pairs
            least = self._least_of_pairs(q[who], t[which])
            order = np.lexsort((least, who))
            first = order[np.unique(who[order], return_index=True)[1]]
            most[who[first]] = np.minimum(most[who[first]], np.sqrt(self._exact(q[who[first]], t[which[first]])))
            own = least <= (wider(most) ** 2)[who]
            who, which = who[own], which[own]
        gap = self._exact(q[who], t[which])
        order = np.lexsort((self.ids[t[which]], gap, who))
        first = order[np.unique(who[order], return_index=True)[1]]
        return t[which[first]], np.sqrt(gap[first])


def closest_on_triangles(query: np.ndarray, corners: np.ndarray, chunk: int = BLOCK, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(closest point of the surface, index of its triangle) for queries, `chunk` at a time; of equal ones that with the least id, or the first."""
    held = Triangles(corners, np.arange(len(corners)) if ids is None else ids)
    which = np.concatenate([np.empty(0, np.int64), *[held.search(query[i : i + chunk]) for i in range(0, len(query), chunk)]])
    return on_triangles(query, corners[which]), which


def triangles(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(specimen_id, face_id, x0 ... z2): faces with their corners' coordinates."""
    out = faces.select("specimen_id", "face_id", "v0", "v1", "v2")
    for k in range(3):
        corner = points.select("specimen_id", F.col("point_id").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in XYZ])
        out = out.join(corner, ["specimen_id", f"v{k}"])
    return out.select("specimen_id", "face_id", *[f"{c}{k}" for k in range(3) for c in XYZ])


def closest_surface(queries: DataFrame, points: DataFrame, faces: DataFrame, block: int = BLOCK) -> DataFrame:
    """(specimen_id, point_id, x, y, z, face_id): for each query point the closest of its specimen's surface."""
    numbers = [f"{c}{k}" for k in range(3) for c in XYZ]
    centre = [(F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3 for c in XYZ]

    def found(specimens, ids, at, face_ids, corners) -> pa.Table:
        point, which = closest_on_triangles(at, corners.reshape(-1, 3, 3), ids=face_ids)
        return pa.table({"specimen_id": specimens, "point_id": ids, "x": point[:, 0], "y": point[:, 1], "z": point[:, 2], "face_id": face_ids[which]})

    specimen = queries.schema["specimen_id"].dataType.simpleString()
    items = triangles(points, faces).withColumnRenamed("face_id", "id")
    made = _meet(queries.withColumnRenamed("point_id", "id"), items, numbers, centre, points, found, f"specimen_id {specimen}, point_id long, x double, y double, z double, face_id long", block)
    return _cast(made, {"point_id": (queries, "point_id"), "face_id": (faces, "face_id")})
