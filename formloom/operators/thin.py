"""Thinning of points: the result of one pass in order of id, by many tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.tables import written
from formloom.operators.affine import XYZ

#: A specimen of n points is cut into about n / BLOCK blocks, each of LEAST_CELLS cells a side or more.
BLOCK, LEAST_CELLS = 1 << 20, 4
#: Where points wait is remembered by parts of so many to a gap.
PARTS = 4
#: A cell is that much wider than the gap, so that rounding can't put two points within the gap more than a cell apart.
WIDER = 1 + 1e-9
_AROUND = list(product((-1, 0, 1), repeat=3))
#: Roles of a task's rows: points of its own block, points that stay and cells with open points in blocks around it.
OWN, STAYS_NEARBY, OPEN_NEARBY = 0, 1, 2
_BLOCK, _CELL, _PLACE = ("specimen_id", "_bx", "_by", "_bz"), ("_cx", "_cy", "_cz"), ("_x", "_y", "_z")


class Pass:
    """A block's points, offered in order of id: does each stay, is it dropped, or does it wait for another block?

    It holds the points that stay, of which few fit into a cell, and the parts of cells in which points wait; so its size
    is bounded by the block's cells, however many points there are. Without a gap nothing is compared, and nothing held.
    """

    def __init__(self, gap: float):
        self.gap2, self.part, self.stay, self.open = gap * gap, gap / PARTS, {}, {}

    def near(self, cell: tuple, place: tuple) -> bool:
        x, y, z = place
        for a, b, c in _AROUND:
            for p, q, r in self.stay.get((cell[0] + a, cell[1] + b, cell[2] + c), ()):
                if (p - x) ** 2 + (q - y) ** 2 + (r - z) ** 2 < self.gap2:
                    return True
        return False

    def waits(self, cell: tuple, place: tuple) -> bool:
        """Whether a part with waiting points reaches into the gap around a place."""
        for a, b, c in _AROUND:
            for part in self.open.get((cell[0] + a, cell[1] + b, cell[2] + c), ()):
                apart = (max(k * self.part - v, v - (k + 1) * self.part, 0.0) for k, v in zip(part, place, strict=True))
                if sum(d * d for d in apart) < self.gap2 * WIDER:
                    return True
        return False

    def wait(self, cell: tuple, place: tuple) -> None:
        self.open.setdefault(cell, set()).add(tuple(math.floor(v / self.part) for v in place))

    def offer(self, role: int, stays: bool, cell: tuple, place: tuple) -> bool | None:
        """Whether a point stays; None if it waits."""
        if role == OPEN_NEARBY:
            self.wait(cell, place)
            return None
        if self.gap2 > 0 and not (role == STAYS_NEARBY or stays):
            if self.near(cell, place):
                return False
            if self.open and self.waits(cell, place):
                self.wait(cell, place)
                return None
        if self.gap2 > 0:
            self.stay.setdefault(cell, []).append(place)
        return True


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of block and id to those of the own block that aren't dropped, with _stays."""
    block, state = None, None
    for b in batches:
        keep, stays = [], []
        key, cell, place, told = (zip(*[b.column(c).to_pylist() for c in names], strict=True) for names in (_BLOCK, _CELL, _PLACE, ("_role", "_stays", "_gap")))
        for i, (k, c, p, (role, before, gap)) in enumerate(zip(key, cell, place, told, strict=True)):
            if k != block:
                block, state = k, Pass(gap)
            found = state.offer(role, before, c, p)
            if role == OWN and found is not False:
                keep.append(i)
                stays.append(found is True)
        kept = b.take(pa.array(keep, pa.int64()))
        yield kept.set_column(kept.schema.get_field_index("_stays"), "_stays", pa.array(stays, pa.bool_()))


def _block(side: Callable[[Column], Column]) -> dict[str, Column]:
    return {f"_b{a}": F.floor(side(F.col(f"_c{a}")) / F.col("_cells")).cast("long") for a in XYZ}


def _elsewhere(rows: DataFrame) -> DataFrame:
    """A row for each other block that has a cell beside the row's own."""
    low, high = _block(lambda c: F.greatest(c - 1, F.lit(0))), _block(lambda c: F.least(c + 1, F.col("_side")))
    around = [F.struct(*[c.alias(k) for k, c in zip(low, ends, strict=True)]) for ends in product(*zip(low.values(), high.values(), strict=True))]
    own = F.struct(*[c.alias(k) for k, c in _block(lambda c: c).items()])
    return rows.withColumn("_b", F.explode(F.array_except(F.array(*around), F.array(own)))).select("*", "_b.*").drop("_b")


def _round(state: DataFrame) -> DataFrame:
    """state after one more pass over every block, without the points that are dropped.

    Of the blocks around it, a block gets the points that stay and the least open point of each part of a cell. A point
    waits if one with a lesser id waits in a part within the gap, which is more careful than it has to be: what is decided
    is right, and the least of all open points never waits, so some rounds decide all.
    """
    own = state.withColumns(_block(lambda c: c)).withColumn("_role", F.lit(OWN))
    stays = _elsewhere(state.where("_stays")).withColumn("_role", F.lit(STAYS_NEARBY))
    key = ["specimen_id", *_CELL, "_cells", "_side", "_gap", "_bx", "_by", "_bz"]
    part = [F.floor(F.col(c) * PARTS / F.col("_gap")).alias(f"_p{c}") for c in _PLACE]
    least = _elsewhere(state.where("not _stays")).groupBy(*key, *part).agg(F.min(F.struct("_id", *_PLACE)).alias("_least"))
    least = least.select(*key, "_least.*", F.lit(False).alias("_stays"), F.lit(OPEN_NEARBY).alias("_role"))
    rows = own.unionByName(stays).unionByName(least, allowMissingColumns=True)
    ordered = rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "_id", *_PLACE, "_role").select(*rows.columns)
    return ordered.mapInArrow(_decided, ordered.schema).select(*state.columns)


def subsample(points: DataFrame, percent: float = 4.0) -> DataFrame:
    """The points that stay when each, in order of id, drops those after it within percent of the bounding box's diagonal.

    Points without coordinates or id are left out. Of points with one id, the one of the least coordinates comes first. A
    specimen without extent, and percent 0, keep all points. Large specimens are many tasks: points whose answer depends
    on a block beside their own wait for the next round, and tables are written between rounds.
    """
    x, y, z = (F.col(c).cast("double") for c in XYZ)
    held = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_held"), "specimen_id", F.col("point_id").alias("_id"), x.alias("_x"), y.alias("_y"), z.alias("_z"))
    held = held.where(" and ".join(f"_{c} is not null and not isnan(_{c})" for c in XYZ) + " and _id is not null")
    boxes = held.groupBy("specimen_id").agg(F.count("*").alias("_n"), *[f(f"_{c}").alias(f"_{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in XYZ])
    wide = [F.col(f"_h{c}") - F.col(f"_l{c}") for c in XYZ]
    gap = F.lit(percent / 100) * F.sqrt(wide[0] * wide[0] + wide[1] * wide[1] + wide[2] * wide[2])
    # a cell's number is below 2**53, whatever percent is
    boxes = boxes.withColumn("_gap", gap).withColumn("_width", F.greatest(F.col("_gap") * WIDER, F.greatest(*wide) / float(1 << 40)))
    boxes = boxes.withColumn("_side", F.when(F.col("_gap") > 0, F.floor(F.greatest(*wide) / F.col("_width"))).otherwise(0).cast("long"))
    per_side = F.ceil(F.sqrt(F.col("_n") / F.lit(float(BLOCK))))
    cells = F.greatest(F.lit(LEAST_CELLS), F.ceil((F.col("_side") + 1) / per_side)).cast("long")
    boxes = written(boxes.select("specimen_id", "_gap", "_width", "_side", cells.alias("_cells"), *[f"_l{c}" for c in XYZ]), "thinning-boxes")
    cell = {f"_c{c}": F.when(F.col("_gap") > 0, F.floor((F.col(f"_{c}") - F.col(f"_l{c}")) / F.col("_width"))).otherwise(0).cast("long") for c in XYZ}
    key = held["specimen_id"].eqNullSafe(boxes["specimen_id"])
    state = held.join(boxes, key).drop(boxes["specimen_id"]).withColumns(cell).drop("_width", *[f"_l{c}" for c in XYZ]).withColumn("_stays", F.lit(False))
    if boxes.where("_side >= _cells").isEmpty():
        # each specimen is a block, in which no point waits
        return _round(state).select("_held.*")
    while True:
        state = written(_round(state), "thinning")
        if state.where("not _stays").isEmpty():
            return state.select("_held.*")
