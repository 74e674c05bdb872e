"""Scaling, mirroring, affine maps and the order of landmarks: projections and joins by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def uniform_scale(points: DataFrame, factor: float) -> DataFrame:
    """Points scaled about the origin."""
    return points.withColumns({c: F.col(c) * F.lit(float(factor)) for c in XYZ})


def mirror(points: DataFrame, axes: Sequence[int] = (-1, 1, 1)) -> DataFrame:
    """Points multiplied by the signs of the axes; by default x changes its sign."""
    return points.withColumns({c: F.col(c) * F.lit(float(a)) for c, a in zip(XYZ, axes, strict=True)})


def apply_affine(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Each specimen's points under its 4 x 4 matrix, row by row in `m`; specimens without one are left out."""
    m = lambda i, j: F.col("m")[4 * i + j]
    moved = {c: m(i, 0) * F.col("x") + m(i, 1) * F.col("y") + m(i, 2) * F.col("z") + m(i, 3) for i, c in enumerate(XYZ)}
    return points.join(transforms, "specimen_id").withColumns(moved).drop("m")


def rewind(faces: DataFrame, axes: Sequence[int] = (-1, 1, 1)) -> DataFrame:
    """Faces of a mesh mirrored by these signs: where an odd number is negative, corners go round the other way."""
    odd = sum(a < 0 for a in axes) % 2 == 1
    return faces.withColumns({"v1": F.col("v2"), "v2": F.col("v1")}) if odd else faces


def mirror_index(text: str, first: int = 0) -> list[int]:
    """A comma-separated permutation, from `first` on, as one from 0 on."""
    index = [int(x) - first for x in text.split(",")]
    if sorted(index) != list(range(len(index))):
        raise ValueError(f"{text!r} isn't a permutation of {first} to {first + len(index) - 1}")
    return index


def reorder(landmarks: DataFrame, index: Sequence[int], first: int = 0) -> DataFrame:
    """Landmark i of the result is landmark index[i]; ids count from `first`, index from 0."""
    mirror_index(",".join(map(str, index)))
    at = F.array(*[F.lit(index.index(i)) for i in range(len(index))])
    return landmarks.where(F.col("lm_id").between(first, first + len(index) - 1)).withColumn("lm_id", F.get(at, (F.col("lm_id") - first).cast("int")) + first)
