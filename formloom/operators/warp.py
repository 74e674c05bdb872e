"""Thin-plate splines, one specimen a task, and dense correspondence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions.tables import written
from formloom.operators.affine import XYZ
from formloom.operators.nearest import closest_on_triangles, closest_surface, nearest_vertex, triangles


def _chunk(n: int) -> int:
    """How many points to compare with n others at a time: four million pairs, a hundred megabytes at most."""
    return max(1, (1 << 22) // max(1, n))


def spline(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of the spline with U(r) = r that takes source landmarks to the target's exactly: n rows, then four affine ones."""
    n = len(source)
    if n < 4:
        raise ValueError(f"a spline needs four landmarks at least; there are {n}")
    k = np.linalg.norm(source[:, None] - source[None], axis=2)
    p = np.hstack([np.ones((n, 1)), source])
    if np.linalg.matrix_rank(p - [0, *source.mean(0)]) < 4 or (k + np.eye(n) == 0).any():
        raise ValueError("a spline needs landmarks that are distinct and don't lie in one plane")
    system = np.block([[k, p], [p.T, np.zeros((4, 4))]])
    return np.linalg.solve(system, np.vstack([target, np.zeros((4, 3))]))


def warp(points: np.ndarray, source: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Points under a spline, a part at a time."""
    out, chunk = np.empty((len(points), 3)), _chunk(len(source))
    for i in range(0, len(points), chunk):
        own = points[i : i + chunk]
        r = np.linalg.norm(own[:, None] - source[None], axis=2)
        out[i : i + chunk] = r @ weights[:-4] + weights[-4] + own @ weights[-3:]
    return out


def warp_points(points: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Points of every specimen under the spline from its source landmarks to its target's, both by specimen_id and lm_id."""
    marks = source.select("specimen_id", "lm_id", *XYZ).join(target.select("specimen_id", "lm_id", *[F.col(c).alias(f"t{c}") for c in XYZ]), ["specimen_id", "lm_id"])

    def moved(own: pd.DataFrame, lm: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(lm):
            return own.iloc[:0]
        lm = lm.sort_values("lm_id")
        src = lm[list(XYZ)].to_numpy(float)
        xyz = warp(own[list(XYZ)].to_numpy(float), src, spline(src, lm[["tx", "ty", "tz"]].to_numpy(float)))
        return own.assign(x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2])

    # columns of their own, since both sides may come from one table
    own, lm = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (points, marks))
    return own.groupBy("specimen_id").cogroup(lm.groupBy("specimen_id")).applyInPandas(moved, points.schema)


def transfer_colors(queries: DataFrame, points: DataFrame, colors: DataFrame) -> DataFrame:
    """(specimen_id, point_id, r, g, b): the colour of the nearest vertex; null where that vertex has none."""
    near = nearest_vertex(queries, points)
    own = colors.select("specimen_id", F.col("point_id").alias("vertex_id"), "r", "g", "b")
    return near.join(own, ["specimen_id", "vertex_id"], "left").select("specimen_id", "point_id", "r", "g", "b")


def per_specimen(df: DataFrame, specimens: DataFrame) -> DataFrame:
    """A copy of df, which has no specimen_id, for each specimen; df is an atlas or a mean, one shape in size."""
    return specimens.select("specimen_id").distinct().crossJoin(df)


def dense_correspondence(points: DataFrame, faces: DataFrame, landmarks: DataFrame, atlas: DataFrame, atlas_landmarks: DataFrame, mean: DataFrame, stages: dict[str, DataFrame] | None = None) -> DataFrame:
    """(specimen_id, point_id, x, y, z): where each atlas point lies on each specimen.

    Specimens and, once, the atlas are warped to the mean shape; each atlas point goes to the closest point of a
    specimen's surface there, and back with the specimen. Warped meshes and the result are written once, whatever is made
    of them. stages: gets the warped meshes, for inspection.
    """
    goal = per_specimen(mean, landmarks)
    in_mean = written(warp_points(points.select("specimen_id", "point_id", *XYZ), landmarks, goal), "dense-subjects")
    one = F.lit("atlas").alias("specimen_id")
    base = written(warp_points(atlas.select(one, "point_id", *XYZ), atlas_landmarks.select(one, "lm_id", *XYZ), mean.select(one, "lm_id", *XYZ)).drop("specimen_id"), "dense-base")
    on_surface = closest_surface(per_specimen(base, landmarks), in_mean, faces).drop("face_id")
    if stages is not None:
        stages |= {"subjects": in_mean, "base": base}
    return written(warp_points(on_surface, goal, landmarks), "dense")


__all__ = ["closest_on_triangles", "closest_surface", "dense_correspondence", "nearest_vertex", "per_specimen", "spline", "transfer_colors", "triangles", "warp", "warp_points"]
