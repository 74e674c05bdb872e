"""Rigid and similarity fits, and the mean of shapes that are aligned to each other.

Sums over landmarks are aggregates; Python sees one row of moments for each specimen.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions.schema import TRANSFORM
from formloom.functions.tables import written
from formloom.operators.affine import XYZ, apply_affine
from formloom.operators.features import mean_landmarks

SCALES = (None, "symmetric", "lsq")
#: Landmarks of all specimens that the driver may hold: 24 bytes each as numbers.
MOST_HERE = 1_000_000


def matrix_from_moments(cov: np.ndarray, source: np.ndarray, target: np.ndarray, var_source: float, var_target: float, scale: str | None) -> np.ndarray:
    """The 4 x 4 matrix that best takes source to target without reflection.

    cov: covariance of source (rows) and target. scale: None keeps size; "symmetric" is the ratio of sizes; "lsq" is the
    least squares scale.
    """
    u, s, vt = np.linalg.svd(cov)
    sign = np.array([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rotation = (vt.T * sign) @ u.T
    k = 1.0
    if scale and var_source > 0:
        k = np.sqrt(var_target / var_source) if scale == "symmetric" else float((s * sign).sum() / var_source)
    out = np.eye(4)
    out[:3, :3] = k * rotation
    out[:3, 3] = target - k * rotation @ source
    return out


def fit_transforms(landmarks: DataFrame, target: DataFrame, scale: str | None = None) -> DataFrame:
    """(specimen_id, m): for each specimen the map of its landmarks to the target's.

    target: (lm_id, x, y, z), or with specimen_id one for each specimen. A specimen whose landmarks aren't those of the
    target, in number, is an error.
    """
    if scale not in SCALES:
        raise ValueError(f"scale is {scale!r}; it must be one of {SCALES}")
    keys = ["specimen_id", "lm_id"] if "specimen_id" in target.columns else ["lm_id"]
    goal = target.select(*keys, *[F.col(c).alias(f"t{c}") for c in XYZ])
    # every row knows how many landmarks its target has, so that a missing one shows
    n = goal.groupBy(*keys[:-1]).agg(F.count("*").alias("wanted"))
    both = landmarks.select("specimen_id", "lm_id", *XYZ).join(goal, keys, "left")
    both = both.join(n, keys[:-1], "left") if keys[:-1] else both.crossJoin(F.broadcast(n))
    moments = both.groupBy("specimen_id").agg(
        F.count("*").alias("own"),
        F.count("tx").alias("met"),
        F.max("wanted").alias("wanted"),
        F.array(*[F.coalesce(F.covar_pop(a, f"t{b}"), F.lit(0.0)) for a in XYZ for b in XYZ]).alias("cov"),
        F.array(*[F.avg(c) for c in XYZ]).alias("source"),
        F.array(*[F.avg(f"t{c}") for c in XYZ]).alias("target"),
        sum((F.var_pop(c) for c in XYZ), F.lit(0.0)).alias("var_source"),
        sum((F.var_pop(f"t{c}") for c in XYZ), F.lit(0.0)).alias("var_target"),
    )
    whole = (F.col("own") == F.col("met")) & (F.col("own") == F.col("wanted"))
    said = F.concat(F.lit("landmarks of specimen "), F.col("specimen_id").cast("string"), F.lit(" aren't the target's in number"))
    checked = moments.withColumn("own", F.when(whole, F.col("own")).otherwise(F.raise_error(said).cast("long")))

    def solve(batches):
        for b in batches:
            m = [matrix_from_moments(np.array(r.cov).reshape(3, 3), np.array(r.source), np.array(r.target), r.var_source, r.var_target, scale).ravel().tolist() for r in b[b.own > 0].itertuples()]
            yield pd.DataFrame({"specimen_id": b.specimen_id, "m": m})

    return checked.mapInPandas(solve, f"specimen_id {landmarks.schema['specimen_id'].dataType.simpleString()}, m array<double>")


def align(points: DataFrame, landmarks: DataFrame, target: DataFrame, remove_scale: bool = False, *more: DataFrame) -> tuple[DataFrame, ...]:
    """Points and landmarks of every specimen that has landmarks, moved to the target; with remove_scale also resized.

    more: further tables of points by specimen, semilandmarks say, to be moved likewise.
    """
    m = fit_transforms(landmarks, target, "symmetric" if remove_scale else None)
    return apply_affine(points, m), apply_affine(landmarks, m), *(apply_affine(x, m) for x in more)


def _centred(landmarks: DataFrame, unit: bool) -> DataFrame:
    stats = landmarks.groupBy("specimen_id").agg(*[F.avg(c).alias(f"c{c}") for c in XYZ], F.sqrt(sum((F.var_pop(c) for c in XYZ), F.lit(0.0)) * F.count("*")).alias("size"))
    k = F.when(F.lit(unit) & (F.col("size") > 0), F.col("size")).otherwise(F.lit(1.0))
    return landmarks.join(stats, "specimen_id").withColumns({c: (F.col(c) - F.col(f"c{c}")) / k for c in XYZ}).select("specimen_id", "lm_id", *XYZ)


def _round_here(shapes: np.ndarray, mean: np.ndarray, scale: str | None) -> np.ndarray:
    """The mean of centred shapes (specimens x landmarks x 3), each fitted to `mean`."""
    cov = np.einsum("slx,ly->sxy", shapes, mean) / shapes.shape[1]
    at = np.zeros(3)
    var, goal = (shapes**2).sum((1, 2)) / shapes.shape[1], float((mean**2).sum() / shapes.shape[1])
    return np.mean([s @ matrix_from_moments(c, at, at, v, goal, scale)[:3, :3].T for s, c, v in zip(shapes, cov, var, strict=True)], axis=0)


def procrustes(landmarks: DataFrame, keep_size: bool = False, iterations: int = 300, tolerance: float = 1e-9, most_here: int = MOST_HERE) -> tuple[DataFrame, DataFrame]:
    """(mean, aligned): specimens aligned to their own mean, which starts as the first specimen, until it settles (`iterations` rounds at most).

    Without keep_size all shapes, and the mean, have centroid size one. Up to most_here landmarks in all are averaged on
    the driver; beyond, each round is a job, and the landmarks of one mean come to the driver, never the specimens'.
    """
    spark = landmarks.sparkSession
    shapes = written(_centred(landmarks, not keep_size), "shapes")
    schema = f"lm_id {landmarks.schema['lm_id'].dataType.simpleString()}, x double, y double, z double"

    def settled(rows: list) -> np.ndarray:
        xyz = np.array([[r.x, r.y, r.z] for r in rows], float).reshape(-1, 3)
        xyz = xyz - xyz.mean(0)
        size = np.sqrt((xyz**2).sum())
        return xyz if keep_size or not size else xyz / size

    n, first = shapes.agg(F.count("*"), F.min("specimen_id")).first()
    if first is None:
        return spark.createDataFrame([], schema), shapes
    here, found = None, []
    if n <= most_here:
        found = sorted(shapes.collect(), key=lambda r: (r.specimen_id, r.lm_id))
        rows = [r for r in found if r.specimen_id == first]
    else:
        rows = shapes.where(F.col("specimen_id") == F.lit(first)).orderBy("lm_id").collect()
    ids, mean, moved = [r.lm_id for r in rows], settled(rows), 0.0
    if found and [r.lm_id for r in found] == ids * (n // len(ids)):
        here = np.array([(r.x, r.y, r.z) for r in found]).reshape(-1, len(ids), 3)
    for _ in range(iterations):
        if here is not None:
            rows = _round_here(here, mean, None if keep_size else "lsq")
            new = rows - rows.mean(0)
            size = np.sqrt((new**2).sum())
            new = new if keep_size or not size else new / size
            moved, mean = float(np.abs(new - mean).max()), new
            if moved < tolerance:
                break
            continue
        goal = spark.createDataFrame([(i, *map(float, p)) for i, p in zip(ids, mean, strict=True)], schema)
        aligned = apply_affine(shapes, fit_transforms(shapes, goal, None if keep_size else "lsq"))
        new = settled(mean_landmarks(aligned).orderBy("lm_id").collect())
        moved, mean = float(np.abs(new - mean).max()), new
        if moved < tolerance:
            break
    if moved >= tolerance:
        warnings.warn(f"the mean hasn't settled in {iterations} rounds; it moved by {moved:.3g} in the last", stacklevel=2)
    goal = spark.createDataFrame([(i, *map(float, p)) for i, p in zip(ids, mean, strict=True)], schema)
    return goal, apply_affine(shapes, fit_transforms(shapes, goal, None if keep_size else "lsq"))


__all__ = ["TRANSFORM", "align", "fit_transforms", "matrix_from_moments", "procrustes"]
