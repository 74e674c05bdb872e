"""How good a correspondence is: landmarks left out of splines, and distances between surfaces both ways."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators.affine import XYZ
from formloom.operators.nearest import closest_surface


def left_out(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How far each landmark ends from its target under the spline of all others; not a number where these can't make one.

    The spline of all landmarks and the inverse of its system have all of these: leaving out the k-th, the error is its
    weight over the inverse's k-th diagonal element.
    """
    n = len(source)
    if n < 6:
        return np.full(n, np.nan)
    p = np.hstack([np.ones((n, 1)), source])
    system = np.block([[np.linalg.norm(source[:, None] - source[None], axis=2), p], [p.T, np.zeros((4, 4))]])
    try:
        inverse = np.linalg.inv(system)
    except np.linalg.LinAlgError:
        return np.full(n, np.nan)
    diagonal = np.diag(inverse)[:n]
    sound = np.abs(diagonal) > 1e-9 * np.abs(inverse).max()
    weights = (inverse @ np.vstack([target, np.zeros((4, 3))]))[:n]
    return np.where(sound, np.linalg.norm(weights, axis=1) / np.abs(np.where(sound, diagonal, 1)), np.nan)


def landmark_errors(landmarks: DataFrame, target: DataFrame) -> DataFrame:
    """(specimen_id, lm_id, error): how far each landmark of a specimen ends from the target's, (lm_id, x, y, z), under the spline of its others.

    Specimens are few landmarks each; error is null where the others can't make a spline.
    """
    both = landmarks.select("specimen_id", "lm_id", *XYZ).join(target.select("lm_id", *[F.col(c).alias(f"t{c}") for c in XYZ]), "lm_id")

    def errors(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("lm_id")
        return own[["specimen_id", "lm_id"]].assign(error=left_out(own[list(XYZ)].to_numpy(float), own[["tx", "ty", "tz"]].to_numpy(float)))

    kind = {c: landmarks.schema[c].dataType.simpleString() for c in ("specimen_id", "lm_id")}
    made = both.groupBy("specimen_id").applyInPandas(errors, f"specimen_id {kind['specimen_id']}, lm_id {kind['lm_id']}, error double")
    return made.withColumn("error", F.when(~F.isnan("error"), F.col("error")))


def distances_to_surface(points: DataFrame, other_points: DataFrame, other_faces: DataFrame) -> DataFrame:
    """(specimen_id, point_id, distance) of each point to the other surface of its specimen."""
    at = closest_surface(points, other_points, other_faces).select("specimen_id", "point_id", *[F.col(c).alias(f"s{c}") for c in XYZ])
    gap = F.sqrt(sum((F.pow(F.col(c) - F.col(f"s{c}"), 2) for c in XYZ), F.lit(0.0)))
    return points.select("specimen_id", "point_id", *XYZ).join(at, ["specimen_id", "point_id"]).select("specimen_id", "point_id", gap.alias("distance"))


def surface_distances(points: DataFrame, faces: DataFrame, other_points: DataFrame, other_faces: DataFrame) -> DataFrame:
    """(specimen_id, mean, p95, hausdorff, and these one way): between two surfaces of each specimen, measured at their points, both ways."""
    there = distances_to_surface(points, other_points, other_faces).withColumn("way", F.lit("to"))
    back = distances_to_surface(other_points, points, faces).withColumn("way", F.lit("from"))
    every = there.unionByName(back)
    one = lambda f, way: f(F.when(F.col("way") == way, F.col("distance")))
    figures = {"mean": F.avg, "p95": lambda c: F.percentile(c, 0.95), "greatest": F.max}
    both = [f(F.col("distance")).alias("hausdorff" if n == "greatest" else n) for n, f in figures.items()]
    return every.groupBy("specimen_id").agg(*both, *[one(f, way).alias(f"{n}_{way}") for way in ("to", "from") for n, f in figures.items()])
