"""Means and spreads across specimens: of points, landmarks, distances and colours. All are grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of points whose distances a task computes.
PAIRS = 1 << 22


def distance(a: str, b: str) -> Column:
    """Euclidean, between (ax, ay, az) and (bx, by, bz) for prefixes a and b."""
    return F.sqrt(sum((F.pow(F.col(f"{a}{c}") - F.col(f"{b}{c}"), 2) for c in "xyz"), F.lit(0.0)))


def _prefixed(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in "xyz"])


def mean_mesh(points: DataFrame) -> DataFrame:
    """(point_id, x, y, z): each point's mean over specimens."""
    return points.groupBy("point_id").agg(*[F.avg(c).alias(c) for c in "xyz"])


def mean_landmarks(landmarks: DataFrame) -> DataFrame:
    """(lm_id, x, y, z): each landmark's mean over specimens, without aligning them."""
    return landmarks.groupBy("lm_id").agg(*[F.avg(c).alias(c) for c in "xyz"])


def magnitudes(points: DataFrame, atlas: DataFrame) -> DataFrame:
    """(specimen_id, point_id, distance) of each point to the atlas's."""
    both = _prefixed(points, "s_", "specimen_id", "point_id").join(_prefixed(atlas, "a_", "point_id"), "point_id")
    return both.select("specimen_id", "point_id", distance("s_", "a_").alias("distance"))


def asymmetries(points: DataFrame, mirrored: DataFrame) -> DataFrame:
    """(specimen_id, point_id, distance) of each point to the same point of the mirrored specimen."""
    keys = ["specimen_id", "point_id"]
    both = _prefixed(points, "s_", *keys).join(_prefixed(mirrored, "m_", *keys), keys)
    return both.select(*keys, distance("s_", "m_").alias("distance"))


def spread(distances: DataFrame) -> DataFrame:
    """(point_id, magnitude_mean, magnitude_sd): over specimens, with the population's deviation."""
    return distances.groupBy("point_id").agg(F.avg("distance").alias("magnitude_mean"), F.stddev_pop("distance").alias("magnitude_sd"))


def point_results(distances: DataFrame) -> DataFrame:
    """(point_id, name, value): mean, deviation and every specimen's distances in long form."""
    both = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("Magnitude Mean", "magnitude_mean"), ("Magnitude SD", "magnitude_sd"))])
    stats = spread(distances).select("point_id", F.inline(both))
    return stats.unionByName(distances.select("point_id", F.col("specimen_id").cast("string").alias("name"), F.col("distance").alias("value")))


def result_names(results: DataFrame) -> DataFrame:
    """The columns that a result offers."""
    return results.select("name").distinct()


def select_result(results: DataFrame, name: str) -> DataFrame:
    return results.where(F.col("name") == name).select("point_id", "value")


def wide(results: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A column for each of the names, or of all names, for exports."""
    if names is None:
        names = sorted(r.name for r in result_names(results).where("name is not null").collect())
    return results.groupBy("point_id").pivot("name", names).agg(F.first("value"))


def color_mean(colors: DataFrame) -> DataFrame:
    """(point_id, r, g, b): over the specimens that have a colour there."""
    return colors.groupBy("point_id").agg(*[F.avg(c).alias(c) for c in "rgb"])


def color_variance(colors: DataFrame, per_channel: bool = False) -> DataFrame:
    """(point_id, variance): the population variance of all channels' values together, or of each channel."""
    if per_channel:
        return colors.groupBy("point_id").agg(*[F.var_pop(c).alias(f"variance_{c}") for c in "rgb"])
    n = sum((F.count(c) for c in "rgb"), F.lit(0))
    total = sum((F.sum(F.col(c).cast("double")) for c in "rgb"), F.lit(0.0))
    squares = sum((F.sum(F.col(c).cast("double") * F.col(c)) for c in "rgb"), F.lit(0.0))
    return colors.groupBy("point_id").agg((squares / n - F.pow(total / n, 2)).alias("variance"))


def distances_to_mean(landmarks: DataFrame, mean: DataFrame) -> DataFrame:
    """(specimen_id, distance): the sum over landmarks of the distances to the mean shape."""
    both = _prefixed(landmarks, "s_", "specimen_id", "lm_id").join(_prefixed(mean, "m_", "lm_id"), "lm_id")
    return both.groupBy("specimen_id").agg(F.sum(distance("s_", "m_")).alias("distance"))


def closest(distances: DataFrame) -> DataFrame:
    """The specimen with the least distance, of equal ones the first; no row if there are none."""
    return distances.agg(F.min_by(F.struct("specimen_id", "distance"), F.struct("distance", "specimen_id")).alias("s")).where("s is not null").select("s.*")


def outliers(distances: DataFrame, from_z: float = 1.0) -> DataFrame:
    """(specimen_id, distance, z, outlier): distances in deviations from their mean."""
    stats = distances.agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("distance") - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0))
    return distances.crossJoin(F.broadcast(stats)).select("specimen_id", "distance", z.alias("z"), (z > from_z).alias("outlier"))


def distance_matrix(points: DataFrame) -> DataFrame:
    """(i, j, distance) for all pairs of points of one set; its n * n rows are the result asked for.

    Points are counted and dealt out first, so that a task makes about PAIRS rows, however many points there are.
    """
    n = points.count()
    a = _prefixed(points, "a_", F.col("point_id").alias("i")).repartition(max(1, -(-n * n // PAIRS)))
    b = _prefixed(points, "b_", F.col("point_id").alias("j"))
    return a.crossJoin(b).select("i", "j", distance("a_", "b_").alias("distance"))


def ordinals(names: DataFrame, column: str = "specimen_id") -> DataFrame:
    """Names with their place in sorted order, from 0. Meant for names of specimens, one short row each."""
    return names.select(column).distinct().withColumn("ord", F.row_number().over(Window.orderBy(column)) - 1)
