"""Clusters of colours, meshes cut out of meshes, sparse points, and normals."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formloom.operators.affine import XYZ
from formloom.operators.nearest import triangles
from formloom.operators.thin import subsample

#: Distinct colours that a task clusters in a round.
COLORS = 1 << 16

__all__ = ["child_meshes", "faces_within", "gather", "kmeans_colors", "normals", "orient", "reindex", "subsample", "subset_landmarks"]


def faces_within(faces: DataFrame, assignment: DataFrame) -> DataFrame:
    """Faces whose corners are all of one cluster, with cluster_id; others vanish. assignment: (specimen_id, point_id, cluster_id)."""
    out = faces
    for k in range(3):
        out = out.join(assignment.select("specimen_id", F.col("point_id").alias(f"v{k}"), F.col("cluster_id").alias(f"c{k}")), ["specimen_id", f"v{k}"])
    return out.where("c0 = c1 and c1 = c2").select("specimen_id", "face_id", "v0", "v1", "v2", F.col("c0").alias("cluster_id"))


def reindex(kept: DataFrame, first: int = 0) -> DataFrame:
    """(specimen_id, cluster_id, point_id, new_id): the vertices of kept faces, numbered without gaps by cluster."""
    vertices = kept.select("specimen_id", "cluster_id", F.explode(F.array("v0", "v1", "v2")).alias("point_id")).distinct()
    w = Window.partitionBy("specimen_id", "cluster_id").orderBy("point_id")
    return vertices.withColumn("new_id", F.row_number().over(w) - 1 + first)


def child_meshes(points: DataFrame, faces: DataFrame, assignment: DataFrame, centroids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, faces) of a mesh for each cluster, numbered anew, named Cluster_<id>; with the centroid's colour, 0 to 1."""
    kept = faces_within(faces, assignment)
    index = reindex(kept)
    name = F.concat(F.lit("Cluster_"), F.col("cluster_id").cast("string"))
    own = points.join(index, ["specimen_id", "point_id"]).select("specimen_id", "cluster_id", name.alias("name"), F.col("new_id").alias("point_id"), *XYZ)
    if centroids is not None:
        colour = F.array(*[F.floor(F.col(c)) / F.lit(255.0) for c in "rgb"]).alias("color")
        own = own.join(centroids.select("cluster_id", colour), "cluster_id")
    out = kept
    for k in range(3):
        out = out.join(index.select("specimen_id", "cluster_id", F.col("point_id").alias(f"v{k}"), F.col("new_id").alias(f"n{k}")), ["specimen_id", "cluster_id", f"v{k}"])
    return own, out.select("specimen_id", "cluster_id", "face_id", *[F.col(f"n{k}").alias(f"v{k}") for k in range(3)])


def _round(centres: dict[int, np.ndarray]):
    """Colours (r, g, b, n) to a row for each start's cluster: the sums of its colours, their number and their cost."""

    def made(batches):
        for b in batches:
            c, n = b[["r", "g", "b"]].to_numpy(float), b["n"].to_numpy(np.int64)
            for start, m in centres.items():
                d2 = np.stack([((c[:, 0] - x[0]) ** 2 + (c[:, 1] - x[1]) ** 2) + (c[:, 2] - x[2]) ** 2 for x in m])
                at = d2.argmin(0)
                part = pd.DataFrame({"cluster_id": at, "n": n, "cost": d2.min(0) * n} | {k: c[:, i] * n for i, k in enumerate("rgb")})
                yield part.groupby("cluster_id", as_index=False).sum().assign(start=start)[["start", "cluster_id", "r", "g", "b", "n", "cost"]]

    return made


def kmeans_colors(colors: DataFrame, k: int = 5, restarts: int = 15, iterations: int = 300, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(assignment, centroids): clusters of colours by Lloyd's rounds, the best of some seeded starts.

    Only distinct colours with their counts are clustered, of which there are 256**3 at most; a round is one aggregation
    for all starts that haven't settled, and a warning tells if some haven't after all rounds.
    Clusters are numbered by their centroids' colours.
    """
    if not 1 <= k <= 15:
        raise ValueError(f"k is {k}; it must be 1 to 15")
    spark = colors.sparkSession
    known = colors.where("r is not null and g is not null and b is not null")
    counted = known.groupBy("r", "g", "b").agg(F.count("*").alias("n")).persist()
    # every round is a task for each part, so parts follow the colours' number and not that of the points
    distinct = counted.coalesce(max(1, -(-counted.count() // COLORS))).persist()

    def nearest(centres: list[tuple]):
        d2 = [sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip("rgb", m, strict=True)), F.lit(0.0)) for m in centres]
        best = F.array_min(F.array(*[F.struct(d.alias("d2"), F.lit(i).alias("cluster_id")) for i, d in enumerate(d2)]))
        return best

    centres, costs = {}, {}
    for start in range(max(1, restarts)):
        rows = distinct.orderBy(F.xxhash64("r", "g", "b", F.lit(seed + start)), "r", "g", "b").limit(k).collect()
        if rows:
            centres[start] = np.array([(r.r, r.g, r.b) for r in rows], float)
    moving = dict(centres)
    for _ in range(iterations):
        if not moving:
            break
        parts = distinct.mapInPandas(_round(moving), "start int, cluster_id int, r double, g double, b double, n long, cost double")
        sums = parts.groupBy("start", "cluster_id").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in "rgb"], F.sum("cost").alias("cost")).collect()
        new, now = {s: m.copy() for s, m in moving.items()}, dict.fromkeys(moving, 0.0)
        for r in sorted(sums, key=lambda r: (r.start, r.cluster_id)):
            new[r.start][r.cluster_id] = (r.r, r.g, r.b)
            now[r.start] += r.cost
        centres, costs = centres | new, costs | now
        moving = {s: m for s, m in new.items() if not np.allclose(m, moving[s], rtol=0, atol=1e-9)}
    if moving:
        warnings.warn(f"{len(moving)} of {len(centres)} starts haven't settled in {iterations} rounds", stacklevel=2)
    distinct.unpersist()
    counted.unpersist()
    best = min(costs, key=lambda s: (costs[s], s), default=None)
    centres = sorted(map(tuple, centres[best].tolist())) if best is not None else []
    table = spark.createDataFrame([(i, *map(float, m)) for i, m in enumerate(centres)], "cluster_id int, r double, g double, b double")
    keys = [c for c in colors.columns if c not in "rgb"]
    return known.withColumn("cluster_id", nearest(centres)["cluster_id"] if centres else F.lit(None).cast("int")).select(*keys, "cluster_id"), table


def gather(points: DataFrame, index: DataFrame, first: int = 0) -> DataFrame:
    """(specimen_id, lm_id, label, x, y, z): specimens' points at the ids of index, numbered without gaps."""
    w = Window.orderBy("point_id")
    numbered = index.select("point_id").distinct().withColumn("lm_id", (F.row_number().over(w) - 1 + first).cast("int"))
    return points.join(numbered, "point_id").select("specimen_id", "lm_id", F.col("lm_id").cast("string").alias("label"), *XYZ)


def subset_landmarks(landmarks: DataFrame, base: DataFrame, first: int = 0) -> DataFrame:
    """Landmarks that are selected in base, numbered and labelled without gaps."""
    w = Window.orderBy("lm_id")
    kept = base.where("selected").select("lm_id").distinct().withColumn("new", (F.row_number().over(w) - 1 + first).cast("int"))
    return landmarks.join(kept, "lm_id").withColumns({"lm_id": F.col("new"), "label": F.col("new").cast("string")}).drop("new")


def normals(points: DataFrame, faces: DataFrame, flip: bool = False) -> DataFrame:
    """(specimen_id, point_id, nx, ny, nz): of unit length, the sum of the faces' normals by area. flip: for mirrored meshes."""
    t = triangles(points, faces).join(faces, ["specimen_id", "face_id"])
    e = {f"e{k}{c}": F.col(f"{c}{k}") - F.col(f"{c}0") for k in (1, 2) for c in XYZ}
    t = t.withColumns(e)
    sign = F.lit(-1.0 if flip else 1.0)
    cross = {f"n{a}": sign * (F.col(f"e1{b}") * F.col(f"e2{c}") - F.col(f"e1{c}") * F.col(f"e2{b}")) for a, b, c in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}
    corners = t.withColumns(cross).select("specimen_id", F.explode(F.array("v0", "v1", "v2")).alias("point_id"), "nx", "ny", "nz")
    total = corners.groupBy("specimen_id", "point_id").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in XYZ])
    length = F.sqrt(sum((F.col(f"n{c}") * F.col(f"n{c}") for c in XYZ), F.lit(0.0)))
    return total.select("specimen_id", "point_id", *[F.when(length > 0, F.col(f"n{c}") / length).otherwise(F.lit(0.0)).alias(f"n{c}") for c in XYZ])


def _oriented(faces: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component, whether to flip, whether the component has two sides) of each triangle.

    Neighbours over an edge that two triangles share are wound alike if they run along it in opposite directions. A
    component is turned as a whole so that the volume it encloses, seen from its middle, isn't negative.
    """
    n = len(faces)
    edges = np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]])
    owner, low = np.tile(np.arange(n), 3), edges.min(1)
    order = np.lexsort((edges.max(1), low))
    key = np.sort(edges, 1)[order]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if n else np.empty(0, int)
    size = np.diff([*starts, len(key)])
    first = order[starts[size == 2]]
    second = order[starts[size == 2] + 1]
    apart = owner[first] != owner[second]
    first, second = first[apart], second[apart]
    turned = (edges[first, 0] == edges[second, 0]).tolist()
    parent, parity, sided = list(range(n)), [0] * n, [True] * n

    def root(i: int) -> tuple[int, int]:
        path, flips = [], 0
        while parent[i] != i:
            path.append(i)
            i = parent[i]
        for j in reversed(path):
            flips ^= parity[j]
            parent[j], parity[j] = i, flips
        return i, flips

    for a, b, flip in zip(owner[first].tolist(), owner[second].tolist(), turned, strict=True):
        (i, p), (j, q) = root(a), root(b)
        if i != j:
            i, j = min(i, j), max(i, j)
            parent[j], parity[j] = i, p ^ q ^ flip
            sided[i] = sided[i] and sided[j]
        elif p ^ q != flip:
            sided[i] = False
    found = [root(i) for i in range(n)]
    component, flips = np.array([r for r, _ in found], np.int64), np.array([f for _, f in found], bool)
    corners = points[faces].astype(float)
    count = np.maximum(np.bincount(component, minlength=n), 1)
    middle = np.stack([np.bincount(component, corners[:, :, k].mean(1), n) / count for k in range(3)], 1)
    c = corners - middle[component][:, None]
    volume = np.einsum("ij,ij->i", c[:, 0], np.cross(c[:, 1], c[:, 2])) * np.where(flips, -1, 1)
    flips ^= (np.bincount(component, volume, n) < 0)[component]
    two_sided = np.array(sided, bool)[component]
    return component, flips & two_sided, two_sided


def orient(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(specimen_id, face_id, v0, v1, v2, component, flipped, orientable): faces wound alike with their neighbours and outwards.

    component: the least face_id of those that edges connect. Components with one side only, Moebius strips say, stay as
    they are and aren't orientable; edges of three faces and more connect none. A specimen is one task's work, with some
    hundred bytes a face; faces with corners that aren't points are an error.
    """

    def made(own: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        own, at = own.sort_values("face_id"), at.sort_values("point_id")
        ids, v = at.point_id.to_numpy(), own[["v0", "v1", "v2"]].to_numpy()
        if not len(own):
            return own.assign(component=0, flipped=False, orientable=False).iloc[:0]
        index = np.searchsorted(ids, v)
        if not len(ids) or (ids[np.minimum(index, len(ids) - 1)] != v).any():
            raise ValueError("faces have corners that aren't points")
        component, flips, sided = _oriented(index, at[list(XYZ)].to_numpy(float))
        turned = np.where(flips[:, None], v[:, [0, 2, 1]], v)
        return own.assign(v0=turned[:, 0], v1=turned[:, 1], v2=turned[:, 2], component=own.face_id.to_numpy()[component], flipped=flips, orientable=sided)

    kept = faces.select(*[F.col(c).alias(c) for c in ("specimen_id", "face_id", "v0", "v1", "v2")])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    schema = f"{fields}, component {kept.schema['face_id'].dataType.simpleString()}, flipped boolean, orientable boolean"
    at = points.select(*[F.col(c).alias(c) for c in ("specimen_id", "point_id", *XYZ)])
    return kept.groupBy("specimen_id").cogroup(at.groupBy("specimen_id")).applyInPandas(made, schema)
