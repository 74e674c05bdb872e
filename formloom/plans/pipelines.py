"""Workflows: atlas, shape, symmetry, dense landmarks and recolouring. Stages hand DataFrames on; files are written on demand."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions.schema import require
from formloom.functions.tables import written
from formloom.operators import affine, align, features, segment, texture, warp


@dataclass
class Specimens:
    """A collection: points, faces and landmarks by specimen_id; texels where there are textures.

    stages: gets what workflows make on the way, written already: aligned_points and aligned_landmarks, mirrored_points
    and mirrored_landmarks, and the warped meshes, subjects and base, to judge the correspondence by.
    """

    points: DataFrame
    faces: DataFrame
    landmarks: DataFrame
    texels: DataFrame | None = None
    stages: dict = field(default_factory=dict)
    #: textures as images, (specimen_id, image) as Spark's image source has them, in place of texels
    images: DataFrame | None = None


@dataclass
class Atlas:
    """A mean mesh with faces and landmarks, without specimen_id."""

    points: DataFrame
    faces: DataFrame
    landmarks: DataFrame


def check(s: Specimens, textures: bool = False) -> None:
    """An error if a table lacks columns that workflows need, or if textures are asked for and there are none."""
    require(s.points, "specimen_id", "point_id", "x", "y", "z")
    require(s.faces, "specimen_id", "face_id", "v0", "v1", "v2")
    require(s.landmarks, "specimen_id", "lm_id", "x", "y", "z")
    if textures:
        require(s.points, "u", "v")
        if s.images is not None:
            require(s.images, "specimen_id", "image")
        elif s.texels is not None:
            require(s.texels, "specimen_id", "row", "col", "r", "g", "b")
        else:
            raise ValueError("colours need textures")


def has_textures(s: Specimens) -> bool:
    return s.images is not None or s.texels is not None


def colors_of(s: Specimens) -> DataFrame:
    """(specimen_id, point_id, r, g, b): the points' colours, from images or from texels."""
    return texture.sample(s.points, s.texels) if s.images is None else texture.sample_images(s.points, s.images)


def unpaired(s: Specimens) -> DataFrame:
    """(specimen_id, missing): specimens that have points without landmarks, or landmarks without points."""
    p, lm = s.points.select("specimen_id").distinct(), s.landmarks.select("specimen_id").distinct()
    return p.join(lm, "specimen_id", "left_anti").withColumn("missing", F.lit("landmarks")).unionByName(lm.join(p, "specimen_id", "left_anti").withColumn("missing", F.lit("points")))


def closest_specimen(landmarks: DataFrame) -> DataFrame:
    """(specimen_id, distance): the specimen whose aligned landmarks are closest to the aligned mean."""
    mean, aligned = align.procrustes(landmarks)
    return features.closest(features.distances_to_mean(aligned, mean))


def _aligned(s: Specimens, target: DataFrame, remove_scale: bool) -> tuple[DataFrame, DataFrame]:
    """Points and landmarks moved to the target, written once; they are the stages `align` of the collection."""
    points, marks = align.align(s.points, s.landmarks.select("specimen_id", "lm_id", "x", "y", "z"), target, remove_scale)
    found = written(points, "aligned-points"), written(marks, "aligned-landmarks")
    s.stages |= {"aligned_points": found[0], "aligned_landmarks": found[1]}
    return found


def make_atlas(s: Specimens, remove_scale: bool = True) -> Atlas:
    """The mean of all specimens, in correspondence, in the frame of the one closest to their mean."""
    check(s)
    base = closest_specimen(s.landmarks).first()
    if base is None:
        raise ValueError("there are no landmarks")
    own = lambda df: df.where(F.col("specimen_id") == F.lit(base.specimen_id))
    base_marks = own(s.landmarks).select("lm_id", "x", "y", "z")
    points, marks = _aligned(s, base_marks, remove_scale)
    mean, _ = align.procrustes(marks)
    dense = warp.dense_correspondence(points, s.faces, marks, own(points).drop("specimen_id"), own(marks).drop("specimen_id"), mean, s.stages)
    return Atlas(features.mean_mesh(dense), own(s.faces).drop("specimen_id"), features.mean_landmarks(marks))


def _in_atlas(s: Specimens, atlas: Atlas, remove_scale: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    points, marks = _aligned(s, atlas.landmarks, remove_scale)
    mean, _ = align.procrustes(marks)
    return points, marks, mean


def shape(s: Specimens, atlas: Atlas, remove_scale: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(point results in long form, colour means, colour variances); no colours without textures."""
    check(s, has_textures(s))
    points, marks, mean = _in_atlas(s, atlas, remove_scale)
    dense = warp.dense_correspondence(points, s.faces, marks, atlas.points, atlas.landmarks, mean, s.stages)
    results = features.point_results(features.magnitudes(dense, atlas.points))
    if not has_textures(s):
        return results, None, None
    colors = written(warp.transfer_colors(dense, points, colors_of(s)), "dense-colors")
    return results, features.color_mean(colors), features.color_variance(colors)


def mirrored(points: DataFrame, marks: DataFrame, index: Sequence[int], axes: Sequence[int] = (-1, 1, 1), first: int = 0, more: Sequence[DataFrame] = ()) -> tuple[DataFrame, ...]:
    """Points and landmarks mirrored, left and right landmarks exchanged, and fitted to what they were before.

    more: further tables of points by specimen, semilandmarks say, to be mirrored and moved likewise.
    """
    turned = affine.reorder(affine.mirror(marks, axes), index, first)
    m = align.fit_transforms(turned, marks.select("specimen_id", "lm_id", "x", "y", "z"))
    return affine.apply_affine(affine.mirror(points, axes), m), affine.apply_affine(turned, m), *(affine.apply_affine(affine.mirror(x, axes), m) for x in more)


def mirrored_meshes(s: Specimens, index: Sequence[int], axes: Sequence[int] = (-1, 1, 1), first: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points, faces, landmarks, normals) of the mirror images, fitted to the originals; faces look outwards as before."""
    points, marks = mirrored(s.points, s.landmarks.select("specimen_id", "lm_id", "x", "y", "z"), index, axes, first)
    faces = affine.rewind(s.faces, axes)
    return points, faces, marks, segment.normals(points, faces)


def symmetry(s: Specimens, atlas: Atlas, index: Sequence[int], remove_scale: bool = True, first: int = 0) -> DataFrame:
    """Point results of the distances between specimens and their mirror images, in correspondence."""
    check(s)
    affine.mirror_index(",".join(map(str, index)))
    if not index:
        raise ValueError("symmetry needs the order of mirrored landmarks")
    points, marks, mean = _in_atlas(s, atlas, remove_scale)
    dense = warp.dense_correspondence(points, s.faces, marks, atlas.points, atlas.landmarks, mean, s.stages)
    m_points, m_marks = (written(x, f"mirrored-{n}") for n, x in zip(("points", "landmarks"), mirrored(points, marks, index, first=first), strict=True))
    s.stages |= {"mirrored_points": m_points, "mirrored_landmarks": m_marks}
    m_mean, _ = align.procrustes(m_marks)
    m_dense = warp.dense_correspondence(m_points, s.faces, m_marks, atlas.points, atlas.landmarks, m_mean)
    return features.point_results(features.asymmetries(dense, m_dense))


def sparse_atlas(atlas: Atlas, percent: float = 4.0) -> DataFrame:
    """The atlas's points that stay after thinning; count them for a preview."""
    return segment.subsample(atlas.points.withColumn("specimen_id", F.lit("atlas")), percent).drop("specimen_id")


def dense_landmarks(s: Specimens, atlas: Atlas, percent: float = 4.0) -> DataFrame:
    """(specimen_id, lm_id, label, x, y, z): landmarks at the thinned atlas's points, for all specimens and the atlas itself."""
    points, marks, mean = _in_atlas(s, atlas, True)
    dense = warp.dense_correspondence(points, s.faces, marks, atlas.points, atlas.landmarks, mean, s.stages)
    index = sparse_atlas(atlas, percent)
    base = atlas.points.withColumn("specimen_id", F.lit("atlas"))
    as_text = dense.withColumn("specimen_id", F.col("specimen_id").cast("string"))
    return segment.gather(as_text.unionByName(base.select(*as_text.columns)), index)


def recolor(s: Specimens, mode: str = "uchar-vector", k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(encoded colours, points of a mesh for each colour cluster, its faces)."""
    check(s, textures=True)
    colors = colors_of(s)
    at, centroids = segment.kmeans_colors(colors, k)
    own, own_faces = segment.child_meshes(s.points, s.faces, at, centroids)
    return texture.encode(colors, mode), own, own_faces
