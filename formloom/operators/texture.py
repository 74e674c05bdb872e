"""Colours of points from texture images: pixel by texture coordinates, encoded in one of three ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("uchar-vector", "float-vector", "float-components")


def pixel(coordinate: str, size: Column) -> Column:
    """The index of the pixel at a coordinate that is held within 0 to 1, cut and not rounded; null without one."""
    return F.when(F.col(coordinate).isNotNull(), F.floor(F.least(F.greatest(F.col(coordinate), F.lit(0.0)), F.lit(1.0)) * (size - 1))).cast("int")


def texels(images: DataFrame) -> DataFrame:
    """(specimen_id, row, col, r, g, b) of images as Spark's image source reads them: rows from the top, blue first.

    Alpha is dropped, and one channel serves for three.
    """
    at = F.col("image.width") * F.col("row") + F.col("col")
    grid = images.withColumn("row", F.explode(F.expr("sequence(0, image.height - 1)"))).withColumn("col", F.explode(F.expr("sequence(0, image.width - 1)")))
    offset = F.when(F.col("image.nChannels") == 1, at).otherwise(at * F.col("image.nChannels"))
    step = F.when(F.col("image.nChannels") == 1, F.lit(0)).otherwise(F.lit(1))
    byte = lambda i: F.conv(F.hex(F.substring(F.col("image.data"), offset + step * i + 1, F.lit(1))), 16, 10).cast("int")
    return grid.select("specimen_id", "row", "col", byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def flip(texel: DataFrame) -> DataFrame:
    """Rows from the bottom instead of the top, for each specimen's image."""
    height = texel.groupBy("specimen_id").agg((F.max("row") + 1).alias("height"))
    return texel.join(height, "specimen_id").withColumn("row", F.col("height") - 1 - F.col("row")).drop("height")


def encode(colors: DataFrame, mode: str) -> DataFrame:
    """Colours 0 to 255 as `rgb` (array<int>), as `color` (array<double>, 0 to 1), or as three columns, 0 to 255."""
    if mode not in MODES:
        raise ValueError(f"mode is {mode!r}; it must be one of {MODES}")
    keys = [c for c in colors.columns if c not in ("r", "g", "b")]
    if mode == "uchar-vector":
        return colors.select(*keys, F.array(*[F.col(c).cast("int") for c in "rgb"]).alias("rgb"))
    if mode == "float-vector":
        return colors.select(*keys, F.array(*[F.col(c) / F.lit(255.0) for c in "rgb"]).alias("color"))
    return colors.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in zip("rgb", ("color_red", "color_green", "color_blue"), strict=True)])


def sample(points: DataFrame, texel: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(specimen_id, point_id, r, g, b): each point's pixel. The coordinate v counts from the image's bottom.

    Points of specimens without texture, or without coordinates, have null colours.
    """
    if sizes is None:
        sizes = texel.groupBy("specimen_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    placed = points.select("specimen_id", "point_id", "u", "v").join(sizes, "specimen_id", "left")
    placed = placed.withColumns({"col": pixel("u", F.col("width")), "row": (F.col("height") - 1 - pixel("v", F.col("height"))).cast("int")})
    return placed.join(texel, ["specimen_id", "row", "col"], "left").select("specimen_id", "point_id", "r", "g", "b")


def packed(texel: DataFrame) -> DataFrame:
    """(specimen_id, image): texels as an image each, as Spark's image source has them; texels that are missing are black."""

    def made(own: pa.Table) -> pa.Table:
        row, col = (own.column(c).to_numpy() for c in ("row", "col"))
        pixels = np.zeros((row.max() + 1, col.max() + 1, 3), np.uint8)
        for k, c in enumerate("bgr"):
            pixels[row, col, k] = own.column(c).to_numpy()
        h, w, _ = pixels.shape
        return pa.table({"specimen_id": own.column("specimen_id").slice(0, 1), "height": pa.array([h], pa.int32()), "width": pa.array([w], pa.int32()), "data": [pixels.tobytes()]})

    kind = texel.schema["specimen_id"].dataType.simpleString()
    held = texel.select("specimen_id", "row", "col", "r", "g", "b").groupBy("specimen_id").applyInArrow(made, f"specimen_id {kind}, height int, width int, data binary")
    image = F.struct(F.lit("").alias("origin"), "height", "width", F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), "data")
    return held.select("specimen_id", image.alias("image"))


def sample_images(points: DataFrame, images: DataFrame) -> DataFrame:
    """(specimen_id, point_id, r, g, b): as `sample`, from images as they are, which meet their specimen's points in a task.

    What is shuffled are points and the images' bytes, not their pixels. Of several images of a specimen that with the
    least origin counts.
    """
    one = images.groupBy("specimen_id").agg(F.min_by("image", "image.origin").alias("i")).select("specimen_id", *[F.col(f"i.{c}").alias(c) for c in ("height", "width", "nChannels", "data")])

    def colours(own: pa.Table, image: pa.Table) -> pa.Table:
        n, found = own.num_rows, {c: pa.nulls(own.num_rows, pa.int32()) for c in "rgb"}
        if n and image.num_rows:
            h, w, channels = (image.column(c)[0].as_py() for c in ("height", "width", "nChannels"))
            pixels = np.frombuffer(image.column("data")[0].as_buffer(), np.uint8).reshape(h, w, channels)
            u, v = (own.column(c).to_numpy().astype(float) for c in "uv")
            lacks = np.isnan(u) | np.isnan(v)
            place = lambda c, size: np.floor(np.clip(np.where(lacks, 0, c), 0, 1) * (size - 1)).astype(int)
            got = pixels[h - 1 - place(v, h), place(u, w)]
            found = {c: pa.array(got[:, 0 if channels == 1 else k].astype(np.int32), mask=lacks) for k, c in enumerate("bgr")}
        return pa.table({"specimen_id": own.column("specimen_id"), "point_id": own.column("point_id"), **{c: found[c] for c in "rgb"}})

    kinds = [f"{c} {points.schema[c].dataType.simpleString()}" for c in ("specimen_id", "point_id")]
    # columns of their own, since both sides may come from one table
    sides = [df.select(*columns).groupBy("specimen_id") for df, columns in ((points, [*[F.col(c).alias(c) for c in ("specimen_id", "point_id")], *[F.col(c).cast("double").alias(c) for c in "uv"]]), (one, [F.col(c).alias(c) for c in one.columns]))]
    return sides[0].cogroup(sides[1]).applyInArrow(colours, f"{', '.join(kinds)}, r int, g int, b int")


def wedges(points: DataFrame, faces: DataFrame, corners: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, faces, origins) of meshes in which a point has one place in the texture.

    corners: (specimen_id, face_id, corner, u, v). A point that its faces' corners put at several places of the texture
    becomes as many, numbered without gaps from 0 by specimen; origins, (specimen_id, point_id, origin_id), says which point
    each was. Points that no corner places keep their own coordinates, if they have any.
    """
    around = faces.select("specimen_id", "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "origin_id"))
    own = points.select("specimen_id", F.col("point_id").alias("origin_id"), F.col("u").alias("own_u"), F.col("v").alias("own_v"))
    placed = around.join(corners.select("specimen_id", "face_id", "corner", "u", "v"), ["specimen_id", "face_id", "corner"], "left").join(own, ["specimen_id", "origin_id"])
    known = F.col("u").isNotNull() & F.col("v").isNotNull()
    placed = placed.select("specimen_id", "face_id", "corner", "origin_id", *[F.when(known, F.col(c)).otherwise(F.col(f"own_{c}")).alias(c) for c in "uv"])
    alone = own.join(placed.select("specimen_id", "origin_id").distinct(), ["specimen_id", "origin_id"], "left_anti").select("specimen_id", "origin_id", F.col("own_u").alias("u"), F.col("own_v").alias("v"))
    distinct = placed.select("specimen_id", "origin_id", "u", "v").distinct().unionByName(alone)
    numbered = distinct.withColumn("point_id", (F.row_number().over(Window.partitionBy("specimen_id").orderBy("origin_id", "u", "v")) - 1).cast("int"))
    same = [F.col("p.specimen_id") == F.col("n.specimen_id"), F.col("p.origin_id") == F.col("n.origin_id"), F.col("p.u").eqNullSafe(F.col("n.u")), F.col("p.v").eqNullSafe(F.col("n.v"))]
    corner = placed.alias("p").join(numbered.alias("n"), same).select("p.specimen_id", "face_id", "corner", "point_id")
    new_faces = corner.groupBy("specimen_id", "face_id").agg(*[F.max(F.when(F.col("corner") == k, F.col("point_id"))).alias(f"v{k}") for k in range(3)])
    place = points.select("specimen_id", F.col("point_id").alias("origin_id"), "x", "y", "z")
    new_points = numbered.join(place, ["specimen_id", "origin_id"]).select("specimen_id", "point_id", "x", "y", "z", "u", "v")
    return new_points, new_faces, numbered.select("specimen_id", "point_id", "origin_id")


def of_origins(colors: DataFrame, origins: DataFrame) -> DataFrame:
    """(specimen_id, point_id, r, g, b): for each point the mean colour of what `wedges` has split it into, as doubles."""
    own = colors.join(origins, ["specimen_id", "point_id"])
    return own.groupBy("specimen_id", F.col("origin_id").alias("point_id")).agg(*[F.avg(c).alias(c) for c in "rgb"])
