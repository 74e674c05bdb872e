"""Tables of a run as Parquet, and single meshes or landmark sets as files for other programs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_folder(root: str, at: float | None = None) -> str:
    """The folder of a run, named by its time in UTC."""
    return f"{root.rstrip('/')}/{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime(at))}"


def write_stage(df: DataFrame, run: str, table: str, stage: str) -> None:
    """Rows of a stage (align, mirror, atlas, result ...) of a table, by specimen where there are specimens: a file each."""
    if "specimen_id" in df.columns:
        df.repartition("specimen_id").write.mode("overwrite").partitionBy("specimen_id").parquet(f"{run}/{table}/stage={stage}")
    else:
        df.write.mode("overwrite").parquet(f"{run}/{table}/stage={stage}")


def markups_json(landmarks: DataFrame) -> DataFrame:
    """(specimen_id, value): each specimen's landmarks as a markups file's text."""
    point = F.struct("lm_id", F.struct(F.col("label"), F.array("x", "y", "z").alias("position"), F.coalesce("selected", F.lit(True)).alias("selected")).alias("p"))
    full = landmarks if "selected" in landmarks.columns else landmarks.withColumn("selected", F.lit(True))
    sets = full.groupBy("specimen_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda r: r["p"]).alias("points"))
    markup = F.struct(F.lit("Fiducial").alias("type"), F.lit("LPS").alias("coordinateSystem"), F.col("points").alias("controlPoints"))
    return sets.select("specimen_id", F.to_json(F.struct(F.array(markup).alias("markups"))).alias("value"))


def _numbered(points: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with `at`, their place in their specimen, and faces with places for corners."""
    p = points.withColumn("at", F.row_number().over(Window.partitionBy("specimen_id").orderBy("point_id")) - 1)
    f = faces.select("specimen_id", "face_id", "v0", "v1", "v2")
    for k in range(3):
        f = f.join(p.select("specimen_id", F.col("point_id").alias(f"v{k}"), F.col("at").alias(f"a{k}")), ["specimen_id", f"v{k}"])
    return p, f


def _lists(points: DataFrame, faces: DataFrame, columns: tuple[str, ...], line: Column, how: str) -> DataFrame:
    """(specimen_id, v, f): a specimen's points, with `line` besides, and its faces, in order."""
    p, t = _numbered(points, faces)
    v = p.groupBy("specimen_id").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line"), *[F.col(c).cast("double").alias(c) for c in columns]))).alias("v"))
    f = t.groupBy("specimen_id").agg(F.array_sort(F.collect_list(F.struct("face_id", F.concat_ws(" ", "a0", "a1", "a2").alias("line")))).alias("f"))
    none = F.array().cast(f.schema["f"].dataType)
    return v.join(f, "specimen_id", how).withColumn("f", F.coalesce("f", none))


def ply_text(points: DataFrame, faces: DataFrame, arrays: tuple[str, ...] = ()) -> DataFrame:
    """(specimen_id, value): each specimen's mesh as an ASCII PLY file's text; arrays: more columns of points, as doubles.

    Points are numbered anew from 0 in the order of their ids. For meshes whose text is too long for a value there is
    files.write_meshes.
    """
    columns = ("x", "y", "z", *arrays)
    ids = _lists(points, faces, (), F.concat_ws(" ", *[F.col(c).cast("double").cast("string") for c in columns]), "left")
    corner = F.transform("f", lambda t: F.concat(F.lit("3 "), t["line"]))
    head = F.concat_ws("\n", F.lit("ply\nformat ascii 1.0"), F.concat(F.lit("element vertex "), F.size("v")), *[F.lit(f"property double {c}") for c in columns], F.concat(F.lit("element face "), F.size("f")), F.lit("property list uchar int vertex_indices\nend_header"))
    return ids.select("specimen_id", F.concat(head, F.lit("\n"), F.array_join(F.col("v.line"), "\n"), F.lit("\n"), F.array_join(corner, "\n"), F.when(F.size("f") > 0, F.lit("\n")).otherwise(F.lit(""))).alias("value"))


def vtp_text(points: DataFrame, faces: DataFrame, arrays: tuple[str, ...] = ()) -> DataFrame:
    """(specimen_id, value): each specimen's mesh as XML polydata in text, with arrays of points."""
    both = _lists(points, faces, arrays, F.concat_ws(" ", *[F.col(c).cast("double").cast("string") for c in "xyz"]), "inner")
    named = [F.concat(F.lit(f'<DataArray type="Float64" Name="{a}" format="ascii">'), F.array_join(F.col("v").getField(a).cast("array<string>"), " "), F.lit("</DataArray>")) for a in arrays]
    ends = F.array_join(F.transform(F.sequence(F.lit(1), F.size("f")), lambda i: (3 * i).cast("string")), " ")
    text = F.concat(
        F.lit('<VTKFile type="PolyData" version="0.1" byte_order="LittleEndian"><PolyData><Piece NumberOfPoints="'), F.size("v"), F.lit('" NumberOfPolys="'), F.size("f"), F.lit('"><PointData>'), *named,
        F.lit('</PointData><Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">'), F.array_join(F.col("v.line"), " "), F.lit('</DataArray></Points><Polys><DataArray type="Int64" Name="connectivity" format="ascii">'), F.array_join(F.col("f.line"), " "),
        F.lit('</DataArray><DataArray type="Int64" Name="offsets" format="ascii">'), ends, F.lit("</DataArray></Polys></Piece></PolyData></VTKFile>"),
    )
    return both.select("specimen_id", text.alias("value"))


def write_files(texts: DataFrame, folder: str) -> None:
    """One folder for each specimen with its text, written by Spark, so that any store will do."""
    texts.repartition("specimen_id").write.mode("overwrite").partitionBy("specimen_id").option("lineSep", "\n").text(folder)
