"""Landmark sets from markups JSON and FCSV files, and textures from image files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions.schema import IMAGE_ENDINGS, specimen_id

# The parts of a markups file that are read, and the order of an FCSV row's fields.
MARKUPS = "markups array<struct<coordinateSystem:string,controlPoints:array<struct<label:string,position:array<double>,selected:boolean>>>>"
FCSV = ("id", "x", "y", "z", "ow", "ox", "oy", "oz", "vis", "sel", "lock", "label", "desc", "associatedNodeID")


#: Coordinates are held as left, posterior, superior; a file may state the opposite signs of the first two, also by number.
_OPPOSITE = ("RAS", "0")


def _in_lps(system: Column, x: Column, y: Column, z: Column) -> list[Column]:
    sign = F.when(F.upper(F.trim(system)).isin(*_OPPOSITE), F.lit(-1.0)).otherwise(F.lit(1.0))
    return [(sign * x).alias("x"), (sign * y).alias("y"), z.alias("z")]


def markups_points(raw: DataFrame) -> DataFrame:
    """Landmarks of markups files (path, value), in the order of their control points; ids count from 0, points without `selected` are.

    Coordinates come out in LPS, whichever system the file states; one that states none is taken to be in LPS.
    """
    markup = raw.select(specimen_id(F.col("path")).alias("specimen_id"), F.from_json("value", MARKUPS)["markups"][0].alias("m"))
    points = markup.select("specimen_id", F.col("m.coordinateSystem").alias("system"), F.posexplode("m.controlPoints").alias("lm_id", "p"))
    xyz = _in_lps(F.col("system"), *[F.col("p.position")[i] for i in range(3)])
    return points.select("specimen_id", "lm_id", F.col("p.label").alias("label"), *xyz, F.coalesce("p.selected", F.lit(True)).alias("selected"))


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """Landmarks of *.json files."""
    raw = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return markups_points(raw.select(F.col("_metadata.file_path").alias("path"), "value"))


def read_fcsv(spark: SparkSession, folder: str) -> DataFrame:
    """Landmarks of *.fcsv files, in the order of their lines; those that begin with # are comments, which may state the
    coordinate system. Files that state none are taken to be in LPS. Fields in quotes may hold commas."""
    raw = spark.read.option("pathGlobFilter", "*.fcsv").option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    stated = F.regexp_extract("value", r"(?im)^#\s*CoordinateSystem\s*=\s*([A-Za-z0-9]+)", 1)
    points = raw.select(specimen_id(F.col("path")).alias("specimen_id"), stated.alias("system"), F.posexplode(lines).alias("lm_id", "line"))
    fields = ", ".join(f"{n} string" for n in FCSV)
    points = points.withColumn("f", F.from_csv("line", F.lit(fields), {"quote": '"'}))
    xyz = _in_lps(F.col("system"), *[F.col(f"f.{c}").cast("double") for c in "xyz"])
    return points.select("specimen_id", "lm_id", F.col("f.label").alias("label"), *xyz, F.coalesce(F.trim("f.sel") != "0", F.lit(True)).alias("selected"))


def read_landmarks(spark: SparkSession, folder: str) -> DataFrame:
    """Landmarks of both kinds of files."""
    return reduce(DataFrame.unionByName, (read_json(spark, folder), read_fcsv(spark, folder)))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(specimen_id, image): textures, as Spark's image source reads them; endings in any case."""
    either = ",".join(e for x in IMAGE_ENDINGS for e in (x, x.upper(), x.capitalize()))
    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % either).load(folder)
    return found.select(specimen_id(F.col("image.origin")).alias("specimen_id"), "image")
