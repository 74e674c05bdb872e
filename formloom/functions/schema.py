"""Schemas of the tables that the engine works on, and the id that files of one specimen share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESH_POINT = "specimen_id string, point_id int, x double, y double, z double, u double, v double"
MESH_FACE = "specimen_id string, face_id int, v0 int, v1 int, v2 int"
LANDMARK = "specimen_id string, lm_id int, label string, x double, y double, z double, selected boolean"
TRANSFORM = "specimen_id string, m array<double>"
TEXEL = "specimen_id string, row int, col int, r int, g int, b int"
POINT_RESULT = "point_id int, name string, value double"

# The endings that files of meshes, landmarks and textures have.
MESH_ENDINGS = ("ply", "obj", "stl", "vtk", "vtp")
LANDMARK_ENDINGS = ("mrk.json", "json", "fcsv")
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "bmp")


def specimen_id(path: Column) -> Column:
    """A file's name without folders and without known endings, however many; `_align` and the like stay."""
    endings = "|".join(sorted({e for x in (*MESH_ENDINGS, *LANDMARK_ENDINGS, *IMAGE_ENDINGS) for e in x.split(".")}))
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.regexp_replace(name, rf"(?i)(?:\.(?:{endings}))+$", "")


def require(df, *columns: str) -> None:
    """An error that names what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
