"""Meshes from files (PLY, OBJ, STL, VTK, VTP) as tables of points and faces, one task for each file."""

from __future__ import annotations

import base64
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions.schema import MESH_ENDINGS, specimen_id
from formloom.functions.tables import written

# The formats' names of number types, as numpy's.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
VTK_TYPES = {"float": ">f4", "double": ">f8", "int": ">i4", "unsigned_int": ">u4", "long": ">i8", "vtktypeint64": ">i8", "vtkIdType": ">i8", "short": ">i2", "unsigned_char": ">u1", "char": ">i1"}
VTP_TYPES = {"Float32": "f4", "Float64": "f8", "Int32": "i4", "Int64": "i8", "UInt32": "u4", "UInt64": "u8", "UInt8": "u1", "Int8": "i1", "Int16": "i2", "UInt16": "u2"}

#: points x 3, texture coordinates x 2 or None, faces x 3
Mesh = tuple[np.ndarray, np.ndarray | None, np.ndarray]


def _fan(polygons: list | np.ndarray) -> np.ndarray:
    """Polygons as triangles around their first corners."""
    if isinstance(polygons, np.ndarray):
        k = polygons.shape[1] if polygons.ndim == 2 else 0
        if k < 3:
            return np.empty((0, 3), np.int64)
        p = polygons.astype(np.int64)
        return np.stack([np.stack([p[:, 0], p[:, i], p[:, i + 1]], 1) for i in range(1, k - 1)], 1).reshape(-1, 3)
    return np.array([(p[0], p[i], p[i + 1]) for p in polygons for i in range(1, len(p) - 1)], np.int64).reshape(-1, 3)


def _same_lists(body, count: str, item: str, order: str, n: int, at: int) -> tuple[np.ndarray, int] | None:
    """n lists of as many numbers each as the first one has, and where they end; None if their lengths differ."""
    first = int(np.frombuffer(body, np.dtype(order + PLY_TYPES[count]), 1, at)[0]) if n else 0
    t = np.dtype([("n", order + PLY_TYPES[count]), ("v", order + PLY_TYPES[item], (first,))])
    if at + n * t.itemsize > len(body):
        return None
    rows = np.frombuffer(body, t, n, at)
    return (rows["v"], at + n * t.itemsize) if (rows["n"] == first).all() else None


def _ply(raw: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None]:
    """points, their texture coordinates, triangles, and those of triangles' corners; each may have several."""
    head, _, body = raw.partition(b"end_header\n") if b"end_header\n" in raw else raw.partition(b"end_header\r\n")
    lines = [x.split() for x in head.decode("latin-1").splitlines()]
    if not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    kind = next(x[1] for x in lines if x[:1] == ["format"])
    elements: list[tuple[str, int, list]] = []
    for x in lines:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            elements[-1][2].append(x[1:])
    order, ascii_ = ">" if kind == "binary_big_endian" else "<", kind == "ascii"
    numbers = np.array(body.split(), float) if ascii_ else None
    at, made = 0, {}
    for name, n, properties in elements:
        columns: dict[str, object] = {}
        plain = all(p[0] != "list" for p in properties)
        if ascii_ and plain:
            table = numbers[at : at + n * len(properties)].reshape(n, len(properties))
            columns = {p[-1]: table[:, i] for i, p in enumerate(properties)}
            at += n * len(properties)
        elif plain:
            t = np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in properties])
            table = np.frombuffer(body, t, n, at)
            columns = {k: table[k].astype(float) for k in t.names}
            at += n * t.itemsize
        elif len(properties) == 1 and n and ascii_ and (numbers[at :: (width := int(numbers[at]) + 1)][:n] == width - 1).all() and len(numbers) - at >= n * width:
            columns = {properties[0][-1]: numbers[at : at + n * width].reshape(n, width)[:, 1:]}
            at += n * width
        elif len(properties) == 1 and not ascii_ and (same := _same_lists(body, properties[0][1], properties[0][2], order, n, at)):
            columns, at = {properties[0][-1]: same[0]}, same[1]
        else:
            columns = {p[-1]: [] for p in properties}
            for _ in range(n):
                for p in properties:
                    def take(kind_of: str, many: int) -> np.ndarray:
                        nonlocal at
                        if ascii_:
                            own = numbers[at : at + many]
                            at += many
                            return own
                        t = np.dtype(order + PLY_TYPES[kind_of])
                        own = np.frombuffer(body, t, many, at)
                        at += many * t.itemsize
                        return own

                    columns[p[-1]].append(take(p[2], int(take(p[1], 1)[0])) if p[0] == "list" else float(take(p[0], 1)[0]))
        made[name] = columns
    v, f = made["vertex"], made.get("face", {})
    uv = next((c for c in (("u", "v"), ("s", "t"), ("texture_u", "texture_v")) if set(c) <= set(v)), None)
    points = np.column_stack([np.asarray(v[c], float) for c in "xyz"]).reshape(-1, 3)
    lists = next((f[c] for c in ("vertex_indices", "vertex_index") if c in f), [])
    of_corners = None
    if len(lists) and "texcoord" in f:
        own = [np.asarray(c, float).reshape(-1, 2) if len(c) == 2 * len(p) else np.full((len(p), 2), np.nan) for p, c in zip(lists, f["texcoord"], strict=True)]
        of_corners = np.array([(c[0], c[i], c[i + 1]) for c in own for i in range(1, len(c) - 1)]).reshape(-1, 3, 2)
    return points, None if uv is None else np.column_stack([np.asarray(v[c], float) for c in uv]), _fan(lists), of_corners


def parse_ply(raw: bytes) -> Mesh:
    """Points that have no texture coordinates of their own take those of the first corner that has some."""
    points, uv, faces, of_corners = _ply(raw)
    return points, uv if of_corners is None or uv is not None else _first_of_corners(len(points), faces, of_corners), faces


def _first_of_corners(points: int, faces: np.ndarray, of_corners: np.ndarray) -> np.ndarray:
    out, flat, own = np.full((points, 2), np.nan), faces.ravel()[::-1], of_corners.reshape(-1, 2)[::-1]
    known = ~np.isnan(own).any(1)
    out[flat[known]] = own[known]
    return out


def _obj(raw: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None]:
    v, vt, polygons, corners_of = [], [], [], []
    for line in raw.decode("utf-8", "replace").splitlines():
        x = line.split()
        if not x:
            continue
        if x[0] == "v":
            v.append([float(c) for c in x[1:4]])
        elif x[0] == "vt":
            vt.append([float(x[1]), float(x[2]) if len(x) > 2 else 0.0])
        elif x[0] == "f":
            corners, own = [], []
            for c in x[1:]:
                a, *rest = c.split("/")
                corners.append(int(a) - 1 if int(a) > 0 else len(v) + int(a))
                t = int(rest[0]) if rest and rest[0] else 0
                own.append(t - 1 if t > 0 else len(vt) + t if t else -1)
            polygons.append(corners)
            corners_of.append(own)
    points, faces = np.array(v, float).reshape(-1, 3), _fan(polygons)
    if not any(t >= 0 for own in corners_of for t in own):
        return points, None, faces, None
    table = np.vstack([np.array(vt, float).reshape(-1, 2), [[np.nan, np.nan]]])
    return points, None, faces, table[_fan(corners_of)]


def parse_obj(raw: bytes) -> Mesh:
    """Points take the texture coordinates of the first corner that uses them."""
    points, _, faces, of_corners = _obj(raw)
    return points, None if of_corners is None else _first_of_corners(len(points), faces, of_corners), faces


def parse_stl(raw: bytes) -> Mesh:
    """Equal corners become one point, numbered in the order in which they first appear."""
    n = struct.unpack_from("<I", raw, 80)[0] if len(raw) >= 84 else -1
    if n >= 0 and len(raw) == 84 + 50 * n:
        t = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("more", "<u2")])
        corners = np.frombuffer(raw, t, n, 84)["corners"].reshape(-1, 3).astype(float)
    else:
        words = raw.split()
        if words[:1] != [b"solid"]:
            raise ValueError("not an STL file")
        corners = np.array([[float(words[i + k]) for k in (1, 2, 3)] for i, w in enumerate(words) if w == b"vertex"], float).reshape(-1, 3)
    distinct, first, back = np.unique(corners, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], None, rank[back.ravel()].reshape(-1, 3)


def parse_vtk(raw: bytes) -> Mesh:
    """Legacy polydata, as text or binary."""
    lines = raw.split(b"\n", 4)
    binary = lines[2].strip().upper() == b"BINARY"
    at, points, uv, faces = sum(len(x) + 1 for x in lines[:3]), np.empty((0, 3)), None, np.empty((0, 3), np.int64)

    def word() -> str:
        nonlocal at
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        own, at = raw[at:end].decode("latin-1"), end
        return own

    def numbers(n: int, kind: str) -> np.ndarray:
        nonlocal at
        if not binary:
            return np.array([float(word()) for _ in range(n)])
        at = raw.index(b"\n", at) + 1
        t = np.dtype(VTK_TYPES[kind])
        own = np.frombuffer(raw, t, n, at)
        at += n * t.itemsize
        return own

    while w := word().upper():
        if w == "POINTS":
            n, kind = int(word()), word()
            points = numbers(3 * n, kind).astype(float).reshape(-1, 3)
        elif w == "POLYGONS":
            n, size = int(word()), int(word())
            flat, i, lists = numbers(size, "int").astype(int).tolist(), 0, []
            for _ in range(n):
                lists.append(flat[i + 1 : i + 1 + flat[i]])
                i += 1 + flat[i]
            faces = _fan(lists)
        elif w == "TEXTURE_COORDINATES":
            word()
            size, kind = int(word()), word()
            uv = numbers(size * len(points), kind).astype(float).reshape(len(points), size)[:, :2]
    return points, uv, faces


def parse_vtp(raw: bytes) -> Mesh:
    """XML polydata with arrays in place, as text or base64, compressed or not, or appended, raw or as base64."""
    appended, packed = b"", ""
    found = re.search(rb"<AppendedData[^>]*encoding\s*=\s*[\"'](\w+)[\"'][^>]*>", raw)
    if found:
        packed = found[1].decode()
        begin, end = raw.index(b"_", found.end()) + 1, raw.rindex(b"</AppendedData>")
        appended, raw = raw[begin:end], raw[: found.end()] + raw[end:]
    root = ET.fromstring(raw)
    order = ">" if root.get("byte_order") == "BigEndian" else "<"
    head = np.dtype(order + VTP_TYPES[root.get("header_type", "UInt32")])

    def blocks(data: bytes, raw_: bool) -> bytes:
        """An array's bytes: after their number, or in compressed blocks after the blocks' sizes; as they are, or as base64."""
        part = (lambda at, n: data[at : at + n]) if raw_ else (lambda at, n: base64.b64decode(data[at : at + 4 * -(-n // 3)])[:n])
        length = (lambda n: n) if raw_ else (lambda n: 4 * -(-n // 3))
        k = head.itemsize
        if not root.get("compressor"):
            n = int(np.frombuffer(part(0, k), head)[0])
            return data[k : k + n] if raw_ else base64.b64decode(data[: length(k + n)])[k : k + n]
        many = int(np.frombuffer(part(0, k), head)[0])
        sizes = np.frombuffer(part(0, (3 + many) * k), head)[3:].tolist()
        at = length((3 + many) * k)
        whole = data[at : at + sum(sizes)] if raw_ else base64.b64decode(data[at : at + length(sum(sizes))])
        ends = np.cumsum([0, *sizes]).tolist()
        return b"".join(zlib.decompress(whole[i:j]) for i, j in zip(ends, ends[1:], strict=False))

    def values(a: ET.Element) -> np.ndarray:
        t, text = np.dtype(order + VTP_TYPES[a.get("type")]), (a.text or "").strip()
        how = a.get("format", "ascii")
        if how == "ascii":
            return np.array(text.split(), float).astype(t)
        if how == "appended":
            return np.frombuffer(blocks(appended[int(a.get("offset", "0")) :], packed == "raw"), t)
        return np.frombuffer(blocks(text.encode(), False), t)

    piece = next(root.iter("Piece"))
    points = values(next(piece.find("Points").iter("DataArray"))).astype(float).reshape(-1, 3)
    polys = {a.get("Name"): values(a).astype(int) for a in piece.find("Polys").iter("DataArray")} if piece.find("Polys") is not None else {}
    ends = polys.get("offsets", np.empty(0, int)).tolist()
    triangles = ends == list(range(3, 3 * len(ends) + 1, 3))
    lists = polys["connectivity"].reshape(-1, 3) if ends and triangles else [polys["connectivity"][a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    data = piece.find("PointData")
    tc = data.get("TCoords") if data is not None else None
    uv = next((values(a).astype(float).reshape(len(points), -1)[:, :2] for a in data.iter("DataArray") if a.get("Name") == tc), None) if tc else None
    return points, uv, _fan(lists)


PARSERS: dict[str, Callable[[bytes], Mesh]] = {"ply": parse_ply, "obj": parse_obj, "stl": parse_stl, "vtk": parse_vtk, "vtp": parse_vtp}
_PARSED = "specimen_id string, path string, error string, xyz array<array<double>>, uv array<array<double>>, faces array<array<int>>"


def read_meshes(spark: SparkSession, folder: str, endings: tuple[str, ...] = MESH_ENDINGS) -> DataFrame:
    """(specimen_id, path, error, xyz, uv, faces): a row for each file with one of the endings; hidden files are left out.

    A file that can't be read has an error and no mesh.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{%s}" % ",".join(endings)).option("recursiveFileLookup", "true").load(folder)
    named = files.select(specimen_id(F.col("path")).alias("specimen_id"), "path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ending"), "content")

    def parse(batches):
        for b in batches:
            for r in b.itertuples():
                own = {"specimen_id": r.specimen_id, "path": r.path, "error": None, "xyz": None, "uv": None, "faces": None}
                try:
                    xyz, uv, faces = PARSERS[r.ending](bytes(r.content))
                    own |= {"xyz": xyz.tolist(), "uv": None if uv is None else uv.tolist(), "faces": faces.tolist()}
                except Exception as e:  # any broken file is reported, not fatal
                    own["error"] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([own])

    return named.mapInPandas(parse, _PARSED)


def mesh_points(meshes: DataFrame) -> DataFrame:
    """The table of points of meshes that could be read; ids count from 0, and coordinates that a point lacks are null."""
    p = meshes.where("error is null").select("specimen_id", "uv", F.posexplode("xyz").alias("point_id", "p"))
    known = lambda i: F.when(~F.isnan(F.get("t", F.lit(i))), F.get("t", F.lit(i)))
    return p.withColumn("t", F.get("uv", F.col("point_id"))).select("specimen_id", "point_id", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")], known(0).alias("u"), known(1).alias("v"))


def mesh_faces(meshes: DataFrame) -> DataFrame:
    """The table of triangles of meshes that could be read."""
    f = meshes.where("error is null").select("specimen_id", F.posexplode("faces").alias("face_id", "f"))
    return f.select("specimen_id", "face_id", *[F.col("f")[i].alias(f"v{i}") for i in range(3)])


def mesh_errors(meshes: DataFrame) -> DataFrame:
    return meshes.where("error is not null").select("specimen_id", "path", "error")


#: Rows that a task hands on at a time.
ROWS = 1 << 16
_SCANNED = "specimen_id string, path string, error string, kind string, id int, x double, y double, z double, u double, v double, v0 int, v1 int, v2 int, corner int"
_CORNERS: dict[str, Callable[[bytes], tuple]] = {"ply": _ply, "obj": _obj}


def scan(spark: SparkSession, folder: str, endings: tuple[str, ...] = MESH_ENDINGS) -> DataFrame:
    """The meshes of a folder in one pass: rows of kind `point`, `face`, `corner` (texture coordinates of a face's corner) or `error`.

    One task for each file or some small ones; a file is parsed into arrays and handed on some thousand rows at a time. The
    rows are written as a table, in which a file's rows of a kind lie together, so that reading points skips most of the
    faces. Files are read by Spark, and may lie
    in any store that it knows; a file of over 2 GB is beyond its limit for a value.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{%s}" % ",".join(endings)).option("recursiveFileLookup", "true").load(folder)
    named = files.select(specimen_id(F.col("path")).alias("specimen_id"), "path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ending"), "content")

    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (f.split() for f in _SCANNED.split(", "))])

    def flat(n: int, columns: dict[str, object]) -> Iterator[pa.RecordBatch]:
        for i in range(0, n, ROWS):
            many = min(n, i + ROWS) - i
            made = []
            for f in schema:
                c = columns.get(f.name)
                made.append(pa.nulls(many, f.type) if c is None else pa.repeat(pa.scalar(c, f.type), many) if isinstance(c, str) else pa.array(c[i : i + many], f.type))
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, path, ending = (b.column(c)[k].as_py() for c in range(3))
                try:
                    raw = b.column(3)[k].as_py()
                    xyz, uv, faces = PARSERS[ending](raw)
                    more = _CORNERS[ending](raw)[3] if ending in _CORNERS else None
                    if len(faces) and (faces.min() < 0 or faces.max() >= len(xyz)):
                        raise ValueError("faces have corners that aren't points")
                    parts = [("point", len(xyz), {"id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]} | ({} if uv is None else {"u": uv[:, 0], "v": uv[:, 1]}))]
                    parts.append(("face", len(faces), {"id": np.arange(len(faces)), "v0": faces[:, 0], "v1": faces[:, 1], "v2": faces[:, 2]}))
                    if more is not None:
                        flat_uv = more.reshape(-1, 2)
                        parts.append(("corner", len(flat_uv), {"id": np.repeat(np.arange(len(more)), 3), "corner": np.tile(np.arange(3), len(more)), "u": flat_uv[:, 0], "v": flat_uv[:, 1]}))
                except Exception as e:  # any broken file is reported, not fatal
                    parts = [("error", 1, {"error": f"{type(e).__name__}: {e}"})]
                for kind, n, columns in parts:
                    yield from flat(n, {"specimen_id": name, "path": path, "kind": kind} | columns)

    found = named.mapInArrow(parse, _SCANNED)
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return written(found.select("specimen_id", "path", "error", "kind", "id", "x", "y", "z", known("u"), known("v"), "v0", "v1", "v2", "corner"), "meshes")


def points_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("kind = 'point'").select("specimen_id", F.col("id").alias("point_id"), "x", "y", "z", "u", "v")


def faces_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("kind = 'face'").select("specimen_id", F.col("id").alias("face_id"), "v0", "v1", "v2")


def corners_of(scanned: DataFrame) -> DataFrame:
    """(specimen_id, face_id, corner, u, v): texture coordinates of faces' corners, where files have them."""
    return scanned.where("kind = 'corner'").select("specimen_id", F.col("id").alias("face_id"), "corner", "u", "v")


def errors_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("kind = 'error'").select("specimen_id", "path", "error")


def points_and_paths(scanned: DataFrame) -> DataFrame:
    """(path): the files that have points."""
    return scanned.where("kind = 'point'").select("path").distinct()
