"""Readers and writers of meshes, landmarks and images."""

import base64
import struct
import zlib

import numpy as np
import pytest

from formloom.operators import texture
from formloom.sources import landmarks, mesh, sinks
from formloom.streaming import arrivals

P = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0.5]], float)
TRIS = [[0, 1, 2], [0, 2, 3]]


def ply(kind):
    head = f"ply\nformat {kind} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty float u\nproperty float v\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n".encode()
    if kind == "ascii":
        return head + "\n".join([*(f"{x} {y} {z} 0.25 0.5" for x, y, z in P), "4 0 1 2 3"]).encode()
    o = "<" if "little" in kind else ">"
    return head + b"".join(struct.pack(o + "5f", *p, 0.25, 0.5) for p in P) + struct.pack(o + "B4i", 4, 0, 1, 2, 3)


def stl(binary):
    t = [[P[i] for i in f] for f in TRIS]
    if binary:
        return b"\0" * 80 + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 0, *np.ravel(x), 0) for x in t)
    return ("solid s\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {a} {b} {c}\n" for a, b, c in x) + "endloop\nendfacet\n" for x in t) + "endsolid").encode()


def vtk(binary):
    head = b"# vtk DataFile Version 3.0\nx\n" + (b"BINARY" if binary else b"ASCII") + b"\nDATASET POLYDATA\nPOINTS 4 float\n"
    if binary:
        return head + P.astype(">f4").tobytes() + b"\nPOLYGONS 1 5\n" + np.array([4, 0, 1, 2, 3], ">i4").tobytes() + b"\n"
    return head + "\n".join(" ".join(map(str, p)) for p in P).encode() + b"\nPOLYGONS 1 5\n4 0 1 2 3\n"


def vtp(packed):
    def array(name, a, kind, n=1):
        if not packed:
            return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{n}" format="ascii">{" ".join(map(str, a.ravel().tolist()))}</DataArray>'
        raw = a.tobytes()
        z = zlib.compress(raw)
        text = base64.b64encode(struct.pack("<4I", 1, len(raw), 0, len(z))).decode() + base64.b64encode(z).decode()
        return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{n}" format="binary">{text}</DataArray>'

    zip_ = ' compressor="vtkZLibDataCompressor"' if packed else ""
    return (
        f'<VTKFile type="PolyData" byte_order="LittleEndian"{zip_}><PolyData><Piece NumberOfPoints="4" NumberOfPolys="1"><Points>'
        + array("Points", P.astype("<f8"), "Float64", 3) + "</Points><Polys>" + array("connectivity", np.arange(4, dtype="<i8"), "Int64") + array("offsets", np.array([4], "<i8"), "Int64") + "</Polys></Piece></PolyData></VTKFile>"
    ).encode()


@pytest.mark.parametrize(
    ("ending", "raw"),
    [("ply", ply("ascii")), ("ply", ply("binary_little_endian")), ("ply", ply("binary_big_endian")), ("stl", stl(True)), ("stl", stl(False)), ("vtk", vtk(True)), ("vtk", vtk(False)), ("vtp", vtp(True)), ("vtp", vtp(False))],
)
def test_parsers(ending, raw):
    xyz, uv, faces = mesh.PARSERS[ending](raw)
    assert np.allclose(xyz, P) and faces.tolist() == TRIS
    assert uv is None or np.allclose(uv, [[0.25, 0.5]] * 4)


def test_obj():
    raw = b"# c\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0.5\nvt 0.25 0.5\nf 1/1 2/1/1 3//1 -1\n"
    xyz, uv, faces = mesh.parse_obj(raw)
    assert np.allclose(xyz, P) and faces.tolist() == TRIS and np.allclose(uv[:2], 0.25 + np.array([[0, 0.25]] * 2)) and np.isnan(uv[2:]).all()


def test_read_a_folder_and_write_it_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, raw in (("a.ply", ply("ascii")), ("b.stl", stl(True)), ("bad.ply", b"no"), (".hidden.ply", ply("ascii")), ("note.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(raw)
    found = mesh.read_meshes(spark, f"file://{tmp_path}/in")
    assert sorted(r.specimen_id for r in found.collect()) == ["a", "b", "bad"]
    assert [r.specimen_id for r in mesh.mesh_errors(found).collect()] == ["bad"]
    points, faces = mesh.mesh_points(found), mesh.mesh_faces(found)
    assert points.count() == 8 and faces.count() == 4
    assert points.where("specimen_id = 'a'").first().u == 0.25 and points.where("specimen_id = 'b'").first().u is None
    for r in sinks.ply_text(points, faces).collect():
        xyz, _, tri = mesh.parse_ply(r.value.encode())
        assert np.allclose(xyz, P) and tri.tolist() == TRIS
    for r in sinks.vtp_text(points.withColumn("d", points.x * 2), faces, ("d",)).collect():
        xyz, _, tri = mesh.parse_vtp(r.value.encode())
        assert np.allclose(xyz, P) and tri.tolist() == TRIS and 'Name="d"' in r.value
    run = sinks.run_folder(str(tmp_path), 0)
    assert run.endswith("19700101T000000Z")
    sinks.write_stage(points, run, "mesh_point", "align")
    assert spark.read.parquet(f"{run}/mesh_point").where("stage = 'align'").count() == 8
    sinks.write_files(sinks.ply_text(points, faces), f"{tmp_path}/out")
    assert mesh.parse_ply(next((tmp_path / "out" / "specimen_id=a").glob("part*")).read_bytes())[2].tolist() == TRIS


def test_landmarks(spark, tmp_path):
    one = '{"markups": [{"type": "Fiducial", "coordinateSystem": "LPS", "controlPoints": [{"label": "p", "position": [1, 2, 3]}, {"label": "q", "position": [4, 5, 6.5], "selected": false}]}]}'
    (tmp_path / "fish.mrk.json").write_text(one)
    (tmp_path / "bird.fcsv").write_text("# Markups fiducial file\n# columns = id,x\nn_0,1,2,3,0,0,0,1,1,1,0,F-1,,\nn_1,4,5,6,0,0,0,1,1,0,0,F-2,,\n")
    got = landmarks.read_landmarks(spark, f"file://{tmp_path}")
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [("bird", 0, "F-1", 1.0, 2.0, 3.0, True), ("bird", 1, "F-2", 4.0, 5.0, 6.0, False), ("fish", 0, "p", 1.0, 2.0, 3.0, True), ("fish", 1, "q", 4.0, 5.0, 6.5, False)]
    again = tmp_path / "again"
    again.mkdir()
    for r in sinks.markups_json(got).collect():
        (again / f"{r.specimen_id}.mrk.json").write_text(r.value)
    assert sorted(tuple(r) for r in landmarks.read_json(spark, f"file://{again}").collect()) == rows


def test_stream_of_landmarks(spark, tmp_path):
    for s in range(3):
        (tmp_path / f"s{s}.mrk.json").write_text('{"markups": [{"controlPoints": [{"label": "p", "position": [%d, 0, 0]}]}]}' % s)
    q = arrivals.running_mean(arrivals.landmark_stream(spark, f"file://{tmp_path}", 1), "means")
    q.processAllAvailable()
    q.stop()
    r = spark.table("means").first()
    assert (r.lm_id, r.x, r.n) == (0, 1.0, 3)


def png(rows):
    """Rows of RGB pixels as a PNG file."""
    h, w = len(rows), len(rows[0])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(c for p in r for c in p) for r in rows))) + chunk(b"IEND", b"")


def bmp(rows):
    """Rows of RGB pixels as a BMP file: 24 bits, blue first, from the bottom, lines filled to four bytes."""
    h, w = len(rows), len(rows[0])
    data = b"".join(b"".join(bytes(p[::-1]) for p in r) + bytes(-3 * w % 4) for r in reversed(rows))
    return b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(data), 2835, 2835, 0, 0) + data


@pytest.mark.parametrize(("name", "made"), [("fish.PNG", png), ("fish.bmp", bmp)])
def test_image(spark, tmp_path, name, made):
    rows = [[(255, 0, 1), (0, 255, 2)], [(0, 0, 253), (9, 8, 7)]]
    (tmp_path / name).write_bytes(made(rows))
    t = texture.texels(landmarks.read_images(spark, f"file://{tmp_path}"))
    got = {(r.specimen_id, r.row, r.col): (r.r, r.g, r.b) for r in t.collect()}
    assert got == {("fish", i, j): rows[i][j] for i in range(2) for j in range(2)}
    flipped = {(r.row, r.col): (r.r, r.g, r.b) for r in texture.flip(t).collect()}
    assert flipped[0, 0] == (0, 0, 253)


@pytest.mark.parametrize("system", [None, "LPS", "RAS", "0"])
def test_stream_equals_batch(spark, tmp_path, system):
    import json

    markup = {"controlPoints": [{"label": "p", "position": [1, 2, 3]}, {"label": "q", "position": [4, 5, 6], "selected": False}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.mrk.json").write_text(json.dumps({"markups": [markup | ({"coordinateSystem": system} if system else {})]}))
    name = f"landmarks_{system}"
    q = arrivals.landmark_stream(spark, f"file://{tmp_path}/in").writeStream.format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    want = [tuple(r) for r in landmarks.read_json(spark, f"file://{tmp_path}/in").collect()]
    assert sorted(tuple(r) for r in spark.table(name).collect()) == sorted(want) and want[0][3] == (-1 if system in ("RAS", "0") else 1)


def surface(spark, ids):
    """Two meshes on the same points, whose ids have gaps, with a value and an array of them a point."""
    points = [(s, 2 * i + 3, *map(float, p), i / 3, [i / 3, -1.0 * i]) for s in ids for i, p in enumerate(P)]
    faces = [(s, k, *[2 * i + 3 for i in f]) for s in ids for k, f in enumerate(TRIS)]
    return spark.createDataFrame(points, "specimen_id string, point_id int, x double, y double, z double, d double, both array<double>"), spark.createDataFrame(faces, "specimen_id string, face_id int, v0 int, v1 int, v2 int")


@pytest.mark.parametrize("kind", ["ply", "ply-ascii", "vtp"])
def test_mesh_files_by_name(spark, tmp_path, kind):
    from formloom.sources import files

    points, faces = surface(spark, ["a", "b é"])
    files.write_meshes(points, faces, f"{tmp_path}/out", kind, ("d & e", "f"), "both")
    ending = kind.partition("-")[0]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"a.{ending}", f"b é.{ending}"]
    raw = (tmp_path / "out" / f"a.{ending}").read_bytes()
    assert (b'Name="d &amp; e"' if kind == "vtp" else b"property double d_&_e") in raw
    found = mesh.scan(spark, f"{tmp_path}/out")
    got = mesh.points_of(found)
    assert sorted((r.specimen_id, r.point_id, r.x, r.y, r.z, r.u) for r in got.collect()) == sorted((s, i, *map(float, p), None) for s in ("a", "b é") for i, p in enumerate(P))
    assert sorted((r.specimen_id, r.v0, r.v1, r.v2) for r in mesh.faces_of(found).collect()) == sorted((s, *f) for s in ("a", "b é") for f in TRIS)
    none = spark.createDataFrame([], faces.schema)
    files.write_meshes(points, none, f"{tmp_path}/none", kind)
    assert mesh.faces_of(mesh.scan(spark, f"{tmp_path}/none")).count() == 0 and mesh.points_of(mesh.scan(spark, f"{tmp_path}/none")).count() == 8


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    from formloom.sources import files

    points, faces = surface(spark, ["a", "b"])
    for p, f in ((points.where("specimen_id = 'a' or point_id > 3"), faces), (points.replace("b", "x/y", "specimen_id"), faces.where("specimen_id = 'a'"))):
        with pytest.raises(Exception, match="corners that aren't points|can't be the name"):
            files.write_meshes(p, f, f"{tmp_path}/out")
        assert list((tmp_path / "out").iterdir()) == []
    with pytest.raises(Exception, match="lacks some"):
        files.write_meshes(points, faces, f"{tmp_path}/out", "ply", ("only",), "both")
    with pytest.raises(ValueError):
        files.write_meshes(points, faces, f"{tmp_path}/out", "obj")
    files.write_named(spark.createDataFrame([("s", bytes([0, 255, 10]))], "specimen_id string, value binary"), f"{tmp_path}/raw", ".bin")
    assert (tmp_path / "raw" / "s.bin").read_bytes() == bytes([0, 255, 10])
    with pytest.raises(Exception, match="share a name"):
        files.write_named(spark.createDataFrame([("s", "a"), ("s", "b")], "specimen_id string, value string"), f"{tmp_path}/twice", ".txt")


def appended(packed, encoding):
    arrays, at, blob = [P.astype("<f8"), np.arange(4, dtype="<i8"), np.array([4], "<i8")], [], b""
    for a in arrays:
        raw, z = a.tobytes(), zlib.compress(a.tobytes())
        parts = [struct.pack("<4I", 1, len(raw), 0, len(z)), z] if packed else [struct.pack("<I", len(raw)) + raw]
        at.append(len(blob))
        blob += b"".join(parts if encoding == "raw" else map(base64.b64encode, parts))
    array = lambda i, kind, name: f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="3" format="appended" offset="{at[i]}"/>'
    zip_ = ' compressor="vtkZLibDataCompressor"' if packed else ""
    return f'<VTKFile type="PolyData" byte_order="LittleEndian"{zip_}><PolyData><Piece NumberOfPoints="4" NumberOfPolys="1"><Points>{array(0, "Float64", "Points")}</Points><Polys>{array(1, "Int64", "connectivity")}{array(2, "Int64", "offsets")}</Polys></Piece></PolyData><AppendedData encoding="{encoding}">\n _'.encode() + blob + b"\n</AppendedData></VTKFile>"


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("encoding", ["raw", "base64"])
def test_appended_arrays(packed, encoding):
    xyz, _, faces = mesh.parse_vtp(appended(packed, encoding))
    assert np.allclose(xyz, P) and faces.tolist() == TRIS
