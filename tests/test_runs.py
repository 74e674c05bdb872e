"""Folders to results, coordinate systems of landmark files, and mirrored meshes."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.operators import affine, segment
from formloom.plans import pipelines, runs
from formloom.sources import landmarks

CORNERS = [(0, 0, 0), (4, 0, 0), (0, 3, 0), (0, 0, 2), (1, 1, 3), (2, 3, 1)]
FACES = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 5), (1, 5, 4), (1, 4, 3), (2, 3, 4), (2, 4, 5)]


def ply(points):
    head = f"ply\nformat ascii 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(FACES)}\nproperty list uchar int vertex_indices\nend_header\n"
    return head + "".join("{} {} {}\n".format(*p) for p in points) + "".join("3 {} {} {}\n".format(*f) for f in FACES)


@pytest.fixture
def folders(tmp_path):
    """Three specimens of one shape, each moved; a broken model; a specimen without landmarks."""
    models, marks = tmp_path / "models", tmp_path / "marks"
    models.mkdir()
    marks.mkdir()
    draw = np.random.default_rng(1)
    for k in range(3):
        p = np.array(CORNERS, float) + 0.05 * draw.standard_normal((6, 3)) + k
        (models / f"s{k}.ply").write_text(ply(p.tolist()))
        points = [{"label": str(i), "position": x} for i, x in enumerate(p.tolist())]
        (marks / f"s{k}.mrk.json").write_text(json.dumps({"markups": [{"coordinateSystem": "LPS", "controlPoints": points}]}))
    (models / "broken.ply").write_text("ply\nnothing")
    (models / "alone.ply").write_text(ply(CORNERS))
    return str(models), str(marks), str(tmp_path / "out")


def test_coordinate_systems(spark, tmp_path):
    point = {"label": "a", "position": [1, 2, 3]}
    for name, system in (("l", "LPS"), ("r", "RAS"), ("n", None)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"markups": [{"coordinateSystem": system, "controlPoints": [point]}]}))
    (tmp_path / "f.fcsv").write_text('# Markups fiducial file version = 4.11\n# CoordinateSystem = LPS\n# columns = id,x\n1,1,2,3,0,0,0,1,1,0,0,"tip, left",,\n')
    (tmp_path / "g.fcsv").write_text("# CoordinateSystem = 0\n1,1,2,3,0,0,0,1,1,1,0,b,,\n")
    (tmp_path / "h.fcsv").write_text("1,1,2,3,0,0,0,1,1,1,0,c,,\n")
    got = {r.specimen_id: (r.x, r.y, r.z, r.label, r.selected) for r in landmarks.read_landmarks(spark, str(tmp_path)).collect()}
    lps, ras = (1.0, 2.0, 3.0), (-1.0, -2.0, 3.0)
    assert got == {"l": (*lps, "a", True), "r": (*ras, "a", True), "n": (*lps, "a", True), "f": (*lps, "tip, left", False), "g": (*ras, "b", True), "h": (*lps, "c", True)}


def test_faces_of_mirrored_meshes_look_outwards(spark):
    points = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(CORNERS)], "specimen_id string, point_id int, x double, y double, z double")
    faces = spark.createDataFrame([("s", i, *f) for i, f in enumerate(FACES)], "specimen_id string, face_id int, v0 int, v1 int, v2 int")
    before = {r.point_id: (r.nx, r.ny, r.nz) for r in segment.normals(points, faces).collect()}
    after = {r.point_id: (r.nx, r.ny, r.nz) for r in segment.normals(affine.mirror(points), affine.rewind(faces)).collect()}
    assert all(np.allclose(after[i], (-n[0], n[1], n[2])) for i, n in before.items())
    assert affine.rewind(faces, (-1, -1, 1)).collect() == faces.collect()
    marks = points.withColumnRenamed("point_id", "lm_id")
    made = pipelines.mirrored_meshes(pipelines.Specimens(points, faces, marks), [0, 1, 2, 3, 4, 5])
    assert made[1].count() == len(FACES) and made[3].count() == len(CORNERS)


def test_folders_to_results(spark, folders):
    models, marks, out = folders
    s = runs.read_specimens(spark, models, marks)
    assert {r.specimen_id for r in s.points.select("specimen_id").distinct().collect()} == {"s0", "s1", "s2"}
    atlas = runs.read_atlas(spark, f"{models}/s0.ply", f"{marks}/s0.mrk.json")
    assert (atlas.points.count(), atlas.landmarks.count()) == (6, 6)
    made = runs.run(spark, "shape", out, models, marks, atlas=atlas)
    results = spark.read.parquet(f"{made}/results/stage=shape")
    assert {r.name for r in results.select("name").distinct().collect()} == {"Magnitude Mean", "Magnitude SD", "s0", "s1", "s2"}
    assert results.where(F.col("value") > 1).count() == 0
    assert b"Magnitude Mean" in open(f"{made}/shape/results/shape.vtp", "rb").read()
    runs.write_atlas(atlas, made)
    again = runs.read_atlas(spark, f"{made}/atlas/model", f"{made}/atlas/landmarks")
    for table in ("points", "faces", "landmarks"):
        want = sorted(map(tuple, getattr(atlas, table).collect()), key=repr)
        assert want and sorted(map(tuple, getattr(again, table).collect()), key=repr) == want
    assert sorted(again.points.collect()) == sorted(spark.read.parquet(f"{made}/points/stage=atlas").select(again.points.columns).collect())
    with pytest.raises(ValueError, match="one model"):
        runs.read_atlas(spark, f"{made}/atlas/landmarks", f"{made}/atlas/landmarks")
    with pytest.raises(ValueError, match="one set"):
        runs.read_atlas(spark, f"{made}/atlas/model", f"{made}/atlas/model")
    with pytest.raises(ValueError):
        runs.run(spark, "other", out, models, marks)


def same(spark, made, stage, table, got):
    want = spark.read.parquet(f"{made}/{table}/stage={stage}")
    columns = [c for c in want.columns if c in got.columns and c != "label"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert rows(want) == rows(got) and want.count() > 0


@pytest.mark.parametrize(("workflow", "stages"), [("atlas", ["align"]), ("symmetry", ["align", "mirror", "align-atlas"]), ("dense_landmarks", ["align"])])
def test_files_of_workflows_can_be_read_again(spark, folders, workflow, stages):
    from formloom.functions.tables import own_folder
    from formloom.sources import mesh

    models, marks, out = folders
    held = spark.range(3).persist()
    held.count()
    before = set(os.listdir(own_folder(spark).removeprefix("file://"))) if os.path.exists(own_folder(spark).removeprefix("file://")) else set()
    made = runs.run(spark, workflow, out, models, marks, index=[0, 1, 2, 3, 5, 4] if workflow == "symmetry" else ())
    assert held.is_cached and set(os.listdir(own_folder(spark).removeprefix("file://"))) == before
    for stage in stages:
        s = runs.read_specimens(spark, f"{made}/{stage}/models", f"{made}/{stage}/landmarks")
        for table in ("points", "faces", "landmarks"):
            same(spark, made, stage, table, getattr(s, table))
    found = mesh.scan(spark, f"{made}/correspondence/models" if workflow != "atlas" else f"{made}/atlas/correspondence/models")
    assert {r.specimen_id for r in mesh.points_of(found).select("specimen_id").distinct().collect()} == {"s0", "s1", "s2", "base"}
    if workflow == "dense_landmarks":
        same(spark, made, "dense", "landmarks", landmarks.read_landmarks(spark, f"{made}/dense_landmarks"))
    if workflow == "symmetry":
        # mirror images of aligned specimens, at the place of the atlas, not of the files
        assert spark.read.parquet(f"{made}/points/stage=mirror").agg(F.avg("x")).first()[0] == pytest.approx(spark.read.parquet(f"{made}/points/stage=align").agg(F.avg("x")).first()[0], abs=0.5)
        with pytest.raises(ValueError, match="index"):
            runs.run(spark, "symmetry", out, models, marks)


def test_subset_of_files(spark, folders, tmp_path):
    _, marks, out = folders
    points = [{"label": str(i), "position": [0, 0, 0], "selected": i % 2 == 1} for i in range(6)]
    (tmp_path / "base.mrk.json").write_text(json.dumps({"markups": [{"controlPoints": points}]}))
    made = runs.subset(spark, out, marks, f"{tmp_path}/base.mrk.json")
    got = landmarks.read_landmarks(spark, f"{made}/subset")
    same(spark, made, "subset", "landmarks", got)
    want = landmarks.read_landmarks(spark, marks).where("lm_id % 2 = 1")
    assert sorted((r.specimen_id, r.lm_id, r.x) for r in got.collect()) == sorted((r.specimen_id, r.lm_id // 2, r.x) for r in want.collect())
    (tmp_path / "base.mrk.json").write_text(json.dumps({"markups": [{"controlPoints": [p | {"selected": False} for p in points]}]}))
    with pytest.raises(ValueError, match="selected"):
        runs.subset(spark, out, marks, f"{tmp_path}/base.mrk.json")


def test_textures_of_a_folder(spark, tmp_path):
    from tests.test_files import png

    for name in ("models", "marks", "textures"):
        (tmp_path / name).mkdir()
    head = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty float u\nproperty float v\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    for s in ("a", "b"):
        (tmp_path / "models" / f"{s}.ply").write_text(head + "0 0 0 0 0\n1 0 0 1 0\n0 1 0 1 1\n3 0 1 2\n")
        (tmp_path / "marks" / f"{s}.mrk.json").write_text(json.dumps({"markups": [{"controlPoints": [{"label": "p", "position": [0, 0, 0]}]}]}))
    (tmp_path / "textures" / "a.png").write_bytes(png([[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (10, 11, 12)]]))
    s = runs.read_specimens(spark, *(str(tmp_path / n) for n in ("models", "marks", "textures")))
    pipelines.check(s, True)
    got = {(r.specimen_id, r.point_id): (r.r, r.g, r.b) for r in pipelines.colors_of(s).collect()}
    assert got == {("a", 0): (7, 8, 9), ("a", 1): (10, 11, 12), ("a", 2): (4, 5, 6)} | {("b", i): (None,) * 3 for i in range(3)}
    assert not pipelines.has_textures(runs.read_specimens(spark, str(tmp_path / "models"), str(tmp_path / "marks")))
