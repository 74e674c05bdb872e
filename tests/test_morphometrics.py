"""Alignment, splines, surfaces, clusters and workflows: properties, degenerate inputs and hand-made meshes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.functions.schema import require, specimen_id
from formloom.operators import affine, align, features, segment, texture, warp
from formloom.plans import pipelines

TETRA = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0], [0, 0, 3], [1, 2, 2.5]], float)


def turn(seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((3, 3)))
    return q * np.sign(np.linalg.det(q))


def marks(spark, sets):
    return spark.createDataFrame([(s, i, *map(float, p)) for s, ps in sets.items() for i, p in enumerate(ps)], "specimen_id string, lm_id int, x double, y double, z double")


def target(spark, ps):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(ps)], "lm_id int, x double, y double, z double")


def xyz(df, key):
    return np.array([[r.x, r.y, r.z] for r in df.orderBy(key).collect()])


@pytest.mark.parametrize("scale", [None, "symmetric", "lsq"])
def test_fit_recovers_the_map(spark, scale):
    k = 2.5 if scale else 1.0
    moved = k * TETRA @ turn(1).T + [1, 2, 3]
    lm = marks(spark, {"a": moved, "b": TETRA})
    _, out = align.align(lm.withColumnRenamed("lm_id", "point_id"), lm, target(spark, TETRA), scale is not None)
    if scale == "lsq":
        out = affine.apply_affine(lm, align.fit_transforms(lm, target(spark, TETRA), "lsq"))
    for s in "ab":
        assert np.allclose(xyz(out.where(F.col("specimen_id") == s), "lm_id"), TETRA)


def test_fit_never_reflects(spark):
    lm = marks(spark, {"a": TETRA * [-1, 1, 1]})
    m = np.array(align.fit_transforms(lm, target(spark, TETRA)).first().m).reshape(4, 4)
    assert np.isclose(np.linalg.det(m[:3, :3]), 1)


def test_unequal_landmarks_are_an_error(spark):
    with pytest.raises(Exception, match="aren't the target's"):
        align.fit_transforms(marks(spark, {"a": TETRA[:4]}), target(spark, TETRA)).collect()
    with pytest.raises(ValueError):
        align.fit_transforms(marks(spark, {"a": TETRA}), target(spark, TETRA), "other")


@pytest.mark.parametrize("most_here", [0, 1000])
def test_procrustes(spark, most_here):
    draw = np.random.default_rng(0)
    shapes = {str(i): TETRA + 0.02 * draw.standard_normal(TETRA.shape) for i in range(4)}
    moved = {s: 1.7 * p @ turn(int(s) + 5).T + int(s) for s, p in shapes.items()}
    a, _ = align.procrustes(marks(spark, shapes), most_here=most_here, iterations=6)
    b, aligned = align.procrustes(marks(spark, moved), most_here=most_here, iterations=6)
    a, b = xyz(a, "lm_id"), xyz(b, "lm_id")
    d = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2)
    assert np.isclose((a**2).sum(), 1) and np.allclose(d(a), d(b), atol=1e-6)
    assert features.closest(features.distances_to_mean(aligned, target(spark, b))).count() == 1


def test_one_specimen_is_its_own_mean(spark):
    lm = marks(spark, {"a": TETRA})
    mean, aligned = align.procrustes(lm)
    assert features.distances_to_mean(aligned, mean).first().distance < 1e-9


def test_spline(spark):
    draw = np.random.default_rng(2)
    src, to = draw.standard_normal((8, 3)), draw.standard_normal((8, 3))
    w = warp.spline(src, to)
    assert np.allclose(warp.warp(src, src, w), to, atol=1e-9)
    a, b = turn(3) * 1.4, np.array([1, 2, 3])
    w = warp.spline(src, src @ a + b)
    p = draw.standard_normal((20, 3))
    assert np.allclose(warp.warp(p, src, w), p @ a + b, atol=1e-9)
    for bad in (src[:3], np.c_[src[:, :2], np.zeros(8)], np.r_[src[:7], src[:1]]):
        with pytest.raises(ValueError):
            warp.spline(bad, bad)


def test_closest_on_triangles_against_dense_sampling():
    draw = np.random.default_rng(4)
    corners, q = draw.standard_normal((30, 3, 3)), draw.standard_normal((40, 3))
    at, face = warp.closest_on_triangles(q, corners, chunk=7)
    u = np.array([(i, j) for i in np.linspace(0, 1, 41) for j in np.linspace(0, 1, 41) if i + j <= 1 + 1e-9])
    dense = corners[:, :1] + u[None, :, :1] * (corners[:, 1:2] - corners[:, :1]) + u[None, :, 1:] * (corners[:, 2:] - corners[:, :1])
    least = np.linalg.norm(q[:, None] - dense.reshape(-1, 3)[None], axis=2).min(1)
    own = np.linalg.norm(q - at, axis=1)
    assert (own <= least + 1e-9).all() and (own >= least - 0.15).all()
    flat = np.array([[[0, 0, 0], [1, 0, 0], [2, 0, 0]]], float)
    assert np.allclose(warp.closest_on_triangles(np.array([[1.5, 1, 0]]), flat)[0], [[1.5, 0, 0]]) and face.max() < 30


def cube():
    p = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    return p, [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]


def specimens(spark, textures=False):
    draw = np.random.default_rng(6)
    p, f = cube()
    points, faces, lms = [], [], []
    for s in "abc":
        v = np.array([x[1:] for x in p]) + 0.05 * draw.standard_normal((8, 3))
        points += [(s, i, *map(float, v[i]), i / 7, 1 - i / 7) for i in range(8)]
        faces += [(s, k, *t) for k, t in enumerate(f)]
        lms += [(s, i, *map(float, v[i])) for i in range(7)]
    t = spark.createDataFrame([(s, r, c, 10 * r, 20 * c, 5) for s in "ab" for r in range(2) for c in range(2)], "specimen_id string, row int, col int, r int, g int, b int")
    return pipelines.Specimens(
        spark.createDataFrame(points, "specimen_id string, point_id int, x double, y double, z double, u double, v double"),
        spark.createDataFrame(faces, "specimen_id string, face_id int, v0 int, v1 int, v2 int"),
        spark.createDataFrame(lms, "specimen_id string, lm_id int, x double, y double, z double"),
        t if textures else None,
    )


def test_workflows(spark):
    s = specimens(spark, textures=True)
    atlas = pipelines.make_atlas(s)
    assert atlas.points.count() == 8
    results, mean, variance = pipelines.shape(s, atlas)
    names = {r.name for r in features.result_names(results).collect()}
    assert names == {"Magnitude Mean", "Magnitude SD", "a", "b", "c"}
    assert mean.count() == 8 and variance.count() == 8
    assert features.wide(results, sorted(names)).count() == 8
    s.texels = None
    assert pipelines.shape(s, atlas)[1] is None
    dense = pipelines.dense_landmarks(s, atlas, percent=1.0)
    assert {r.specimen_id for r in dense.select("specimen_id").distinct().collect()} == {"a", "b", "c", "atlas"}
    assert pipelines.unpaired(s).count() == 0


def test_own_correspondence(spark):
    """Exact at landmarks; elsewhere the way back is another spline than the way there, and close to its inverse."""
    s = specimens(spark)
    own = lambda df: df.where("specimen_id = 'a'")
    mean, _ = align.procrustes(s.landmarks)
    out = warp.dense_correspondence(own(s.points), own(s.faces), own(s.landmarks), own(s.points).drop("specimen_id"), own(s.landmarks).drop("specimen_id"), mean)
    got, want = xyz(out, "point_id"), xyz(own(s.points), "point_id")
    assert np.allclose(got[:7], want[:7], atol=1e-6) and np.linalg.norm(got[7] - want[7]) < 0.1


def test_mirror_twice_and_reorder(spark):
    lm = marks(spark, {"a": TETRA})
    assert np.allclose(xyz(affine.mirror(affine.mirror(lm)), "lm_id"), TETRA)
    assert np.allclose(xyz(affine.reorder(lm, [1, 0, 2, 4, 3]), "lm_id"), TETRA[[1, 0, 2, 4, 3]])
    assert affine.mirror_index("2,1,3", first=1) == [1, 0, 2]
    with pytest.raises(ValueError):
        affine.mirror_index("0,0,1")
    own = lm.withColumnRenamed("lm_id", "point_id")
    p, m, semi = pipelines.mirrored(own, lm, [0, 1, 2, 3, 4], more=(own,))
    assert m.count() == 5 and np.allclose(xyz(semi, "point_id"), xyz(p, "point_id"))


def test_inputs_are_checked(spark):
    s = specimens(spark)
    pipelines.check(s)
    with pytest.raises(ValueError, match="textures"):
        pipelines.recolor(s)
    s.faces = s.faces.drop("v2")
    with pytest.raises(ValueError, match="v2"):
        pipelines.make_atlas(s)


def test_recolor(spark):
    encoded, points, faces = pipelines.recolor(specimens(spark, textures=True), "float-vector", k=2)
    assert encoded.count() == 24 and "color" in points.columns and faces.count() >= 0


def test_straddling_faces_vanish_and_ids_close_up(spark):
    f = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 1, 2, 3, 4), ("a", 2, 4, 5, 6)], "specimen_id string, face_id int, v0 int, v1 int, v2 int")
    at = spark.createDataFrame([("a", i, 0 if i < 4 else 1) for i in range(8)], "specimen_id string, point_id int, cluster_id int")
    p = spark.createDataFrame([("a", i, float(i), 0.0, 0.0) for i in range(8)], "specimen_id string, point_id int, x double, y double, z double")
    own, faces = segment.child_meshes(p, f, at)
    assert sorted((r.name, r.point_id, r.x) for r in own.collect()) == [("Cluster_0", 0, 0.0), ("Cluster_0", 1, 1.0), ("Cluster_0", 2, 2.0), ("Cluster_1", 0, 4.0), ("Cluster_1", 1, 5.0), ("Cluster_1", 2, 6.0)]
    assert sorted((r.cluster_id, r.v0, r.v1, r.v2) for r in faces.collect()) == [(0, 0, 1, 2), (1, 0, 1, 2)]


def test_colors(spark):
    t = spark.createDataFrame([("a", r, c, 100 * r, 50 * c, 7) for r in range(2) for c in range(2)], "specimen_id string, row int, col int, r int, g int, b int")
    p = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 1.0, 1.0), ("a", 2, -3.0, 9.0), ("b", 0, 0.5, 0.5), ("a", 3, None, None)], "specimen_id string, point_id int, u double, v double")
    got = {(r.specimen_id, r.point_id): (r.r, r.g, r.b) for r in texture.sample(p, t).collect()}
    assert got == {("a", 0): (100, 0, 7), ("a", 1): (0, 50, 7), ("a", 2): (0, 0, 7), ("b", 0): (None, None, None), ("a", 3): (None, None, None)}
    assert features.color_variance(spark.createDataFrame([(1, 0, 0, 3), (1, 0, 0, 9)], "point_id int, r int, g int, b int")).first().variance == 11.0
    with pytest.raises(ValueError):
        texture.encode(t, "other")


@pytest.mark.parametrize("k", [1, 3])
def test_kmeans(spark, k):
    rows = [("a", i, [10, 100, 200][i % 3] + i % 2, 5, 5) for i in range(60)] + [("a", 99, None, None, None)]
    at, centres = segment.kmeans_colors(spark.createDataFrame(rows, "specimen_id string, point_id int, r int, g int, b int"), k)
    assert at.count() == 60 and centres.count() == k
    if k == 3:
        assert sorted(r["count"] for r in at.groupBy("cluster_id").count().collect()) == [20, 20, 20]
        assert [round(r.r) for r in centres.orderBy("cluster_id").collect()] == [10, 100, 200]
    with pytest.raises(ValueError):
        segment.kmeans_colors(at, 16)


def test_normals_point_outwards(spark):
    p, f = cube()
    points = spark.createDataFrame([("a", *x) for x in p], "specimen_id string, point_id int, x double, y double, z double")
    faces = spark.createDataFrame([("a", k, *t) for k, t in enumerate(f)], "specimen_id string, face_id int, v0 int, v1 int, v2 int")
    for flip, sign in ((False, 1), (True, -1)):
        for r in segment.normals(points, faces, flip).collect():
            out = np.array(p[r.point_id][1:]) - 0.5
            assert sign * np.dot([r.nx, r.ny, r.nz], out) > 0 and np.isclose(r.nx**2 + r.ny**2 + r.nz**2, 1)


def test_subsample_against_brute_force(spark):
    v = np.random.default_rng(8).random((80, 3))
    df = spark.createDataFrame([("a", i, *map(float, x)) for i, x in enumerate(v)], "specimen_id string, point_id int, x double, y double, z double")
    gap, stay = 0.1 * np.linalg.norm(np.ptp(v, axis=0)), []
    for i, x in enumerate(v):
        if all(np.linalg.norm(x - v[j]) >= gap for j in stay):
            stay.append(i)
    assert sorted(r.point_id for r in segment.subsample(df, 10).collect()) == stay
    assert segment.subsample(df, 0).count() == 80


def test_results_hold_under_other_partitions(spark):
    s = specimens(spark)
    a = features.spread(features.magnitudes(s.points, features.mean_mesh(s.points))).orderBy("point_id").collect()
    b = features.spread(features.magnitudes(s.points.repartition(7), features.mean_mesh(s.points.repartition(3)))).orderBy("point_id").collect()
    assert np.allclose([r[1:] for r in a], [r[1:] for r in b])


def test_ids_of_files(spark):
    names = ["file:/x/fish_1.mrk.json", "/y/fish.2.ply", "fish_align.fcsv", "a/b/skull.PNG"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r[0] for r in df.select(specimen_id(F.col("path"))).collect()] == ["fish_1", "fish.2", "fish_align", "skull"]
    with pytest.raises(ValueError, match="missing"):
        require(df, "path", "x")


def test_kmeans_is_settled_and_best_of_fifteen(spark):
    draw = np.random.default_rng(3)
    c = draw.integers(0, 256, (3000, 3))
    at, centres = segment.kmeans_colors(spark.createDataFrame([("s", i, *map(int, x)) for i, x in enumerate(c)], "specimen_id string, point_id int, r int, g int, b int"), 8)
    m = np.array([(r.r, r.g, r.b) for r in centres.orderBy("cluster_id").collect()])
    own = np.array([r.cluster_id for r in at.orderBy("point_id").collect()])
    assert np.allclose([c[own == k].mean(0) for k in range(8)], m, atol=1e-6)
    with pytest.warns(UserWarning, match="settled"):
        segment.kmeans_colors(spark.createDataFrame([("s", i, *map(int, x)) for i, x in enumerate(c)], "specimen_id string, point_id int, r int, g int, b int"), 8, 2, 2)


def test_rounds_of_kmeans_follow_the_colours(spark, monkeypatch):
    """Not the number of the shuffle's parts, which grows with the points."""
    frame, parts = type(spark.range(0)), []
    real = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, *a, **b: parts.append(self.rdd.getNumPartitions()) or real(self, *a, **b))
    colors = spark.range(2000).selectExpr("'s' as specimen_id", "cast(id as int) as point_id", "cast(id % 7 as int) as r", "cast(id % 5 as int) as g", "0 as b")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        segment.kmeans_colors(colors, 2, 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert parts and set(parts) == {1}


def test_a_distance_matrix_is_many_tasks(spark, monkeypatch):
    """As many as its rows need, though its points are one part."""
    monkeypatch.setattr(features, "PAIRS", 400, raising=False)
    points = spark.range(100).coalesce(1).selectExpr("id as point_id", "cast(id as double) as x", "0.0D as y", "0.0D as z")
    made = features.distance_matrix(points)
    sizes = [r.n for r in made.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 1000
    assert made.where("distance != abs(i - j)").count() == 0
