"""Named queries over the derived morphometric views, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.tables import written
from formloom.operators import accuracy, affine, align, colors, drift, features, segment, texture, warp
from formloom.plans import pipelines, views


def _r(c: Column | str) -> Column:
    """Six places, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _long_keys(df: DataFrame, *keys: str) -> list[Column]:
    return [F.col(k).cast("long").alias(k) for k in keys]


def _out(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*[F.col(k).cast("long").alias(k) for k in keys], *[_r(v).alias(v) for v in values])


def _sql(values: str, rest: str) -> str:
    return f"{views.SQL} select {values} from {rest}"


def _f(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 as {name}"


_S, _P = "cast(s as bigint) as specimen_id", "cast(pid as bigint) as point_id"
_XYZ = ["x", "y", "z"]
_DIST = "sqrt(pow(x-ax,2)+pow(y-ay,2)+pow(z-az,2))"
_TO_MEAN = "(select s, sum(sqrt(pow(x-mx,2)+pow(y-my,2)+pow(z-mz,2))) d from lm join mean using (pid) group by s)"
#: left and right landmarks exchanged, from 0 on
MIRROR_INDEX = [1, 0, 3, 2, 5, 4, 7, 6]


def _magnitudes(spark, d):
    p = views.points(spark, d)
    return features.magnitudes(p, features.mean_mesh(p))


def _sampled(spark, d):
    return texture.sample(views.points(spark, d), views.texel(spark, d))


def _gathered(spark, d):
    """The same from images, in tasks."""
    return texture.sample_images(views.points(spark, d), texture.packed(views.texel(spark, d)))


def _asymmetries(spark, d):
    p = views.points(spark, d)
    return features.asymmetries(p, affine.mirror(p))


def _to_mean(spark, d):
    lm = views.landmarks(spark, d)
    return features.distances_to_mean(lm, features.mean_landmarks(lm))


def _pivot(spark, d):
    wide = features.wide(features.point_results(_magnitudes(spark, d)), ["Magnitude Mean", "Magnitude SD", "0", "1"])
    return wide.select(F.col("point_id").cast("long").alias("point_id"), *[_r(f"`{a}`").alias(b) for a, b in (("Magnitude Mean", "magnitude_mean"), ("Magnitude SD", "magnitude_sd"), ("0", "specimen_0"), ("1", "specimen_1"))])


def _pivot_all(spark, d):
    """The whole export: the long results' names are the columns, one for each specimen beside mean and deviation."""
    wide = features.wide(features.point_results(_magnitudes(spark, d)))
    return wide.select(F.col("point_id").cast("long").alias("point_id"), *[_r(F.col(f"`{c}`")).alias(c) for c in wide.columns if c != "point_id"])


def _kept(spark, d):
    return segment.faces_within(views.faces(spark, d), views.assignment(spark, d))


def _kept_once(spark, d):
    """The kept faces of all specimens, each once, as the SQL's `kept` has them."""
    return _kept(spark, d).select("face_id", "v0", "v1", "v2", "cluster_id").distinct()


def _affine(spark, d):
    """A turn by 90 degrees about z, twice the size, and a shift."""
    s = views.points(spark, d).select("specimen_id").distinct()
    m = s.withColumn("m", F.array(*[F.lit(float(v)) for v in (0, -2, 0, 1, 2, 0, 0, 2, 0, 0, 2, 3, 0, 0, 0, 1)]))
    return affine.apply_affine(views.points(spark, d), m)


def _queries_for_nearest(spark, d):
    return views.points(spark, d).withColumn("x", F.col("x") + 0.05)


def _aligned(scale):
    def made(spark, d):
        p, lm = views.points(spark, d), views.landmarks(spark, d).drop("selected")
        return _out(align.align(p, lm, features.mean_landmarks(lm), scale)[0], ["specimen_id", "point_id"], _XYZ)

    return made


def _gpa(spark, d):
    return _out(align.procrustes(views.landmarks(spark, d).drop("selected"))[0], ["lm_id"], _XYZ)


def _warped(spark, d):
    lm = views.landmarks(spark, d).drop("selected")
    return _out(warp.warp_points(views.points(spark, d), lm, warp.per_specimen(features.mean_landmarks(lm), lm)), ["specimen_id", "point_id"], _XYZ)


def _specimens(spark, d, textures: bool = False) -> pipelines.Specimens:
    """The views as a collection, written once as files of a collection are read once."""
    points = written(views.points(spark, d), "view-points")
    lm = points.where(F.col("point_id") <= views.LANDMARKS).select("specimen_id", F.col("point_id").alias("lm_id"), *_XYZ)
    return pipelines.Specimens(points, written(views.faces(spark, d), "view-faces"), lm, views.texel(spark, d) if textures else None)


def _plain_atlas(s: pipelines.Specimens) -> pipelines.Atlas:
    """The plain mean of a collection, with the faces of its first specimen."""
    first = s.faces.agg(F.min("specimen_id").alias("specimen_id"))
    return pipelines.Atlas(written(features.mean_mesh(s.points), "view-atlas"), s.faces.join(F.broadcast(first), "specimen_id", "left_semi").drop("specimen_id"), features.mean_landmarks(s.landmarks))


def _workflow(which: Callable, textures: bool = False) -> Callable:
    """A query of a workflow: which(collection, its plain atlas)."""

    def made(spark, d):
        s = _specimens(spark, d, textures)
        return which(s, _plain_atlas(s))

    return made


def _dense(spark, d):
    s = _specimens(spark, d)
    a = _plain_atlas(s)
    mean, _ = align.procrustes(s.landmarks)
    return _out(warp.dense_correspondence(s.points, s.faces, s.landmarks, a.points, a.landmarks, mean), ["specimen_id", "point_id"], _XYZ)


def _long(results: DataFrame) -> DataFrame:
    return results.select(F.col("point_id").cast("long").alias("point_id"), "name", _r("value").alias("value"))


def _kmeans(spark, d):
    at, centres = segment.kmeans_colors(_sampled(spark, d), 5)
    return _out(at.join(centres, "cluster_id"), ["specimen_id", "point_id", "cluster_id"], ["r", "g", "b"])


def _offset(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """The distance of a's points to b's, by key."""
    both = a.join(b.select(*keys, *[F.col(c).alias(f"b{c}") for c in _XYZ]), list(keys))
    return both.select(*keys, F.sqrt(sum(((F.col(c) - F.col(f"b{c}")) * (F.col(c) - F.col(f"b{c}")) for c in _XYZ), F.lit(0.0))).alias("offset"))


def _lengths(points: DataFrame) -> DataFrame:
    """Each point's distance to the next one of its specimen."""
    after = points.select("specimen_id", (F.col("point_id") - 1).alias("point_id"), *_XYZ)
    return _out(_offset(points, after, "specimen_id", "point_id").withColumnRenamed("offset", "length"), ["specimen_id", "point_id"], ["length"])


def _aligned_points(scale):
    def made(spark, d):
        lm = views.landmarks(spark, d).drop("selected")
        return align.align(views.points(spark, d), lm, features.mean_landmarks(lm), scale)

    return made


def _balance(spark, d):
    """What is left of a shift and of a turn between the fitted landmarks and the target: nothing, if the fit is the best."""
    lm = views.landmarks(spark, d).drop("selected")
    target = features.mean_landmarks(lm)
    both = align.align(views.points(spark, d), lm, target)[1].join(target.select("lm_id", *[F.col(c).alias(f"t{c}") for c in _XYZ]), "lm_id")
    turn = {f"turn_{a}": F.covar_pop(b, f"t{c}") - F.covar_pop(c, f"t{b}") for a, b, c in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}
    shift = {f"shift_{c}": F.avg(F.col(c) - F.col(f"t{c}")) for c in _XYZ}
    return _out(both.groupBy("specimen_id").agg(*[e.alias(n) for n, e in (turn | shift).items()]), ["specimen_id"], [*turn, *shift])


def _gpa_balance(spark, d):
    """The mean's centre and size, and how far the mean of the shapes that are aligned to it lies from it, at its own size."""
    mean, aligned = align.procrustes(views.landmarks(spark, d).drop("selected"))
    own = features.mean_landmarks(aligned)
    size = own.agg(F.sqrt(sum((F.var_pop(c) for c in _XYZ), F.lit(0.0)) * F.count("*")).alias("k"))
    resized = own.crossJoin(F.broadcast(size)).select("lm_id", *[(F.col(c) / F.col("k")).alias(c) for c in _XYZ])
    off = _offset(mean, resized, "lm_id").agg(F.round(F.max("offset"), 4).alias("moved"))
    figures = mean.agg(F.count("*").alias("landmarks"), *[F.avg(c).alias(f"centre_{c}") for c in _XYZ], F.sqrt(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("size"))
    return _out(figures.crossJoin(off), ["landmarks"], ["centre_x", "centre_y", "centre_z", "size", "moved"])


def _kmeans_balance(spark, d):
    """Points and clusters, points for which another centroid is nearer, and how far centroids are from their points' means."""
    at, centres = segment.kmeans_colors(_sampled(spark, d), 5)
    own = at.join(_sampled(spark, d), ["specimen_id", "point_id"]).join(centres.select("cluster_id", *[F.col(c).alias(f"c{c}") for c in "rgb"]), "cluster_id")
    d2 = lambda c: sum(((F.col(x) - c(x)) * (F.col(x) - c(x)) for x in "rgb"), F.lit(0.0))
    every = centres.agg(F.collect_list(F.struct("r", "g", "b")).alias("all"))
    own = own.crossJoin(F.broadcast(every)).withColumn("least", F.array_min(F.transform("all", lambda m: d2(lambda x: m[x]))))
    farther = own.agg(F.count("*").alias("points"), F.countDistinct("cluster_id").alias("clusters"), F.sum((d2(lambda x: F.col(f"c{x}")) > F.col("least") + 1e-6).cast("long")).alias("farther"))
    shifted = own.groupBy("cluster_id").agg(F.greatest(*[F.abs(F.avg(x) - F.max(f"c{x}")) for x in "rgb"]).alias("off")).agg(F.max("off").alias("shifted"))
    return _out(farther.crossJoin(shifted), ["points", "clusters", "farther"], ["shifted"])


def _results_balance(results: DataFrame) -> DataFrame:
    """By point: its specimens, and how far mean and deviation are from those of the specimens' own values."""
    names = ("Magnitude Mean", "Magnitude SD")
    own = ~F.col("name").isin(*names)
    stats = results.groupBy("point_id").agg(F.count(F.when(own, 1)).alias("specimens"), F.avg(F.when(own, F.col("value"))).alias("mean"), F.stddev_pop(F.when(own, F.col("value"))).alias("sd"), *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"n{i}") for i, n in enumerate(names)])
    return _out(stats.withColumns({"mean_off": F.abs(F.col("mean") - F.col("n0")), "sd_off": F.abs(F.col("sd") - F.col("n1"))}), ["point_id", "specimens"], ["mean_off", "sd_off"])


def _atlas_landmarks(spark, d):
    """How far the atlas's points that are landmarks lie from its landmarks."""
    atlas = pipelines.make_atlas(_specimens(spark, d))
    own = atlas.points.select(F.col("point_id").alias("lm_id"), *_XYZ)
    return _out(_offset(own, atlas.landmarks, "lm_id"), ["lm_id"], ["offset"])


def _moved(points: DataFrame, rows: list[str]) -> DataFrame:
    """Points under a map of each specimen; rows: x, y and z of the image in terms of x, y, z and specimen_id."""
    return points.withColumns(dict(zip(_XYZ, map(F.expr, rows), strict=True)))


#: The mean mesh of all, once for each specimen, turned by 90 degrees about z, resized and shifted by specimen.
_SIMILAR = ["-y * (1 + specimen_id / 10) + specimen_id", "x * (1 + specimen_id / 10) - 2", "z * (1 + specimen_id / 10) + 0.5"]
#: The same bent, resized and shifted by specimen.
_BENT = ["(x + 0.1 * y * y) * (1 + specimen_id / 10) + specimen_id", "(y + 0.1 * x * z) * (1 + specimen_id / 10)", "(z - 0.05 * x * x) * (1 + specimen_id / 10) - 3"]
#: The same sheared and stretched by specimen.
_SHEARED = ["x * (1 + specimen_id / 10) + 0.2 * y", "y + 0.1 * z + specimen_id", "z * (1 - specimen_id / 20)"]


def _copies(spark, d, rows: list[str], textures: bool = False) -> tuple[pipelines.Specimens, pipelines.Atlas]:
    """A collection of copies of one mesh, each moved by its own map, with the textures and coordinates of the views; and that mesh as atlas."""
    s = _specimens(spark, d, textures)
    atlas = _plain_atlas(s)
    points = written(_moved(s.points.select("specimen_id", "point_id", "u", "v").join(atlas.points, "point_id"), rows), "copies")
    lm = points.where(F.col("point_id") <= views.LANDMARKS).select("specimen_id", F.col("point_id").alias("lm_id"), *_XYZ)
    images = texture.packed(views.texel(spark, d)) if textures else None
    return pipelines.Specimens(points, s.faces, lm, images=images), pipelines.Atlas(atlas.points, atlas.faces, atlas.points.where(F.col("point_id") <= views.LANDMARKS).withColumnRenamed("point_id", "lm_id"))


def _two_sided(spark, d) -> tuple[pipelines.Specimens, pipelines.Atlas]:
    """Copies of a mesh that is its own mirror image: the mean mesh beside itself with x the other way round.

    Of the points from n + 1 on each is the mirror image of the one n before; landmarks are the first four and theirs.
    """
    mean = _plain_atlas(_specimens(spark, d))
    n = mean.points.agg(F.max("point_id").alias("n"))
    right = mean.points.select("point_id", F.abs("x").alias("x"), "y", "z").crossJoin(F.broadcast(n))
    points = written(right.unionByName(right.withColumns({"point_id": F.col("point_id") + F.col("n"), "x": -F.col("x")})), "two-sided")
    faces = mean.faces.crossJoin(F.broadcast(n))
    other = faces.withColumns({k: F.col(k) + F.col("n") for k in ("face_id", "v0", "v1", "v2")})
    own = points.where((F.col("point_id") <= 4) | F.col("point_id").between(F.col("n") + 1, F.col("n") + 4))
    marks = own.select(F.when(F.col("point_id") <= 4, F.col("point_id")).otherwise(F.col("point_id") - F.col("n") + 4).cast("int").alias("lm_id"), *_XYZ)
    atlas = pipelines.Atlas(points.drop("n"), written(faces.unionByName(other).drop("n"), "two-sided"), marks)
    ids = spark.range(3).select(F.col("id").cast("int").alias("specimen_id"))
    each = lambda df: ids.crossJoin(df)
    return pipelines.Specimens(_moved(each(atlas.points), _SIMILAR), each(atlas.faces), _moved(each(marks), _SIMILAR)), atlas


def _shape_of_copies(spark, d):
    return _long(pipelines.shape(*_copies(spark, d, _SIMILAR))[0])


def _colors_of_copies(spark, d):
    return _out(pipelines.shape(*_copies(spark, d, _SIMILAR, True))[1], ["point_id"], ["r", "g", "b"])


def _symmetry_of_copies(spark, d):
    return _long(pipelines.symmetry(*_two_sided(spark, d), [4, 5, 6, 7, 0, 1, 2, 3], first=1))


def _dense_of_copies(spark, d):
    s, a = _copies(spark, d, _SHEARED)
    return _out(warp.dense_correspondence(s.points, s.faces, s.landmarks, a.points, a.landmarks, a.landmarks), ["specimen_id", "point_id"], _XYZ)


def _drift_of_copies(spark, d):
    s, a = _copies(spark, d, _BENT)
    found = drift.drift_correspondence(s.points, a.points, 0.0, tolerance=1e-6)
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("specimen_id", "point_id", "vertex_id")])


def _dense_landmarks_of_copies(spark, d):
    made = pipelines.dense_landmarks(*_copies(spark, d, _SIMILAR), 0.0)
    return made.select("specimen_id", F.col("lm_id").cast("long").alias("lm_id"), "label", *[_r(c).alias(c) for c in _XYZ])


def _surface_accuracy(spark, d):
    p, f = views.points(spark, d), views.faces(spark, d)
    return _out(accuracy.surface_distances(_queries_for_nearest(spark, d), f, p, f), ["specimen_id"], ["mean", "p95", "hausdorff", "mean_to", "p95_to", "greatest_to", "mean_from", "p95_from", "greatest_from"])


def _oriented(spark, d):
    made = segment.orient(views.points(spark, d), views.faces(spark, d))
    return made.select(*_long_keys(made, "specimen_id", "face_id", "v0", "v1", "v2", "component"), "flipped", "orientable")


_ORIENTED_SQL = _sql(
    f"{_S}, cast(v0 as bigint) as face_id, cast(v0 as bigint) as v0, cast(case when turn then v2 else v1 end as bigint) as v1, cast(case when turn then v1 else v2 end as bigint) as v2, 1::bigint as component, turn as flipped, true as orientable",
    """(select s, v0, v1, v2, (v0 % 2 = 0) <> (sum(case when v0 % 2 = 0 then -det else det end) over (partition by s) < 0) as turn from (
        select *, (ax-mx)*((b_y-my)*(cz-mz)-(bz-mz)*(cy-my)) - (ay-my)*((bx-mx)*(cz-mz)-(bz-mz)*(cx-mx)) + (az-mz)*((bx-mx)*(cy-my)-(b_y-my)*(cx-mx)) as det from (
            select *, avg((ax+bx+cx)/3) over (partition by s) as mx, avg((ay+b_y+cy)/3) over (partition by s) as my, avg((az+bz+cz)/3) over (partition by s) as mz from (
                select a.s as s, v0, v1, v2, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as b_y, b.z as bz, c.x as cx, c.y as cy, c.z as cz
                from face join pt a on a.pid = v0 join pt b on b.pid = v1 and b.s = a.s join pt c on c.pid = v2 and c.s = a.s))))""",
)


def _chain(source: str, *steps: str) -> str:
    """A table from steps that each read the one before, `_`; materialised, or their expressions would multiply."""
    named = [f"s0 as materialized (select * from {source})"]
    for i, step in enumerate(steps):
        named.append(f"s{i + 1} as materialized (select *, {step} from s{i})")
    return f"(with {', '.join(named)} select * from s{len(steps)})"


def _lab_steps(k: int, red: str, green: str, blue: str) -> list[str]:
    """L, A and B of the colours in three columns."""
    line = lambda c: f"case when {c}/255::double <= 0.04045 then {c}/255::double/12.92 else pow(({c}/255::double + 0.055)/1.055, 2.4) end"
    bend = lambda c: f"case when {c} > 216::double/24389 then cbrt({c}) else ({c}*24389::double/27 + 16)/116 end"
    return [
        f"{line(red)} as lr{k}, {line(green)} as lg{k}, {line(blue)} as lb{k}",
        f"(0.4124564*lr{k} + 0.3575761*lg{k} + 0.1804375*lb{k})/0.95047 as wx{k}, 0.2126729*lr{k} + 0.7151522*lg{k} + 0.0721750*lb{k} as wy{k}, (0.0193339*lr{k} + 0.1191920*lg{k} + 0.9503041*lb{k})/1.08883 as wz{k}",
        f"{bend(f'wx{k}')} as fx{k}, {bend(f'wy{k}')} as fy{k}, {bend(f'wz{k}')} as fz{k}",
        f"116*fy{k} - 16 as L{k}, 500*(fx{k} - fy{k}) as A{k}, 200*(fy{k} - fz{k}) as B{k}",
    ]


def _difference_sql(source: str) -> str:
    """source, which has the colours r, gr, b and mr, mg, mb, with their difference as `de`."""
    seven = lambda c: f"sqrt(pow({c}, 7)/(pow({c}, 7) + pow(25, 7)))"
    hue = lambda a, b: f"case when {a} = 0 and {b} = 0 then 0 else (degrees(atan2({b}, {a})) + 360) % 360 end"
    return _chain(
        source,
        *_lab_steps(1, "r", "gr", "b"),
        *_lab_steps(2, "mr", "mg", "mb"),
        f"1 + 0.5*(1 - {seven('((sqrt(A1*A1 + B1*B1) + sqrt(A2*A2 + B2*B2))/2)')}) as g",
        f"sqrt(g*A1*g*A1 + B1*B1) as c1, sqrt(g*A2*g*A2 + B2*B2) as c2, {hue('g*A1', 'B1')} as h1, {hue('g*A2', 'B2')} as h2",
        "case when c1*c2 = 0 then 0 when h2 - h1 > 180 then h2 - h1 - 360 when h2 - h1 < -180 then h2 - h1 + 360 else h2 - h1 end as dh, case when c1*c2 = 0 then h1 + h2 when abs(h2 - h1) <= 180 then (h1 + h2)/2 when h1 + h2 < 360 then (h1 + h2 + 360)/2 else (h1 + h2 - 360)/2 end as h, (L1 + L2)/2 as lm, (c1 + c2)/2 as cm",
        f"1 - 0.17*cos(radians(h - 30)) + 0.24*cos(radians(2*h)) + 0.32*cos(radians(3*h + 6)) - 0.2*cos(radians(4*h - 63)) as t, -2*{seven('cm')}*sin(radians(60*exp(-pow((h - 275)/25, 2)))) as rt",
        "(L2 - L1)/(1 + 0.015*pow(lm - 50, 2)/sqrt(20 + pow(lm - 50, 2))) as dl, (c2 - c1)/(1 + 0.045*cm) as dc, 2*sqrt(c1*c2)*sin(radians(dh/2))/(1 + 0.015*cm*t) as dhh",
        "sqrt(greatest(dl*dl + dc*dc + dhh*dhh + rt*dc*dhh, 0)) as de",
    )


_DIFFERENCES_SQL = _sql(f"{_S}, {_P}, {_f('de', 'difference')}", _difference_sql("(select rgb.s, rgb.pid, r, g as gr, b, mr, mg, mb from rgb join (select pid, avg(r) as mr, avg(g) as mg, avg(b) as mb from rgb group by pid) m on m.pid = rgb.pid)"))
_PAIRS_SQL = _sql(
    f"cast(s as bigint) as specimen_1, cast(s2 as bigint) as specimen_2, count(*) as points, {_f('avg(de)', 'mean')}, {_f('max(de)', 'greatest')}",
    _difference_sql("(select p.s, q.s as s2, p.r, p.g as gr, p.b, q.r as mr, q.g as mg, q.b as mb from rgb p join rgb q on p.pid = q.pid and p.s < q.s)") + " group by s, s2",
)


def _accuracy_sql() -> str:
    """Distances of vertices that are shifted to the surface, and of the surface's own vertices to the shifted one."""
    def one(shift: str) -> str:
        found = _surface_sql().replace("+ 0.05", shift).removeprefix(views.SQL)
        return f"(select f.specimen_id as s, sqrt(pow(q.x {shift} - f.x, 2) + pow(q.y - f.y, 2) + pow(q.z - f.z, 2)) as d from ({found}) f join pt q on q.s = f.specimen_id and q.pid = f.point_id)"

    whole = lambda e: e.replace("round(arg_min", "(arg_min").replace(", 6) + 0.0 as", ") as")
    figures = ", ".join(_f(f"{f} {w}", f"{n}{way}" if way or n != "greatest" else "hausdorff") for way, w in (("", ""), ("_to", "filter (way = 'to')"), ("_from", "filter (way = 'from')")) for n, f in (("mean", "avg(d)"), ("p95", "quantile_cont(d, 0.95)"), ("greatest", "max(d)")))
    return _sql(f"{_S}, {figures}", whole(f"(select s, d, 'to' as way from {one('+ 0.05')} union all select s, d, 'from' from {one('- 0.05')}) group by s"))


_RESULTS_SQL = _sql(f"{_P}, count(*) as specimens, 0.0::double as mean_off, 0.0::double as sd_off", "pt group by pid")
_NEXT = "sqrt(pow(p.x-n.x,2)+pow(p.y-n.y,2)+pow(p.z-n.z,2))"
_NEXT_FROM = "pt p join pt n on n.s = p.s and n.pid = p.pid + 1"
_CORNERS = "face join pt a on a.pid = v0 join pt b on b.pid = v1 and b.s = a.s join pt c on c.pid = v2 and c.s = a.s"


def _normals_sql() -> str:
    edges = ", ".join(f"{p}.{c} - a.{c} as {e}{c}" for p, e in (("b", "e"), ("c", "f")) for c in _XYZ)
    cross = ", ".join(f"e{b}*f{c} - e{c}*f{b} as n{a}" for a, b, c in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")))
    sums = f"(select s, pid, sum(nx) nx, sum(ny) ny, sum(nz) nz from (select s, unnest([v0, v1, v2]) as pid, {cross} from (select a.s as s, v0, v1, v2, {edges} from {_CORNERS})) group by s, pid)"
    length = "sqrt(nx*nx + ny*ny + nz*nz)"
    return _sql(f"{_S}, {_P}, " + ", ".join(_f(f"case when {length} > 0 then n{c} / {length} else 0 end", f"n{c}") for c in _XYZ), sums)


def _surface_sql() -> str:
    """The closest of the foot in a triangle's plane, where it lies inside, and of the closest points of its edges."""
    dot = lambda p, q: "(" + " + ".join(f"{p}{c}*{q}{c}" for c in _XYZ) + ")"
    minus = lambda p, q, n: ", ".join(f"{p}{c} - {q}{c} as {n}{c}" for c in _XYZ)
    corners = ", ".join(f"{p}.{c} as {n}{c}" for p, n in (("a", "k"), ("b", "l"), ("c", "m")) for c in _XYZ)
    pairs = f"(select q.s as s, q.pid as pid, q.x + 0.05 as qx, q.y as qy, q.z as qz, {corners} from pt q join pt a on a.s = q.s join face on v0 = a.pid join pt b on b.pid = v1 and b.s = q.s join pt c on c.pid = v2 and c.s = q.s)"
    edges = f"(select *, {minus('l', 'k', 'e')}, {minus('m', 'k', 'f')}, {minus('m', 'l', 'g')}, {minus('q', 'k', 'h')}, {minus('q', 'l', 'i')} from {pairs})"
    sums = f"(select *, {dot('e', 'e')} ee, {dot('e', 'f')} ef, {dot('f', 'f')} ff, {dot('h', 'e')} he, {dot('h', 'f')} hf, {dot('i', 'g')} ig, {dot('g', 'g')} gg from {edges})"
    feet = f"(select *, ee*ff - ef*ef as det, (ff*he - ef*hf) as v, (ee*hf - ef*he) as w from {sums})"
    held = lambda x: f"greatest(0, least(1, {x}))"
    on = lambda start, edge, t: "{" + ", ".join(f"'{c}': {start}{c} + ({t}) * {edge}{c}" for c in _XYZ) + "}"
    inside = "{" + ", ".join(f"'{c}': k{c} + v/det*e{c} + w/det*f{c}" for c in _XYZ) + "}"
    candidates = f"[{on('k', 'e', held('he/ee'))}, {on('k', 'f', held('hf/ff'))}, {on('l', 'g', held('ig/gg'))}, case when det > 0 and v >= 0 and w >= 0 and v + w <= det then {inside} end]"
    points = f"(select s, pid, qx, qy, qz, unnest({candidates}) as p from {feet})"
    far = "pow(p.x-qx,2)+pow(p.y-qy,2)+pow(p.z-qz,2)"
    return _sql(f"{_S}, {_P}, " + ", ".join(_f(f"arg_min(p.{c}, {far})", c) for c in _XYZ), f"{points} where p is not null group by s, pid")


def _subsample_sql() -> str:
    """Point after point, with those that have stayed so far."""
    gap = "(select s as gs, 0.04 * sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)+pow(max(z)-min(z),2)) as gap from pt group by s)"
    start = "select distinct s, 0::bigint as seen, []::struct(pid bigint, x double, y double, z double)[] as held from pt"
    near = "len([h for h in held if pow(h.x-pt.x,2)+pow(h.y-pt.y,2)+pow(h.z-pt.z,2) < gap*gap]) > 0"
    step = f"select steps.s, seen + 1, case when {near} then held else list_append(held, {{'pid': pt.pid::bigint, 'x': pt.x, 'y': pt.y, 'z': pt.z}}) end from steps join pt on pt.s = steps.s and pt.pid = seen + 1 join {gap} on gs = steps.s"
    last = "(select s, unnest(held) as h from steps join (select max(seen) as top from steps) on seen = top)"
    return views.SQL.replace("with raw as", "with recursive raw as", 1) + f", steps as ({start} union all {step}) select {_S}, h.pid as point_id, " + ", ".join(_f(f"h.{c}", c) for c in _XYZ) + f" from {last}"


#: name: (query, SQL or None)
REGISTERED: dict[str, tuple[Callable, str | None]] = {
    "mean_landmarks": (
        lambda s, d: _out(features.mean_landmarks(views.landmarks(s, d)), ["lm_id"], _XYZ),
        _sql(f"cast(pid as bigint) as lm_id, {_f('mx', 'x')}, {_f('my', 'y')}, {_f('mz', 'z')}", "mean"),
    ),
    "mean_mesh": (
        lambda s, d: _out(features.mean_mesh(views.points(s, d)), ["point_id"], _XYZ),
        _sql(f"{_P}, {_f('ax', 'x')}, {_f('ay', 'y')}, {_f('az', 'z')}", "atlas"),
    ),
    "shape_magnitude_long": (
        lambda s, d: _out(_magnitudes(s, d), ["specimen_id", "point_id"], ["distance"]),
        _sql(f"{_S}, {_P}, {_f(_DIST, 'distance')}", "pt join atlas using (pid)"),
    ),
    "shape_magnitude_stats": (
        lambda s, d: _out(features.spread(_magnitudes(s, d)), ["point_id"], ["magnitude_mean", "magnitude_sd"]),
        _sql(f"{_P}, {_f(f'avg({_DIST})', 'magnitude_mean')}, {_f(f'stddev_pop({_DIST})', 'magnitude_sd')}", "pt join atlas using (pid) group by pid"),
    ),
    "asymmetry_stats": (
        lambda s, d: _out(features.spread(_asymmetries(s, d)), ["point_id"], ["magnitude_mean", "magnitude_sd"]),
        _sql(f"{_P}, {_f('avg(abs(2*x))', 'magnitude_mean')}, {_f('stddev_pop(abs(2*x))', 'magnitude_sd')}", "pt group by pid"),
    ),
    "color_mean": (
        lambda s, d: _out(features.color_mean(_sampled(s, d)), ["point_id"], ["r", "g", "b"]),
        _sql(f"{_P}, {_f('avg(r)', 'r')}, {_f('avg(g)', 'g')}, {_f('avg(b)', 'b')}", "rgb group by pid"),
    ),
    "color_variance_pooled": (
        lambda s, d: _out(features.color_variance(_sampled(s, d)), ["point_id"], ["variance"]),
        _sql(f"{_P}, {_f('var_pop(c)', 'variance')}", "(select pid, r c from rgb union all select pid, g from rgb union all select pid, b from rgb) group by pid"),
    ),
    "color_variance_channels": (
        lambda s, d: _out(features.color_variance(_sampled(s, d), per_channel=True), ["point_id"], ["variance_r", "variance_g", "variance_b"]),
        _sql(f"{_P}, " + ", ".join(_f(f"var_pop({c})", f"variance_{c}") for c in "rgb"), "rgb group by pid"),
    ),
    "uv_sample_uchar": (
        lambda s, d: texture.encode(_gathered(s, d), "uchar-vector").select(F.col("specimen_id").cast("long").alias("specimen_id"), F.col("point_id").cast("long").alias("point_id"), *[F.col("rgb")[i].cast("long").alias(c) for i, c in enumerate("rgb")]),
        _sql(f"{_S}, {_P}, cast(r as bigint) as r, cast(g as bigint) as g, cast(b as bigint) as b", "rgb"),
    ),
    "uv_sample_float": (
        lambda s, d: texture.encode(_gathered(s, d), "float-vector").select(F.col("specimen_id").cast("long").alias("specimen_id"), F.col("point_id").cast("long").alias("point_id"), *[_r(F.col("color")[i]).alias(c) for i, c in enumerate("rgb")]),
        _sql(f"{_S}, {_P}, " + ", ".join(_f(f"{c} / cast(255 as double)", c) for c in "rgb"), "rgb"),
    ),
    "uv_sample_components": (
        lambda s, d: _out(texture.encode(_gathered(s, d), "float-components"), ["specimen_id", "point_id"], ["color_red", "color_green", "color_blue"]),
        _sql(f"{_S}, {_P}, cast(r as double) as color_red, cast(g as double) as color_green, cast(b as double) as color_blue", "rgb"),
    ),
    "flip_image": (
        lambda s, d: texture.flip(views.texel(s, d)).select(*[F.col(c).cast("long").alias(c) for c in ("specimen_id", "row", "col", "r", "g", "b")]),
        _sql(f"{_S}, cast(15 - row as bigint) as row, cast(col as bigint) as col, cast(r as bigint) as r, cast(g as bigint) as g, cast(b as bigint) as b", "texel"),
    ),
    "uniform_scale": (
        lambda s, d: _out(affine.uniform_scale(views.points(s, d), 2.5), ["specimen_id", "point_id"], _XYZ),
        _sql(f"{_S}, {_P}, " + ", ".join(_f(f"{c} * cast(2.5 as double)", c) for c in _XYZ), "pt"),
    ),
    "mirror_points": (
        lambda s, d: _out(affine.mirror(views.points(s, d)), ["specimen_id", "point_id"], _XYZ),
        _sql(f"{_S}, {_P}, {_f('-x', 'x')}, {_f('y', 'y')}, {_f('z', 'z')}", "pt"),
    ),
    "apply_affine": (
        lambda s, d: _out(_affine(s, d), ["specimen_id", "point_id"], _XYZ),
        _sql(f"{_S}, {_P}, {_f('1 - 2 * y', 'x')}, {_f('2 * x + 2', 'y')}, {_f('2 * z + 3', 'z')}", "pt"),
    ),
    "landmark_reorder": (
        lambda s, d: _out(affine.reorder(views.landmarks(s, d), MIRROR_INDEX, first=1), ["specimen_id", "lm_id"], _XYZ),
        _sql(f"{_S}, cast(case when pid % 2 = 1 then pid + 1 else pid - 1 end as bigint) as lm_id, " + ", ".join(_f(c, c) for c in _XYZ), "lm"),
    ),
    "procrustes_distance_to_mean": (
        lambda s, d: _out(_to_mean(s, d), ["specimen_id"], ["distance"]),
        _sql(f"{_S}, {_f('d', 'distance')}", _TO_MEAN),
    ),
    "closest_to_mean": (
        lambda s, d: _out(features.closest(_to_mean(s, d)), ["specimen_id"], ["distance"]),
        _sql(f"{_S}, {_f('d', 'distance')}", f"{_TO_MEAN} order by d, s limit 1"),
    ),
    "outlier_report": (
        lambda s, d: features.outliers(_to_mean(s, d)).select(F.col("specimen_id").cast("long").alias("specimen_id"), _r("distance").alias("distance"), _r("z").alias("z"), "outlier"),
        _sql(f"{_S}, {_f('d', 'distance')}, {_f('z', 'z')}, z > 1 as outlier", f"(select s, d, (d - avg(d) over ()) / stddev_pop(d) over () z from {_TO_MEAN})"),
    ),
    "nearest_vertex": (
        lambda s, d: warp.nearest_vertex(_queries_for_nearest(s, d), views.points(s, d)).select(*[F.col(c).cast("long").alias(c) for c in ("specimen_id", "point_id", "vertex_id")]),
        _sql("cast(q.s as bigint) as specimen_id, cast(q.pid as bigint) as point_id, cast(arg_min(p.pid, pow(q.x+0.05-p.x,2)+pow(q.y-p.y,2)+pow(q.z-p.z,2)) as bigint) as vertex_id", "pt q join pt p on q.s = p.s group by q.s, q.pid"),
    ),
    "nearest_vertex_color": (
        lambda s, d: warp.transfer_colors(_queries_for_nearest(s, d), views.points(s, d), _sampled(s, d)).select(*[F.col(c).cast("long").alias(c) for c in ("specimen_id", "point_id", "r", "g", "b")]),
        _sql(
            "cast(n.s as bigint) as specimen_id, cast(n.pid as bigint) as point_id, cast(r as bigint) as r, cast(g as bigint) as g, cast(b as bigint) as b",
            "(select q.s, q.pid, arg_min(p.pid, pow(q.x+0.05-p.x,2)+pow(q.y-p.y,2)+pow(q.z-p.z,2)) vid from pt q join pt p on q.s = p.s group by q.s, q.pid) n join rgb on rgb.s = n.s and rgb.pid = n.vid",
        ),
    ),
    "dense_landmark_gather": (
        lambda s, d: _out(segment.gather(views.points(s, d), views.points(s, d).where("point_id % 3 = 0"), first=1), ["specimen_id", "lm_id"], _XYZ),
        _sql(f"{_S}, cast(pid / 3 as bigint) as lm_id, " + ", ".join(_f(c, c) for c in _XYZ), "pt where pid % 3 = 0"),
    ),
    "subset_landmarks": (
        lambda s, d: segment.subset_landmarks(views.landmarks(s, d), views.landmarks(s, d).where("specimen_id = 0"), first=1).select(F.col("specimen_id").cast("long").alias("specimen_id"), F.col("lm_id").cast("long").alias("lm_id"), "label", *[_r(c).alias(c) for c in _XYZ]),
        _sql(f"{_S}, cast(pid / 2 as bigint) as lm_id, cast(cast(pid / 2 as bigint) as varchar) as label, " + ", ".join(_f(c, c) for c in _XYZ), "lm where pid % 2 = 0"),
    ),
    "cluster_faces": (
        lambda s, d: _kept_once(s, d).groupBy("cluster_id").agg(F.count("*").alias("n_faces")),
        _sql("cast(c as bigint) as cluster_id, count(*) as n_faces", "kept group by c"),
    ),
    "cluster_reindex": (
        lambda s, d: segment.reindex(_kept_once(s, d).withColumn("specimen_id", F.lit(0)), first=1).select(*[F.col(c).cast("long").alias(c) for c in ("cluster_id", "point_id", "new_id")]),
        _sql("cast(c as bigint) as cluster_id, cast(vid as bigint) as point_id, row_number() over (partition by c order by vid) as new_id", "vert"),
    ),
    "child_mesh_points": (
        lambda s, d: segment.child_meshes(views.points(s, d), views.faces(s, d), views.assignment(s, d))[0].select(F.col("specimen_id").cast("long").alias("specimen_id"), "name", (F.col("point_id") + 1).cast("long").alias("point_id"), *[_r(c).alias(c) for c in _XYZ]),
        _sql(f"{_S}, 'Cluster_' || cast(c as bigint) as name, rn as point_id, " + ", ".join(_f(c, c) for c in _XYZ), "(select c, vid, row_number() over (partition by c order by vid) rn from vert) v join pt on pt.pid = v.vid"),
    ),
    "distance_matrix": (
        lambda s, d: _out(features.distance_matrix(features.mean_mesh(views.points(s, d))), ["i", "j"], ["distance"]),
        _sql(f"cast(a.pid as bigint) as i, cast(b.pid as bigint) as j, {_f('sqrt(pow(a.ax-b.ax,2)+pow(a.ay-b.ay,2)+pow(a.az-b.az,2))', 'distance')}", "atlas a cross join atlas b"),
    ),
    "pivot_magnitudes": (
        _pivot,
        _sql(f"{_P}, {_f(f'avg({_DIST})', 'magnitude_mean')}, {_f(f'stddev_pop({_DIST})', 'magnitude_sd')}, {_f(f'max({_DIST}) filter (s = 0)', 'specimen_0')}, {_f(f'max({_DIST}) filter (s = 1)', 'specimen_1')}", "pt join atlas using (pid) group by pid"),
    ),
    "pivot_magnitudes_all": (_pivot_all, None),
    "result_names": (
        lambda s, d: features.result_names(features.point_results(_magnitudes(s, d))),
        _sql("distinct name", "(select cast(s as varchar) as name from pt union all select 'Magnitude Mean' union all select 'Magnitude SD')"),
    ),
    "heat_map": (
        lambda s, d: features.select_result(features.point_results(_magnitudes(s, d)), "Magnitude Mean").select(F.col("point_id").cast("long").alias("point_id"), _r("value").alias("value")),
        _sql(f"{_P}, {_f(f'avg({_DIST})', 'value')}", "pt join atlas using (pid) group by pid"),
    ),
    "specimen_ordinals": (
        lambda s, d: features.ordinals(views.points(s, d)).select(*[F.col(c).cast("long").alias(c) for c in ("specimen_id", "ord")]),
        _sql(f"{_S}, row_number() over (order by s) - 1 as ord", "(select distinct s from pt)"),
    ),
    "rigid_align": (_aligned(False), None),
    "similarity_align": (_aligned(True), None),
    "gpa_mean": (_gpa, None),
    "tps_warp": (_warped, None),
    "closest_surface": (lambda s, d: _out(warp.closest_surface(_queries_for_nearest(s, d), views.points(s, d), views.faces(s, d)), ["specimen_id", "point_id", "face_id"], _XYZ), None),
    "dense_correspondence": (_dense, None),
    "point_normals": (lambda s, d: _out(segment.normals(views.points(s, d), views.faces(s, d)), ["specimen_id", "point_id"], ["nx", "ny", "nz"]), _normals_sql()),
    "subsample_points": (lambda s, d: _out(segment.subsample(views.points(s, d)), ["specimen_id", "point_id"], _XYZ), _subsample_sql()),
    "closest_surface_points": (
        lambda s, d: _out(warp.closest_surface(_queries_for_nearest(s, d), views.points(s, d), views.faces(s, d)), ["specimen_id", "point_id"], _XYZ),
        _surface_sql(),
    ),
    "rigid_align_lengths": (lambda s, d: _lengths(_aligned_points(False)(s, d)[0]), _sql(f"cast(p.s as bigint) as specimen_id, cast(p.pid as bigint) as point_id, {_f(_NEXT, 'length')}", _NEXT_FROM)),
    "rigid_align_balance": (_balance, _sql(f"distinct {_S}, " + ", ".join(f"0.0::double as {k}_{c}" for k in ("turn", "shift") for c in _XYZ), "pt")),
    "similarity_align_lengths": (
        lambda s, d: _lengths(_aligned_points(True)(s, d)[0]),
        _sql(
            f"cast(p.s as bigint) as specimen_id, cast(p.pid as bigint) as point_id, {_f(f'{_NEXT} * k', 'length')}",
            f"{_NEXT_FROM} join (select s as ks, sqrt(goal / (var_pop(x) + var_pop(y) + var_pop(z))) as k from lm cross join (select var_pop(mx) + var_pop(my) + var_pop(mz) as goal from mean) group by s, goal) on ks = p.s",
        ),
    ),
    "gpa_mean_balance": (_gpa_balance, _sql("count(*) as landmarks, 0.0::double as centre_x, 0.0::double as centre_y, 0.0::double as centre_z, 1.0::double as size, 0.0::double as moved", "mean")),
    "tps_warp_landmarks": (
        lambda s, d: _warped(s, d).where(F.col("point_id") <= views.LANDMARKS),
        _sql(f"{_S}, {_P}, {_f('mx', 'x')}, {_f('my', 'y')}, {_f('mz', 'z')}", "lm join mean using (pid)"),
    ),
    "dense_correspondence_landmarks": (lambda s, d: _dense(s, d).where(F.col("point_id") <= views.LANDMARKS), _sql(f"{_S}, {_P}, " + ", ".join(_f(c, c) for c in _XYZ), "lm")),
    "kmeans_segment_balance": (_kmeans_balance, _sql("count(*) as points, least(5, count(distinct (r, g, b))) as clusters, 0::bigint as farther, 0.0::double as shifted", "rgb")),
    "shape_pipeline_balance": (_workflow(lambda s, a: _results_balance(pipelines.shape(s, a)[0])), _RESULTS_SQL),
    "symmetry_pipeline_balance": (_workflow(lambda s, a: _results_balance(pipelines.symmetry(s, a, MIRROR_INDEX, first=1))), _RESULTS_SQL),
    "atlas_pipeline_landmarks": (_atlas_landmarks, _sql("cast(pid as bigint) as lm_id, 0.0::double as \"offset\"", "mean")),
    "kmeans_segment": (_kmeans, None),
    "atlas_pipeline": (lambda s, d: _out(pipelines.make_atlas(_specimens(s, d)).points, ["point_id"], _XYZ), None),
    "shape_pipeline": (_workflow(lambda s, a: _long(pipelines.shape(s, a)[0])), None),
    "shape_color_pipeline": (_workflow(lambda s, a: _out(pipelines.shape(s, a)[1], ["point_id"], ["r", "g", "b"]), textures=True), None),
    "symmetry_pipeline": (_workflow(lambda s, a: _long(pipelines.symmetry(s, a, MIRROR_INDEX, first=1))), None),
    "dense_landmarks_pipeline": (_workflow(lambda s, a: pipelines.dense_landmarks(s, a, 10.0).select("specimen_id", F.col("lm_id").cast("long").alias("lm_id"), *[_r(c).alias(c) for c in _XYZ])), None),
}


_NUMBERS = "cast(pid as bigint) as point_id, name, 0.0::double as value"
_COPY = [r.replace("specimen_id", "cast(s as double)") for r in _SHEARED]
REGISTERED |= {
    # copies of one mesh: their correspondence is known
    "shape_pipeline_copies": (_shape_of_copies, _sql(_NUMBERS, "atlas cross join (select distinct cast(s as varchar) as name from pt union all select 'Magnitude Mean' union all select 'Magnitude SD')")),
    "shape_color_copies": (_colors_of_copies, _sql(f"{_P}, {_f('avg(r)', 'r')}, {_f('avg(g)', 'g')}, {_f('avg(b)', 'b')}", "rgb group by pid")),
    "symmetry_pipeline_copies": (_symmetry_of_copies, _sql(_NUMBERS, "(select pid from atlas union all select pid + (select n from m) from atlas) cross join (select unnest(['0', '1', '2', 'Magnitude Mean', 'Magnitude SD']) as name)")),
    "dense_correspondence_copies": (
        _dense_of_copies,
        _sql(f"{_S}, {_P}, " + ", ".join(_f(r, c) for r, c in zip(_COPY, _XYZ, strict=True)), "(select s, pid, ax as x, ay as y, az as z from (select distinct s from pt) cross join atlas)"),
    ),
    "drift_copies": (_drift_of_copies, _sql(f"{_S}, {_P}, cast(pid as bigint) as vertex_id", "(select distinct s from pt) cross join atlas")),
    "dense_landmarks_copies": (
        _dense_landmarks_of_copies,
        _sql(f"specimen_id, cast(pid - 1 as bigint) as lm_id, cast(cast(pid - 1 as bigint) as varchar) as label, {_f('ax', 'x')}, {_f('ay', 'y')}, {_f('az', 'z')}", "atlas cross join (select distinct cast(s as varchar) as specimen_id from pt union all select 'atlas')"),
    ),
    "child_mesh_faces": (
        lambda s, d: segment.child_meshes(views.points(s, d), views.faces(s, d), views.assignment(s, d))[1].select(*[F.col(c).cast("long").alias(c) for c in ("specimen_id", "cluster_id", "face_id", "v0", "v1", "v2")]),
        _sql(
            f"{_S}, cast(kept.c as bigint) as cluster_id, cast(kept.v0 as bigint) as face_id, i.rn - 1 as v0, j.rn - 1 as v1, k.rn - 1 as v2",
            "(select distinct s from pt) cross join kept " + " ".join(f"join (select c, vid, row_number() over (partition by c order by vid) rn from vert) {t} on {t}.c = kept.c and {t}.vid = kept.{v}" for t, v in (("i", "v0"), ("j", "v1"), ("k", "v2"))),
        ),
    ),
    "oriented_faces": (_oriented, _ORIENTED_SQL),
    "color_differences": (lambda s, d: _out(colors.differences_to_mean(_gathered(s, d)), ["specimen_id", "point_id"], ["difference"]), _DIFFERENCES_SQL),
    "color_differences_pairs": (lambda s, d: _out(colors.differences_of_pairs(_gathered(s, d)), ["specimen_1", "specimen_2", "points"], ["mean", "greatest"]), _PAIRS_SQL),
    "surface_accuracy": (_surface_accuracy, _accuracy_sql()),
    "landmark_accuracy": (lambda s, d: _out(accuracy.landmark_errors(views.landmarks(s, d), features.mean_landmarks(views.landmarks(s, d))), ["specimen_id", "lm_id"], ["error"]), None),
}


def queries() -> dict[str, Callable]:
    return {name: q for name, (q, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
