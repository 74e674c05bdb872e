"""From folders to results: specimens and atlases read from files, workflows run, and what they make written."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions.tables import scope, written
from formloom.operators import affine, segment
from formloom.plans import pipelines
from formloom.sources import files, landmarks, mesh, sinks

log = logging.getLogger("formloom")
WORKFLOWS = ("atlas", "shape", "symmetry", "dense_landmarks")


def read_specimens(spark: SparkSession, models: str, marks: str, textures: str | None = None) -> pipelines.Specimens:
    """The specimens of a folder of models and one of landmarks, by file name; with textures where there is a folder of them.

    Files that can't be read, and specimens that lack models or landmarks, are logged and left out. Models are parsed once.
    """
    found = mesh.scan(spark, models)
    for r in mesh.errors_of(found).toLocalIterator():
        log.warning("%s can't be read: %s", r["path"], r["error"])
    images = None if textures is None else landmarks.read_images(spark, textures)
    s = pipelines.Specimens(mesh.points_of(found), mesh.faces_of(found), written(landmarks.read_landmarks(spark, marks), "landmarks"), images=images)
    lacking = pipelines.unpaired(s).collect()  # a row for each specimen without one or the other
    for r in lacking:
        log.warning("specimen %s lacks %s", r["specimen_id"], r["missing"])
    if lacking:
        both = s.points.select("specimen_id").distinct().join(s.landmarks.select("specimen_id").distinct(), "specimen_id")
        s.points, s.faces, s.landmarks = (df.join(both, "specimen_id", "left_semi") for df in (s.points, s.faces, s.landmarks))
    return s


def read_atlas(spark: SparkSession, model: str, marks: str) -> pipelines.Atlas:
    """The atlas of a model's file and a landmark file; an error if there isn't just one model, or if there are no landmarks."""
    found, own = mesh.scan(spark, model), written(landmarks.read_landmarks(spark, marks), "landmarks")
    for r in mesh.errors_of(found).collect():
        raise ValueError(f"{r['path']} can't be read: {r['error']}")
    models = [r.path for r in mesh.points_and_paths(found).collect()]
    sets = [r.specimen_id for r in own.select("specimen_id").distinct().limit(2).collect()]
    if len(models) != 1 or len(sets) != 1:
        raise ValueError(f"an atlas is one model and one set of landmarks; {model} has the models {models}, {marks} the sets {sets}")
    return pipelines.Atlas(mesh.points_of(found).drop("specimen_id"), mesh.faces_of(found).drop("specimen_id"), own.select("lm_id", "x", "y", "z"))


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("specimen_id", F.lit(name))


def _labelled(marks: DataFrame) -> DataFrame:
    return marks if "label" in marks.columns else marks.withColumn("label", F.col("lm_id").cast("string"))


def write_atlas(atlas: pipelines.Atlas, run: str) -> None:
    """The atlas's tables, and its model and landmarks as files that read_atlas takes: run/atlas/model/atlas.ply, run/atlas/landmarks/atlas.mrk.json."""
    for table in ("points", "faces", "landmarks"):
        sinks.write_stage(getattr(atlas, table), run, table, "atlas")
    files.write_meshes(_named(atlas.points, "atlas"), _named(atlas.faces, "atlas"), f"{run}/atlas/model")
    files.write_named(sinks.markups_json(_labelled(_named(atlas.landmarks, "atlas"))), f"{run}/atlas/landmarks", ".mrk.json")


def _write_specimens(points: DataFrame, faces: DataFrame, marks: DataFrame, run: str, stage: str) -> None:
    """Meshes and landmarks of a stage as tables, and as files named by their specimens: run/<stage>/models, run/<stage>/landmarks."""
    for table, df in (("points", points), ("faces", faces), ("landmarks", marks)):
        sinks.write_stage(df, run, table, stage)
    files.write_meshes(points, faces, f"{run}/{stage}/models")
    files.write_named(sinks.markups_json(_labelled(marks)), f"{run}/{stage}/landmarks", ".mrk.json")


def _write_results(results: DataFrame, atlas: pipelines.Atlas, run: str, stage: str) -> None:
    """Point results in long form, and, from what has been written, the atlas with an array for each of them as polydata."""
    from formloom.operators import features

    sinks.write_stage(results, run, "results", stage)
    long = results.sparkSession.read.parquet(f"{run}/results/stage={stage}")
    names = tuple(sorted(r["name"] for r in features.result_names(long).collect()))
    # one array of values a point, in the order of their names, so that the number of specimens is not one of columns
    values = long.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("r")).select("point_id", F.col("r.value").alias("values"))
    files.write_meshes(_named(atlas.points.join(values, "point_id"), stage), _named(atlas.faces, stage), f"{run}/{stage}/results", "vtp", names, "values")


def _write_check(stages: dict[str, DataFrame], faces: DataFrame, atlas: pipelines.Atlas, run: str) -> None:
    """The warped meshes to judge the correspondence by."""
    if "subjects" not in stages:
        return
    sinks.write_stage(stages["subjects"], run, "correspondence", "subjects")
    sinks.write_stage(stages["base"], run, "correspondence", "base")
    files.write_meshes(stages["subjects"], faces, f"{run}/correspondence/models")
    files.write_meshes(_named(stages["base"], "base"), _named(atlas.faces, "base"), f"{run}/correspondence/models")


def run(spark: SparkSession, workflow: str, root: str, models: str, marks: str, textures: str | None = None, atlas: pipelines.Atlas | None = None, index: Sequence[int] = (), percent: float = 4.0) -> str:
    """Runs a workflow over folders and writes all that it makes; the folder of the run is returned.

    workflow: atlas, shape, symmetry or dense_landmarks; without an atlas one is made first, and written as well. Beside its
    results, a workflow writes the aligned specimens, mirrored ones if there are, and the warped meshes that correspondence
    was found on. Tables that it makes on the way are deleted at its end, whether it succeeds or fails.
    """
    if workflow not in WORKFLOWS:
        raise ValueError(f"there is no workflow {workflow!r}; there are {WORKFLOWS}")
    if workflow == "symmetry" and not index:
        raise ValueError("symmetry needs the order of mirrored landmarks (index)")
    folder = f"{sinks.run_folder(root)}-{uuid.uuid4().hex[:8]}"
    log.info("%s of %s to %s", workflow, models, folder)
    with scope(spark):
        s = read_specimens(spark, models, marks, textures)
        pipelines.check(s, textures is not None)
        if atlas is None:
            atlas = pipelines.make_atlas(s)
            write_atlas(atlas, folder)
            _write_specimens(s.stages["aligned_points"], s.faces, s.stages["aligned_landmarks"], folder, "align" if workflow == "atlas" else "align-atlas")
            _write_check(s.stages, s.faces, atlas, f"{folder}/atlas")
        if workflow == "shape":
            results, mean, variance = pipelines.shape(s, atlas)
            _write_results(results, atlas, folder, "shape")
            if mean is not None and variance is not None:
                sinks.write_stage(mean, folder, "colors", "mean")
                sinks.write_stage(variance, folder, "colors", "variance")
        elif workflow == "symmetry":
            _write_results(pipelines.symmetry(s, atlas, index), atlas, folder, "symmetry")
            faces = affine.rewind(s.faces)
            _write_specimens(s.stages["mirrored_points"], faces, s.stages["mirrored_landmarks"], folder, "mirror")
            sinks.write_stage(segment.normals(s.stages["mirrored_points"], faces), folder, "normals", "mirror")
        elif workflow == "dense_landmarks":
            made = written(pipelines.dense_landmarks(s, atlas, percent), "dense-landmarks")
            sinks.write_stage(made, folder, "landmarks", "dense")
            files.write_named(sinks.markups_json(made), f"{folder}/dense_landmarks", ".mrk.json")
        if workflow != "atlas":
            _write_specimens(s.stages["aligned_points"], s.faces, s.stages["aligned_landmarks"], folder, "align")
            _write_check(s.stages, s.faces, atlas, folder)
    log.info("%s is done", folder)
    return folder


def subset(spark: SparkSession, root: str, marks: str, base: str) -> str:
    """Landmark files with the landmarks that are selected in the file `base`, numbered and labelled anew; the folder is returned."""
    folder = f"{sinks.run_folder(root)}-{uuid.uuid4().hex[:8]}"
    with scope(spark):
        chosen = written(landmarks.read_landmarks(spark, base), "landmarks")
        if chosen.where("selected").limit(1).count() == 0:
            raise ValueError(f"no landmark is selected in {base}")
        made = written(segment.subset_landmarks(landmarks.read_landmarks(spark, marks), chosen), "subset")
        sinks.write_stage(made, folder, "landmarks", "subset")
        files.write_named(sinks.markups_json(made), f"{folder}/subset", ".mrk.json")
    return folder
