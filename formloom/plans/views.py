"""Meshes, landmarks and textures derived from the table `embeddings`, the same in Spark and in SQL.

A specimen is a label; each has as many points as the label with the fewest vectors. Ids count from 1 here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL = """
with raw as (select label s, row_number() over (partition by label order by vec_id) pid,
                    cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z,
                    0.5 + 2 * cast(embedding[4] as double) u, 0.5 + 2 * cast(embedding[5] as double) v from embeddings),
 m     as (select min(c) n from (select label, count(*) c from embeddings group by label)),
 pt    as (select raw.* from raw cross join m where pid <= n),
 atlas as (select pid, avg(x) ax, avg(y) ay, avg(z) az from pt group by pid),
 texel as (select s, row, col, (row*31+col*17+s*7)%256 r, (row*13+col*29+s*11)%256 g, (row*7+col*3+s*19)%256 b
             from (select distinct label s from embeddings)
             cross join (select range as row from range(16)) cross join (select range as col from range(16))),
 px    as (select s, pid, cast(floor(least(greatest(u,cast(0 as double)),cast(1 as double))*15) as int) col,
                  15-cast(floor(least(greatest(v,cast(0 as double)),cast(1 as double))*15) as int) row from pt),
 rgb   as (select px.s, pid, r, g, b from px join texel on px.s=texel.s and px.row=texel.row and px.col=texel.col),
 face  as (select pid v0, pid+1 v1, pid+2 v2 from atlas where pid+2 <= (select n from m)),
 kept  as (select floor(v0/10) c, v0, v1, v2 from face where floor(v0/10)=floor(v1/10) and floor(v1/10)=floor(v2/10)),
 vert  as (select distinct c, vid from (select c, v0 vid from kept union all select c, v1 from kept union all select c, v2 from kept) q),
 lm    as (select * from pt where pid <= 8), mean as (select pid, avg(x) mx, avg(y) my, avg(z) mz from lm group by pid)
"""
LANDMARKS = 8


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(specimen_id, point_id, x, y, z, u, v)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.col("embedding")[i].cast("double")
    raw = e.select(
        F.col("label").alias("specimen_id"),
        F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("point_id"),
        *[at(i).alias(c) for i, c in enumerate("xyz")],
        (0.5 + 2 * at(3)).alias("u"),
        (0.5 + 2 * at(4)).alias("v"),
    )
    n = e.groupBy("label").agg(F.count("*").alias("c")).agg(F.min("c").alias("n"))
    return raw.crossJoin(F.broadcast(n)).where("point_id <= n").drop("n")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(specimen_id, face_id, v0, v1, v2): strips of three points in succession."""
    p = points(spark, sf_dir).select("specimen_id", "point_id")
    n = p.groupBy("specimen_id").agg(F.max("point_id").alias("n"))
    return p.join(n, "specimen_id").where("point_id + 2 <= n").select("specimen_id", F.col("point_id").alias("face_id"), F.col("point_id").alias("v0"), (F.col("point_id") + 1).alias("v1"), (F.col("point_id") + 2).alias("v2"))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(specimen_id, lm_id, x, y, z, selected): the first points; every other one is selected."""
    p = points(spark, sf_dir).where(F.col("point_id") <= LANDMARKS)
    return p.select("specimen_id", F.col("point_id").alias("lm_id"), "x", "y", "z", (F.col("point_id") % 2 == 0).alias("selected"))


def texel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(specimen_id, row, col, r, g, b): a texture of 16 x 16 for each specimen."""
    s = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("specimen_id")).distinct()
    grid = s.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(15))))
    c = lambda a, b, k: ((F.col("row") * a + F.col("col") * b + F.col("specimen_id") * k) % 256).cast("int")
    return grid.select("specimen_id", "row", "col", c(31, 17, 7).alias("r"), c(13, 29, 11).alias("g"), c(7, 3, 19).alias("b"))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(specimen_id, point_id, cluster_id): ten points in succession are a cluster."""
    return points(spark, sf_dir).select("specimen_id", "point_id", F.floor(F.col("point_id") / 10).alias("cluster_id"))
