"""Uniform shuffle into shards of exact sizes, in DataFrame operations only.

How many rows go from each partition of the input to each shard is drawn first: a matrix whose rows sum up to the
partitions' counts and whose columns to the shards' sizes, row after row from the multivariate hypergeometric law, as in
a uniform permutation of all rows. Each partition permutes its rows by a hash and deals them out by its row of the
matrix, the rows are exchanged, and each shard permutes what it got. Only counts reach the driver.

The local permutation is a sort within the input's own partitions, without an exchange. Its result, each row with its
partition and place, is written once, and counting and dealing both read that table: whatever the input's splits, or the
executors, do between two jobs, a row has one place. A shard's rows are ordered in blocks by their hash's first bits, so
that a shard of any size is many tasks' work; counts of the blocks give each its first slot.

The law is `rows`: the shards' counts are at most one apart. Hashes are of a row's place, so repeated rows, or ids, of any
number are dealt like all others, and no group is kept together.

Defined results: null and empty texts and null ids are rows like others; an empty table gives an empty table; fewer rows
than shards leave some shards empty; columns stay as they are, but those named shard or slot are replaced.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm._shared import new_folder, text_of, written

SHARDS = 24
SEED = 20_000
#: Rows in a block of a shard, about.
BLOCK_ROWS = 8192
#: Rows of the matrix that are written at a time, and those up to which it goes to the rows by broadcast.
MATRIX_ROWS, MOST_BROADCAST = 2048, 50_000
#: Bits of a row's place in its partition; the partition's number stands above them.
PLACE_BITS = 33


def matrix(counts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows to go from each partition to each shard; shards' sizes are at most one apart."""
    total, draw = sum(counts), np.random.default_rng(seed)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        out[p] = left if n == left.sum() else draw.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[p]
    return out


def _permuted(df: DataFrame, seed: int) -> DataFrame:
    """(r, part, place): df's rows, permuted within its partitions. It is read from a table, and so never changes."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(None).cast("int")
    held = df.select(row.alias("r"), F.monotonically_increasing_id().alias("from")).withColumn("by", F.xxhash64("from", F.lit(seed)))
    placed = held.sortWithinPartitions("by", "from").select("r", F.monotonically_increasing_id().alias("at"))
    return written(placed.select("r", F.shiftright("at", PLACE_BITS).alias("part"), F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).alias("place")), "op8-permuted")


def _written_matrix(spark: SparkSession, counts: list[tuple[int, int]], shards: int, seed: int) -> DataFrame:
    """(part, n, upto): a partition's rows, and the places below which they go to the first shard, the first two, and so on."""
    path, schema = new_folder(spark, "op8-matrix"), "part long, n long, upto array<long>"
    listed = F.lit("array<struct<part:long,n:long,upto:array<long>>>")
    upto = np.cumsum(matrix([n for _, n in counts], shards, seed), axis=1)
    for i in range(0, max(1, len(counts)), MATRIX_ROWS):
        some = [{"part": p, "n": n, "upto": u} for (p, n), u in zip(counts[i : i + MATRIX_ROWS], upto[i : i + MATRIX_ROWS].tolist(), strict=True)]
        spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(some)), listed))).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with `shard` and `slot`, the place in the shard, gapless from 0."""
    df = df.drop("shard", "slot")
    rows = _permuted(df, seed)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    plan = _written_matrix(df.sparkSession, counts, shards, seed)
    plan = F.broadcast(plan) if len(counts) <= MOST_BROADCAST else plan
    blocks = max(1, -(-sum(n for _, n in counts) // (shards * block_rows)))

    def dealt(some: DataFrame) -> DataFrame:
        # a row without a place in the matrix is an error, and never left out
        known = F.col("n").isNotNull() & (F.col("place") < F.col("n"))
        shard = F.when(known, F.size(F.filter("upto", lambda c: c <= F.col("place")))).otherwise(F.raise_error(F.lit("a row has no place in the matrix")))
        second = F.xxhash64("part", "place", F.lit(seed + 1))
        return some.join(plan, "part", "left").withColumn("shard", shard.cast("int")).withColumn("second", second).withColumn("block", F.pmod(F.shiftright("second", 20), F.lit(blocks)).cast("int")).drop("n", "upto")

    sizes = dealt(rows.select("part", "place")).groupBy("shard", "block").agg(F.count("*").alias("size"))
    firsts = sizes.select("shard", "block", (F.sum("size").over(Window.partitionBy("shard").orderBy("block")) - F.col("size")).alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "block").orderBy("second", "part", "place"))
    moved = dealt(rows).withColumn("own", own).join(firsts, ["shard", "block"])
    return moved.select(*[F.col(f"r.`{c}`").alias(c) for c in df.columns], "shard", (F.col("first") + F.col("own") - 1).cast("long").alias("slot"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents` in 24 shards; what is returned of each row is taken from what its shard got."""
    got = shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_of(got, "text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op8_shards": op8_shards}
SQL: dict[str, str] = {}
