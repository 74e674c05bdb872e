"""From `documents` to packed training sequences: five stages, each one of the operators of formloom.llm.

Each stage reads what the one before has kept from Parquet, and all of it. Rows are told apart by their place in those
files, so null ids, repeated ids and repeated rows are handled like others: null texts count as empty, of equal or near
texts the row with the smallest id stays (a null id only if it has no other), and an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import op2_exact, op4_packing, op6_simhash, op7_pii, op9_toxicity
from formloom.llm._shared import written

#: Near duplicates: distinct shingles of five words, 0.8 alike or more.
NEAR_WORDS, NEAR_ALIKE = 5, 0.8
#: Which texts are compared: of two that share 0.8 of their shingles, bits of fingerprints differ with a chance of about
#: 0.15, which is 38 of 256; random texts differ in half of them.
NEAR_BITS, NEAR_RADIUS = 256, 56
#: Near fingerprints meet in tables of random bits. A key has the more bits the more fingerprints there are, so that 2,000
#: at most share one by chance (to compare with so many costs about what a further table does), and there are as many tables
#: as leave so small a share of the pairs at NEAR_ALIKE without a common key. A further 0.16 % lie beyond the radius.
NEAR_LOST, NEAR_LEAST_BITS = 0.0035, 14


def _near_tables(fingerprints: int) -> list[list[int]]:
    """The tables for so many distinct fingerprints."""
    width = max(NEAR_LEAST_BITS, fingerprints.bit_length() - 11)
    # bits of two fingerprints differ as often as the angle between their sets says
    differs, log = math.acos(2 * NEAR_ALIKE / (1 + NEAR_ALIKE)) / math.pi, lambda n: math.lgamma(n + 1)
    chance, meets = [], []
    for d in range(NEAR_RADIUS + 1):
        chance.append(math.exp(log(NEAR_BITS) - log(d) - log(NEAR_BITS - d) + d * math.log(differs) + (NEAR_BITS - d) * math.log(1 - differs)))
        meets.append(math.exp(log(NEAR_BITS - d) - log(NEAR_BITS - d - width) - log(NEAR_BITS) + log(NEAR_BITS - width)))
    tables = 1
    while sum(c * (1 - m) ** tables for c, m in zip(chance, meets, strict=True)) > NEAR_LOST:
        tables += 1
    return op6_simhash.sampled(NEAR_BITS, tables, width)


def _numbered(docs: DataFrame) -> DataFrame:
    """(_row, held): docs' rows, each with a number. They are written once, so that a number means the same row in every job."""
    return written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")), "pipeline-numbered")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("_row", F.col("held.text").alias("text"))


def _one_of_each(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents among rows, one for each group; groups: (_row, group)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    own = rows.select("_row", F.col("held.doc_id").alias("doc_id"))
    stay = own.join(groups, "_row").groupBy("group").agg(F.min(order).alias("stays")).select("stays._row")
    return rows.join(stay, "_row", "left_semi").select("held.*")


def _free(name: str, docs: DataFrame) -> str:
    """A name that no column has."""
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network, fitted on the labelled ones among them, doesn't call toxic."""
    return op9_toxicity.reject(docs, op9_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside."""
    rows = _numbered(docs)
    groups = op2_exact.exact_groups(_texts(rows), id_col="_row")
    return _one_of_each(rows, groups.select("_row", F.col("keep_id").alias("group")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that pairs of NEAR_ALIKE or more connect."""
    rows = _numbered(docs)
    groups = op6_simhash.near_groups(_texts(rows), id_col="_row", bits=NEAR_BITS, words=NEAR_WORDS, radius=NEAR_RADIUS, tables=_near_tables, alike=NEAR_ALIKE)
    return _one_of_each(rows, groups.select("_row", F.col("component_id").alias("group")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    before = _free("before", docs)
    made = op7_pii.redact(docs.withColumn(before, F.length("text")))
    changed = F.length("text") != F.col(before)
    return made.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in windows."""
    return op4_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]
#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
