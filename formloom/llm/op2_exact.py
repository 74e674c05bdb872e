"""Exact deduplication by deterministic naming of blocks.

A normalised text is cut into blocks of fixed size. Equal blocks get equal integer names, different blocks different
ones: blocks are dealt by a hash into a fixed number of ranges and sorted there, and a block's rank in its range,
after the range's number, is its name. Then names of adjacent blocks are named as pairs in the same way, level by
level, until one name is left. Texts are equal if and only if they need as many levels and end with the same name;
hashes deal the work out and never decide.

Copies that meet in one task's share of the input are one candidate with a list of its documents, and a block that
many of them hold is one row with a list of its places; so a group, or a block, of a third of all rows reaches the
naming as a few rows for each task. The text is shuffled once.

Defined results: null texts count as empty, and all empty texts are one group; a text of white space only is one
blank; of a group, the row with the smallest id stays, a null id only if it has no other; of repeated rows with that
id exactly one stays; an empty table gives an empty table; columns other than id and text are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm._shared import in_batches, rows, text_of, written

BLOCK_BYTES = 1024
#: Texts that a task holds at a time to merge copies.
HELD_BYTES = 32 << 20
#: Ranges into which blocks and pairs are dealt. A name is range * 2**32 + rank.
RANGES = 1 << 24

_BLOCKS = "block binary, places array<struct<text:long,at:int>>, docs array<struct<text:long,ids:array<long>,sha:string>>"


def normalised(text: str) -> bytes:
    """UTF-8 with every run of [\\x20\\x09-\\x0D] as one blank; these are the characters at which bytes.split() cuts."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return b" " * raw[:1].isspace() + b" ".join(words) + b" " * raw[-1:].isspace()


def _candidates(block_bytes: int, held_bytes: int):
    schema = pa.schema(
        [
            ("block", pa.binary()),
            ("places", pa.list_(pa.struct([("text", pa.int64()), ("at", pa.int32())]))),
            ("docs", pa.list_(pa.struct([("text", pa.int64()), ("ids", pa.list_(pa.int64())), ("sha", pa.string())]))),
        ]
    )

    def out(held: dict[bytes, list], first: int) -> Iterator[tuple]:
        """A row for each distinct block; a text's documents go with the row that has its first block."""
        blocks: dict[bytes, tuple[list, list]] = {}
        for n, (text, ids) in enumerate(held.items()):
            ids.sort(key=lambda x: (x is None, x))
            for at in range(max(1, -(-len(text) // block_bytes))):
                places, docs = blocks.setdefault(text[at * block_bytes : (at + 1) * block_bytes], ([], []))
                places.append({"text": first + n, "at": at})
                if not at:
                    docs.append({"text": first + n, "ids": ids, "sha": hashlib.sha256(text).hexdigest()})
        for block, (places, docs) in blocks.items():
            yield block, places, docs

    def made(batches):
        from pyspark import TaskContext

        held: dict[bytes, list] = {}
        size, first = 0, TaskContext.get().partitionId() << 36
        for doc, text in rows(batches):
            text = normalised(text)
            if text in held:
                held[text].append(doc)
                size += 8
            else:
                held[text] = [doc]
                size += len(text) + 64
            if size >= held_bytes:
                yield from out(held, first)
                first, held, size = first + len(held), {}, 0
        yield from out(held, first)

    return lambda batches: in_batches(made(batches), schema, lambda r: len(r[0]) + 16 * len(r[1]))


def _named(df: DataFrame, *what: str) -> DataFrame:
    """df with the integer name of `what`, from its rank among what falls in the same range."""
    w = Window.partitionBy("range").orderBy(*what)
    return df.withColumn("range", F.pmod(F.xxhash64(*what), F.lit(RANGES))).withColumn("name", F.col("range") * F.lit(1 << 32) + F.dense_rank().over(w)).drop("range")


def _in_order(df: DataFrame, *more) -> DataFrame:
    """The names of each text in the order of their places."""
    return df.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("found"), *more).withColumn("names", F.col("found.name")).drop("found")


def _pairs(df: DataFrame) -> DataFrame:
    """Names of adjacent pairs; a last one without a neighbour is a pair with -1. Only distinct pairs are sorted."""
    pairs = df.select("text", F.explode(F.expr("transform(sequence(0, (size(names) - 1) div 2), i -> struct(cast(i as int) as at, names[2 * i] as a, coalesce(get(names, 2 * i + 1), -1L) as b))")).alias("p")).select("text", "p.*")
    names = _named(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b").drop("n")
    return _in_order(pairs.join(names, ["a", "b"]))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """A row for each row of df: id_col, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_of(df, text_col).alias("t"))
    blocks = written(_named(docs.mapInArrow(_candidates(block_bytes, held_bytes), _BLOCKS), "block").select("name", "places", "docs"), "op2-blocks")
    most = blocks.agg(F.max(F.array_max("places.at"))).first()[0] or 0
    names, identity = _in_order(blocks.select("name", F.explode("places").alias("p")).select("name", "p.*")), None
    for level in range(most.bit_length() + 1):
        names = written(names, "op2-names")
        done = names.where("size(names) = 1").select("text", F.lit(level).alias("level"), F.col("names")[0].alias("name"))
        identity = done if identity is None else identity.unionByName(done)
        names = _pairs(names.where("size(names) > 1"))
    texts = blocks.select(F.explode("docs").alias("d")).select("d.*").join(identity, "text")
    first = F.struct(F.col("ids")[0].isNull().alias("none"), F.col("ids")[0].alias("id"), "text")
    groups = texts.groupBy("level", "name").agg(F.min(first).alias("keep"), F.sum(F.size("ids")).cast("long").alias("group_size"))
    every = texts.join(groups, ["level", "name"]).select("text", "sha", "keep", "group_size", F.posexplode("ids").alias("at", "doc"))
    kept = (F.col("text") == F.col("keep.text")) & (F.col("at") == 0)
    return every.select(F.col("doc").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of the whole table `documents`."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_exact": op2_exact}
SQL = {
    "op2_exact": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""
}
