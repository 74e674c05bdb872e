"""Token ids in Parquet files: list columns, small row groups and pages, and reads of what is asked for only.

Rows lie in ascending id order, across files and within them, so that the statistics of row groups and the page
index let a reader of a few ids skip the rest. Ids are a list<int32> column with a dictionary (or, with
encoding="delta", delta-packed pages); a document's own count and its place in its file are columns of their own,
so that metadata is read without any token. A small table beside the files, written with them, has each file's first and
last id and the number of ids before it; a read of a few ids opens that and the pages of those ids.

Defined results: a null or empty text has the end id alone; a null id sorts first, and rows that share an
id lie in the order of their texts; repeated rows are each written;
an empty table gives an empty table; columns other than id and text are left behind.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm._shared import encoded, in_batches, in_id_order, new_folder, slices, text_of, tokenizer_json

WORD_BPE = "word_bpe_49k.json"
END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 2_000
MOST_BROADCAST = 100_000
_SCHEMA = "file int, doc_id long, file_start long, n_tokens long, tokens array<int>"


def _tokens(content: str, end_id: int):
    schema = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("file_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def made(batches):
        from pyspark import TaskContext

        file, start = TaskContext.get().partitionId(), 0
        for doc, ids in encoded(batches, content):
            ids = np.append(ids, np.int32(end_id))
            yield file, doc, start, len(ids), ids
            start += len(ids)

    return lambda batches: in_batches(made(batches), schema, lambda r: 4 * len(r[4]))


def write_tokens(df: DataFrame, path: str, tokenizer_file: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, encoding: str = "dictionary") -> None:
    """Encodes df and writes it to path: one file for each range of ids, `file` being the range's number; and path/_files.

    encoding: "dictionary", or "delta" for DELTA_BINARY_PACKED pages, which suit ids without frequent values.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is {encoding!r}; it must be 'dictionary' or 'delta'")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    ordered = in_id_order(docs)
    (
        ordered.mapInArrow(_tokens(tokenizer_json(tokenizer_file), end_id), _SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", encoding == "dictionary")
        .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
        .parquet(path)
    )
    table = df.sparkSession.read.schema(_SCHEMA).parquet(path)
    files = table.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before")
    files.select("file", "first_id", "last_id", before).coalesce(1).write.parquet(f"{path}/_files")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, start, n_tokens), without reading a token; start counts the ids of all rows before."""
    return _started(spark, path, None, None, "doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(doc_id, file, start, n_tokens, tokens) of the ids from first_id to last_id; other files and pages are skipped."""
    return _started(spark, path, first_id, last_id, "doc_id", "n_tokens", "tokens")


def _started(spark: SparkSession, path: str, first_id: int | None, last_id: int | None, *columns: str) -> DataFrame:
    """What is read, with start from the ids of the files before.

    There is one row for each file, of a few bytes; up to MOST_BROADCAST of them go to the tokens, and not they to them.
    """
    files = spark.read.schema("file int, first_id long, last_id long, before long").parquet(f"{path}/_files")
    table = spark.read.schema(_SCHEMA).parquet(path)
    if first_id is not None:
        files, table = files.where(F.col("last_id") >= first_id), table.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        files, table = files.where(F.col("first_id") <= last_id), table.where(F.col("doc_id") <= last_id)
    before = files.select("file", "before")
    before = F.broadcast(before) if before.count() <= MOST_BROADCAST else before
    return table.select("file", "file_start", *columns).join(before, "file").withColumn("start", F.col("before") + F.col("file_start")).drop("before", "file_start")


def _crcs(batches):
    for b in slices(batches):
        *meta, tokens = b.columns
        flat = tokens.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*meta, pa.array([zlib.crc32(x.tobytes()) for x in np.split(flat, ends[:-1])], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents`, written as tokens and read back."""
    path = new_folder(spark, "op3-tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op3_tokens": op3_tokens}
SQL: dict[str, str] = {}
