"""BPE encoding and decoding with a table of distinct words.

Encoding works on blocks of documents. A block's texts are split into chunks (words with what clings to them)
and each occurrence becomes a small number in the block's own list of distinct words. The lists are dealt out by
a hash of the word, so that a word of all blocks meets in one task, which encodes it once. The ids go back to the
block, where they take the occurrences' places by position. Only the lists and the numbers are shuffled, never texts.

Decoding joins each id with its piece in the tokenizer's table, which is as large as the vocabulary and no larger.

Defined results: a null or empty text has no ids and decodes to an empty text; a null id column stays null; repeated
rows are encoded each for itself; an empty table gives an empty table; columns other than id and text are left behind,
whatever their names. A text of any length is one row of one block. Frequent words are one entry for each block.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm._shared import CHUNK, byte_of, coder, in_batches, rows, slices, text_of, tokenizer_json

BYTE_BPE = "byte_bpe_50k.json"
#: Characters in a block, and the least number of buckets into which its words are dealt.
BLOCK_CHARS = 8 << 20
BUCKETS = 64
BUCKET_BYTES = 64 << 20


def _bytes(df: DataFrame) -> int:
    """What Spark takes for df's size; 0 where it has no figure."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


class _Numbers(dict):
    """Numbers words in the order in which they first appear, so frequent words get small numbers."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches, block_chars: int) -> Iterator[tuple[int, list, list]]:
    """(number, ids, texts) of blocks; the number comes from the partition and the position there."""
    from pyspark import TaskContext

    block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for doc, text in rows(batches):
        ids.append(doc)
        texts.append(text)
        size += len(text)
        if size >= block_chars:
            yield block, ids, texts
            block, ids, texts, size = block + 1, [], [], 0
    if ids:
        yield block, ids, texts


def _dealt(numbers: _Numbers, buckets: int) -> tuple[np.ndarray, list[tuple[int, list[bytes]]]]:
    """Each word's bucket, and the words of each bucket in the order of their numbers."""
    words = [w.encode() for w in numbers]
    bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return bucket, [(b, [words[i] for i in order[cuts[b] : cuts[b + 1]]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def _check(own: list[bytes]) -> int:
    return zlib.crc32(b"\0".join(own))


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).reshape(-1).view("<u4")


def _lists(block_chars: int, buckets: int) -> Callable:
    """Documents to their blocks' lists of distinct words, in packets by bucket."""

    def made(batches):
        for block, _, texts in _blocks(batches, block_chars):
            numbers = _Numbers()
            for t in texts:
                numbers |= dict.fromkeys(CHUNK.findall(t))
            for b, own in _dealt(numbers, buckets)[1]:
                yield b, block, b"".join(own), np.fromiter(map(len, own), "<u4", len(own)).tobytes()

    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("lengths", pa.binary())])
    return lambda batches: in_batches(made(batches), schema, lambda r: len(r[2]))


def _occurrences(block_chars: int, buckets: int) -> Callable:
    """Documents to blocks of word numbers, one row for each block."""

    def made(batches):
        for block, ids, texts in _blocks(batches, block_chars):
            numbers = _Numbers()
            own = []
            for t in texts:
                found = CHUNK.findall(t)
                own.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
            bucket, packets = _dealt(numbers, buckets)
            codes = np.concatenate(own)
            yield block, ids, np.fromiter(map(len, own), "<u4", len(own)).tobytes(), _packed(codes), len(codes), _packed(bucket), len(bucket), sum(_check(x) for _, x in packets)

    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("codes", pa.binary()), ("n_codes", pa.int64()), ("bucket", pa.binary()), ("n_words", pa.int64()), ("checks", pa.int64())])
    return lambda batches: in_batches(made(batches), schema, lambda r: len(r[3]), 1)


def _encoder(content: str) -> Callable:
    """Packets of words to packets of their ids. A word of many blocks is encoded once."""

    def made(batches):
        encode = coder(content).encode
        table: dict[bytes, bytes] = {}  # the distinct words of a bucket
        last = None
        for bucket, block, words, lengths in rows(batches):
            if bucket != last:
                table, last = {}, bucket
            ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
            own = [words[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            new = [w for w in own if w not in table]
            for w in new:
                table[w] = encode(w.decode()).astype("<u4").tobytes()
            ids = [table[w] for w in own]
            yield block, bucket, _packed(np.frombuffer(b"".join(ids), "<u4")), _packed(np.fromiter(map(len, ids), "<u4", len(ids)) // 4), len(ids), _check(own)

    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("lengths", pa.binary()), ("n", pa.int64()), ("check", pa.int64())])
    return lambda batches: in_batches(made(batches), schema, lambda r: len(r[2]))


def _placed(id_col: str) -> tuple[str, Callable]:
    """A block's numbers and its words' ids to the ids of its documents."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def joined(packets: pa.Table, docs: pa.Table) -> pa.Table:
        (doc,) = docs.to_pylist()
        own = sorted(packets.to_pylist(), key=lambda p: p["bucket"])
        if sum(p["check"] for p in own) != doc["checks"]:
            raise RuntimeError("the two passes over the input read different rows; write the input to a table first")
        lengths = [_unpacked(p["lengths"], p["n"]) for p in own]
        flat = np.concatenate([np.empty(0, "<u4"), *(_unpacked(p["ids"], int(n.sum())) for p, n in zip(own, lengths, strict=True))])
        order = np.argsort(_unpacked(doc["bucket"], doc["n_words"]), kind="stable")
        length = np.zeros(doc["n_words"], np.int64)
        begin = np.zeros(doc["n_words"], np.int64)
        length[order] = np.concatenate([np.empty(0, np.int64), *lengths])
        begin[order] = np.cumsum(length[order]) - length[order]
        codes = _unpacked(doc["codes"], doc["n_codes"])
        ends = np.concatenate([[0], np.cumsum(length[codes])])  # of occurrences, in ids
        at = np.repeat(begin[codes] - ends[:-1], length[codes]) + np.arange(ends[-1])
        cuts = ends[np.concatenate([[0], np.cumsum(np.frombuffer(doc["counts"], "<u4"), dtype=np.int64)])]
        ids = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat[at].astype(np.int32)))
        return pa.Table.from_batches((pa.RecordBatch.from_arrays([pa.array(doc["doc_ids"], pa.int64()), ids], schema=schema).slice(i, 512) for i in range(0, len(ids), 512)), schema)

    return f"`{id_col}` long, ids array<int>", joined


def encode(df: DataFrame, tokenizer_file: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, buckets: int | None = None) -> DataFrame:
    """(id_col, ids array<int>): each text's ids under the tokenizer of tokenizer_file, without added special tokens.

    The input is read twice and must give the same rows in the same order both times, as a scan of files does;
    checksums of each block's words confirm it. buckets: packets of words that a block makes, by default one for each
    BUCKET_BYTES of the input, as many as there are shuffle partitions at least, and never fewer than BUCKETS; a task holds
    the distinct words of one bucket at a time.
    """
    buckets = buckets or max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _bytes(df) // BUCKET_BYTES)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_of(df, text_col).alias("text"))
    lists = docs.mapInArrow(_lists(block_chars, buckets), "bucket int, block long, words binary, lengths binary")
    ids = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoder(tokenizer_json(tokenizer_file)), "block long, bucket int, ids binary, lengths binary, n long, check long")
    codes = docs.mapInArrow(_occurrences(block_chars, buckets), "block long, doc_ids array<long>, counts binary, codes binary, n_codes long, bucket binary, n_words long, checks long")
    schema, joined = _placed(id_col)
    return ids.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(joined, schema)


@functools.lru_cache(maxsize=2)
def _pieces(content: str) -> list[bytes]:
    """The bytes of each id's piece."""
    byte = byte_of()
    read = json.loads(content)
    out = [b""] * (1 + max([*read["model"]["vocab"].values(), *(t["id"] for t in read["added_tokens"])]))
    for piece, i in read["model"]["vocab"].items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    for t in read["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def decoded(batches, content: str, ids_col: str, out_col: str) -> Iterator[pa.RecordBatch]:
    """Batches with the text of ids_col added: each id is joined with its piece."""
    piece = _pieces(content).__getitem__
    for b in slices(batches):
        ids = b.column(b.schema.get_field_index(ids_col))
        flat, length = ids.flatten().to_numpy(zero_copy_only=False).tolist(), ids.value_lengths().fill_null(0).to_numpy()
        stop = np.cumsum(length, dtype=np.int64)
        texts = [b"".join(map(piece, flat[i:j])).decode("utf-8", "replace") if known else None for i, j, known in zip((stop - length).tolist(), stop.tolist(), ids.is_valid().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])


def decode(df: DataFrame, tokenizer_file: str = BYTE_BPE, ids_col: str = "ids", out_col: str = "decoded", then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """df with out_col, the text of ids_col under a byte-level tokenizer; bytes that aren't UTF-8 become U+FFFD.

    The table of pieces is as large as the vocabulary, so each task has it whole. Ids outside of it are an error.
    Null ids give null. then, schema: what is made of the batches in the same pass, and what comes of it.
    """
    if out_col in df.columns:
        df = df.drop(out_col)
    content = tokenizer_json(tokenizer_file)
    out = schema or T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    return df.mapInArrow(lambda batches: (then or iter)(decoded(batches, content, ids_col, out_col)), out)


def _digests(batches):
    for b in batches:
        doc, ids, text = b.columns
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        yield pa.RecordBatch.from_arrays(
            [
                doc,
                pa.array(np.diff(ends), pa.int64()),
                pa.array([hashlib.sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(ends[:-1], ends[1:], strict=True)]),
                pa.array([hashlib.sha256(t).hexdigest() for t in text.cast(pa.binary()).to_pylist()], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents`, encoded and decoded again."""
    ids = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return decode(ids, then=_digests, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}
