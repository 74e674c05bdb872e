"""What several operators share: the shared folder, tables written to it, tokenizer files, and splitting into chunks."""

from __future__ import annotations

import atexit
import functools
import itertools
import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Cuts a text into chunks whose encodings, put one after another, are the text's encoding.
#: A chunk ends only where every version of the pre-tokenizers' patterns has a boundary:
#: after a run of Latin-1 letters that an ASCII character follows, and before a blank or
#: newline that follows a visible ASCII character or such a letter. A newline between a
#: visible character and a letter is a chunk of its own. Everything else stays together.
CHUNK = re.compile(
    rf" ?[{_LETTER}]++(?=[\x00-\x7f]|\Z)|(?<=[!-~{_LETTER}])\n(?=[{_LETTER}])|[\s\S]+?(?:(?<=[!-~{_LETTER}])(?=[ \n])|\Z)"
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset; it must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="formloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/formloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes the tables that this application's operators have written; for the end of a job, when all results have been stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a Parquet table in the shared folder, which cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str, salts: int = 32, how: str = "inner") -> DataFrame:
    """many joined with few on `key`, of which few has one row each; rows of one key are dealt to `salts` parts by the column `by`."""
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt; a null id isn't one of them, and meets no label."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(3)) == 1, F.lit(False))


def bounded_sample(rows_: DataFrame, ids: DataFrame, most_chars: int, name: str) -> list:
    """The rows (i, t, ...) of ids (i, ...), one for each id (the least), as the driver may hold them.

    ids must be few. In the order of their ids' hashes, rows are taken that still fit into most_chars characters of t in all.
    """
    more = [c for c in rows_.columns if c != "i"]
    own = [c for c in ids.columns if c != "i"]
    one = rows_.join(F.broadcast(ids), "i").groupBy("i", *own).agg(F.min(F.struct("t", *[c for c in more if c != "t"])).alias("r"))
    one = written(one.select("i", *own, "r.*"), name)
    left, taken = most_chars, []
    for r in one.select("i", F.length("t").alias("n")).orderBy(F.xxhash64("i"), "i").collect():
        if r["n"] <= left:
            left -= r["n"]
            taken.append(r["i"])
    return one.where(F.col("i").isin(taken)).collect() if taken else []


_BLANK = re.compile(r"\s")


def parts_of(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about so many characters, cut before white space."""
    begin = 0
    while len(text) - begin > size:
        found = _BLANK.search(text, begin + size)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:] if begin else text


def text_of(df: DataFrame, text_col: str):
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def tokenizer_json(name_or_path: str) -> str:
    """The tokenizer file's content, read on the driver; executors get the content and need no file."""
    if not os.path.exists(name_or_path):
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, encoding="utf-8") as f:
        return f.read()


def in_id_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of ascending ids, null first; rows that share an id are ordered by their texts.

    An id that very many rows have, or lack, is spread by its texts' hashes and their places in the input. Rows that
    are equal in both columns may change places, which nothing can tell.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_at"))
    return keyed.repartitionByRange("doc_id", "_h", "_at").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")


@functools.lru_cache(maxsize=4)
def tokenizer(content: str):
    """One tokenizer a worker. Truncation and padding are off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.no_truncation()
    t.no_padding()
    return t


#: Texts of these characters alone are split alike under every version of Unicode; NFC leaves them as they are.
_UNUSUAL = re.compile(r"<\||[^\t\n\r -~À-ÖØ-öø-ÿ¡¿«»°§£€–—‘’“”…•]")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LOWER_PIECES = re.compile(rf"{_CONTRACTIONS}|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_BYTE_PIECES = rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"
#: The pattern for bytes looks back over every blank of a run, which its matcher can't do for very long ones. Such runs
#: go to the tokenizer; a text that is shorter than this has none.
_LONG_RUN = 10_000
_BLANKS = re.compile(r"[\t\n\r ]{%d}" % _LONG_RUN)
#: Stands for a word's end in byte pairs; texts that have it aren't usual ones.
_END = "\x01"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in visible)}


class Coder:
    """Encodes texts as the tokenizer does.

    Usual texts go through a byte pair encoder over the same merges, which is several times as fast; all others through
    the tokenizer. The encoder merges two neighbours whenever together they are a piece, the tokenizer only if they are
    the piece's own two halves. Both come to the same: until a piece's rank is reached, what lies within its bounds is
    merged as if it stood alone, and standing alone it ends as those two halves. That last point is confirmed here for
    each piece; a piece for which it fails, or a tokenizer of another make, leaves all texts to the tokenizer.
    """

    def __init__(self, content: str):
        self.content = content
        read = json.loads(content)
        model, normal = read["model"], read.get("normalizer")
        self.suffix = model.get("end_of_word_suffix") or ""
        made = "suffix" if self.suffix and normal else "bytes" if not normal and read["pre_tokenizer"].get("type") == "ByteLevel" and read["pre_tokenizer"].get("use_regex") and not read["pre_tokenizer"].get("add_prefix_space") else ""
        self.fast = self._encoder(model) if model.get("type") == "BPE" and made and not model.get("ignore_merges") else None

    def _encoder(self, model: dict):
        import tiktoken

        byte, vocab = byte_of(), model["vocab"]
        if len(self.suffix) and not self.suffix.isascii():
            return None

        def raw(piece: str) -> bytes:
            end = bool(self.suffix) and piece.endswith(self.suffix)
            return bytes(byte[c] for c in (piece[: -len(self.suffix)] if end else piece)) + _END.encode() * end

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rank = {m: i for i, m in enumerate(merges)}
        pieces = [(bytes([b]), vocab[c]) for c, b in byte.items()]
        if self.suffix:
            end = _END.encode()
            pieces += [(bytes([b]) + end, vocab[c + self.suffix]) for c, b in byte.items()]
        pieces += [(raw(a + b), vocab[a + b]) for a, b in merges]
        ranks = {p: i for i, (p, _) in enumerate(pieces)}
        if len(ranks) != len(pieces) or not all(self._alone(m, rank) for m in merges):
            return None
        self.id_of = np.array([i for _, i in pieces], np.int32)
        return tiktoken.Encoding("merges", pat_str=f"[^{_END}]+{_END}" if self.suffix else _BYTE_PIECES, mergeable_ranks=ranks, special_tokens={})

    def _alone(self, merge: tuple[str, str], rank: dict) -> bool:
        """Whether a piece's text, standing alone, is merged into the two halves of the piece."""
        text = "".join(merge)
        end = bool(self.suffix) and text.endswith(self.suffix)
        parts = list(text[: -len(self.suffix)] if end else text)
        if end:
            parts[-1] += self.suffix
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in rank:
                return False
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts) == merge

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _UNUSUAL.search(text) or (len(text) >= _LONG_RUN and _BLANKS.search(text)):
            words = CHUNK.findall(text)  # pieces of a very long text are encoded one by one
            return np.fromiter(itertools.chain.from_iterable(x.ids for x in tokenizer(self.content).encode_batch_fast(words, add_special_tokens=False)), np.int32)
        if self.suffix:
            found = _LOWER_PIECES.findall(text.lower())
            text = _END.join(found) + _END * bool(found)
        return self.id_of[self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())]


@functools.lru_cache(maxsize=2)
def coder(content: str) -> Coder:
    """One for a worker, which serves many tasks."""
    return Coder(content)


def encoded(batches: Iterable[pa.RecordBatch], content: str) -> Iterator[tuple]:
    """(id, ids of the text) for rows (id, text)."""
    encode = coder(content).encode
    for doc, text in rows(batches):
        yield doc, encode(text)


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of the batches, one by one."""
    for b in slices(batches):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def slices(batches: Iterable[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, which bounds what their Python objects take."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def in_batches(made: Iterable[tuple], schema: pa.Schema, weigh, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about `most` bytes, as weigh(row) counts them."""
    held: list[tuple] = []
    weight = 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for r in made:
        held.append(r)
        weight += weigh(r)
        if weight >= most:
            yield out()
            held, weight = [], 0
    if held:
        yield out()
