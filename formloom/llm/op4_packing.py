"""Packing documents into windows of fixed length, in order, by dynamic programming.

A task holds a range of ids in ascending order and packs it as one stream of tokens. A window may end where a document
ends, where a sentence ends, or, as texts without sentences need it, at a point of a grid within a sentence. An end within a
document costs a penalty, within a sentence so high a one that it is the exception; padding costs one for each token. For the ends t[0] < t[1] < ...
with penalties p, the least cost f of the stream up to t[j] is

    f[j] = min over i with t[j] - t[i] <= length of f[i] + (length - (t[j] - t[i])) + p[j],

so the best i is the least f[i] + t[i] of a moving range, which a monotone queue gives in constant time. A stream is cut
in stretches; the last window of a stretch is carried into the next. At the end of the stream a last window that falls
short of `length` is cut into windows of powers of two, which need no padding, where that costs less than padding it.

Defined results: a null or empty text is the end id alone; a null id sorts first; rows that share an id are packed one
after another in the order of their texts, each with its own tokens from start 0; an empty table gives an empty table; a document longer than a
window is cut, and none of its tokens is lost; columns other than id and text are left behind.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm._shared import encoded, in_batches, in_id_order, slices, text_of, tokenizer_json

BYTE_BPE = "byte_bpe_50k.json"
LENGTH = 1024
END_ID = 0
#: Costs, in tokens of padding: a window's end at the end of a sentence, elsewhere in a document, and a window by itself.
SENTENCE_PENALTY = 4
WORD_PENALTY = 64
WINDOW_COST = 16
#: Tokens between the points within sentences, and tokens that are planned at a time.
GRID = 16
STRETCH = 1 << 19

_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


@functools.lru_cache(maxsize=2)
def _sentence_tokens(content: str, vocabulary: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether a piece can end a sentence, and whether one can begin the next (it has a blank or newline in front)."""
    ends, begins = np.zeros(vocabulary, bool), np.zeros(vocabulary, bool)
    for piece, i in json.loads(content)["model"]["vocab"].items():
        ends[i] = piece.rstrip("\"')]").endswith((".", "!", "?", "Ċ", "ãĢĤ"))
        begins[i] = piece.startswith(("Ġ", "Ċ"))
    return ends, begins


def cuts(ends: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Which of the possible ends to take: their indexes, the last one included. Neighbours lie at most `length` apart."""
    t, p = [0, *ends.tolist()], [0, *penalties.tolist()]
    best, back = [0] * len(t), [0] * len(t)  # best[j] = f[j] + t[j]
    queue, head = [0], 0
    for j in range(1, len(t)):
        low = t[j] - length
        while t[queue[head]] < low:
            head += 1
        i = queue[head]
        back[j] = i
        value = best[j] = best[i] + length + p[j]
        while len(queue) > head and best[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [], len(t) - 1
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def _ends(ids: np.ndarray, doc_ends: np.ndarray, first: int, content: str, length: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in this stretch, in ascending order, with their penalties. first: the place of its first token in the grid."""
    closes, opens = _sentence_tokens(content)
    penalty = np.full(len(ids) + 1, -1, np.int32)
    step = min(grid, length)
    penalty[(-first) % step :: step] = WORD_PENALTY
    sentence = 1 + np.flatnonzero(closes[ids[:-1]] & opens[ids[1:]])
    penalty[sentence] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = -1
    penalty[len(ids)] = max(0, penalty[len(ids)])
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def _tail(size: int, length: int) -> list[int]:
    """The sizes into which a last window is cut."""
    parts = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
    padding = 0 if len(parts) == 1 else length - size
    return parts if (WINDOW_COST + WORD_PENALTY) * (len(parts) - 1) < padding else [size]


class _Packer:
    """The stream of one task. Documents come in order; pieces go out."""

    def __init__(self, content: str, length: int, grid: int, first_sequence: int):
        self.content, self.length, self.grid, self.sequence = content, length, grid, first_sequence
        self.docs: list[tuple] = []  # id, tokens in all, start of what is held, held tokens
        self.size = self.at = 0

    def add(self, doc, ids: np.ndarray, stretch: int) -> Iterator[tuple]:
        for i in range(0, len(ids), stretch):
            self.docs.append((doc, len(ids), i, ids[i : i + stretch], i + stretch >= len(ids)))
            self.size += len(self.docs[-1][3])
            if self.size >= stretch:
                yield from self.out(last=False)

    def out(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        ids = np.concatenate([d[3] for d in self.docs])
        sizes = np.array([len(d[3]) for d in self.docs])
        stops = np.cumsum(sizes)
        at, penalties = _ends(ids, stops[[d[4] for d in self.docs]], self.at, self.content, self.length, self.grid)
        edges = [0, *at[cuts(at, penalties, self.length)].tolist()]
        if last:
            begin = edges[-2]
            edges = [*edges[:-1], *(begin + np.cumsum(_tail(edges[-1] - begin, self.length))).tolist()]
        else:
            edges = edges[:-1]
        starts = stops - sizes
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            offset = 0
            for k in range(int(np.searchsorted(stops, a, "right")), int(np.searchsorted(starts, b, "left"))):
                doc, total, begin, _, _ = self.docs[k]
                i, j = max(a, int(starts[k])), min(b, int(stops[k]))
                yield doc, begin + i - int(starts[k]), j - i, total, self.sequence, offset, ids[i:j]
                offset += j - i
            self.sequence += 1
        done = edges[-1]
        rest = [(doc, total, begin + max(0, done - s), own[max(0, done - s) :], ends) for (doc, total, begin, own, ends), s in zip(self.docs, starts.tolist(), strict=True) if s + len(own) > done]
        self.docs, self.size, self.at = rest, len(ids) - done, self.at + done


def _packing(content: str, length: int, end_id: int, grid: int, stretch: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def made(batches):
        from pyspark import TaskContext

        packer = _Packer(content, length, grid, TaskContext.get().partitionId() << 40)
        for doc, ids in encoded(batches, content):
            yield from packer.add(doc, np.append(ids, np.int32(end_id)), max(stretch, 4 * length))
        yield from packer.out(last=True)

    return lambda batches: in_batches(made(batches), schema, lambda r: 64 + 4 * r[2])


def pack(df: DataFrame, tokenizer_file: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, grid: int = GRID, stretch: int = STRETCH) -> DataFrame:
    """A row for each piece of a document in a window: doc_id, start (its document's ids before it), length, doc_tokens,
    sequence_id (the window), offset (in the window, gapless from 0) and ids."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    ordered = in_id_order(docs)
    return ordered.mapInArrow(_packing(tokenizer_json(tokenizer_file), length, end_id, grid, stretch), _PIECES)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of the ids."""

    def made(batches):
        for b in slices(batches, 4096):
            ids = b.column(6)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            stops = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            crc = [zlib.crc32(x.tobytes()) for x in np.split(flat, stops[:-1])]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(crc, pa.int64())], names=[*b.schema.names[:6], "ids_crc32"])

    return pieces.mapInArrow(made, _PIECES.replace("ids array<int>", "ids_crc32 long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents` in windows of 1024 tokens."""
    return with_crc(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op4_packing": op4_packing}
SQL: dict[str, str] = {}
