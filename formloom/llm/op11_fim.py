"""Fill-in-the-middle forms of documents, by run-length encoded character classes.

A text is held as its maximal runs of white space and of other characters: where each run starts, and how many units have
ended by its end. A cut after so many units is found by binary search among these counts, and its place within the run by
arithmetic. Units are tokens (white space, then what follows up to the next; white space at the end is one of its own) or
characters. Runs are found by numpy, a few million characters at a time, so a text of any length takes a few bytes a run.

Two numbers drawn from a document's id cut its text into prefix, middle and suffix; two more say whether it stays as it is
and in which of two orders its parts go behind their marks. Nothing is shuffled, and each document depends on itself alone.

Defined results: null texts count as empty, and empty texts stay plain, as do those that contain a mark; a null id is
drawn as an empty one; rows of the same id and text come out alike; an empty table gives an empty table; columns other
than id and text are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm._shared import in_batches, rows, text_of

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are cut, and of 100 cut ones those with the suffix first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
UNITS = ("tokens", "characters")
#: Characters whose classes are held at a time.
HELD = 1 << 22

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


class Runs:
    """The runs of a text: `starts` and `ends` in characters, and `upto`, the units that have ended by each run's end."""

    def __init__(self, text: str, units: str = "tokens", held: int = HELD):
        edges, last = [], None
        for i in range(0, len(text), held):
            part = text[i : i + held]
            codes = np.frombuffer(part.encode(), np.uint8) if part.isascii() else np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
            white = (codes == 32) | ((codes >= 9) & (codes <= 13))
            turns = np.flatnonzero(white[1:] != white[:-1]) + (i + 1)
            if last is None:
                self.first_white = bool(white[0])
            elif last != bool(white[0]):
                edges.append(np.array([i]))
            edges.append(turns)
            last = bool(white[-1])
        inner = np.concatenate(edges) if edges else np.empty(0, np.int64)
        self.starts = np.concatenate([[0], inner]) if text else inner
        self.ends = np.concatenate([inner, [len(text)]]) if text else inner
        if units == "characters":
            self.upto = self.ends
            return
        own = np.zeros(len(self.starts), np.int64)
        if len(own):
            own[int(self.first_white) :: 2] = 1
            own[-1] = 1
        self.upto = np.cumsum(own)

    @property
    def units(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def place(self, units: int) -> int:
        """The character before which so many units have ended."""
        if units <= 0:
            return 0
        run = int(np.searchsorted(self.upto, units))
        before = int(self.upto[run - 1]) if run else 0
        start, end = int(self.starts[run]), int(self.ends[run])
        return start + (units - before) * (end - start) // (int(self.upto[run]) - before)


def draws(doc: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers below 2**32 for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(doc: int | None, text: str, units: str = "tokens", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    h1, h2, h3, h4 = draws(doc, seed)
    runs = Runs(text, units)
    n = runs.units
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (runs.place(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = "tokens", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): a row for each of df's; form is plain, psm or spm."""
    if units not in UNITS:
        raise ValueError(f"units are {units!r}; they must be one of {UNITS}")

    def made(batches):
        own = ((doc, *transformed(doc, text, units, seed, rate, suffix_first)) for doc, text in rows(batches))
        return in_batches(own, _SCHEMA, lambda r: 64 + len(r[-1]))

    given = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    return given.mapInArrow(made, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from an output and its form. The first mark of a kind is ours, since texts with marks stay plain."""
    out = F.col(output)

    def parted(first: str, second: str) -> list[Column]:
        a = F.substr(F.substring_index(out, second, 1), F.lit(len(first) + 1))
        rest = F.substr(out, F.length(a) + len(first + second) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return [a, b, F.substr(rest, F.length(b) + len(MIDDLE) + 1)]

    p, s, m = parted(PREFIX, SUFFIX)
    t, q, k = parted(SUFFIX, PREFIX)
    return F.when(F.col(form) == "psm", F.concat(p, m, s)).when(F.col(form) == "spm", F.concat(q, k, t)).otherwise(out)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of the whole table `documents`."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {"op11_fim": op11_fim}
SQL = {
    "op11_fim": r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
     w as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
                  [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in [0, 1, 2, 3]] as h from d),
     c as (select *, len(w) as n, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b from w),
     f as (select doc_id, t, n, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:n], '') as s,
                  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 50 then 'plain'
                       when h[4] % 100 < 80 then 'spm' else 'psm' end as form from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from f
"""
}
