"""Near duplicates by SimHash, compared in bit slices.

Fingerprints are compared within buckets. A bucket's fingerprints lie as bit planes: word w of plane b holds bit b of 64
fingerprints. One fingerprint is compared with 64 others at a time: the planes where they differ are added up in
carry-save counters, which overflow beyond the radius, and blocks of 64 whose lanes have all overflowed are abandoned.

Which fingerprints share a bucket: `pigeonhole` tables lose no pair within the radius (the bits are cut into
radius + same blocks, and any `same` of these that agree make a bucket); `sampled` tables take random bits for radii
for which blocks would be too small, and find a pair with a probability that grows with the number of tables.

A bucket gives links to the least fingerprint that each is connected with, never all pairs, and the links of all buckets
are joined into components by alternating large-star and small-star steps. Only distinct fingerprints are compared;
equal ones, however many, are one row from the first aggregation on. A bucket of more than BUCKET fingerprints is cut into
blocks of so many, and any two of its blocks are compared in a task of their own.

Defined results: a null or empty text, or one of white space, has the fingerprint zero, which is linked like any other;
fewer words than a shingle has are one shingle; repeated rows are returned each; a null id can't be a component's least
id unless it has no other; an empty table gives an empty table; columns other than id and text are left behind.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm._shared import in_batches, rows, spread_join, text_of, written

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: (query, block) combinations that are compared at a time.
COMBINATIONS = 1 << 16
#: Fingerprints whose bits are unpacked at a time.
AT_A_TIME = 1 << 12
#: Shingles of a component's block, two of which are compared in a task.
BLOCK = 1 << 21
#: Fingerprints of a bucket's block, two of which are compared in a task.
BUCKET = 1 << 15


def pigeonhole(bits: int = BITS, radius: int = RADIUS, same: int = 2) -> list[list[int]]:
    """Bit positions of the tables that hold every pair within the radius."""
    blocks = np.array_split(np.arange(bits), radius + same)
    return [np.concatenate(c).tolist() for c in itertools.combinations(blocks, same)]


def sampled(bits: int, tables: int, width: int, seed: int = SEED) -> list[list[int]]:
    """`width` random bit positions for each table."""
    draw = np.random.default_rng(seed)
    return [sorted(draw.choice(bits, width, replace=False).tolist()) for _ in range(tables)]


def hashes(raw: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of words, some thousands at a time."""
    import xxhash

    w = raw.lower().split()
    if not w:
        return
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    hashed = map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles)
    left = max(1, len(w) - words + 1)
    while left:
        n = min(left, 255 * 64)
        yield np.fromiter(itertools.islice(hashed, n), np.uint64, n)
        left -= n


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes(text.encode(), words)]))


def _majority(hashed: Iterable[np.ndarray], bits: int) -> bytes:
    """A bit is set if over half the hashes have it. Beyond 64 bits, further hashes are mixed from the first."""
    lanes = bits // 64
    counts, n = np.zeros((lanes, 64), np.int64), 0
    for h in hashed:
        n += len(h)
        for k in range(lanes):
            if k:
                x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
            else:
                x = h
            bit = np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, 64)
            for i in range(0, len(bit), 255):
                counts[k] += bit[i : i + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > n).tobytes()


def fingerprint(text: str, bits: int = BITS, words: int = WORDS) -> bytes:
    """Of all shingles of a text, repeated ones included."""
    return _majority(hashes(text.encode(), words), bits)


def set_fingerprint(held: np.ndarray, bits: int) -> bytes:
    """Of a set of shingles."""
    return _majority((held[i : i + 255 * 64] for i in range(0, len(held), 255 * 64)), bits)


def _fingerprints(bits: int, words: int):
    schema = pa.schema([("doc", pa.int64()), ("fp", pa.binary())])
    return lambda batches: in_batches(((doc, fingerprint(text, bits, words)) for doc, text in rows(batches)), schema, lambda r: 64)


def _set_fingerprints(bits: int, words: int):
    """(doc, fp, name): name stands for the set of shingles."""
    schema = pa.schema([("doc", pa.int64()), ("fp", pa.binary()), ("name", pa.binary())])

    def made(batches):
        import xxhash

        for doc, text in rows(batches):
            held = shingle_set(text, words)
            yield doc, set_fingerprint(held, bits), xxhash.xxh128_digest(held.tobytes())

    return lambda batches: in_batches(made(batches), schema, lambda r: 96)


def _bits(fps: Iterable[bytes], size: int) -> np.ndarray:
    """A row of bits for each fingerprint."""
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(-1, size), axis=1)


def _buckets(tables: list[list[int]], bits: int):
    def made(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                column = b.column(0).slice(i, 4096)
                bit = _bits(column.to_pylist(), bits // 8)
                for t, at in enumerate(tables):
                    key = bit[:, at].astype(np.int64) @ (1 << np.arange(len(at), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), column], names=["table", "key", "fp"])

    return made


def _csa(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near(planes: np.ndarray, asked: np.ndarray, query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, lane) within the radius. planes: bits x blocks of 64 lanes; asked: bits x queries, 0 or all ones;
    query, block, lanes: which to compare, with a mask of the lanes that count."""
    depth = radius.bit_length()
    start = (1 << depth) - 1 - radius  # counters overflow once radius + 1 bits have come on top
    one = np.uint64(0xFFFFFFFFFFFFFFFF)
    count = [np.full(len(query), one if start >> k & 1 else np.uint64(0)) for k in range(depth)]
    over = np.zeros(len(query), np.uint64)
    for b in range(0, len(planes), 2):
        d1 = planes[b, block] ^ asked[b, query]
        d2 = planes[b + 1, block] ^ asked[b + 1, query]
        if depth:
            count[0], carry = _csa(count[0], d1, d2)
        else:
            carry = d1 | d2
        for k in range(1, depth):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 16 == 14 and len(query):
            alive = (lanes & ~over) != 0
            if 2 * np.count_nonzero(alive) < len(query):
                query, block, lanes, over = query[alive], block[alive], lanes[alive], over[alive]
                count = [c[alive] for c in count]
    left = lanes & ~over
    some = np.flatnonzero(left)
    which, lane = np.nonzero(np.unpackbits(left[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[some][which], 64 * block[some][which] + lane


def _roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The forest with i and j of each pair in one tree; roots are the least members."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def bucket_links(fps: list[bytes], since: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[bytes, bytes]]:
    """Links of fingerprints to the first of those that they are connected with. since, end: the range of places with which each is compared."""
    n, size = len(fps), len(fps[0])
    planes = np.zeros((8 * size, -(-n // 64)), "<u8")
    for k in range(0, n, AT_A_TIME):  # a number of whole blocks
        bit = _bits(fps[k : k + AT_A_TIME], size)
        padded = np.zeros((-(-len(bit) // 64) * 64, 8 * size), np.uint8)
        padded[: len(bit)] = bit
        planes[:, k // 64 : k // 64 + len(padded) // 64] = np.packbits(padded.T.copy(), axis=1, bitorder="little").view("<u8")
    i = np.arange(n)
    first, last = since // 64, (end - 1) // 64
    many = np.where(since < end, last - first + 1, 0)
    parent, at, upto = np.arange(n), 0, np.cumsum(many)
    while at < n:
        stop = min(at + AT_A_TIME, max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMBINATIONS, "right"))))
        own, m = i[at:stop], many[at:stop]
        query = np.repeat(own, m)
        block = np.repeat(first[at:stop], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        low = np.maximum(since[query] - 64 * block, 0).astype(np.uint64)
        high = np.minimum(end[query] - 64 * block, 64)
        lanes = np.uint64(0xFFFFFFFFFFFFFFFF) << low
        lanes &= np.where(high == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (high % 64).astype(np.uint64)) - np.uint64(1))
        asked = np.where(_bits(fps[at:stop], size).T, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        found, lane = near(planes, asked, query - at, block, lanes, radius)
        parent = _roots(parent, found + at, lane)
        at = stop
    for k in np.flatnonzero(parent != i).tolist():
        yield fps[k], fps[parent[k]]


_LINKS = "a binary, b binary, bucket long, block int, held binary"
_LINKED = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("bucket", pa.int64()), ("block", pa.int32()), ("held", pa.binary())])


def _linker(radius: int, most: int):
    """Rows (table, key, fp) in order of their buckets to links, and to the blocks of buckets that are too large for that.

    A bucket is named by the place of its first row in the task, after the task's number.
    """

    def found(fps: list[bytes], sizes: list[int]) -> Iterator[tuple]:
        own = np.array(sizes)
        ends = np.repeat(np.cumsum(own), own)
        for a, b in bucket_links(fps, np.arange(1, len(fps) + 1), ends, radius):
            yield a, b, None, None, None

    def made(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 40
        waiting, sizes = [], []  # whole buckets that are compared together
        bucket, held, blocks, row = None, [], 0, 0  # the bucket that goes on

        def close() -> Iterator[tuple]:
            nonlocal held, blocks, waiting, sizes
            if blocks:
                if held:
                    yield None, None, name + row, blocks, b"".join(held)
            elif len(held) > 1:
                waiting += held
                sizes.append(len(held))
                if len(waiting) >= most:
                    yield from found(waiting, sizes)
                    waiting, sizes = [], []
            held, blocks = [], 0

        for b in batches:
            if not b.num_rows:
                continue
            table, key, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            new = [0, *(1 + np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0))).tolist(), len(fps)]
            for i, j in zip(new[:-1], new[1:], strict=True):
                if (int(table[i]), int(key[i])) != bucket:
                    yield from close()
                    bucket, row = (int(table[i]), int(key[i])), row + 1
                held += fps[i:j]
                while len(held) > most:
                    yield None, None, name + row, blocks, b"".join(held[:most])
                    held, blocks = held[most:], blocks + 1
        yield from close()
        if waiting:
            yield from found(waiting, sizes)

    return lambda batches: in_batches(made(batches), _LINKED, lambda r: 64 + len(r[4] or b""))


def _pair_linker(radius: int, size: int):
    """Rows (bucket, p, q, block, held) in order of the first three to links between the blocks p and q, or within p."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def made(batches):
        for (_, p, q), group in itertools.groupby(rows(batches), lambda r: r[:3]):
            first, *second = [[r[-1][k : k + size] for k in range(0, len(r[-1]), size)] for r in sorted(group, key=lambda r: r[3])]
            fps = first + (second[0] if second else [])
            since = np.arange(1, len(fps) + 1) if p == q else np.full(len(fps), len(first))
            end = np.where(np.arange(len(fps)) < len(first), len(fps), 0)
            yield from bucket_links(fps, since, end, radius)

    return lambda batches: in_batches(made(batches), schema, lambda r: 64)


def _links(dealt: DataFrame, bits: int, radius: int, most: int) -> DataFrame:
    """(a, b): the links of fingerprints (table, key, fp) that lie in their buckets, in order."""
    found = written(dealt.mapInArrow(_linker(radius, most), _LINKS), "op6-linked")
    blocks = found.where("held is not null").select("bucket", "block", "held")
    many = blocks.groupBy("bucket").agg(F.max("block").alias("last"))
    each = blocks.join(many, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    pairs = each.select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "held").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return found.where("a is not null").select("a", "b").union(pairs.mapInArrow(_pair_linker(radius, bits // 8), "a binary, b binary"))


def alike_roots(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set of shingles, the first of those that it is connected with by pairs at least so much alike.

    Two such sets share one of the first few of their elements, in any order that both keep; here the rarest come first.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    member = np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    r = rank[code]
    r = r[np.lexsort((r, member))]
    start = np.cumsum(sizes) - sizes
    prefix = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
    early = np.arange(len(r)) - start[member] < prefix[member]
    asked, holder = r[early], member[early]
    order = np.lexsort((holder, asked))
    holder, first = holder[order], np.searchsorted(asked[order], np.arange(len(count) + 1))
    parent, mark = np.arange(n), np.zeros(len(count), np.int64)
    for i in np.flatnonzero(sizes).tolist():
        own = r[start[i] : start[i] + sizes[i]]
        near = np.concatenate([holder[first[c] : first[c + 1]] for c in own[: prefix[i]].tolist()])
        near = np.unique(near[(near > i) & (parent[near] != parent[i])])
        near = near[np.minimum(sizes[near], sizes[i]) >= least * np.maximum(sizes[near], sizes[i]) - 1e-9]
        for k in range(0, len(near), AT_A_TIME):
            some = near[k : k + AT_A_TIME]
            begin = np.cumsum(sizes[some]) - sizes[some]
            at = np.repeat(start[some] - begin, sizes[some]) + np.arange(sizes[some].sum())
            mark[own] = 1
            both = np.add.reduceat(mark[r[at]], begin)
            mark[own] = 0
            found = some[both / (sizes[some] + sizes[i] - both) >= least]
            parent = _roots(parent, np.full(len(found), i), found)
    return parent


def _confirmer(least: float):
    """Rows (root, p, q, name, held) in order of the first three to links of names."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def made(batches):
        for _, group in itertools.groupby(rows(batches), lambda r: r[:3]):
            names, sets = zip(*((name, np.frombuffer(held, np.uint64)) for *_, name, held in group), strict=True)
            for k, j in enumerate(alike_roots(list(sets), least).tolist()):
                if k != j:
                    yield names[k], names[j]

    return lambda batches: in_batches(made(batches), schema, lambda r: 64)


def _held_sets(words: int):
    """Rows (root, name, text) to (root, name, n, held)."""
    schema = pa.schema([("root", pa.binary()), ("name", pa.binary()), ("n", pa.int64()), ("held", pa.binary())])

    def made(batches):
        for root, name, text in rows(batches):
            held = shingle_set(text, words)
            yield root, name, len(held), held.tobytes()

    return lambda batches: in_batches(made(batches), schema, lambda r: 96 + 8 * r[2])


def confirmed(texts: DataFrame, member: DataFrame, words: int, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b) as components() has it, of sets' names. texts: (doc, t); member: (name, doc, root), a row for each set."""
    crowded = member.groupBy("root").agg(F.count("*").alias("sets")).where("sets > 1").select("root")
    asked = written(spread_join(member, crowded, "root", "name").select("root", "name", "doc"), "op6-asked")
    sets = texts.join(asked, "doc").select("root", "name", "t").mapInArrow(_held_sets(words), "root binary, name binary, n long, held binary")
    sets = written(sets, "op6-sets")
    # a large component's sets are dealt to blocks, and any two blocks make a task
    parts = sets.groupBy("root").agg(F.ceil(F.sum("n") / block).alias("parts"))
    own = spread_join(sets, parts, "root", "name").withColumn("own", F.pmod(F.xxhash64("name"), F.greatest("parts", F.lit(1))))
    other = F.expr("if(parts > 1, filter(sequence(0L, parts - 1), x -> x <> own), array(own))")
    dealt = own.withColumn("other", F.explode(other)).select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "name", "held")
    dealt = dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
    return components(dealt.mapInArrow(_confirmer(least), "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked node a but the least of its component, and that least one, b."""
    links, before = written(links.where("a <> b").distinct(), "op6-links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == before or not now[0]:
            return links
        before = now
        both = links.select("a", "b").union(links.select("b", "a"))
        # the least neighbours are a table of their own, so that both sides of the join are exchanges and the links of a
        # node that very many share can be split among tasks
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "op6-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "op6-large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "op6-least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "op6-links")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, words: int = WORDS, radius: int = RADIUS, tables: list[list[int]] | Callable[[int], list[list[int]]] | None = None, alike: float | None = None, most: int = BUCKET) -> DataFrame:
    """A row for each row of df: id_col, fingerprint (hexadecimal), component_id (the least id of its group).

    tables: which bits make the keys of each table, or a function that says so for a number of distinct fingerprints.
    alike: the share of their distinct shingles that two texts must have in common for a link.
    most: fingerprints of a bucket that are compared in one task."""
    tables = tables or pigeonhole(bits, radius)
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_of(df, text_col).alias("t"))
    if alike is None:
        docs = written(texts.mapInArrow(_fingerprints(bits, words), "doc long, fp binary"), "op6-fingerprints")
    else:
        docs = written(texts.mapInArrow(_set_fingerprints(bits, words), "doc long, fp binary, name binary"), "op6-fingerprints")
    distinct = docs.groupBy("fp").agg(F.min("doc").alias("least"))
    if callable(tables):
        tables = tables(docs.select("fp").distinct().count())
    dealt = distinct.select("fp").mapInArrow(_buckets(tables, bits), "table int, key long, fp binary").repartition("table", "key").sortWithinPartitions("table", "key")
    stars, node = components(_links(dealt, bits, radius, most)), "fp"
    if alike is not None:
        distinct, node = docs.groupBy("name", "fp").agg(F.min("doc").alias("least")), "name"
        member = distinct.join(stars.withColumnRenamed("a", "fp"), "fp", "left").select("name", F.col("least").alias("doc"), F.coalesce("b", "fp").alias("root"))
        stars = confirmed(texts, member, words, alike)
    member = written(distinct.join(stars.withColumnRenamed("a", node), node, "left").select(node, "least", F.coalesce("b", node).alias("root")), "op6-members")
    # a root of one member needs no join; a large component's members are many tasks' work
    ids = member.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members")).where("members > 1").select("root", "first")
    named = spread_join(member, ids, "root", node, how="left").select(node, F.coalesce("first", "least").alias("component_id"))
    return docs.join(named, node).select(F.col("doc").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the whole table `documents`: 64 bits, three words, a radius of three bits."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
