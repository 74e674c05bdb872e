"""A Merkle manifest of documents: a tree for each language, and one over the languages' roots.

Leaves are sorted once and numbered by language. Blocks of 2**k consecutive leaves are reduced by tasks, where k follows
the number of rows so that MOST_TOP blocks at most are left; their nodes are the small top tree, which the driver builds.
The paths from block nodes to the top are broadcast; tasks put a leaf's path within its block before its block's, which
finishes its proof, and each row folds its own. Languages of up to a block's size are finished by the task of their block
and never reach the driver, so their number doesn't matter; the tree over the languages' roots is made in the same way.

A path has an entry a level: `<` or `>` and the sibling's digest, which stands left or right of the node, or `-` where
the node has none.

Defined results: each null column is a `-` in its leaf; ids ascend with null first; rows of one id are ordered by their
leaves, and rows that are equal altogether have equal leaves, so which of them is which makes no difference to the tree;
a null id isn't tampered with, and a tampered count of the largest long is one more, in decimals; an empty table gives an
empty table; columns that leaves don't have are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm._shared import in_batches, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Block nodes that the driver may hold, and the least size of a block as a power of two.
MOST_TOP, LEAST_BITS = 16_384, 4
#: Bits of a row's place in its partition; the partition's number stands above them.
PLACE_BITS = 33
TAMPERED = 7

_NODES = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("node", pa.string())])
_WAYS = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("leaf", pa.string()), ("id", pa.int64()), ("more", pa.string()), ("path", pa.list_(pa.string())), ("top", pa.string())])


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def levels(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """The nodes, and the levels above them, until one node is left or `most` levels have been added."""
    out = [nodes]
    while (len(out[-1]) > 1) if most is None else (len(out) <= most):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def path(tree: list[list[str]], at: int) -> list[str]:
    """The siblings of a node of the lowest level, up to the top."""
    found = []
    for level in tree[:-1]:
        other = at ^ 1
        found.append("-" if other >= len(level) else ("<" if other < at else ">") + level[other])
        at >>= 1
    return found


def leaf(row: dict[str, Column]) -> Column:
    """The digest of a row: each column `-` if null, else the number of its bytes, a colon and itself."""
    texts = [c.cast("string") for c in row.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """leaves with `at`, the place in their tree, and `n`, its leaves; order: columns besides `tree`. Rows are written once."""
    placed = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_p", F.monotonically_increasing_id())
    rows = written(placed.withColumns({"_part": F.shiftright("_p", PLACE_BITS), "_p": F.col("_p").bitwiseAND((1 << PLACE_BITS) - 1)}), "op12-leaves")
    # a partition holds a stretch of each of its trees; there are about as many stretches as partitions and trees
    own = rows.groupBy("tree", "_part").agg(F.min("_p").alias("first"), F.count("*").alias("own"))
    w = Window.partitionBy("tree")
    before = F.sum("own").over(w.orderBy("_part")) - F.col("own")
    stretches = written(own.select("tree", "_part", (before - F.col("first")).alias("shift"), F.sum("own").over(w).alias("n")), "op12-stretches")
    return rows.join(stretches, ["tree", "_part"]).withColumn("at", F.col("_p") + F.col("shift")).drop("_p", "_part", "shift")


def _blocks(batches, bits: int) -> Iterator[tuple[str, int, int, list[tuple]]]:
    """(tree, leaves of the tree, block, rows without these) for each block of rows (tree, n, at, leaf ...), which come in order."""
    now, held = None, []
    for b in batches:
        for tree, n, at, *own in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key = (tree, n, at >> bits)
            if key != now:
                if now is not None:
                    yield *now, held
                now, held = key, []
            held.append((at, *own))
    if now is not None:
        yield *now, held


def _reduced(held: list[tuple], n: int, bits: int) -> list[list[str]]:
    """A block's levels: to its tree's root if that is the only block, else to the level of block nodes."""
    return levels([r[1] for r in held], None if n <= 1 << bits else bits)


def paths(leaves: DataFrame, rows: int, most_top: int = MOST_TOP, least_bits: int = LEAST_BITS) -> DataFrame:
    """(tree, at, leaf, id, more, path, top) for leaves (tree, n, at, leaf, id, more), `rows` in all: the way of each to its tree's root, `top`.

    A task holds a block at a time: rows / most_top leaves, twice as many at most.
    """
    spark = leaves.sparkSession
    bits = max(least_bits, (-(-rows // most_top) - 1).bit_length())

    def ordered(*more: str) -> DataFrame:
        own = leaves.select("tree", "n", "at", "leaf", *more, F.shiftright("at", bits).alias("block"))
        return own.repartition("tree", "block").sortWithinPartitions("tree", "block", "at").drop("block")

    def reduce(batches):
        own = ((tree, block, _reduced(held, n, bits)[-1][0]) for tree, n, block, held in _blocks(batches, bits) if n > 1 << bits)
        return in_batches(own, _NODES, lambda r: 128)

    # trees of more than one block; they have 2 * most_top blocks at most
    large: dict[str, list[str]] = {}
    for r in sorted(ordered().mapInArrow(reduce, "tree string, block long, node string").collect()):
        large.setdefault(r.tree, []).append(r.node)
    suffixes = {}
    for tree, nodes in large.items():
        upper = levels(nodes)
        suffixes |= {(tree, block): (path(upper, block), upper[-1][0]) for block in range(len(nodes))}
    sent = spark.sparkContext.broadcast(suffixes)

    def finish(batches):
        def made():
            for tree, n, block, held in _blocks(batches, bits):
                lower = _reduced(held, n, bits)
                rest, top = sent.value[tree, block] if n > 1 << bits else ([], lower[-1][0])
                for i, r in enumerate(held):
                    yield tree, *r, path(lower, i) + rest, top

        return in_batches(made(), _WAYS, lambda r: 256 + 80 * len(r[-2]))

    return ordered("id", "more").mapInArrow(finish, "tree string, at long, leaf string, id long, more string, path array<string>, top string")


def folded(leaf_: str, path_: str) -> Column:
    """The root that a leaf's digest and its path lead to."""
    step = lambda node, s: F.sha2(F.when(s.startswith("<"), F.concat(F.substr(s, F.lit(2)), node)).when(s.startswith(">"), F.concat(node, F.substr(s, F.lit(2)))).otherwise(node), 256)
    return F.aggregate(F.col(path_), F.col(leaf_), step)


def proof(path_: str) -> Column:
    """The digest of a path's siblings."""
    return F.sha2(F.array_join(F.transform(F.col(path_), lambda s: F.substr(s, F.lit(2))), ""), 256)


def manifest(df: DataFrame, tampered: Column | None = None, most_top: int = MOST_TOP, least_bits: int = LEAST_BITS) -> DataFrame:
    """(doc_id, leaf, path, subroot, root, folded_leaf): a row for each of df's, with its way to the root over all languages.

    tampered: rows whose n_chars are one more when they are folded.
    """
    own = {c: F.col(f"`{c}`") for c in COLUMNS}
    more = own | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    # trees are in the order of their languages, without one first
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    leaves = df.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf(own).alias("leaf"), F.when(changed, leaf(more)).alias("more"))
    rows = numbered(leaves, "id", "leaf", "more")
    ways = paths(rows, rows.count(), most_top, least_bits)
    roots = written(ways.where("at = 0").select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("id"), F.col("top").alias("leaf"), F.col("tree").alias("more")), "op12-roots")
    upper = paths(numbered(roots, "more"), roots.count(), most_top, least_bits)
    over = written(upper.select(F.col("more").alias("tree"), F.col("path").alias("upper"), F.col("top").alias("root")), "op12-upper")
    found = ways.join(over, "tree")
    return found.select(F.col("id").alias("doc_id"), "leaf", F.concat("path", "upper").alias("path"), F.col("top").alias("subroot"), "root", F.coalesce("more", "leaf").alias("folded_leaf"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the whole table `documents`; rows whose id's checksum 7 divides are tampered with."""
    made = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPERED)) == 0)
    back = made.withColumn("folded_root", folded("folded_leaf", "path"))
    return back.select("doc_id", "leaf", "subroot", "root", proof("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op12_merkle": op12_merkle}
def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


#: A tree's nodes from its leaves, and each leaf's path.
_TREE = """
{0}(t, lev, pos, n, h) as (
    select t, 0, pos, n, h from {1} union all
    select t, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from {0} where n > 1 group by t, lev, n, pos // 2),
{0}_path as (
    select l.t, l.pos, list(case when o.h is null then '-' when o.pos < p.pos then '<' || o.h else '>' || o.h end order by p.lev) as path
    from {1} l join {0} p on p.t = l.t and p.n > 1 and p.pos = l.pos >> p.lev left join {0} o on o.t = p.t and o.lev = p.lev and o.pos = xor(p.pos, 1) group by l.t, l.pos)"""
SQL = {
    "op12_merkle": f"""
with recursive bits as (
    select *, cast(doc_id as varchar) as d from documents),
crc as (
    select doc_id, source, lang, n_chars, text, xor(4294967295, list_reduce(
        list_concat([4294967295], flatten([[(ascii(d[i]) >> k) & 1 for k in range(8)] for i in range(1, strlen(d) + 1)])),
        lambda c, b: xor(c >> 1, case when xor(c, b) & 1 = 1 then 3988292384 else 0 end))) % 7 = 0 as bad from bits),
leaves as (
    select doc_id, coalesce('=' || lang, '-') as t, row_number() over (partition by lang order by doc_id nulls first) - 1 as pos, count(*) over (partition by lang) as n,
           {_leaf_sql("n_chars")} as h, case when bad then {_leaf_sql("(n_chars + 1)")} else {_leaf_sql("n_chars")} end as other from crc),
{_TREE.format("low", "leaves")},
tops as (select '' as t, t as lang, row_number() over (order by t) - 1 as pos, count(*) over () as n, h from low where n = 1),
{_TREE.format("high", "tops")},
every as (
    select l.doc_id, l.h as leaf, s.h as subroot, r.h as root, l.other, list_concat(coalesce(p.path, []), coalesce(q.path, [])) as path
    from leaves l join tops s on s.lang = l.t join high r on r.n = 1 left join low_path p on p.t = l.t and p.pos = l.pos left join high_path q on q.pos = s.pos),
folded as (
    select *, list_reduce(list_concat([other], path), lambda a, s: sha256(case s[1] when '<' then s[2:] || a when '>' then a || s[2:] else a end)) as folded_root from every)
select doc_id, leaf, subroot, root, sha256(array_to_string([s[2:] for s in path], '')) as proof_sha256, folded_root, folded_root = root as verified from folded
"""
}
