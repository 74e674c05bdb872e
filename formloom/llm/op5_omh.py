"""Document fingerprints by Order MinHash, in DataFrame operations only.

A text's k-mers are runs of k units, numbered by occurrence: the second "of the" is another element than the first. Units
are words; a word of more than LONGEST characters, and a character of a script that sets no blanks, is cut into characters.
For each of ORDERS orders of the elements the least `tuple_size` of them are selected, put in the order in which they stand
in the text, and hashed. The fingerprint is the row of these hashes; likeness is the share of places at which two agree.
Editing a passage changes which elements there are, and moving one the order in which they stand, so likeness falls with
edit distance.

The orders are turns of one circle of hashes: in the i-th, elements are ordered from the circle's i-th mark on. Elements
are sorted once, and the least of each order are the first ones after its mark.

A row's fingerprint is worked out within the row, by functions of arrays: nothing is shuffled, and a text takes memory in
proportion to its length.

Defined results: a null or empty text, or one of white space, has the fingerprint of no element, which is like itself and
nothing else; fewer units than k are one k-mer, and fewer elements than a tuple has are taken again; more units than
MOST_UNITS, which would take gigabytes for one row, are an error and never cut off; rows are fingerprinted
each for itself, with whatever ids they repeat or lack; an empty table gives an empty table; columns other than id and
texts are left behind, and may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm._shared import text_of, written

K = 2
ORDER_BITS = 6
ORDERS = 1 << ORDER_BITS
TUPLE = 2
#: Hexadecimal digits of a tuple's hash in the fingerprint.
DIGITS = 8
#: Characters of the longest word that is one unit.
LONGEST = 24
#: Bits of an element's place in the text; above them stands its hash. No Spark row holds a text of so many units with their array.
PLACE_BITS = 27
MOST_UNITS = 1 << PLACE_BITS
_HASH, _PLACE = f"{-MOST_UNITS}L", f"{MOST_UNITS - 1}L"
#: Partitions of the texts for each shuffle partition of the session, as a text takes more room in k-mers.
SPREAD = 4
_BLANKS = r"[\x20\x09-\x0D]+"
#: Characters of scripts that set no blanks between words.
UNBROKEN = r"[\u0E00-\u0EFF\u2E80-\uFFEF]"
_WORDLIKE = r"[^\x20\x09-\x0D\u0E00-\u0EFF\u2E80-\uFFEF]"
UNIT = rf"{_WORDLIKE}{{1,{LONGEST}}}+(?!{_WORDLIKE})|[^\x20\x09-\x0D]"


def _sql(pattern: str) -> str:
    """A pattern within a literal of SQL."""
    return pattern.replace("\\", "\\\\")


def _let(name: str, value: str, body: str) -> str:
    """body with a name for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _elements(text: str, k: int) -> str:
    """A text's k-mers as sorted numbers: bits of its hash, then the place. A k-mer's first occurrence has its own hash, the c-th a hash of that and c."""
    numbered = f"if(size(u) > {MOST_UNITS}, raise_error('a text has more than {MOST_UNITS} units'), xxhash64(x{''.join(f', get(u, i + {j})' for j in range(1, k))}) & {_HASH} | i)"
    # the last k-mer of a text that has fewer units than k lacks some
    kmers = f"sort_array(transform(slice(u, 1, greatest(size(u) - {k - 1}, least(size(u), 1))), (x, i) -> {numbered}))"
    same = lambda a, b: f"(({a}) ^ ({b})) & {_HASH} = 0"
    again = f"filter(s, (x, j) -> j > 0 and {same('x', 's[j - 1]')})"
    first = f"filter(s, (x, j) -> j = 0 or not {same('x', 's[j - 1]')})"
    runs = f"filter(sequence(0, size(d) - 1), j -> j = 0 or not {same('d[j]', 'd[j - 1]')})"
    renamed = f"flatten(transform(r, (b, q) -> transform(slice(d, b + 1, coalesce(get(r, q + 1), size(d)) - b), (x, j) -> xxhash64(x & {_HASH}, j + 2) & {_HASH} | x & {_PLACE})))"
    whole = _let("d", again, f"if(size(d) = 0, s, {_let('r', runs, f'sort_array(concat({first}, {renamed}))')})")
    # where no word is cut, a plain split gives the same units
    cut = f"({text} rlike '{_sql(UNBROKEN)}' or exists(w, x -> length(x) > {LONGEST}))"
    units = _let("w", f"split({text}, '{_sql(_BLANKS)}')", f"if({cut}, regexp_extract_all({text}, '{_sql(UNIT)}', 0), array_remove(w, ''))")
    return _let("u", units, _let("s", kmers, whole))


def _fingerprint(text: str, k: int, size: int) -> Column:
    """Each order's tuple of elements, by their places in the text, hashed."""
    mark = lambda x: f"shiftright({x}, {64 - ORDER_BITS})"
    # the first few after each mark are all that any order selects
    few = f"filter(a, (x, j) -> j < {size} or {mark('x')} <> {mark(f'a[j - {size}]')})"
    begins = f"filter(sequence(0, size(e) - 1), j -> j = 0 or {mark('e[j]')} <> {mark('e[j - 1]')})"
    chosen = [f"e[(j + {i}) % size(e)]" for i in range(size)]
    placed = ", ".join(f"shiftleft({x} & {_PLACE}, {63 - PLACE_BITS}) | shiftrightunsigned({x}, {PLACE_BITS + 1})" for x in chosen)
    hashed = ", ".join(f"z[{i}] & {(1 << 63 - PLACE_BITS) - 1}L" for i in range(size))
    digits = _let("z", f"sort_array(array({placed}))", f"lpad(hex(xxhash64({hashed}) & {(1 << 4 * DIGITS) - 1}L), {DIGITS}, '0')")
    least, top = -(ORDERS // 2), ORDERS // 2 - 1
    row = f"concat(array_join(transform(b, (j, q) -> repeat(c[q], int({mark('e[j]')} - if(q = 0, {least - 1}, {mark('e[b[q - 1]]')})))), ''), repeat(c[0], int({top} - {mark('element_at(e, -1)')})))"
    made = _let("b", begins, _let("c", f"transform(b, j -> {digits})", f"lower({row})"))
    return F.expr(_let("e", _let("a", _elements(text, k), few), f"if(size(e) = 0, repeat('0', {DIGITS * ORDERS}), {made})"))


def likeness(a: Column, b: Column) -> Column:
    """The share of places at which two fingerprints agree, 0 to 1; null if one is null."""
    same = F.filter(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda j: F.substring(a, DIGITS * j + 1, F.lit(DIGITS)) == F.substring(b, DIGITS * j + 1, F.lit(DIGITS)))
    return F.when(a.isNotNull() & b.isNotNull(), F.size(same) / F.lit(float(ORDERS)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_cols: Sequence[str] = ("text",), keep: dict[str, Column] | None = None, k: int = K, tuple_size: int = TUPLE) -> DataFrame:
    """A row for each row of df: id_col, the columns of `keep` by name, and fp_0, fp_1, ... for the texts of text_cols."""
    own = F.col(f"`{id_col}`").cast("long")
    held = df.select(own.alias("i"), *[c.alias(f"k_{n}") for n, c in (keep or {}).items()], *[text_of(df, c).alias(f"t{j}") for j, c in enumerate(text_cols)])
    return held.select(F.col("i").alias(id_col), *[F.col(f"k_{n}").alias(n) for n in keep or {}], *[_fingerprint(f"t{j}", k, tuple_size).alias(f"fp_{j}") for j in range(len(text_cols))])


def next_ids(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next_id): each id with the next in descending order, the last with the first; null ids have none.

    Ids are sorted in ranges; what crosses from range to range is one id for each of them.
    """
    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id is not null").distinct()
    ids = written(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "op5-ids")
    heads = ids.groupBy("part").agg(F.max("id").alias("head"))
    over = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lag("head").over(over), F.max("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    own = F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id")))
    return written(ids.withColumn("own", own).join(heads, "part").select("id", F.coalesce("own", "head").alias("next_id")), "op5-next")


def _cut(text: str) -> str:
    return f"(length({text}) div 3)"


def _edited(head: str) -> Column:
    return F.expr(f"concat(substring(text, 1, length(text) - {_cut('text')}), substring(coalesce({head}, ''), 1, {_cut('text')}))").alias("edited")


def with_edits(df: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, text, edited) of the rows with ids: the last third of a text replaced by as much of the next one's beginning.

    Of rows that share the next id, the beginning that sorts first is taken. Texts are dealt by id once, for both uses.
    """
    n = SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(df, "text").alias("text")).where("doc_id is not null").repartition(n, "doc_id")
    sizes = df.select(F.col("doc_id").cast("long").alias("id"), F.expr("length(coalesce(text, '')) div 3").alias("cut")).groupBy("id").agg(F.max("cut").alias("cut"))
    asked = links.join(sizes, "id").select(F.col("next_id").alias("doc_id"), "id", "cut")
    heads = docs.join(asked, "doc_id").select("id", F.expr("substring(text, 1, cut)").alias("head")).repartition(n, "id").groupBy("id").agg(F.min("head").alias("head"))
    return docs.join(heads.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "text", _edited("head"))


def op5_omh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents`: each text's fingerprint, its edited text's, and their likeness.

    A row without an id has no next text: its edited text lacks the last third, and near_next is 0.
    """
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    links = next_ids(df)
    facts = {"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)}
    without = df.where("doc_id is null").select(F.col("doc_id").cast("long"), text_of(df, "text").alias("text")).select("doc_id", "text", _edited("''"))
    edits = with_edits(df, links).unionByName(without)
    made = written(fingerprints(edits, text_cols=("text", "edited"), keep=facts), "op5-fingerprints")
    after = made.select(F.col("doc_id").alias("next_id"), "fp_0").join(links, "next_id").groupBy("id").agg(F.min("fp_0").alias("next_fp"))
    both = made.join(after.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("fp_0").alias("fingerprint"),
        F.col("fp_1").alias("edited_fingerprint"),
        likeness(F.col("fp_0"), F.col("fp_1")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp_0"), F.col("next_fp")), F.lit(0.0)).alias("near_next"),
    )


QUERIES = {"op5_omh": op5_omh}
SQL: dict[str, str] = {}
