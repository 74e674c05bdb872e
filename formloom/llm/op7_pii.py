"""Personal data in texts, in DataFrame operations only.

Regular expressions propose spans; validators confirm them: parts of an IP address, Luhn's digit for cards, mod 97 for
IBANs, the number of digits of phones. Words near a span, on both sides, adjust its score up or down. Spans of the four
base kinds that pass their validators always stay; IBANs and phone numbers without a country's code stay or go by their scores.

Patterns are written so that Java's matcher needs no recursion and no second look at a run of characters: their
repetitions are possessive where giving back can't help, and a run is entered at its first character only. What is done
for all spans of a text is done in blocks of spans, and characters are looked up in parts of the text, so that the work
grows with the text and its spans and not with their product.

Defined results: null and empty texts have no spans; texts of any length are searched whole; repeated rows are returned
each, null ids included; an empty table gives an empty table; columns other than id and text are left behind by
find(), and kept as they are by redact(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm._shared import text_of

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE = KINDS[:4]
_LOCAL = "A-Za-z0-9._%+-"
#: Words that speak against a number's being a person's.
_OTHER = "order|serial|part no|model|sku|invoice|tracking|version"
#: kind: (what a text must match to be searched, pattern, score, words nearby that raise it, words that lower it)
PATTERNS = {
    "email": ("@", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write|reach", None),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|server|host|address|login|node", _OTHER),
    "card": (r"[0-9](?:[ -]?[0-9]){15}", r"[0-9](?:[ -]?[0-9]){15,}+", 0.8, "card|credit|visa|master|pay|debit", _OTHER),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|tel|call|fax|mobile|dial", _OTHER),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, "iban|account|bank|transfer", _OTHER),
    "local_phone": (r"[0-9]{3}[ -]?[0-9]{3}", r"(?<![0-9+.)-])\(?[0-9]{3,5}\)?[ -][0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9.-])", 0.3, "phone|tel|call|fax|mobile|dial", _OTHER),
}
#: What a word nearby adds to a score or takes from it, the characters in front of a span and behind it that are near it, and the score from which an added span stays.
CONTEXT_SCORE, CONTEXT_CHARS, ADDED_FROM = 0.3, 40, 0.6
#: Characters in a part of a text, and spans in a block.
PART, BLOCK = 512, 256


def _sql(text: str) -> str:
    """A pattern as a literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


#: Conditions on a proposal m; the leftmost longest match is judged once, and nothing shorter is tried.
_VALID = {
    "email": "true",
    "ip": "forall(split(m, '\\\\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    # every second digit from the right counts double, with nine taken off beyond nine
    "card": f"length({_digits('m')}) between 16 and 19 and aggregate(transform(split(reverse({_digits('m')}), ''), (d, i) -> if(i % 2 = 0, int(d), if(int(d) > 4, 2 * int(d) - 9, 2 * int(d)))), 0, (a, x) -> a + x) % 10 = 0",
    "phone": f"length({_digits('m')}) between 8 and 15",
    # the first four characters go to the end, letters count from ten
    "iban": "aggregate(transform(split(concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4)), ''), c -> if(c between '0' and '9', int(c), ascii(c) - 55)), 0, (a, x) -> (a * if(x > 9, 100, 10) + x) % 97) = 1",
    "local_phone": f"length({_digits('m')}) between 9 and 12",
}


def _let(name: str, value: str, body: str) -> str:
    """body with a name for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(items: str, zero: str, step: str, each: str, made: str, join: str) -> str:
    """An array with `each`, of the type `made`, for every item x, given the state a before it; `step` is the state after it.

    Items are folded in blocks, since an array that grows is copied with every item; `join` is the state after a block (x)
    that began at a.
    """
    blocks = f"transform(sequence(0, size(items) div {BLOCK}), k -> slice(items, k * {BLOCK} + 1, {BLOCK}))"
    local = f"transform({blocks}, block -> aggregate(block, {zero}, (a, x) -> {step}))"
    before = f"aggregate(ends, named_struct('a', {zero}, 'all', cast(array() as array<int>)), (s, x) -> named_struct('a', {_let('a', 's.a', join)}, 'all', concat(s.all, array(s.a))), s -> s.all)"
    inner = f"aggregate(block, named_struct('a', o, 'all', cast(array() as array<{made}>)), (s, x) -> named_struct('a', {_let('a', 's.a', step)}, 'all', concat(s.all, array({_let('a', 's.a', each)}))), s -> s.all)"
    whole = f"flatten(transform({blocks}, (block, k) -> {_let('o', 'starts[k]', inner)}))"
    return _let("items", items, _let("ends", local, _let("starts", before, whole)))


def _chars(first: str, n: str) -> str:
    """n characters of the text from place `first` (0 is the first) on, from its parts p."""
    one = f"substring(p[({first}) div {PART}], ({first}) % {PART} + 1, {n})"
    last = f"(({first}) + ({n}) - 1) div {PART}"
    more = f"array_join(transform(sequence(({first}) div {PART}, least({last}, size(p) - 1)), k -> if(k = ({first}) div {PART}, substring(p[k], ({first}) % {PART} + 1), if(k = {last}, substring(p[k], 1, (({first}) + ({n}) - 1) % {PART} + 1), p[k]))), '')"
    return f"if(({n}) <= 0 or ({first}) div {PART} >= size(p), '', if({last} = ({first}) div {PART}, {one}, {more}))"


def _spans(kind: str) -> str:
    """The kind's spans in column `t`, whose parts are `p`. Between matches lie the parts into which they split the text; lengths add up to places."""
    asked, pattern, score, words, against = PATTERNS[kind]
    q = _sql(pattern)
    # an array of lengths before each match, and one of places
    found = f"arrays_zip(transform(split(t, {q}, -1), g -> length(g)), m)"
    items = f"transform(slice({found}, 1, size(m)), z -> named_struct('gap', z['0'], 'n', length(z['m']), 'm', z['m']))"
    each = "named_struct('start', a + x.gap, 'end', a + x.gap + x.n, 'text', x.m)"
    placed = _let("m", f"regexp_extract_all(t, {q}, 0)", f"if(size(m) = 0, null, {_running(items, '0', 'a + x.gap + x.n', each, 'struct<start:int,end:int,text:string>', 'a + x')})")
    valid = f"filter({placed}, s -> exists(array(s.text), m -> {_VALID[kind]}))"
    near = _let("b", f"lower({_chars(f'greatest(s.start - {CONTEXT_CHARS}, 0)', f'least(s.start, {CONTEXT_CHARS})')})", _let("e", f"lower({_chars('s.end', str(CONTEXT_CHARS))})", "{}"))
    says = lambda what: f"(b rlike {_sql(f'(?:{what})')} or e rlike {_sql(f'(?:{what})')})"
    lowered = f" - if({says(against)}, {CONTEXT_SCORE}D, 0D)" if against else ""
    made = near.format(f"{score}D + if({says(words)}, least({CONTEXT_SCORE}D, 1D - {score}D), 0D){lowered}")
    scored = f"transform({valid}, s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.end, 'text', s.text, 'score', {made}))"
    if kind not in BASE:
        scored = f"filter({scored}, s -> s.score >= {ADDED_FROM}D)"
    none = "cast(array() as array<struct<kind:string,start:int,end:int,text:string,score:double>>)"
    return f"if(t rlike {_sql(asked)}, coalesce({scored}, {none}), {none})"


def _found(df: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """`more`, the text t, its parts p and its spans."""
    texts = df.select(*more, text_of(df, text_col).alias("t"))
    parts = F.expr(f"regexp_extract_all(t, '(?s).{{1,{PART}}}', 0)").alias("p")
    return texts.select("*", parts).select("*", F.concat(*[F.expr(_spans(k)) for k in KINDS]).alias("spans"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): kind, start and end in code points (end exclusive), text and score, by kind and then by start."""
    return _found(df, text_col, F.col(f"`{id_col}`").alias("i")).select(F.col("i").alias(id_col), "spans")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each span in text_col replaced by its kind in brackets; spans that overlap are replaced as one. A null stays null."""
    found = _found(df, text_col, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))
    ordered = "array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    # with each span the end of those before it; a span that begins there or later is replaced, with what lies between
    after = _running(ordered, "0", "greatest(a, x.end)", "named_struct('from', a, 'to', x.start, 'end', x.end, 'kind', x.kind)", "struct<from:int,to:int,end:int,kind:string>", "greatest(a, x)")
    pieces = f"transform(filter(after, s -> s.to >= s.from), s -> concat({_chars('s.from', 's.to - s.from')}, '[', upper(s.kind), ']'))"
    end = "array_max(transform(spans, s -> s.end))"
    rest = _let("z", end, _chars("z", "n - z"))
    whole = _let("n", "length(t)", _let("after", after, f"concat(array_join({pieces}, ''), {rest})"))
    made = found.select("r", F.expr(f"if(size(spans) > 0, {whole}, r.`{text_col}`)").alias("made"))
    return made.select(*[(F.col("made") if c == text_col else F.col(f"r.`{c}`")).alias(c) for c in df.columns])


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the whole table `documents`."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = "filter(spans, s -> s.kind in ({}))".format(", ".join(f"'{k}'" for k in BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(_listed(base)), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
SQL: dict[str, str] = {}
