"""Quality by co-training of two views, in numpy.

One classifier sees a document's content: its words and marks, hashed, and their shares and repetition. The other sees the page it came as: language,
source, length and layout (lines and blanks), and none of its words. Both are logistic regressions. Over some
rounds each labels the unlabelled documents of which it is most confident, as many of each label as that label's share
asks for, and the other learns from them. Each view is then calibrated on labelled rows that it hasn't learnt from, and
the calibrated logits are combined by one more regression into the score of every document.

Fitting takes at most MOST_LABELLED labelled and MOST_UNLABELLED unlabelled rows, those whose ids' hashes are least, of
MOST_CHARS characters in all on each side; every document is scored, on its whole text.

Defined results: a null or empty text has content without words and is scored like others; null metadata are a value of
their own; repeated rows are scored each, null ids included; rows with a null label teach nothing, rows labelled twice
their higher label, and of rows that share an id the least is learnt from; where the labels are all of one kind, every score is their mean (1 without labels: all are kept);
an empty table gives an empty table; columns other than those named are never read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm._shared import bounded_sample, held_out, in_batches, parts_of, rows, text_of

MOST_LABELLED, MOST_UNLABELLED, MOST_CHARS = 3000, 2000, 32_000_000
BUCKETS, STYLES, ROUNDS, SHARE, STEPS, SEED = 4096, 9, 4, 0.05, 250, 10
KEEP_FROM = 0.5
#: Features of a page: its numbers, and codes of language and source.
PAGES = 6 + 16 + 48
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Buckets(dict):
    """A word's bucket; known words are forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        b = self[word] = zlib.crc32(word.encode()) % BUCKETS
        return b


def content(texts: list[str], buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of the texts' words and marks; the squares of a text's weights sum up to one."""
    held = [np.empty((2, 0), np.int64)]
    for k, text in enumerate(texts):
        for part in parts_of(text):
            found = _TOKEN.findall(part.lower())
            at, n = np.unique(np.fromiter(map(buckets.__getitem__, found), np.int64, len(found)), return_counts=True)
            held.append(np.stack([k * BUCKETS + at, n]))
    place, n = np.concatenate(held, axis=1)
    place, back = np.unique(place, return_inverse=True)
    w = np.log1p(np.bincount(back, weights=n, minlength=len(place)))
    row = place // BUCKETS
    return row, place % BUCKETS, (w / np.sqrt(np.bincount(row, weights=w * w, minlength=len(texts)))[row]).astype(np.float32)


def style(text: str) -> np.ndarray:
    """Shares of kinds of characters in a text, and how much of it is new."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n, c, words, lines = max(1, len(raw)), np.bincount(raw, minlength=256), text.split(), text.split("\n")
    many = max(1, len(words))
    capitals, digits = c[65:91].sum(), c[48:58].sum()
    letters, marks = capitals + c[97:123].sum() + c[128:].sum(), c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    ends = c[46] + c[33] + c[63]
    return np.array([letters / n, capitals / n, digits / n, marks / n, c[124] / many, ends / many, n / many, len(set(words)) / many, len(set(lines)) / len(lines)], np.float32)


def page(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Numbers and one-of-many codes of a page: its size, layout, language and source."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n, breaks = max(1, len(raw)), np.flatnonzero(raw == 10)
    lines = len(breaks) + 1
    numbers = [
        np.log1p(max(0, n_chars or 0)),
        float(n_chars is None),
        np.log1p(lines),
        np.log1p(n / lines),
        np.count_nonzero(np.diff(breaks) == 1) / lines,
        np.count_nonzero((raw == 32) | (raw == 9)) / n * 4,
    ]
    coded = np.zeros(64, np.float32)
    coded[zlib.crc32(f"lang={lang}".encode()) % 16] = 1
    coded[16 + zlib.crc32(f"source={source}".encode()) % 48] = 1
    return np.concatenate([np.array(numbers, np.float32), coded])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    """Logistic regression by Adam, with weights decayed. Features from `dense` on are standardised, those before are sparse."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dense: int = 0, decay: float = 1e-3, steps: int = STEPS):
        self.mean = np.concatenate([np.zeros(dense, np.float32), x[:, dense:].mean(0)])
        self.sd = np.concatenate([np.full(dense, 1 / 8, np.float32), x[:, dense:].std(0) + 1e-2])
        self.dense = dense
        draw = np.random.default_rng(SEED)
        self.w, self.b = np.zeros(x.shape[1], np.float32), 0.0
        m, v, mb, vb = np.zeros_like(self.w), np.zeros_like(self.w), 0.0, 0.0
        for t in range(1, steps + 1):
            own = draw.integers(0, len(x), 256)
            z = (x[own] - self.mean) / self.sd
            d = (_sigmoid(z @ self.w + self.b) - y[own]) / len(own)
            g, gb = z.T @ d + decay * self.w, d.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            rate = 0.05 * min(1, 2 * (1 - t / (steps + 1))) / (1 - 0.9**t)
            self.w = (self.w - rate * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            self.b -= rate * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.sd) @ self.w + self.b

    def sparse(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, more: np.ndarray) -> np.ndarray:
        """The logits of rows whose sparse features are given by place; more: the others."""
        k = self.dense
        return np.bincount(row, weights=weight / self.sd[at] * self.w[at], minlength=len(more)) + ((more - self.mean[k:]) / self.sd[k:]) @ self.w[k:] + self.b


class Model:
    """Two views and how they are put together."""

    def __init__(self, views: list[Logistic], calibration: list[tuple[float, float]], join: Logistic):
        self.views, self.calibration, self.join = views, calibration, join

    def score(self, pages: list[tuple], buckets: _Buckets) -> np.ndarray:
        """The two views' scores and the joint one, for each (text, lang, source, n_chars)."""
        raw = (self.views[0].sparse(*content([r[0] for r in pages], buckets), np.array([style(r[0]) for r in pages])), self.views[1].logit(np.array([page(*r) for r in pages], np.float32)))
        own = np.stack([a * x + b for (a, b), x in zip(self.calibration, raw, strict=True)], axis=1)
        return np.column_stack([_sigmoid(own), _sigmoid(self.join.logit(own.astype(np.float32)))])


def _platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make logits honest, by Newton's steps; counts of both labels are raised by one, and the slope is held near one."""
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(30):
        p = _sigmoid(a * logits + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - goal) * logits).sum() + a - 1, (p - goal).sum()])
        h = np.array([[(w * logits * logits).sum() + 1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(labelled: list[tuple], unlabelled: list[tuple], rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """labelled: (text, lang, source, n_chars, label); unlabelled: without label. Every fourth labelled row calibrates."""
    buckets = _Buckets()

    def views(found: list[tuple]) -> list[np.ndarray]:
        x = np.zeros((len(found), BUCKETS + STYLES), np.float32)
        row, at, w = content([r[0] for r in found], buckets)
        x[row, at] = w
        for i, r in enumerate(found):
            x[i, BUCKETS:] = style(r[0])
        return [x, np.array([page(*r[:4]) for r in found], np.float32).reshape(-1, PAGES)]

    y = np.array([r[4] for r in labelled], np.float32)
    calibrates = np.arange(len(y)) % 4 == 3
    for side in (calibrates, ~calibrates):
        if len(set(y[side])) < 2:  # too few to set rows apart
            calibrates = np.zeros(len(y), bool)
            break
    x, pool = views(labelled), views(unlabelled)
    learn = [(v[~calibrates], y[~calibrates]) for v in x]
    free = [np.ones(len(unlabelled), bool) for _ in x]
    rate = float(y.mean())
    for n in range(rounds + 1):
        made = [Logistic(*learn[k], dense=(BUCKETS, 0)[k]) for k in range(2)]
        if n == rounds or not len(unlabelled):
            break
        for k in range(2):  # what view k is sure of, the other learns
            logits = made[k].logit(pool[k])
            order = np.argsort(logits)
            take = max(1, round(share * len(order)))
            for label, own in ((1, order[::-1][: max(1, round(take * rate))]), (0, order[: max(1, round(take * (1 - rate)))])):
                own = own[free[1 - k][own] & ((logits[own] > 0) == bool(label))]
                free[1 - k][own] = False
                lx, ly = learn[1 - k]
                learn[1 - k] = (np.concatenate([lx, pool[1 - k][own]]), np.concatenate([ly, np.full(len(own), label, np.float32)]))
    judge = calibrates if calibrates.any() else np.ones(len(y), bool)
    logits = [made[k].logit(x[k][judge]) for k in range(2)]
    calibration = [_platt(v, y[judge]) for v in logits]
    both = np.stack([a * v + b for (a, b), v in zip(calibration, logits, strict=True)], axis=1).astype(np.float32)
    return Model(made, calibration, Logistic(both, y[judge]))


def _scoring(model: Model):
    schema = pa.schema([("i", pa.int64()), ("text_score", pa.float64()), ("page_score", pa.float64()), ("score", pa.float64())])

    def made(batches):
        buckets, held, size = _Buckets(), [], 0

        def out():
            return ((i, *made) for (i, *_), made in zip(held, model.score([r[1:] for r in held], buckets).tolist(), strict=True))

        for r in rows(batches):
            held.append(r)
            size += len(r[1])
            if size >= 1 << 18:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return lambda batches: in_batches(made(batches), schema, lambda r: 64)


def _seen(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, chars_col: str) -> DataFrame:
    own = {"i": (id_col, "long"), "lang": (lang_col, "string"), "source": (source_col, "string"), "n_chars": (chars_col, "long")}
    named = {n: F.col(f"`{c}`").cast(t).alias(n) for n, (c, t) in own.items()}
    return df.select(named["i"], text_of(df, text_col).alias("t"), named["lang"], named["source"], named["n_chars"])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality") -> Model | float:
    """The model from bounded samples; the labels' mean if they are all of one kind, 1 if there are none."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{label_col}`").alias("label")).where("label is not null and i is not null").groupBy("i").agg(F.max("label").alias("label"))
    some = known.where(~held_out("i")).orderBy(F.xxhash64("i"), "i").limit(MOST_LABELLED)
    seen = _seen(df, id_col, text_col, lang_col, source_col, chars_col)
    pages = lambda found: sorted(((r["i"], r["t"], r["lang"], r["source"], r["n_chars"]) for r in found), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    taken = bounded_sample(seen, some, MOST_CHARS, "op10-labelled")
    label = {r["i"]: int(r["label"]) for r in taken}
    kinds = set(label.values())
    if len(kinds) < 2:
        return float(kinds.pop()) if kinds else 1.0
    rest = seen.select("i").where("i is not null").join(known, "i", "left_anti").distinct().orderBy(F.xxhash64("i"), "i").limit(MOST_UNLABELLED)
    free = pages(bounded_sample(seen, rest, MOST_CHARS, "op10-unlabelled"))
    return fit([(*r[1:], label[r[0]]) for r in pages(taken)], [r[1:] for r in free])


def score(df: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """(id_col, text_score, page_score, score) for each row of df."""
    seen = _seen(df, id_col, text_col, lang_col, source_col, chars_col)
    if isinstance(model, float):
        return seen.select(F.col("i").alias(id_col), *[F.lit(model).alias(c) for c in ("text_score", "page_score", "score")])
    return seen.mapInArrow(_scoring(model), f"`{id_col}` long, text_score double, page_score double, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents`, scored; those from KEEP_FROM on are kept."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = score(df, train(df, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return made.select("doc_id", held_out().alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
