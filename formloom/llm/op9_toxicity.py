"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word enters as the sum of what it is (an embedding, for words that several training texts have) and how it is spelt
(the mean embedding of its runs of three and five characters); what the gates take from a word is worked out once for each distinct
word. A text is scored in windows of WINDOW words of which STRIDE are new, all of them, to its end. Attention pools the
states of a window into its logit; the windows' logits, weighted by their softmax, make the text's.

The network is fitted on the driver from at most MOST_TOXIC and MOST_CLEAN labelled rows, those whose ids' hashes are
least, of MOST_CHARS characters in all. Of a text of more than MOST_WINDOWS windows a step of the fit learns from those
that the network finds most toxic, as the softmax hardly lets any others count. These bounds are the only ones: every text
is scored whole.

Defined results: a null or empty text, or one without words, is one window without words, scored by the network's bias;
repeated rows are scored each, null ids included; rows with a null label teach nothing, rows labelled twice their
higher label, and of rows that share a labelled id the least text is learnt from; where there are no labels of both kinds, every score is the share of toxic labels (0 without labels);
an empty table gives an empty table; columns other than id and text are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm._shared import bounded_sample, held_out, in_batches, parts_of, rows, slices, text_of

WINDOW, STRIDE = 32, 24
MOST_TOXIC, MOST_CLEAN, MOST_CHARS, MOST_WINDOWS = 1500, 3000, 32_000_000, 64
EMBED, HIDDEN, ATTEND, MOST_WORDS = 8, 8, 8, 20_000
#: Runs of characters that spell a word, and the buckets into which they are hashed.
SIZES, PIECES = (3, 5), 16_384
STEPS, BATCH, RATE, SEED = 700, 32, 0.01, 9
#: From this step on the network is the running average of what the steps give.
AVERAGED_FROM = 300
#: A text is called toxic from this score on.
TOXIC_FROM = 0.7
_WORD = re.compile(r"\w+")
#: Fills up windows; no text has it as a word.
PAD = "\0"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows(n: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the windows of n words."""
    begin = 0
    while True:
        yield begin, min(n, begin + WINDOW)
        if begin + WINDOW >= n:
            return
        begin += STRIDE


def pieces(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' runs of `size` characters (with two marks on each side), and how many each word has."""
    text = "".join(f"\x02\x02{w}\x03\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 4
    h = np.full(len(c) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(1_000_003) + c[k : len(c) - size + 1 + k]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    inside = np.ones(len(c), bool)
    ends = np.cumsum(length)
    for k in range(1, size):  # runs that would reach into the next word
        inside[ends - k] = False
    return (h[inside[: len(h)]] % np.uint64(PIECES)).astype(np.int64), length - size + 1


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gathered(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values that fall on the same place."""
    return np.stack([np.bincount(at, weights=v, minlength=size) for v in values.T], axis=1).astype(np.float32)


class Network:
    """Parameters, scores and gradients."""

    def __init__(self, vocabulary: dict[str, int], seed: int = SEED):
        r, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": 0.3 * r.standard_normal((len(vocabulary) + 1, EMBED)).astype(np.float32),
            "char": 0.3 * r.standard_normal((PIECES, EMBED)).astype(np.float32),
            "in": draw(2 * EMBED, 6 * h),
            "in0": np.zeros(6 * h, np.float32),
            "fwd": draw(h, 3 * h),
            "bwd": draw(h, 3 * h),
            "att": draw(2 * h, ATTEND),
            "att0": np.zeros(ATTEND, np.float32),
            "pick": draw(ATTEND),
            "out": draw(2 * h),
            "out0": np.full(1, -2, np.float32),
        }

    def inputs(self, words: list[str], forget: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """What each word gives the gates of both directions."""
        known = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        if forget is not None:
            known[forget] = 0
        own = [pieces(words, size) for size in SIZES]
        n = sum(k for _, k in own)
        spelt = sum(np.add.reduceat(self.p["char"][b], np.cumsum(k) - k, axis=0) for b, k in own) / n[:, None]
        x = np.concatenate([self.p["word"][known], spelt], axis=1).astype(np.float32)
        return x @ self.p["in"] + self.p["in0"], (known, own, n, x)

    def _run(self, gates: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction. gates: time x windows x 3 hidden."""
        h, size = np.zeros((gates.shape[1], HIDDEN), np.float32), HIDDEN
        out, past = np.empty((*gates.shape[:2], size), np.float32), []
        for t in range(len(gates)):
            from_h = h @ u
            zr = _sigmoid(gates[t, :, : 2 * size] + from_h[:, : 2 * size])
            z, r = zr[:, :size], zr[:, size:]
            new = np.tanh(gates[t, :, 2 * size :] + r * from_h[:, 2 * size :])
            m = mask[t][:, None]
            if keep:
                past.append((h, z, r, new, from_h[:, 2 * size :]))
            h = h + m * (1 - z) * (new - h)
            out[t] = h
        return out, past

    def logits(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """A logit for each window. index, mask: time x windows."""
        p, h = self.p, HIDDEN
        gates = table[index]
        fwd, past_f = self._run(gates[:, :, : 3 * h], p["fwd"], mask, keep)
        bwd, past_b = self._run(gates[::-1, :, 3 * h :], p["bwd"], mask[::-1], keep)
        states = np.concatenate([fwd, bwd[::-1]], axis=2)
        u = np.tanh(states @ p["att"] + p["att0"])
        e = np.where(mask > 0, u @ p["pick"], -1e9)
        a = np.exp(e - e.max(0)) * mask
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return pooled @ p["out"] + p["out0"][0], (past_f, past_b, states, u, a, pooled)

    def gradients(self, table_parts: tuple, rows_of_table: int, index: np.ndarray, mask: np.ndarray, kept: tuple, d_logit: np.ndarray) -> dict:
        """By back-propagation through time."""
        p, h = self.p, HIDDEN
        past_f, past_b, states, u, a, pooled = kept
        g = {"out": pooled.T @ d_logit, "out0": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = a[:, :, None] * d_pooled
        d_a = np.einsum("tbh,bh->tb", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["pick"] = np.einsum("tb,tbk->k", d_e, u)
        d_u = d_e[:, :, None] * p["pick"] * (1 - u * u)
        g["att"] = np.einsum("tbh,tbk->hk", states, d_u)
        g["att0"] = d_u.sum((0, 1))
        d_states += d_u @ p["att"].T
        d_gates = np.empty((*index.shape, 6 * h), np.float32)
        g["fwd"] = self._back(past_f, p["fwd"], mask, d_states[:, :, :h], d_gates[:, :, : 3 * h])
        g["bwd"] = self._back(past_b, p["bwd"], mask[::-1], d_states[::-1, :, h:], d_gates[::-1, :, 3 * h :])
        d_table = _gathered(index.ravel(), d_gates.reshape(-1, 6 * h) * mask.reshape(-1, 1), rows_of_table)
        known, own, n, x = table_parts
        g["in"], g["in0"] = x.T @ d_table, d_table.sum(0)
        d_x = d_table @ p["in"].T
        g["word"] = _gathered(known, d_x[:, :EMBED], len(p["word"]))
        each = d_x[:, EMBED:] / n[:, None]
        g["char"] = sum(_gathered(bucket, np.repeat(each, k, axis=0), PIECES) for bucket, k in own)
        return g

    @staticmethod
    def _back(past: list, u: np.ndarray, mask: np.ndarray, d_out: np.ndarray, d_gates: np.ndarray) -> np.ndarray:
        size, d_u = HIDDEN, np.zeros_like(u)
        d_h = np.zeros_like(past[0][0])
        for t in range(len(past) - 1, -1, -1):
            h, z, r, new, from_h = past[t]
            m = mask[t][:, None]
            d = (d_h + d_out[t]) * m
            d_h = (d_h + d_out[t]) * (1 - m) + d * z
            d_z = d * (h - new) * z * (1 - z)
            d_n = d * (1 - z) * (1 - new * new)
            d_r = d_n * from_h * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_from = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_u += h.T @ d_from
            d_h = d_h + d_from @ u.T
        return d_u


def _cut(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(text, begin, end) of the windows of texts of so many words."""
    return [(k, a, b) for k, n in enumerate(sizes) for a, b in windows(n)]


def _filled(texts: list[np.ndarray], cut: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts of word numbers as index and mask (time x windows)."""
    index, mask = np.zeros((len(cut), WINDOW), np.int64), np.zeros((len(cut), WINDOW), np.float32)
    for i, (k, a, b) in enumerate(cut):
        index[i, : b - a] = texts[k][a:b]
        mask[i, : b - a] = 1
    return index.T.copy(), mask.T.copy()


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows as index and mask (time x windows), and the text of each window."""
    cut = _cut([len(x) for x in texts])
    return *_filled(texts, cut), np.array([k for k, _, _ in cut])


def _all_logits(net: Network, table: np.ndarray, texts: list[np.ndarray], cut: list[tuple[int, int, int]], at_a_time: int = 1024) -> np.ndarray:
    """Logits of windows, which are laid out some at a time."""
    return np.concatenate([net.logits(table, *_filled(texts, cut[i : i + at_a_time]))[0] for i in range(0, len(cut), at_a_time)])


def _strongest(net: Network, table: np.ndarray, texts: list[np.ndarray], most: int) -> list[tuple[int, int, int]]:
    """The texts' windows, of each text at most so many: those of the highest logits."""
    out = []
    for k, x in enumerate(texts):
        own = [(k, a, b) for a, b in windows(len(x))]
        if len(own) > most:
            order = np.argsort(-_all_logits(net, table, texts, own), kind="stable")
            own = [own[i] for i in np.sort(order[:most]).tolist()]
        out += own
    return out


def _pooled(logits: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' logits and the windows' weights in them. Windows of a text are neighbours."""
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    top = np.maximum.reduceat(logits, begin)[text]
    weight = np.exp(logits - top)
    weight /= np.add.reduceat(weight, begin)[text]
    return np.add.reduceat(weight * logits, begin), weight


def fit(texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam on the texts' log loss; now and then a word is taken for an unknown one, so that spelling counts as well."""
    draw = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    seen: dict[str, int] = {}
    for own in split:
        for w in set(own):
            seen[w] = seen.get(w, 0) + 1
    common = sorted((w for w, n in seen.items() if n > 2), key=lambda w: (-seen[w], w))[:MOST_WORDS]
    net = Network({w: i + 1 for i, w in enumerate(common)}, seed)
    label = np.array(toxic, np.float32)
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    average = {k: v.copy() for k, v in net.p.items()}
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, len(split)):
            order = draw.permutation(len(split))
        own, order = order[:BATCH], order[BATCH:]
        number: dict[str, int] = {PAD: 0}
        coded = [np.array([number.setdefault(w, len(number)) for w in split[k]], np.int64) for k in own]
        table, parts = net.inputs(list(number), draw.random(len(number)) < 0.1)
        cut = _strongest(net, table, coded, MOST_WINDOWS)
        index, mask = _filled(coded, cut)
        text = np.array([k for k, _, _ in cut])
        logits, kept = net.logits(table, index, mask, keep=True)
        pooled, weight = _pooled(logits, text)
        d = (_sigmoid(pooled) - label[own]) / len(own)
        d_logit = (d[text] * weight * (1 + logits - pooled[text])).astype(np.float32)
        grads = net.gradients(parts, len(table), index, mask, kept, d_logit)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1, 1 / (norm + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            net.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8) + 1e-3 * rate * net.p[k] * (k in ("word", "char"))
            average[k] += (1.0 if step < AVERAGED_FROM else 0.01) * (net.p[k] - average[k])
    net.p = average
    return net


class Scorer:
    """Scores texts, and remembers what distinct words give the gates, a bounded number of them."""

    MOST = 150_000

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {PAD: 0}
        self.table = self.net.inputs([PAD])[0]
        self.used = 1

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers in the table, which gets those that it lacks."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            made = self.net.inputs(new)[0]
            self.number.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.used : self.used + len(new)] = made
            self.used += len(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.used > self.MOST:
            self.forget()
        coded = [np.concatenate([self.numbers(words_of(part)) for part in parts_of(t)]) for t in texts]
        cut = _cut([len(x) for x in coded])
        logits = _all_logits(self.net, self.table, coded, cut)
        return _sigmoid(_pooled(logits.astype(np.float64), np.array([k for k, _, _ in cut]))[0])


def _scoring(net: Network):
    schema = pa.schema([("i", pa.int64()), ("score", pa.float64())])

    def made(batches):
        scorer, ids, texts, size = Scorer(net), [], [], 0

        def out():
            return zip(ids, scorer.scores(texts).tolist(), strict=True)

        for i, t in rows(batches):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= 1 << 18:
                yield from out()
                ids, texts, size = [], [], 0
        if ids:
            yield from out()

    return lambda batches: in_batches(made(batches), schema, lambda r: 64)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | float:
    """The network from a bounded sample of labelled rows; the share of toxic labels if they are all of one kind."""
    known = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").alias("label")).where(F.col("label").isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("label").alias("label"))
    least = [known.where(F.col("label") == v).orderBy(F.xxhash64(id_col), id_col).limit(n) for v, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    texts = df.select(F.col(f"`{id_col}`").alias("i"), text_of(df, text_col).alias("t"))
    asked = least[0].union(least[1]).select(F.col(id_col).alias("i"), "label")
    found = sorted((r["label"], r["i"], r["t"]) for r in bounded_sample(texts, asked, MOST_CHARS, "op9-sample"))
    toxic = [int(label) for label, _, _ in found]
    if len(set(toxic)) < 2:
        return float(np.mean(toxic)) if toxic else 0.0
    return fit([t for _, _, t in found], toxic)


def score(df: DataFrame, net: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for each row of df."""
    if isinstance(net, float):
        return df.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.lit(net).alias("score"))
    return df.select(F.col(f"`{id_col}`").cast("long"), text_of(df, text_col)).mapInArrow(_scoring(net), f"`{id_col}` long, score double")


def reject(df: DataFrame, net: Network | float, text_col: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """df without the rows whose texts score toxic_from or more; all columns stay as they are."""
    if isinstance(net, float):
        return df.where(F.lit(net < toxic_from))
    at = df.columns.index(text_col)

    def kept(batches):
        scorer = Scorer(net)
        for b in slices(batches):
            if b.num_rows:
                yield b.filter(pa.array(scorer.scores([t or "" for t in b.column(at).to_pylist()]) < toxic_from))

    return df.mapInArrow(kept, df.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents`, scored by a network fitted on the rows that aren't held out."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = score(df, train(df, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
