"""The registered queries, every column, against plain versions over a small table of odd texts."""

import functools
import hashlib
import math
import re
import types
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from formloom.llm import op1_bpe, op2_exact, op3_tokens, op4_packing, op5_omh, op6_simhash, op7_pii, op8_shards, op9_toxicity, op10_quality
from formloom.llm._shared import new_folder, tokenizer, tokenizer_json
from tests.llm.test_operators import BASE, ODD, PII, brute_components, likeness, order_minhash, plain, simhash

SPARE = "lang string, source string, n_chars long, name long, shard int, t string, p long"
LONG = ["a" + " " * 1_000_000 + "b", "\t" * 1_000_000, "x\n" + "\n" * 1_000_000, "y" * 1_000_000, "7" * 1_000_000]


@pytest.fixture(scope="module")
def texts():
    extra = ["one more text. It has two sentences, and then some."] * 3 + [" ".join(f"word{i} and" for i in range(k * 40)) + "." for k in range(1, 12)]
    return list(enumerate([*ODD, *PII, *extra]))


@pytest.fixture(scope="module")
def sf(spark, texts):
    path = new_folder(spark, "test-sf")
    spark.createDataFrame([(i, t, "en", None, None, 1, 2, "t", 3) for i, t in texts], "doc_id long, text string, " + SPARE).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def le(ids):
    return np.array(ids, "<u4").tobytes()


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def ids_of(name, text):
    return tokenizer(tokenizer_json(name)).encode(text or "", add_special_tokens=False).ids


def test_op1(spark, sf, texts):
    t = tokenizer(tokenizer_json(op1_bpe.BYTE_BPE))
    want = {}
    for i, x in texts:
        ids = ids_of(op1_bpe.BYTE_BPE, x)
        want[i] = (len(ids), sha(le(ids)), sha(t.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op1_bpe.op1_bpe(spark, sf).collect()} == want


def test_long_runs_of_one_character(spark):
    path = new_folder(spark, "test-long")
    spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    want = {i: [*ids_of(op1_bpe.BYTE_BPE, x)] for i, x in enumerate(LONG)}
    assert {r.doc_id: r.ids_sha256 for r in op1_bpe.op1_bpe(spark, path).collect()} == {i: sha(le(x)) for i, x in want.items()}
    pieces = {}
    for r in op4_packing.op4_packing(spark, path).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, own in want.items():
        own = [*own, 0]
        assert sum(n for _, n, _ in pieces[i]) == len(own)
        assert all(zlib.crc32(le(own[a : a + n])) == crc for a, n, crc in pieces[i])


def test_op2(spark, sf, texts):
    same = {}
    for i, x in texts:
        same.setdefault(plain(x), []).append(i)
    want = {i: (min(own), len(own), i == min(own), sha(x.encode())) for x, own in same.items() for i in own}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op2_exact.op2_exact(spark, sf).collect()} == want


def test_op3(spark, sf, texts):
    want, start = {}, 0
    for i, x in texts:
        ids = [*ids_of(op3_tokens.WORD_BPE, x), 1]
        want[i] = (start, len(ids), zlib.crc32(le(ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op3_tokens.op3_tokens(spark, sf).collect()} == want


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_are_as_stated(spark, sf, tmp_path, encoding):
    path = f"{tmp_path}/tokens"
    op3_tokens.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path, encoding=encoding)
    for f in tmp_path.glob("tokens/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size <= 2 * op3_tokens.ROW_GROUP_BYTES
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.compression == "ZSTD"
                if column.path_in_schema.startswith("tokens"):
                    assert any(("DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in e for e in column.encodings)
                if column.path_in_schema == "doc_id":
                    assert column.has_column_index
    few = op3_tokens.read_tokens(spark, path, 4, 6)
    assert {r.doc_id for r in few.collect()} == {4, 5, 6}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,4)" in plan and "LessThanOrEqual(doc_id,6)" in plan


def test_rows_that_share_an_id_lie_in_the_order_of_their_texts(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(40)] + [(None, "x"), (None, "a")]
    got = []
    for n in (1, 5):
        path = f"{tmp_path}/{n}"
        op3_tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), path)
        got.append(sorted((r.start, r.doc_id is None, tuple(r.tokens)) for r in op3_tokens.read_tokens(spark, path).collect()))
    assert got[0] == got[1]


def test_op4(spark, sf, texts):
    got = op4_packing.op4_packing(spark, sf).collect()
    windows, at = {}, {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
        at.setdefault(r.doc_id, []).append(r)
    for i, x in texts:
        ids, own = [*ids_of(op4_packing.BYTE_BPE, x), 0], sorted(at[i], key=lambda r: r.start)
        assert [r.start for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(le(ids[r.start : r.start + r.length])) for r in own)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))] and sum(p.length for p in own) <= 1024


def test_packing_of_prose(spark):
    """Little is padded, and few windows end within a sentence."""
    draw = np.random.default_rng(4)
    words = ["river", "stone", "meadow", "evening", "cloud", "the", "a", "walks"]
    prose = [" ".join(" ".join(draw.choice(words, draw.integers(4, 25))).capitalize() + "." for _ in range(int(draw.integers(1, 60)))) for _ in range(300)]
    got = op4_packing.pack(spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string").coalesce(1)).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    sizes = [sum(r.length for r in own) for own in windows.values()]
    padded = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    closes, opens = op4_packing._sentence_tokens(tokenizer_json(op4_packing.BYTE_BPE))
    ids = {i: np.array([*ids_of(op4_packing.BYTE_BPE, x), 0]) for i, x in enumerate(prose)}
    within = 0
    for own in windows.values():
        r = max(own, key=lambda r: r.offset)
        e = r.start + r.length
        within += e < r.doc_tokens and not (closes[ids[r.doc_id][e - 1]] and opens[ids[r.doc_id][e]])
    assert padded <= 0.03 * sum(sizes) and within <= 0.1 * len(windows)


def test_op5(spark, sf, texts):
    got = {r.doc_id: r for r in op5_omh.op5_omh(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, x in texts:
        x, after = x or "", texts[i - 1][1] or ""
        cut = len(x) // 3
        edited, r = x[: len(x) - cut] + after[:cut], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), sha(edited.encode()))
        assert r.fingerprint == order_minhash(x) and r.edited_fingerprint == order_minhash(edited)
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == likeness(r.fingerprint, order_minhash(after))


def test_op6(spark, sf, texts):
    prints = [simhash(x) for _, x in texts]
    want = {i: (f"{f:016x}", k) for (i, _), f, k in zip(texts, prints, brute_components(prints, 3), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash.op6_simhash(spark, sf).collect()} == want


@pytest.mark.parametrize("most", [3, 7, 50])
def test_large_buckets_are_compared_in_blocks(spark, most):
    draw = np.random.default_rng(most)
    base = " ".join(f"w{i}" for i in range(90)).split()
    rows = []
    for i in range(60):
        own = list(base)
        for k in draw.choice(90, int(draw.integers(0, 3)), replace=False):
            own[k] = f"e{i}"
        rows.append((i, " ".join(own)))
    prints = [simhash(t) for _, t in rows]
    got = {r.doc_id: r.component_id for r in op6_simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    assert got == dict(enumerate(brute_components(prints, 3)))


def test_op7(spark, sf, texts):
    for r in op7_pii.op7_pii(spark, sf).collect():
        spans = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, texts[r.doc_id][1] or "") if ok(m[0])]
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in BASE]
        assert r.base_sha256 == sha(",".join(listed).encode())
        assert [s for s in r.spans.split(",") if s.split(":")[0] in BASE] == listed


def test_personal_data_in_very_many_places(spark):
    """100,000 spans in one text, in the middle of other characters than ASCII ones, found and replaced as plain Python does."""
    text = " ".join(f"é user{i}@mail{i}.org 🙂 tel 020 7946 {i % 10000:04d}" for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = sorted((s.start, s.end, s.kind, s.text) for s in op7_pii.find(df).first().spans)
    assert len(spans) == 100_000 and all(text[a:b] == t for a, b, _, t in spans)
    want, at = [], 0
    for a, b, kind, _ in spans:
        want.append(f"{text[at:a]}[{kind.upper()}]")
        at = b
    assert op7_pii.redact(df).first().text == "".join(want) + text[at:]


def test_words_nearby_can_speak_against_a_number(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    rows = [(1, iban), (2, f"serial number {iban}"), (3, f"{iban} is the order"), (4, f"iban, for your order: {iban}")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in op7_pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["iban"], 2: [], 3: [], 4: ["iban"]}


def test_overlapping_spans_are_replaced_as_one(spark):
    text = "x 4111 1111 1111 1111@mail.org +4111 1111 1111 1111 1 end"
    r = op7_pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want, at = "", 0
    for s in sorted(r.spans, key=lambda s: (s.start, s.end, s.kind)):
        if s.start >= at:
            want += f"{text[at : s.start]}[{s.kind.upper()}]"
        at = max(at, s.end)
    assert op7_pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == want + text[at:]


def test_op8(spark, sf, texts):
    got = op8_shards.op8_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in texts]
    by = {}
    for r in got:
        raw = (texts[r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize(("before", "after"), [(2, 8), (8, 2), (4, 8)])
def test_shards_whatever_the_splits(spark, before, after):
    path = new_folder(spark, "test-splits")
    spark.range(20_000).selectExpr("id", "cast(id as string) as text").coalesce(1).write.option("parquet.block.size", 20_000).parquet(path)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", before)
        made = op8_shards.shuffle(spark.read.parquet(path), block_rows=100)
        spark.conf.set("spark.sql.files.minPartitionNum", after)
        got = made.select("id", "shard", "slot").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r.id for r in got) == list(range(20_000)) and len({(r.shard, r.slot) for r in got}) == 20_000


def test_shards_are_uniform(spark):
    """A row's shard and slot tell nothing of its place in the input, and the matrix has the law's means and variances."""
    got = op8_shards.shuffle(spark.range(24_000).withColumnRenamed("id", "at").repartition(5), shards=8, block_rows=500).toPandas()
    met = np.histogram2d(got["at"], got["shard"], bins=[12, 8])[0]
    assert ((met - 250) ** 2 / 250).sum() < 77 + 5 * math.sqrt(2 * 77)
    for _, own in got.groupby("shard"):
        assert abs(np.corrcoef(own["at"], own["slot"])[0, 1]) < 5 / math.sqrt(len(own))
    drawn = np.array([op8_shards.matrix([30, 50, 20], 4, seed) for seed in range(3000)])
    assert np.abs(drawn.mean(0) - np.array([[7.5], [12.5], [5.0]])).max() < 0.25
    assert abs(drawn[:, 0, 0].var() - 30 * 0.25 * 0.75 * 70 / 99) < 0.4


def plain_score(net, text):
    """The network's score by loops over words, one hidden state after the other."""
    p, h = net.p, op9_toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    words = re.findall(r"\w+", text.lower())
    logits = []
    for a, b in op9_toxicity.windows(len(words)):
        gates = [net.inputs([w])[0][0] for w in words[a:b]]
        states = {}
        for side, order in (("fwd", range(len(gates))), ("bwd", range(len(gates) - 1, -1, -1))):
            s, own = np.zeros(h), p[side]
            for t in order:
                g = gates[t][: 3 * h] if side == "fwd" else gates[t][3 * h :]
                u = s @ own
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
                states.setdefault(t, {})[side] = s
        both = [np.concatenate([states[t]["fwd"], states[t]["bwd"]]) for t in range(len(gates))]
        e = np.array([np.tanh(x @ p["att"] + p["att0"]) @ p["pick"] for x in both])
        weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(e) else e
        pooled = sum((w * x for w, x in zip(weight, both, strict=True)), np.zeros(2 * h))
        logits.append(float(pooled @ p["out"] + p["out0"][0]))
    x = np.array(logits)
    weight = np.exp(x - x.max())
    return sig((weight / weight.sum()) @ x)


def test_scores_of_toxicity_against_loops(spark, sf, texts):
    net = op9_toxicity.fit([t or "" for _, t in texts[:20]], [i % 2 for i in range(20)], steps=30)
    got = {r.doc_id: r.score for r in op9_toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), net).collect()}
    for i, t in texts:
        if len(t or "") < 4000:
            assert abs(got[i] - plain_score(net, t or "")) < 1e-4, t


def test_scores_of_long_texts_against_loops(monkeypatch):
    """Many windows, of a text that is cut into parts, which must not show in its score."""
    net = op9_toxicity.fit(["calm river stone"] * 10 + ["awful rotten liar"] * 10, [0] * 10 + [1] * 10, steps=20)
    draw = np.random.default_rng(6)
    long = " ".join(draw.choice(["calm", "river", "Stone", "awful", "ROTTEN", "liar", "naïve", "水火"], 3000)) + "\n\tliar"
    assert len(list(op9_toxicity.windows(3001))) > 20 and len(long) > 4000
    whole = op9_toxicity.Scorer(net).scores(["", long, "calm"])
    monkeypatch.setattr(op9_toxicity, "parts_of", functools.partial(op9_toxicity.parts_of, size=700))
    parts = op9_toxicity.Scorer(net).scores(["", long, "calm"])
    assert np.allclose(whole, parts, rtol=0, atol=1e-12)
    monkeypatch.setattr(net, "inputs", functools.lru_cache(lambda w, f=net.inputs: f(list(w))))
    cached = types.SimpleNamespace(p=net.p, inputs=lambda words: net.inputs(tuple(words)))
    assert np.abs(whole - [plain_score(cached, t) for t in ("", long, "calm")]).max() < 1e-4


def test_op9(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(op9_toxicity.fit, "__defaults__", (20, op9_toxicity.SEED))
    got = {r.doc_id: r for r in op9_toxicity.op9_toxicity(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    held = {i: 1 - i % 2 for i, _ in texts if zlib.crc32(str(i).encode()) % 3 == 1}
    spark.createDataFrame([(i, held.get(i, i % 2), held.get(i, i % 2)) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/other/labels.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "'xx' as lang", "'yy' as source", "5L as n_chars").write.parquet(f"{sf}/other/documents.parquet")
    again = {r.doc_id: r.score for r in op9_toxicity.op9_toxicity(spark, f"{sf}/other").collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in got.items())  # held-out labels, lang and source change nothing


def test_a_labelled_id_of_many_rows_is_one_text(spark):
    rows = [(i, f"calm words {i}") for i in range(30)] + [(3, f"copy {k}") for k in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    net = op9_toxicity.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels)
    assert isinstance(net, op9_toxicity.Network)
    from formloom.llm._shared import bounded_sample

    df = spark.createDataFrame(rows, "i long, t string")
    found = bounded_sample(df, spark.createDataFrame([(3, 1), (4, 0), (99, 1)], "i long, label int"), 1000, "test-sample")
    assert sorted((r.i, r.t, r.label) for r in found) == [(3, "calm words 3", 1), (4, "calm words 4", 0)]
    assert len(bounded_sample(df, spark.createDataFrame([(3,), (4,)], "i long"), 13, "test-sample")) == 1


def test_the_strongest_windows_are_learnt_from():
    net = op9_toxicity.Network({}, 3)
    words = [op9_toxicity.PAD, "calm", "river", "bad"]
    table = net.inputs(words)[0]
    text = np.array([1, 2] * 400)
    text[700] = 3
    cut = op9_toxicity._strongest(net, table, [text, np.array([1, 2])], 5)
    every = [(0, a, b) for a, b in op9_toxicity.windows(len(text))]
    logits = op9_toxicity._all_logits(net, table, [text], every, at_a_time=7)
    best = sorted(np.argsort(-logits, kind="stable")[:5].tolist())
    assert cut == [every[i] for i in best] + [(1, 0, 2)]


def test_scores_of_quality_against_loops(spark, sf, texts):
    draw = np.random.default_rng(2)
    make = lambda ok: " ".join(draw.choice(["tree", "river", "stone"] if ok else ["##", "|", "buy"], 30))
    model = op10_quality.fit([(make(i % 2), "en", "s", 90, i % 2) for i in range(80)], [(make(i % 2), None, "s", None) for i in range(20)])
    got = {r.doc_id: r for r in op10_quality.score(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
    sig = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    for i, t in texts:
        t, counts = t or "", {}
        for w in re.findall(r"\w+|[^\w\s]+", t.lower()):
            b = zlib.crc32(w.encode()) % op10_quality.BUCKETS
            counts[b] = counts.get(b, 0) + 1
        x = np.zeros(op10_quality.BUCKETS + op10_quality.STYLES)
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
        for b, n in counts.items():
            x[b] = math.log1p(n) / norm
        x[op10_quality.BUCKETS :] = op10_quality.style(t)
        both = [a * v.logit(own[None])[0] + b for v, (a, b), own in zip(model.views, model.calibration, (x, op10_quality.page(t, "en", None, None)), strict=True)]
        want = [sig(both[0]), sig(both[1]), sig(model.join.logit(np.array([both], np.float32))[0])]
        assert np.allclose([got[i].text_score, got[i].page_score, got[i].score], want, atol=1e-4), t


def plain_style(t):
    """The style features, a character at a time."""
    size = max(1, len(t.encode()))
    width = lambda of: sum(len(c.encode()) for c in t if of(c))
    ascii_ = lambda c: c < "\x80"
    words = t.split()
    many = max(1, len(words))
    letters = width(lambda c: not ascii_(c) or c.isalpha())
    marks = width(lambda c: ascii_(c) and 32 < ord(c) < 127 and not c.isalnum())
    ends = sum(t.count(c) for c in ".!?")
    capitals, digits = width(lambda c: ascii_(c) and c.isupper()), width(lambda c: ascii_(c) and c.isdigit())
    return [letters / size, capitals / size, digits / size, marks / size, t.count("|") / many, ends / many, size / many, len(set(words)) / many, len(set(t.split("\n"))) / (t.count("\n") + 1)]


def plain_page(t, lang, source, n_chars):
    """The page features: six numbers, then where language and source lie among 16 and 48 places."""
    size, lines = max(1, len(t.encode())), t.count("\n") + 1
    doubled = sum(a == b == "\n" for a, b in zip(re.sub(r"[^\n]+", "x", t), re.sub(r"[^\n]+", "x", t)[1:], strict=False))
    out = [math.log(1 + max(0, n_chars or 0)), float(n_chars is None), math.log(1 + lines), math.log(1 + size / lines), doubled / lines, (t.count(" ") + t.count("\t")) / size * 4] + [0] * 64
    out[6 + zlib.crc32(f"lang={lang}".encode()) % 16] = 1
    out[22 + zlib.crc32(f"source={source}".encode()) % 48] = 1
    return out


def test_features_of_quality_against_loops(texts):
    for k, (_, t) in enumerate(texts):
        t, facts = t or "", [("en", "web", 90), (None, None, None), ("de", "x", -3)][k % 3]
        assert np.allclose(op10_quality.style(t), plain_style(t), atol=1e-5), t
        assert np.allclose(op10_quality.page(t, *facts), plain_page(t, *facts), atol=1e-4), t


def test_unlabelled_pages_help(spark):
    """Few labelled pages show few of the words; their sources tell which unlabelled pages are alike, whose words the text view then learns."""
    draw = np.random.default_rng(9)
    # words of one shape, so that style tells nothing
    names = [f"w{i}" for i in draw.permutation(np.arange(1000, 1900))]
    kinds, plain = [names[:400], names[400:800]], names[800:]

    def made(y):
        return " ".join([*draw.choice(plain, 4), *draw.choice(kinds[1 - y], 8)])

    labelled = [(made(y), "en", f"s{y}", 90, y) for y in draw.integers(0, 2, 20).tolist()]
    unlabelled = [(made(i % 2), "en", f"s{i % 2}", 90) for i in range(1200)]
    asked = [(made(i % 2), "en", None, 90) for i in range(400)]
    right = []
    for more in ([], unlabelled):
        scores = op10_quality.fit(labelled, more).score(asked, op10_quality._Buckets())[:, 0]
        good, bad = scores[1::2], scores[::2]
        right.append(((good[:, None] > bad[None]) + (good[:, None] == bad[None]) / 2).mean())
    assert right[1] > right[0] + 0.05 and right[1] > 0.95, right


def test_op10(spark, sf, texts):
    got = op10_quality.op10_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in texts]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got)


def test_parts_of_texts():
    from formloom.llm._shared import parts_of

    for t in ("", "a b  c", "abc" * 50, " x" * 90, "é\n" * 30):
        parts = list(parts_of(t, 7))
        assert "".join(parts) == t and [w for p in parts for w in p.split()] == t.split()


def test_empty_tables(spark):
    path = new_folder(spark, "test-none")
    spark.createDataFrame([], "doc_id long, text string, " + SPARE).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    from formloom.llm import queries

    for name, query in queries.queries().items():
        assert query(spark, path).count() == 0, name


def test_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from formloom.llm import _shared

    class Other:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        _shared.shared_folder(Other())
    assert spark.range(1).select(F.lit(1)).count() == 1
