"""Each operator against a brute-force version, over nulls, empty and long texts, repeated rows, ties and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from formloom.llm import op1_bpe, op2_exact, op3_tokens, op4_packing, op5_omh, op6_simhash, op7_pii, op8_shards, op9_toxicity, op10_quality
from formloom.llm._shared import Coder, new_folder, tokenizer, tokenizer_json

ODD = [
    "", None, " ", "\n", "a  b", "a \t b", " lead", "don't  'tis we'll  x", "<|endoftext|> x <|endoftext|>y", "é́ é x wordő őword naïve",
    "\t\tx \n y\n\nz \n\n ", "日本語 テキスト。 123 4a", "x" * 5000, "word " * 9000, "a\x85b \x1c c", "🙂 🙂x", "a\nB\nc.\nD\r\nE", "ſ K ª º µ x ²³",
    "The cat sat on the mat and looked at the moon for a while.", "The cat sat on the mat and looked at the moon for a while.", "the Cat sat on the mat and looked  at the moon for a while.",
    "mail me: jo.doe@mail.example.org or 192.168.0.1, card 4111 1111 1111 1111, call +49 30 1234567",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name long, block string, shard int, fp string, doc long"


@pytest.fixture
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "src", None, i, "b", 1, "f", 7) for i, t in enumerate(ODD)]
    rows += [rows[18], (None, "The cat sat", None, None, None, 0, None, None, None, None), (None, None, None, None, None, 0, None, None, None, None)]
    path = new_folder(spark, "test-docs")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def key(x):
    return (x is None, x)


def test_bpe_equals_the_tokenizer_and_goes_round(docs, empty):
    t = tokenizer(tokenizer_json(op1_bpe.BYTE_BPE))
    want = sorted(((i, t.encode(x, add_special_tokens=False).ids) for i, x in texts(docs)), key=lambda r: (key(r[0]), r[1]))
    got = op1_bpe.decode(op1_bpe.encode(docs, block_chars=40, buckets=8)).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=lambda r: (key(r[0]), r[1])) == want
    assert sorted((r.decoded for r in got)) == sorted(x for _, x in texts(docs))
    assert op1_bpe.encode(empty).count() == 0


def test_decode_nulls_and_broken_bytes(spark):
    got = op1_bpe.decode(spark.createDataFrame([(1, None, "old"), (2, [188, 40], "old"), (3, [], "old")], "doc_id long, ids array<int>, decoded string")).orderBy("doc_id").collect()
    t = tokenizer(tokenizer_json(op1_bpe.BYTE_BPE))
    assert [r.decoded for r in got] == [None, t.decode([188, 40], skip_special_tokens=False), ""]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_coder_equals_the_tokenizer(name):
    c = Coder(tokenizer_json(name))
    assert c.fast is not None
    t = tokenizer(c.content)
    for x in [x for x in ODD if x] + ["It's John's; they'll 12.5% «été» — “q” 'Ll 'S", "à la\r\n\r\n  x", "A" * 300 + "!?" * 50]:
        assert c.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, x


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("held", [32 << 20, 1])
def test_exact_groups(docs, empty, held):
    got = op2_exact.exact_groups(docs, block_bytes=8, held_bytes=held).collect()
    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    assert len(got) == len(rows)
    want = sorted(((i, min((j for j, u in rows if u == t), key=key), sum(u == t for _, u in rows), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len({t for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert op2_exact.exact_groups(empty).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, empty, encoding):
    path = new_folder(spark, "test-tokens")
    op3_tokens.write_tokens(docs, path, encoding=encoding)
    t = tokenizer(tokenizer_json(op3_tokens.WORD_BPE))
    want = sorted(((i, [*t.encode(x, add_special_tokens=False).ids, 1]) for i, x in texts(docs)), key=lambda r: (r[0] is not None, r[0], r[1]))
    got = op3_tokens.read_tokens(spark, path).collect()
    assert sorted(((r.doc_id, r.tokens) for r in got), key=lambda r: (r[0] is not None, r[0], r[1])) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:i]) for i in range(len(ordered))]
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert {r.doc_id for r in op3_tokens.read_tokens(spark, path, 3, 5).collect()} == {3, 4, 5}
    plan = op3_tokens.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens#" not in plan.replace("n_tokens#", "")
    op3_tokens.write_tokens(empty, path + "-none")
    assert op3_tokens.read_tokens(spark, path + "-none").count() == 0
    with pytest.raises(ValueError):
        op3_tokens.write_tokens(docs, path + "-x", encoding="other")


@pytest.mark.parametrize("length", [16, 1024])
def test_packing_keeps_every_token(docs, empty, length):
    t = tokenizer(tokenizer_json(op4_packing.BYTE_BPE))
    got = op4_packing.pack(docs, length=length, stretch=200).collect()
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in texts(docs) if i is not None}
    for i, want in ids.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))
        assert {r.doc_tokens for r in own} == {len(want)}
        copies = len(own[0:1]) and sum(r.start == 0 for r in own)
        assert sorted(x for r in own for x in r.ids) == sorted(want * copies)
        assert all(r.ids == want[r.start : r.start + r.length] for r in own)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= length
    assert op4_packing.pack(empty).count() == 0


def test_cuts_are_the_best():
    draw = np.random.default_rng(3)
    for _ in range(40):
        ends = np.cumsum(draw.integers(1, 9, draw.integers(1, 12)))
        p = draw.integers(0, 6, len(ends))
        length = int(draw.integers(8, 14))

        def least(i, ends=ends, p=p, length=length):
            """Costs of what follows the i-th end, by trying everything."""
            at = 0 if i < 0 else ends[i]
            if i == len(ends) - 1:
                return 0
            return min(length - (ends[j] - at) + p[j] + least(j) for j in range(i + 1, len(ends)) if ends[j] - at <= length)

        edges = [0, *ends[op4_packing.cuts(ends, p, length)]]
        cost = sum(length - (b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)) + sum(p[np.searchsorted(ends, edges[1:])])
        assert cost == least(-1)


def test_order_minhash(spark, docs, empty):
    got = op5_omh.fingerprints(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r.fp_0 for r in got}
    assert by_id[18] == by_id[19] and by_id[0] == by_id[1] == by_id[2] and by_id[18] != by_id[21]
    assert op5_omh.fingerprints(empty).count() == 0
    words = " ".join(f"w{i}" for i in range(60))
    turned = " ".join([*(f"w{i}" for i in range(30, 60)), *(f"w{i}" for i in range(30))])
    few = words.replace("w7 ", "x ")
    df = spark.createDataFrame([(1, words, few, turned)], "doc_id long, a string, b string, c string")
    r = op5_omh.fingerprints(df, text_cols=("a", "b", "c")).select(op5_omh.likeness(F.col("fp_0"), F.col("fp_1")).alias("few"), op5_omh.likeness(F.col("fp_0"), F.col("fp_2")).alias("turned"), op5_omh.likeness(F.col("fp_0"), F.col("fp_0")).alias("same")).first()
    assert r.same == 1 and r.few > r.turned > 0


def order_minhash(text, k=op5_omh.K, size=op5_omh.TUPLE):
    """Order MinHash by plain loops: units, numbered k-mers, and for each order the least few elements by place."""
    units = []
    for w in re.split(r"[\x20\x09-\x0D]+", text or ""):
        for run in re.findall(r"[\u0E00-\u0EFF\u2E80-\uFFEF]|[^\u0E00-\u0EFF\u2E80-\uFFEF]+", w):
            while len(run) > op5_omh.LONGEST:
                units.append(run[0])
                run = run[1:]
            units += [run] * bool(run)
    top, seen, elements = (1 << 64) - op5_omh.MOST_UNITS, {}, []
    for i in range(max(len(units) - k + 1, min(len(units), 1))):
        h = 42
        for u in units[i : i + k]:
            h = xxhash.xxh64_intdigest(u.encode(), h)
        h &= top
        seen[h] = seen.get(h, 0) + 1
        if seen[h] > 1:
            h = xxhash.xxh64_intdigest(seen[h].to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)) & top
        elements.append((h, i))
    out = ""
    for order in range(op5_omh.ORDERS):
        mark = ((order << 64 - op5_omh.ORDER_BITS) + (1 << 63)) % (1 << 64)
        least = sorted(elements, key=lambda e, mark=mark: ((e[0] - mark) % (1 << 64), e[1]))
        least = (least * size)[:size]
        h = 42
        for e in sorted(least, key=lambda e: e[1]):
            h = xxhash.xxh64_intdigest((e[0] >> op5_omh.PLACE_BITS + 1).to_bytes(8, "little"), h)
        out += f"{h & 0xFFFFFFFF:08x}" if elements else "00000000"
    return out


def likeness(a, b):
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / (len(a) // 8)


def test_order_minhash_against_plain_loops(spark):
    draw = np.random.default_rng(5)
    made = [" ".join(draw.choice(["the", "cat", "of", "moon", "日本", "x" * 30, "tree"], n)) for n in (1, 2, 3, 5, 9, 30, 200, 900)]
    rows = list(enumerate([*ODD, *made, "日本語テキスト" * 40]))
    got = {r.doc_id: r.fp_0 for r in op5_omh.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == order_minhash(t), t


def test_order_minhash_of_texts_without_blanks(spark):
    a = "".join(chr(0x4E00 + i * 7919 % 3000) for i in range(3000))
    b = "".join("x" if i % 300 == 7 else c for i, c in enumerate(a))
    r = op5_omh.fingerprints(spark.createDataFrame([(1, a, b)], "doc_id long, a string, b string"), text_cols=("a", "b")).first()
    assert likeness(r.fp_0, r.fp_1) > 0.8


def simhash(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_groups(docs, empty):
    got = op6_simhash.near_groups(docs).collect()
    rows = sorted(texts(docs), key=lambda r: key(r[0]))
    fps = [simhash(t) for _, t in rows]
    root = brute_components(fps, 3)
    want = sorted(((i, f"{f:016x}", rows[k][0]) for (i, _), f, k in zip(rows, fps, root, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert op6_simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bucket_links_against_brute_force(radius):
    draw = np.random.default_rng(radius)
    base = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), replace=False)) for _ in range(300)]
    fps = [int(base[i % 12]) ^ f for i, f in enumerate(flips)]
    half = np.arange(300) < 170
    begin, end = np.where(half, 0, 170), np.where(half, 170, 300)
    parent = {f: f for f in range(300)}
    index = {}
    for a, b in op6_simhash.bucket_links([f.to_bytes(8, "big") for f in fps], begin, end, radius):
        index.setdefault(a, set()).add(b)
    for lo, hi in ((0, 170), (170, 300)):
        want = brute_components(fps[lo:hi], radius)
        groups = {}
        for k, r in enumerate(want):
            groups.setdefault(r, set()).add(fps[lo + k].to_bytes(8, "big"))
        linked = {a for a in index if any(a in g for g in groups.values())}
        for g in groups.values():
            assert len(g) == 1 or g & linked
    del parent


def test_pigeonhole_holds_every_pair():
    tables = op6_simhash.pigeonhole(16, 3)
    draw = np.random.default_rng(0)
    for _ in range(2000):
        diff = set(draw.choice(16, 3, replace=False).tolist())
        assert any(not diff & set(t) for t in tables)


def luhn(m):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(re.sub("[^0-9]", "", m))))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(m)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}
PII = [
    "a@b.c_d@e.f x..y@d.e a@b@c.d a@b.c.@d.e é🙂 a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3", "4111 1111 1111 1111x 4111-1111-1111-1111 " + "1" * 40,
    "+49 (30) 1234-5678.x +1 +1 2 +123456789012345678 +1" + " " * 50 + "x", None, "", "1" * 30000, "a." * 9000, "x" * 60000 + "@", "+1-2-3" * 900, "a@b.c " * 900,
]


def test_personal_data_against_python(spark, empty):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PII)], "doc_id long, text string, t string")
    for r in op7_pii.find(df).collect():
        want = [(k, m.start(), m.end(), m[0]) for k, (p, ok) in BASE.items() for m in re.finditer(p, PII[r.doc_id] or "") if ok(m[0])]
        assert [(s.kind, s.start, s.end, s.text) for s in r.spans if s.kind in op7_pii.BASE] == want
        assert all(0 <= s.score <= 1 for s in r.spans)
    assert op7_pii.find(empty).count() == 0


def test_added_spans_and_redaction(spark):
    t = "My iban is DE89 3704 0044 0532 0130 00, wrong: DE88 3704 0044 0532 0130 00. Please call 030 1234567; code 555 1234567."
    df = spark.createDataFrame([(1, t, 5), (2, None, 6), (3, "clean", 7)], "doc_id long, text string, r long")
    spans = {(s.kind, s.text) for s in op7_pii.find(df).where("doc_id = 1").first().spans}
    assert ("iban", "DE89 3704 0044 0532 0130 00") in spans and not any(x.startswith("DE88") for k, x in spans if k == "iban")
    assert ("local_phone", "030 1234567") in spans
    got = {r.doc_id: (r.text, r.r) for r in op7_pii.redact(df).collect()}
    assert "[IBAN]" in got[1][0] and "DE89" not in got[1][0] and got[2] == (None, 6) and got[3] == ("clean", 7)


def test_shards(docs, empty):
    got = op8_shards.shuffle(docs, shards=4, block_rows=3).collect()
    assert sorted((r.text or "") for r in got) == sorted(x for _, x in texts(docs))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert op8_shards.shuffle(empty).count() == 0
    assert op8_shards.shuffle(docs.limit(2), shards=5).count() == 2


def test_matrix_margins():
    counts = [5, 0, 1000, 37, 58]
    m = op8_shards.matrix(counts, 7)
    assert m.sum(1).tolist() == counts and m.sum(0).max() - m.sum(0).min() <= 1


def test_windows_overlap_and_reach_the_end():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        w = list(op9_toxicity.windows(n))
        assert w[-1][1] == n and all(b[0] - a[0] == op9_toxicity.STRIDE for a, b in zip(w, w[1:], strict=False))


def test_gradients_are_right():
    """Each parameter's gradient against differences of the loss."""
    net = op9_toxicity.Network({"a": 1, "b": 2}, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [op9_toxicity.PAD, "a", "b", "cde"]
    index, mask, text = op9_toxicity._laid_out([np.array([1, 2, 3]), np.array([2, 2])])

    def loss():
        table, parts = net.inputs(words)
        logits, kept = net.logits(table, index, mask, keep=True)
        return float((logits * np.array([1.0, -2.0])).sum()), table, parts, kept

    _, table, parts, kept = loss()
    g = net.gradients(parts, len(table), index, mask, kept, np.array([1.0, -2.0]))
    draw = np.random.default_rng(0)
    for k, v in net.p.items():
        at = tuple(draw.integers(0, s) for s in v.shape) if k not in ("char",) else (int(op9_toxicity.pieces(["cde"], 3)[0][0]), 2)
        if k == "word":
            at = (1, 3)
        old, e = v[at], 1e-2
        v[at] = old + e
        up = loss()[0]
        v[at] = old - e
        down = loss()[0]
        v[at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), k


def test_toxicity_learns_and_scores_odd_texts(spark, docs, empty):
    draw = np.random.default_rng(1)
    plain_words = ["tree", "river", "stone", "cloud", "meadow", "walk", "evening"]
    made = []
    for i in range(160):  # toxic words stand anywhere
        w = draw.choice(plain_words, 60).tolist()
        for bad in ["idiot", "scum"] * (i % 2):
            w.insert(int(draw.integers(0, len(w))), bad)
        made.append(" ".join(w))
    net = op9_toxicity.fit(made, [i % 2 for i in range(160)], steps=200)
    scores = op9_toxicity.Scorer(net).scores([made[0], made[1], " ".join(made[0:20:2] + made[1:2] + made[20:40:2]), ""])
    assert scores[0] < 0.3 < 0.7 < scores[1] and scores[2] > 0.5 and 0 <= scores[3] <= 1
    got = op9_toxicity.score(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = op9_toxicity.reject(docs, net)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert op9_toxicity.score(empty, net).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert op9_toxicity.train(docs, none) == 0.0
    assert op9_toxicity.score(docs, 0.0).count() == docs.count()


def test_quality(spark, docs, empty):
    draw = np.random.default_rng(2)
    words = ["tree", "river", "stone", "cloud", "meadow"]
    good = [" ".join(draw.choice(words, 40)) + "." for _ in range(60)]
    bad = [" | ".join(draw.choice(words, 40)) + " ###" for _ in range(60)]
    model = op10_quality.fit([(t, "en", "s", 9, 1) for t in good[:40]] + [(t, "en", "s", 9, 0) for t in bad[:40]], [(t, "en", "s", 9) for t in good[40:50] + bad[40:50]])
    b = op10_quality._Buckets()
    assert all(model.score([(t, "en", "s", 9)], b)[0, 2] > 0.5 for t in good[50:]) and all(model.score([(t, "en", "s", 9)], b)[0, 2] < 0.5 for t in bad[50:])
    got = op10_quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert op10_quality.score(empty, model).count() == 0
    assert op10_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) == 1.0


def test_op5_query_edits(spark):
    from formloom.llm.op5_omh import op5_omh as query

    path = new_folder(spark, "test-sf")
    rows = [(i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in query(spark, path).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        t, n = t or "", ODD[(i - 1) % len(ODD)] or ""
        c = len(t) // 3
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - c] + n[:c]).encode()).hexdigest()
    assert zlib.crc32(b"") == 0


def test_context_behind_a_span(spark):
    rows = [(1, "020 7946 0958 (tel)"), (2, "020 7946 0958" + " " * 37 + "tel"), (3, "020 7946 0958" + " " * 38 + "tel"), (4, "020 7946 0958"), (5, "🙂 020 7946 0958 is my phone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.spans] for r in op7_pii.find(df).collect()}
    assert got == {1: [("local_phone", 0, 13, 0.6)], 2: [("local_phone", 0, 13, 0.6)], 3: [], 4: [], 5: [("local_phone", 2, 15, 0.6)]}
    assert {r.doc_id: r.text for r in op7_pii.redact(df).collect()}[1] == "[LOCAL_PHONE] (tel)"
