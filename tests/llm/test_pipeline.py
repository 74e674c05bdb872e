"""The pipeline's stages on their own and together."""

import numpy as np
import pytest

import corpus_pipeline
from formloom.llm import op6_simhash
from formloom.llm._shared import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark):
    base = " ".join(f"word{i % 97}x{i}" for i in range(400))
    near = base.replace("word5x5 ", "other ")
    rows = [(3, base, "en", None, 1), (2, base, None, "s", 1), (7, near, "en", "s", 1), (5, "mail jo@example.org now please", "en", "s", 30), (None, None, None, None, None), (9, "", "en", "s", 0), (9, "", "en", "s", 0), (11, base.upper(), "en", "s", 1)]
    path = new_folder(spark, "test-pipeline")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    assert corpus_pipeline.toxicity(spark, docs, folder).count() == docs.count()
    exact = corpus_pipeline.exact_dedup(spark, docs, folder)
    assert exact.columns == docs.columns and sorted(r.doc_id for r in exact.collect()) == [2, 5, 7, 9, 11]
    near = corpus_pipeline.near_dedup(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in near) == [2, 5, 9]
    clean = {r.doc_id: r for r in corpus_pipeline.pii(spark, docs, folder).collect()}
    assert clean[5].text == "mail [EMAIL] now please" and clean[5].n_chars == 23 and clean[3].n_chars == 1 and clean[None].text is None
    assert corpus_pipeline.run(spark, folder).where("start = 0").count() == 3


def test_stages_of_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_own_tables_are_dropped(spark):
    from formloom.llm._shared import drop_tables, own_folder, shared_folder, written

    assert written(spark.range(3).select("id"), "test").count() == 3
    other = f"{shared_folder(spark)}/formloom/another-application"
    spark.range(2).write.parquet(other)
    drop_tables(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert spark.read.parquet(other).count() == 2


def test_rows_survive_other_splits(spark, folder):
    """The input is read in other splits by the time of the action."""
    path = new_folder(spark, "test-splits")
    spark.range(6000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', id, 'x', i))) as text", "'en' as lang", "'s' as source", "10L as n_chars").coalesce(1).write.option("parquet.block.size", 65536).parquet(path)
    for before, after in ((2, 8), (8, 2)):
        for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
            try:
                spark.conf.set("spark.sql.files.minPartitionNum", before)
                made = stage(spark, spark.read.parquet(path), folder)
                spark.conf.set("spark.sql.files.minPartitionNum", after)
                assert made.select("doc_id").distinct().count() == 6000
            finally:
                spark.conf.unset("spark.sql.files.minPartitionNum")


def test_recall_at_the_similarity(spark, folder):
    """Pairs at 0.80 to 0.82 by scattered word changes; each is alone, so nothing but its own link can find it."""
    draw, texts = np.random.default_rng(11), []
    while len(texts) < 240:
        base = " ".join(f"v{len(texts)}x{i}" for i in range(int(draw.integers(80, 400))))
        n = len(base.split())
        other = _edited(base, draw.choice(n, max(1, round(n * 0.0225)), replace=False))
        if 0.8 <= _alike(base, other) <= 0.82:
            texts += [base, other]
    kept = corpus_pipeline.near_dedup(spark, _texts(spark, texts), folder).count()
    assert len(texts) - kept >= 0.95 * len(texts) / 2


def _edited(text, places):
    words = text.split()
    for k in places:
        words[k] = f"edit{k}"
    return " ".join(words)


def _texts(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def _alike(a, b):
    a, b = (set(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_texts_below_the_similarity_stay(spark, folder):
    texts = []
    for k in range(30):
        base = " ".join(f"w{k}x{i}" for i in range(404))
        texts += [base, _edited(base, range(5, 404, 36))]
    assert all(0.7 < _alike(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    passage = " ".join(f"again{i}" for i in range(20))
    texts += [" ".join([passage] * 30 + [f"t{k}x{i}" for i in range(60)]) for k in range(4)]
    assert corpus_pipeline.near_dedup(spark, _texts(spark, texts), folder).count() == len(texts)


def test_links_of_a_split_component(spark):
    base = " ".join(f"w{i}" for i in range(204))
    texts = [_edited(base, [7 * k + 3 for k in range(j, j + 2)]) for j in range(12)] + [_edited(base, range(3, 204, 20))]
    rows = spark.createDataFrame([(i, t, bytes([i]), b"r") for i, t in enumerate(texts)], "doc long, t string, name binary, root binary")
    for block in (1 << 21, 500):
        found = op6_simhash.confirmed(rows.select("doc", "t"), rows.select("name", "doc", "root"), 5, 0.8, block).collect()
        assert sorted((r.a[0], r.b[0]) for r in found) == [(i, 0) for i in range(1, 12)]


def test_near_texts_just_above_the_similarity_go(spark, folder):
    texts = []
    for k in range(100):
        base = " ".join(f"u{k}x{i}" for i in range(229))
        texts += [base, _edited(base, range(5, 229, 46))]
    assert all(0.8 <= _alike(a, b) < 0.81 for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert corpus_pipeline.near_dedup(spark, _texts(spark, texts), folder).count() == len(texts) // 2


def test_links_by_similarity_are_all_that_there_are():
    draw = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        base = draw.choice(400, 40, replace=False)
        sets += [np.unique(np.concatenate([base[: 40 - n], draw.choice(400, n)])).astype(np.uint64) for n in (0, 2, 4, 6, 8)]
    sets.append(np.empty(0, np.uint64))
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both and both / (len(a) + len(b) - both) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    assert op6_simhash.alike_roots(sets, 0.8).tolist() == want and len(set(want)) < len(sets) - 12
