"""Thinning by many tasks against the loop over points in order of id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.operators import thin

POINT = "specimen_id string, point_id int, x double, y double, z double"


def loop(v, gap):
    stay = np.empty((0, 3))
    kept = []
    for i, x in enumerate(v):
        if not (((stay - x) ** 2).sum(1) < gap * gap).any():
            stay, kept = np.vstack([stay, x]), [*kept, i]
    return kept


def shapes():
    draw = np.random.default_rng(5)
    grid = np.stack(np.meshgrid(np.arange(26), np.arange(26), indexing="ij"), -1).reshape(-1, 2) / 26
    sheet = np.column_stack([grid, np.sin(4 * grid[:, 0]) / 3])
    # a third of all points lie in one spot
    crowded = np.concatenate([draw.random((600, 3)), 0.5 + draw.random((300, 3)) / 1000])[draw.permutation(900)]
    return {"scanned": sheet, "shuffled": sheet[draw.permutation(len(sheet))], "crowded": crowded, "line": np.linspace([0, 0, 0], [1, 2, 3], 400), "spot": np.full((5, 3), 2.0), "one": np.ones((1, 3))}


@pytest.mark.parametrize("block", [thin.BLOCK, 300])
def test_rounds_equal_the_loop(spark, monkeypatch, block):
    """Chains of points that wait for others cross many blocks, and the result is still that of one pass."""
    monkeypatch.setattr(thin, "BLOCK", block)
    named = shapes()
    df = spark.createDataFrame([(s, i, *map(float, x)) for s, v in named.items() for i, x in enumerate(v)], POINT)
    got = thin.subsample(df.repartition(5, "x"), 3).toPandas()
    assert list(got.columns) == df.columns
    for s, v in named.items():
        gap = 0.03 * np.linalg.norm(np.ptp(v, axis=0))
        assert sorted(got[got.specimen_id == s].point_id) == (loop(v, gap) if gap else list(range(len(v)))), s


def test_blocks_are_many(spark, monkeypatch):
    """A specimen is many blocks, none of which has most of its points, and few rounds decide all."""
    monkeypatch.setattr(thin, "BLOCK", 40)
    sizes, plain = [], thin._round

    def counted(state):
        sizes.append(state.groupBy(*[F.floor(F.col(f"_c{a}") / F.col("_cells")) for a in "xyz"]).count().toPandas()["count"])
        return plain(state)

    monkeypatch.setattr(thin, "_round", counted)
    sheet = shapes()["shuffled"]
    got = thin.subsample(spark.createDataFrame([("a", i, *map(float, x)) for i, x in enumerate(sheet)], POINT), 3)
    assert sorted(r.point_id for r in got.collect()) == loop(sheet, 0.03 * np.linalg.norm(np.ptp(sheet, axis=0)))
    assert len(sizes[0]) >= 16 and sizes[0].max() < len(sheet) / 8 and len(sizes) < 20


def test_a_pass_holds_cells_and_no_points():
    p = thin.Pass(1.0)
    assert p.offer(thin.OPEN_NEARBY, False, (1, 0, 0), (1.5, 0, 0)) is None
    assert all(p.offer(thin.OWN, False, (0, 0, 0), (0.5 + k / 1e6, 0, 0)) is None for k in range(1000))
    assert sum(map(len, p.open.values())) <= 3 and not p.stay
    p = thin.Pass(1.0)
    assert [p.offer(thin.OWN, False, (0, 0, 0), (k / 1e6, 0, 0)) for k in range(1000)] == [True] + [False] * 999
    assert sum(map(len, p.stay.values())) == 1


def test_odd_rows(spark, monkeypatch):
    """Missing coordinates and ids, one id twice, ids of specimens that are null, columns with clashing names, no rows."""
    monkeypatch.setattr(thin, "BLOCK", 2)
    rows = [("a", 1, 0.0, 0.0, 0.0), ("a", 1, 0.0, 0.0, 0.0), ("a", 2, None, 0.0, 0.0), ("a", 3, float("nan"), 0.0, 0.0), ("a", None, 5.0, 0.0, 0.0), ("a", 4, 9.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), (None, 2, 1.0, 0.0, 0.0), (None, 3, 1.01, 0.0, 0.0)]
    df = spark.createDataFrame(rows, POINT).withColumn("_gap", F.lit("own")).withColumn("_b", F.lit(1))
    got = thin.subsample(df, 4)
    assert got.columns == df.columns
    assert sorted((str(r.specimen_id), r.point_id, r._gap) for r in got.collect()) == [("None", 1, "own"), ("None", 2, "own"), ("a", 1, "own"), ("a", 4, "own")]
    assert thin.subsample(df.limit(0), 4).count() == 0


def test_nothing_is_held_without_a_gap():
    one = thin.Pass(0.0)
    assert all(one.offer(thin.OWN, False, (0, 0, 0), (float(i), 0.0, 0.0)) for i in range(1000))
    assert not one.stay and not one.open
