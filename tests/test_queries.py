"""Registered queries against SQL."""

import duckdb
import numpy as np
import pytest

from formloom.plans import registry

TABLES = ("embeddings",)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as from read_parquet('{sf}/{t}.parquet')")
    got, want = registry.queries()[name](spark, sf).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert (got.dtypes.values == want.dtypes.values).all()
    for c in columns:
        assert np.array_equal(got[c].values, want[c].values), c


@pytest.mark.parametrize("name", ["rigid_align", "tps_warp", "closest_surface", "dense_correspondence", "point_normals", "subsample_points"])
def test_query_has_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_pivot_has_all_specimens(spark, sf):
    got = registry.queries()["pivot_magnitudes_all"](spark, sf).toPandas()
    long = registry.queries()["shape_magnitude_long"](spark, sf).toPandas()
    names = sorted(map(str, long.specimen_id.unique()))
    assert len(names) > 2 and sorted(got.columns) == sorted(["point_id", "Magnitude Mean", "Magnitude SD", *names])
    for s, own in long.groupby("specimen_id"):
        assert dict(zip(own.point_id, own.distance, strict=True)) == dict(zip(got.point_id, got[str(s)], strict=True))


@pytest.mark.parametrize("name", ["cluster_faces", "cluster_reindex"])
def test_clusters_without_a_label_0(spark, sf, tmp_path, name):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    e.withColumn("label", (e.label + 3).cast(e.schema["label"].dataType)).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = registry.queries()[name](spark, sf).collect()
    assert want and sorted(registry.queries()[name](spark, str(tmp_path)).collect()) == sorted(want)
