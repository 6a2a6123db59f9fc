"""The index of vectors by cells against exact search."""

import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from wordloom.operators import vector_index as VI
from wordloom.sources.written import scratch_path, shared_dir


def exact(names, x, q_names, q, most):
    out = {}
    for name, close in zip(q_names, np.round(np.array(q) @ np.array(x).T, 6), strict=True):
        order = sorted((-s, i) for s, i in zip(close.tolist(), names, strict=True) if i != name)[:most]
        out[name] = [(i, -s) for s, i in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "place").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
        assert r["place"] == len(out[r["query_id"]])
    return out


def clustered(n, rng):
    centres = np.random.default_rng(0).normal(size=(12, 8))
    x = centres[rng.integers(12, size=n)] + 0.2 * rng.normal(size=(n, 8))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).round(4)


def test_recall_of_the_table(spark):
    rows = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()
    names, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    path = scratch_path(spark)
    VI.write_index(table, path)
    assert spark.read.parquet(f"{path}/cells").count() == len(rows)
    got, want = answers(VI.nearest(spark, table, path)), exact(names, x, names, x, 5)
    assert set(got) == set(names) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(want[i]) & set(got[i])) / 5 for i in names]) >= 0.9


@pytest.mark.parametrize("target", [0.95, 1.0])
def test_clusters_and_a_hot_vector(spark, monkeypatch, target):
    """A third of all rows are one vector; blocks are small; other queries than rows; few cells are tried."""
    monkeypatch.setattr(VI, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = clustered(600, rng)
    x[::3] = x[0]
    names = [int(i) for i in rng.permutation(600)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(names, x, strict=True)] + [(None, [0.0] * 8), (999, None)], "id long, vector array<double>").repartition(5)
    path = scratch_path(spark)
    VI.write_index(table, path, most=3, cells=12, target=target)
    tries = spark.read.parquet(f"{path}/about").first()["tries"]
    got, want = answers(VI.nearest(spark, table, path, 3)), exact(names, x, names, x, 3)
    assert got == want if target == 1 else tries < 12
    hits = [len(set(want[i]) & set(got.get(i, []))) / 3 for i in names]
    assert np.mean(hits) >= 0.9 and all(hits[k] == 1 for k in range(0, 600, 3))
    other = clustered(20, rng)
    asked = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(other)], "id long, vector array<double>")
    found, best = answers(VI.nearest(spark, asked, path, 1)), exact(names, x, range(1000, 1020), other, 1)
    assert np.mean([found[i][0][1] >= best[i][0][1] for i in best]) >= 0.9
    with pytest.raises(ValueError):
        VI.nearest(spark, asked, path, 4)


def test_only_tried_cells_are_read(spark):
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(300, rng))], "id long, vector array<double>")
    path = scratch_path(spark)
    VI.write_index(table, path, cells=12, target=0.5)
    df = VI.nearest(spark, table.filter("id = 7"), path)
    tries = spark.read.parquet(f"{path}/about").first()["tries"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert tries < 12 and re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (?:IN \(|= )\d+", plan)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    path = scratch_path(spark)
    VI.write_index(none, path)
    one = spark.createDataFrame([(1, [1.0, 0.0])], none.schema)
    assert VI.nearest(spark, one, path).count() == 0
    path = scratch_path(spark)
    VI.write_index(one, path)
    assert VI.nearest(spark, one, path).count() == 0 and VI.nearest(spark, none, path).count() == 0


def test_a_query_travels_to_a_few_parts(spark):
    """Of vectors without clusters a query tries most cells, but isn't copied to each of them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).round(4)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)
    path = scratch_path(spark)
    VI.write_index(table, path, cells=60, target=1.0)
    tries = spark.read.parquet(f"{path}/about").first()["tries"]
    before = set(os.listdir(shared_dir(spark)))
    df = VI.nearest(spark, table, path)
    assert answers(df) == exact(range(1500), x, range(1500), x, 5) and tries > 3 * VI.PARTS
    new = [f"{shared_dir(spark)}/{d}" for d in set(os.listdir(shared_dir(spark))) - before]
    size = sum(os.path.getsize(os.path.join(d, f)) for d in new for f in os.listdir(d))
    assert size < (VI.PARTS + 4) * 1500 * 8 * 8
