import numpy as np
import pytest

from __spark_entry__ import queries as registered
from corvane.operators import search


def sf_dir(spark, tmp_path, rows):
    """One file with the vectors, as the tables come."""
    data = [(i, None if r is None else [float(x) for x in r], 0) for i, r in enumerate(rows)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def by_terms(a, b, metric):
    total = 0.0
    for x, y in zip(a.astype(float), b.astype(float), strict=True):
        total += (x - y) ** 2 if metric == "l2" else x * y
    return np.round(total, 6) + 0.0


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_all_pairs_whatever_the_files(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(search, "PAIRS", 32)  # several parts of queries and of vectors
    v = np.random.default_rng(1).normal(size=(1800, 64)).astype(np.float32)
    df = registered()[f"distance_{metric}_batch"](spark, sf_dir(spark, tmp_path, v))
    got = {(r["qid"], r["vec_id"]): r["distance"] for r in df.collect()}
    assert len(got) == 1800 * 36
    assert all(d == by_terms(v[q], v[i], metric) for (q, i), d in list(got.items())[::211])
    # One file is one task unless rows are dealt to more.
    assert len([1 for n in df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n]) > 4


def test_odd_vectors_keep_their_rows(spark, tmp_path):
    rows = [[1.0] * 64, None, [2.0] * 63, [float("nan")] * 64, *([[0.5] * 64] * 46), None]
    df = registered()["distance_l2_batch"](spark, sf_dir(spark, tmp_path, rows))
    got = {(r["qid"], r["vec_id"]): r["distance"] for r in df.collect()}
    assert len(got) == 2 * 51 and got[0, 0] == 0.0 and got[0, 4] == 16.0
    assert got[0, 1] == 0.0 and np.isnan(got[0, 3])  # as SQL's greatest has nulls


def test_halves_are_summed_term_by_term():
    a = np.array([[0.5, 0.0009765625]])  # 1 / 1024
    d = search.block_distances(a, (a**2).sum(1), np.array([[0.5, 0.0], [0.0, 0.001953125]]), "l2")
    assert d.tolist() == [[0.000001], [0.250001]]
    assert search.rounded(np.array([0.5, 1.5, -0.5, 2.4, -0.2])).tolist() == [1e-6, 2e-6, -1e-6, 2e-6, 0.0]
    assert not np.signbit(search.rounded(np.array([-0.2])))[0]
