import tracemalloc

import numpy as np

from corvane.operators import ivf, search
from corvane.plans.search import SearchPlan


def table(spark, rows, key, value):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"{key} long, {value} array<float>").coalesce(1)


def answer(hits):
    return sorted(map(tuple, hits.collect()))


def peak(f):
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_lookup_tables_stay_within_their_bytes():
    books = np.random.default_rng(0).normal(size=(8, 64, 8))
    some = next(ivf.query_steps(100_000, books))
    rows = np.zeros((some.stop - some.start, 64))
    assert peak(lambda: ivf.lookup(rows, books, "l2")) < 4 * ivf.TABLE_BYTES < 64 << 20


def test_coded_search_in_parts_gives_the_same(spark):
    """200 queries are several steps, 90 with these codebooks one or two; rows in one task or in five."""
    rng = np.random.default_rng(2)
    v, q = table(spark, rng.normal(size=(400, 64)).astype(np.float32), "vec_id", "embedding"), table(spark, rng.normal(size=(200, 64)).astype(np.float32), "qid", "q")
    coded = ivf.ivfpq_train(ivf.ivfpq_create(64, 4, 8, 256), v)
    plain = ivf.pq_train(ivf.pq_create(64, 8, 256), v)
    assert len(list(ivf.query_steps(200, plain.params["codebooks"]))) > 2
    for search_in, index, add in ((ivf.ivfpq_search, coded, ivf.ivfpq_add), (ivf.pq_search, plain, ivf.pq_add)):
        whole = answer(search_in(add(index, v), q, SearchPlan(25, 3)))
        parts = [answer(search_in(add(index, v.repartition(5)), q.where(f"qid div 50 = {i}"), SearchPlan(25, 3))) for i in range(4)]
        assert sorted(sum(parts, [])) == whole and len(whole) == 5000


def test_equal_vectors_are_not_all_held():
    rows, queries = np.ones((4096, 64)), np.random.default_rng(4).normal(size=(600, 64))
    top = search.TopK(np.arange(600), queries, 10, "ip")
    assert peak(lambda: top.offer(np.arange(4096), rows)) < 200 << 20
    assert top.v.tolist() == list(range(10)) * 600


def test_unrolled_search_sorts_few_pairs_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(search, "FIRST", 20)
    rng = np.random.default_rng(7)
    rows = np.concatenate([rng.normal(size=(200, 8)), np.ones((60, 8))]).astype(np.float32)  # with many equals
    v = table(spark, rows, "vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id AS qid", "embedding AS q")
    for metric in ("l2", "ip"):
        for k in (5, 300):  # more than there are as well
            hits = search.flat_search(v, q, k, metric, "unrolled", 8)
            assert answer(hits) == answer(search.flat_search(v, q, k, metric, "native"))
    odd = v.limit(5).unionByName(spark.createDataFrame([(900, None), (901, [1.0])], "vec_id long, embedding array<float>"))
    assert answer(search.flat_search(odd, q, 9, "l2", "unrolled", 8)) == answer(search.flat_search(odd, q, 9, "l2", "native"))
