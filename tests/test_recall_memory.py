"""What a worker of ivfpq_recall's two searches holds: the same for many queries as for few."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from corvane.operators import ivf, search
from corvane.plans.search import SearchPlan

RNG = np.random.default_rng(11)
ROWS, QUERIES = RNG.normal(size=(12_000, 64)), RNG.normal(size=(2400, 64))
CENTROIDS, BOOKS = RNG.normal(size=(8, 64)), RNG.normal(size=(8, 64, 8))


@pytest.fixture
def worker(spark, monkeypatch):
    """The function that a search hands to Python workers."""
    kind = type(spark.range(1))
    plain, taken = kind.mapInPandas, []
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, schema: taken.append(f) or plain(self, f, schema))

    def of(searched, n):
        q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(QUERIES[:n])], "qid long, q array<double>")
        searched(q)
        return taken.pop()

    return of


def peak_and_rows(f, batches):
    rows = 0
    tracemalloc.start()
    for out in f(iter(batches)):
        rows += len(out)
        del out
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def compare(worker, searched, batches, k):
    (few, _), (many, rows) = (peak_and_rows(worker(searched, n), batches) for n in (600, 2400))
    assert rows == 2400 * k
    assert many < 1.5 * few and many < 96 << 20


def test_codes_are_searched_in_memory_that_queries_do_not_grow(spark, worker):
    lists = spark.createDataFrame([], "list_id int, vec_id long, codes array<smallint>")
    index = ivf.ivfpq_create(64, 8, 8, 64).with_params(centroids=CENTROIDS, codebooks=BOOKS).with_tables(lists=lists)
    codes = RNG.integers(0, 64, (len(ROWS), 8)).astype(np.int16)
    batches = [pd.DataFrame({"list_id": np.arange(i, i + 4000) % 8, "vec_id": np.arange(i, i + 4000), "codes": list(codes[i : i + 4000])}) for i in range(0, len(ROWS), 4000)]
    compare(worker, lambda q: ivf.ivfpq_search(index, q, SearchPlan(250, 7)), batches, 250)


def test_vectors_are_searched_in_memory_that_queries_do_not_grow(spark, worker):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    batches = [pd.DataFrame({"vec_id": np.arange(i, i + 4000), "embedding": list(ROWS[i : i + 4000].astype(np.float32))}) for i in range(0, len(ROWS), 4000)]
    compare(worker, lambda q: search.flat_search(v, q, 10), batches, 10)
