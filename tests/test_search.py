import numpy as np
import pytest

from corvane.functions import text as X
from corvane.functions import vector as V
from corvane.operators import hnsw, ivf, kmeans, search
from corvane.plans.search import Index, InvalidArgument, SearchPlan
from pyspark.sql import functions as F


def table(spark, rows, key="vec_id", value="embedding"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{key} long, {value} array<float>")


def queries(spark, rows):
    return table(spark, rows, "qid", "q")


def answer(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["vec_id"], r["distance"]))
    return out


def brute(v, q, k, metric):
    d = ((q[:, None] - v[None]) ** 2).sum(2) if metric == "l2" else q @ v.T
    return [[int(i) for i in np.lexsort((np.arange(len(v)), d[j] if metric == "l2" else -d[j]))[:k]] for j in range(len(q))]


@pytest.fixture(scope="module")
def random():
    rng = np.random.default_rng(3)
    return rng.normal(size=(300, 16)).astype(np.float32), rng.normal(size=(9, 16)).astype(np.float32)


def test_distances(spark):
    rows = [([1.0, 2.0, 2.0], [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.l2(a, b), V.l2_by_norms(a, b), V.dot(a, b), V.norm(a), V.cosine(a, b), V.unrolled("l2", a, b, 3)).first()
    assert got[:4] == (6.0, 6.0, 2.0, 3.0) and got[4] == pytest.approx(2 / 3) and got[5] == 6.0
    zero = spark.createDataFrame([([0.0, 0.0],)], "a array<double>").select(V.normalised(a)).first()[0]
    assert zero == [0.0, 0.0]


def test_golden_flat(spark):
    v = table(spark, [(0, 0), (1, 1), (2, 2)])
    got = answer(search.flat_search(v, queries(spark, [(0.1, 0.1), (1.9, 2.1)]), 2))
    assert [i for i, _ in got[0]] == [0, 1] and [i for i, _ in got[1]] == [2, 1]
    assert got[0][0][1] == pytest.approx(0.02, abs=1e-5) and got[1][1][1] == pytest.approx(2.02 - 0.4, abs=0.5)
    got = answer(search.flat_search(table(spark, [(1, 0), (0, 1)]), queries(spark, [(0.1, 0.9)]), 1, "ip"))
    assert got[0][0][0] == 1 and got[0][0][1] == pytest.approx(0.9)


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("kernel", ["numpy", "native", "unrolled"])
def test_kernels_agree(spark, random, metric, kernel):
    v, q = random
    got = answer(search.flat_search(table(spark, v).repartition(5), queries(spark, q), 7, metric, kernel, 16))
    assert [[i for i, _ in got[j]] for j in range(len(q))] == brute(v.astype(float), q.astype(float), 7, metric)


def test_ties_blocks_and_limits(spark, monkeypatch):
    v = table(spark, [(1, 1)] * 20 + [(0, 0)]).repartition(4)
    monkeypatch.setattr(search, "BLOCK_BYTES", 16)
    monkeypatch.setattr(search.query_blocks, "__defaults__", (16,))  # a block for each query
    got = answer(search.flat_search(v, queries(spark, [(1, 1), (0, 0), (1, 0)]), 3))
    assert [i for i, _ in got[0]] == [0, 1, 2] and got[1][0][0] == 20 and len(got) == 3
    with pytest.raises(InvalidArgument):
        search.flat_search(v, queries(spark, [(1, 1)]), 0)
    index = search.flat_add(search.flat_create(2), v)
    with pytest.raises(InvalidArgument):
        search.flat_index_search(index, queries(spark, [(1, 1)]), SearchPlan(22), strict=True)
    assert len(answer(search.flat_index_search(index, queries(spark, [(1, 1)]), SearchPlan(99)))[0]) == 21
    assert answer(search.flat_search(v, queries(spark, []), 3)) == {}


def test_radius(spark, random):
    v, q = random
    got = {(r["qid"], r["vec_id"]) for r in search.radius_search(table(spark, v), queries(spark, q), 20.0).collect()}
    d = ((q.astype(float)[:, None] - v.astype(float)[None]) ** 2).sum(2)
    assert got == set(zip(*map(lambda x: x.tolist(), np.nonzero(d < 20.0)), strict=True))


def test_bad_vectors_fail(spark):
    for rows in ([(1, float("nan"))], [(1, float("inf"))], [(1, 2, 3)]):
        with pytest.raises(Exception, match="not a finite vector"):
            search.flat_add(search.flat_create(2), table(spark, rows)).tables["vectors"].collect()
    with pytest.raises(InvalidArgument):
        Index("flat", 0, "l2")
    with pytest.raises(InvalidArgument):
        Index("flat", 2, "cosine")


def lloyd(v, k, metric="l2"):
    c = np.zeros((k, v.shape[1]))
    c[: len(v)] = v[:k]
    for _ in range(5):
        d = ((v[:, None] - c[None]) ** 2).sum(2) if metric == "l2" else -(v @ c.T)
        at = d.argmin(1)
        for j in range(k):
            if (at == j).any():
                c[j] = v[at == j].mean(0)
    return c


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_kmeans(spark, random, metric):
    v = random[0].astype(float)
    assert np.allclose(kmeans.kmeans_train(table(spark, v), 6, metric), lloyd(v, 6, metric), atol=1e-6)


def test_kmeans_edges(spark):
    few = kmeans.kmeans_train(table(spark, [(1, 1), (3, 3)]), 4)
    assert few[2:].tolist() == [[0, 0], [0, 0]]
    assert kmeans.kmeans_train(table(spark, [(1, 1), (3, 3)]), 1).tolist() == [[1, 1]]
    with pytest.raises(ValueError):
        kmeans.kmeans_train(table(spark, []), 2)


def test_ivf_golden_and_full_probe(spark, random):
    v = table(spark, [(i, i) for i in range(5)])
    index = ivf.ivf_add(ivf.ivf_train(ivf.ivf_create(2, 1), v), v)
    got = answer(ivf.ivf_search(index, queries(spark, [(0.1, 0.1), (1.1, 1.0), (4.2, 4.1)]), SearchPlan(1)))
    assert [got[i][0][0] for i in range(3)] == [0, 1, 4]
    rows, q = random
    for metric in ("l2", "ip"):
        index = ivf.ivf_add(ivf.ivf_train(ivf.ivf_create(16, 8, metric), table(spark, rows)), table(spark, rows))
        full = answer(ivf.ivf_search(index, queries(spark, q), SearchPlan(5, 8)))
        assert [[i for i, _ in full[j]] for j in range(len(q))] == brute(rows.astype(float), q.astype(float), 5, metric)
    with pytest.raises(InvalidArgument):
        ivf.ivf_add(ivf.ivf_create(2, 1), v)


def test_pq(spark, random):
    square = table(spark, [(0, 0), (1, 0), (0, 1), (1, 1)])
    index = ivf.pq_add(ivf.pq_train(ivf.pq_create(2, 2, 4), square), square)
    back = {r["vec_id"]: r["embedding"] for r in ivf.pq_decode(index.tables["codes"], index.params["codebooks"]).collect()}
    assert back == {0: [0, 0], 1: [1, 0], 2: [0, 1], 3: [1, 1]}
    got = answer(ivf.pq_search(index, queries(spark, [(0, 0.2), (1, 0.8)]), SearchPlan(2)))
    assert [i for i, _ in got[0]] == [0, 2] and [i for i, _ in got[1]] == [3, 1]
    rows, _ = random
    index = ivf.pq_add(ivf.pq_train(ivf.pq_create(16, 4, 16), table(spark, rows)), table(spark, rows))
    once = ivf.pq_decode(index.tables["codes"], index.params["codebooks"])
    again = ivf.pq_encode(once, index.params["codebooks"])
    assert sorted(index.tables["codes"].collect()) == sorted(again.collect())
    for bad in ((3, 2, 4), (4, 0, 4), (4, 2, 300)):
        with pytest.raises(InvalidArgument):
            ivf.pq_create(*bad)
    with pytest.raises(InvalidArgument):
        ivf.decode_rows(np.array([[9]]), np.zeros((1, 4, 2)))


def test_ivfpq_many_lists(spark, random):
    rows, q = random
    v, r = rows.astype(float), None
    index = ivf.ivfpq_add(ivf.ivfpq_train(ivf.ivfpq_create(16, 4, 4, 16), table(spark, rows)), table(spark, rows))
    c, books = index.params["centroids"], index.params["codebooks"]
    at = kmeans.nearest(v, c)
    r = c[at] + ivf.decode_rows(ivf.encode_rows(v - c[at], books), books)
    got = answer(ivf.ivfpq_search(index, queries(spark, q), SearchPlan(5, 4)))
    want = np.sort(((q.astype(float)[:, None] - r[None]) ** 2).sum(2), 1)[:, :5]
    assert np.allclose([[d for _, d in got[j]] for j in range(len(q))], want, atol=1e-4)
    ip = ivf.ivfpq_add(ivf.ivfpq_train(ivf.ivfpq_create(16, 4, 4, 16, "ip"), table(spark, rows)), table(spark, rows))
    assert len(answer(ivf.ivfpq_search(ip, queries(spark, q), SearchPlan(5, 4)))[0]) == 5


def test_hnsw(spark, tmp_path, random):
    v = table(spark, [(i, i) for i in range(4)])
    index = hnsw.hnsw_add(hnsw.hnsw_create(2, 2, 4), v)
    got = answer(hnsw.hnsw_search(index, queries(spark, [(0.1, 0.1), (2.1, 2.0)]), SearchPlan(2, 4)))
    assert [i for i, _ in got[0]] == [0, 1] and [i for i, _ in got[1]] == [2, 3]
    shot = hnsw.hnsw_snapshot(index, str(tmp_path / "shot"))
    more = hnsw.hnsw_add(index, table(spark, [(2.1, 2.0)]).withColumn("vec_id", F.lit(9).cast("long")))
    assert answer(hnsw.hnsw_search(more, queries(spark, [(2.1, 2.0)]), SearchPlan(1, 5)))[0][0][0] == 9
    assert answer(hnsw.hnsw_search(shot, queries(spark, [(2.1, 2.0)]), SearchPlan(1, 5)))[0][0][0] == 2
    rows, q = random
    index = hnsw.hnsw_add(hnsw.hnsw_create(16, 8, 64), table(spark, rows))
    got = answer(hnsw.hnsw_search(index, queries(spark, q), SearchPlan(10, 64)))
    want = brute(rows.astype(float), q.astype(float), 10, "l2")
    assert sum(len({i for i, _ in got[j]} & set(want[j])) for j in range(len(q))) >= 0.9 * 10 * len(q)


def test_backlinks_against_sequence(spark, random):
    v, m = random[0][:80].astype(float), 4
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    near = {}
    for i in range(len(v)):
        near[i] = [int(j) for j in np.lexsort((np.arange(i), d[i, :i]))[:m]]
        for j in list(near[i]):
            own = near[j]
            if i in own:
                continue
            if len(own) < m:
                own.append(i)
            else:
                worst = int(np.argmax([d[j, x] for x in own]))
                if d[j, i] < d[j, own[worst]]:
                    own[worst] = i
    graph = hnsw.hnsw_add(hnsw.hnsw_create(16, m), table(spark, random[0][:80])).tables["graph"]
    got = {r["node"]: r["neighbors"] for r in graph.collect()}
    assert got == {k: x for k, x in near.items() if x}


def test_text_hashes(spark):
    assert X.fnv1a("abc") == -1792535898324117685 and X.fnv1a("abc") % 10 == 5 and X.fnv1a("abc  ") == X.fnv1a("abc")
    words = ["abc", "", "a_b9", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.fnv1a_column(F.col("w")).alias("h"))
    assert {r["w"]: r["h"] for r in df.collect()} == {w: X.fnv1a(w) for w in words}
    slots = np.flatnonzero(X.embed("Validate credentials and session state.", 512))
    assert slots.tolist() == [43, 134, 278, 305, 471]
    assert np.flatnonzero(X.embed("End metadata flow.", 64)).tolist() == [10, 21, 32]
    assert not X.embed(None, 8).any()
    assert X.sha256_text("abc").startswith("sha256:ba7816bf") and X.sha256_text("abc").endswith("f20015ad")
