"""Every query over the library's own operators, with its SQL for DuckDB.

Searches take every vector whose vec_id is divisible by 50 as a query, against
all vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import vector as V
from .generations import Generations
from .operators import governance, hnsw, ivf, kmeans, search
from .plans.search import SearchPlan
from .sources import files

K, LISTS, PARTS, CODES, LINKS, DIM = 10, 8, 8, 64, 8, 64
#: Probed lists, and candidates by codes that the stored vectors put in order: recall of 0.9 or more on vectors
#: that hardly cluster (see the README).
PROBES, SHORTLIST = 7, 250

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def queries_of(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6))


def exploded(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("pos", "value")).withColumn("value", F.round("value", 6))


# -- pieces of SQL --------------------------------------------------------------------------------

_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS q FROM v WHERE vec_id % 50 = 0)"


def _each(expression: str, a: str, b: str, n: int = DIM) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {expression.format(a=a, b=b)}))"


def _l2(a: str, b: str, n: int = DIM) -> str:
    return _each("({a}[i] - {b}[i]) * ({a}[i] - {b}[i])", a, b, n)


def _ip(a: str, b: str, n: int = DIM) -> str:
    return _each("{a}[i] * {b}[i]", a, b, n)


def _norm(a: str, n: int = DIM) -> str:
    return f"sqrt({_ip(a, a, n)})"


def _top(source: str, k: int = K, order: str = "d ASC", tie: str = "vec_id") -> str:
    return f"SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, {tie}) AS rank FROM ({source})) WHERE rank <= {k}"


def _kmeans(k: int, metric: str = "l2", source: str = "v", n: int = DIM, rounds: int = kmeans.ROUNDS, name: str = "c", part: str = "0") -> str:
    """CTEs name0 .. name{rounds}: part, list_id, c (centroids); ``source`` has vec_id, part, e."""
    cost = _l2("s.e", "k.c", n) if metric == "l2" else f"-{_ip('s.e', 'k.c', n)}"
    out = [f"{name}0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INT) AS list_id, e AS c FROM {source} QUALIFY list_id < {k})"]
    for i in range(rounds):
        out += [
            f"{name}a{i} AS MATERIALIZED (SELECT s.part, s.vec_id, arg_min(k.list_id, {{'d': {cost}, 'l': k.list_id}}) AS list_id FROM {source} s JOIN {name}{i} k ON s.part = k.part GROUP BY s.part, s.vec_id)",
            f"{name}m{i} AS MATERIALIZED (SELECT part, list_id, list(x ORDER BY p) AS c FROM (SELECT a.part, a.list_id, p, avg(e[p]) AS x FROM {name}a{i} a JOIN {source} s ON a.vec_id = s.vec_id AND a.part = s.part, range(1, {n + 1}) r(p) GROUP BY ALL) GROUP BY part, list_id)",
            f"{name}{i + 1} AS MATERIALIZED (SELECT k.part, k.list_id, coalesce(m.c, k.c) AS c FROM {name}{i} k LEFT JOIN {name}m{i} m ON k.part = m.part AND k.list_id = m.list_id)",
        ]
    return ", ".join(out)


def _assigned(name: str, centroids: str, metric: str = "l2", source: str = "v0", n: int = DIM) -> str:
    cost = _l2("s.e", "k.c", n) if metric == "l2" else f"-{_ip('s.e', 'k.c', n)}"
    return f"{name} AS MATERIALIZED (SELECT s.part, s.vec_id, arg_min(k.list_id, {{'d': {cost}, 'l': k.list_id}}) AS list_id FROM {source} s JOIN {centroids} k ON s.part = k.part GROUP BY s.part, s.vec_id)"


_V0 = _V + ", v0 AS (SELECT 0 AS part, vec_id, e FROM v)"
_LAST = f"c{kmeans.ROUNDS}"
_PROBED = "p AS MATERIALIZED (SELECT qid, q, list_id, r FROM (SELECT qid, q, list_id, row_number() OVER (PARTITION BY qid ORDER BY {cost}, list_id) AS r FROM q, {last} k) WHERE r <= {n})"


def _ivf(metric: str, nprobe: int) -> str:
    cost = _l2("q", "k.c") if metric == "l2" else f"-{_ip('q', 'k.c')}"
    d = _l2("p.q", "v.e") if metric == "l2" else _ip("p.q", "v.e")
    return (
        f"WITH {_V0}, {_kmeans(LISTS, metric, 'v0')}, {_assigned('a', _LAST, metric)}, {_PROBED.format(cost=cost, last=_LAST, n=nprobe)} "
        + _top(f"SELECT p.qid, v.vec_id, {d} AS d FROM p JOIN a USING (list_id) JOIN v ON v.vec_id = a.vec_id", order="d ASC" if metric == "l2" else "d DESC")
    )


# -- distances and exact search ---------------------------------------------------------------------


def _flat(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return shown(search.flat_search(v, queries_of(v), K, metric))

    return run


QUERIES["flat_l2_topk"] = _flat("l2")
SQL["flat_l2_topk"] = f"WITH {_V} " + _top(f"SELECT qid, vec_id, {_l2('q', 'e')} AS d FROM q, v")
QUERIES["flat_ip_topk"] = _flat("ip")
SQL["flat_ip_topk"] = f"WITH {_V} " + _top(f"SELECT qid, vec_id, {_ip('q', 'e')} AS d FROM q, v", order="d DESC")
QUERIES["flat_cosine_topk"] = _flat("cosine")
SQL["flat_cosine_topk"] = f"WITH {_V} " + _top(f"SELECT qid, vec_id, {_ip('q', 'e')} / ({_norm('q')} * {_norm('e')}) AS d FROM q, v", order="d DESC")


@query("flat_native_topk", SQL["flat_l2_topk"])
def flat_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in built-in functions alone."""
    v = vectors(spark, sf_dir)
    return shown(search.flat_search(v, queries_of(v), K, "l2", "unrolled", DIM))


@query("distance_l2_batch", f"WITH {_V} SELECT qid, vec_id, round(greatest(0.0, {_l2('q', 'e')}), 6) AS distance FROM q, v")
def distance_l2_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return search.all_distances(v, queries_of(v), "l2", DIM)


@query("distance_ip_batch", f"WITH {_V} SELECT qid, vec_id, round({_ip('q', 'e')}, 6) AS distance FROM q, v")
def distance_ip_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return search.all_distances(v, queries_of(v), "ip", DIM)


@query("flat_filtered_topk", f"WITH {_V} " + _top(f"SELECT qid, v.vec_id, {_l2('q', 'v.e')} AS d FROM q, v JOIN embeddings USING (vec_id) WHERE label IN (1, 3, 5)"))
def flat_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter before the search reaches the scan."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return shown(search.flat_search(table.where("label IN (1, 3, 5)").select("vec_id", "embedding"), queries_of(vectors(spark, sf_dir)), K))


@query("radius_search", f"WITH {_V} SELECT * FROM (SELECT qid, vec_id, round({_l2('q', 'e')}, 6) AS distance FROM q, v WHERE {_l2('q', 'e')} < 1.5)")
def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return shown(search.radius_search(v, queries_of(v), 1.5))


@query("vector_norms", f"WITH {_V} SELECT vec_id, round({_norm('e')}, 6) AS norm FROM v")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("l2_normalize", f"WITH {_V} SELECT vec_id, CAST(p - 1 AS INT) AS pos, round(e[p] / n, 6) AS value FROM (SELECT vec_id, e, {_norm('e')} AS n FROM v), range(1, {DIM + 1}) r(p)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(vectors(spark, sf_dir).withColumn("n", V.normalised(F.col("embedding"))), "n", "vec_id")


@query("subvector_slice", f"WITH {_V} SELECT vec_id, CAST(p - 1 AS INT) AS pos, round(e[16 + p], 6) AS value FROM v, range(1, 9) r(p)")
def subvector_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(vectors(spark, sf_dir).withColumn("s", V.double(V.subvector(F.col("embedding"), 2, 8))), "s", "vec_id")


# -- k-means and inverted files -----------------------------------------------------------------------


def _trained(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        centroids = kmeans.kmeans_train(vectors(spark, sf_dir), LISTS, metric)
        return exploded(kmeans.centroid_frame(spark, centroids), "centroid", "list_id")

    return run


for _metric in ("l2", "ip"):
    QUERIES[f"kmeans_{_metric}"] = _trained(_metric)
    SQL[f"kmeans_{_metric}"] = f"WITH {_V0}, {_kmeans(LISTS, _metric, 'v0')} SELECT list_id, CAST(p - 1 AS INT) AS pos, round(c[p], 6) AS value FROM {_LAST}, range(1, {DIM + 1}) r(p)"


def _index(spark: SparkSession, sf_dir: str, metric: str = "l2"):
    v = vectors(spark, sf_dir)
    return ivf.ivf_add(ivf.ivf_train(ivf.ivf_create(DIM, LISTS, metric), v), v)


_WITH_LISTS = f"WITH {_V0}, {_kmeans(LISTS, 'l2', 'v0')}, {_assigned('a', _LAST)} "


@query("ivf_assign", _WITH_LISTS + "SELECT vec_id, list_id FROM a")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).tables["lists"].select("vec_id", "list_id")


@query("ivf_list_sizes", _WITH_LISTS + "SELECT list_id, count(*) AS n FROM a GROUP BY list_id")
def ivf_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).tables["lists"].groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


@query("residuals", _WITH_LISTS + f"SELECT a.vec_id, CAST(p - 1 AS INT) AS pos, round(e[p] - c[p], 6) AS value FROM a JOIN v ON v.vec_id = a.vec_id JOIN {_LAST} k ON k.list_id = a.list_id, range(1, {DIM + 1}) r(p)")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    centroids = kmeans.centroid_frame(spark, index.params["centroids"])
    joined = index.tables["lists"].join(F.broadcast(centroids), "list_id")
    return exploded(joined.withColumn("r", V.residual(F.col("embedding"), F.col("centroid"))), "r", "vec_id")


@query("ivf_probe_lists", f"WITH {_V0}, {_kmeans(LISTS, 'l2', 'v0')}, {_PROBED.format(cost=_l2('q', 'k.c'), last=_LAST, n=PROBES)} SELECT qid, CAST(r AS INT) AS rank, list_id FROM p")
def ivf_probe_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    centroids = kmeans.centroid_frame(spark, kmeans.kmeans_train(v, LISTS)).select(F.col("list_id").cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
    return search.flat_search(centroids, queries_of(v), PROBES).select("qid", "rank", F.col("vec_id").cast("int").alias("list_id"))


def _ivf_query(metric: str, nprobe: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(ivf.ivf_search(_index(spark, sf_dir, metric), queries_of(vectors(spark, sf_dir)), SearchPlan(K, nprobe)))

    return run


QUERIES["ivf_topk"], SQL["ivf_topk"] = _ivf_query("l2", PROBES), _ivf("l2", PROBES)
QUERIES["ivf_ip_topk"], SQL["ivf_ip_topk"] = _ivf_query("ip", PROBES), _ivf("ip", PROBES)
QUERIES["ivf_full_probe_topk"], SQL["ivf_full_probe_topk"] = _ivf_query("l2", LISTS), SQL["flat_l2_topk"]


@query("label_majority_vote", f"WITH f AS ({SQL['flat_l2_topk']}), n AS (SELECT qid, label, count(*) AS votes FROM f JOIN embeddings USING (vec_id) GROUP BY ALL) SELECT qid, arg_min(label, {{'a': -votes, 'b': label}}) AS label FROM n GROUP BY qid")
def label_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest label of each query's neighbours, the smaller of equals."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    votes = labels.join(F.broadcast(QUERIES["flat_l2_topk"](spark, sf_dir)), "vec_id").groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("qid").agg(F.min(F.struct((-F.col("votes")).alias("a"), "label")).alias("best")).select("qid", "best.label")


# -- product quantization ---------------------------------------------------------------------------

_WIDTH = DIM // PARTS
_SUBS = f"vs AS MATERIALIZED (SELECT vec_id, CAST(part AS INT) AS part, e[part * {_WIDTH} + 1 : part * {_WIDTH} + {_WIDTH}] AS e FROM {{source}}, range({PARTS}) r(part))"
_BOOKS = f"b{kmeans.ROUNDS}"
_WITH_CODES = f"WITH {_V0}, {_SUBS.format(source='v')}, {_kmeans(CODES, 'l2', 'vs', _WIDTH, name='b')}, {_assigned('codes', _BOOKS, 'l2', 'vs', _WIDTH)} "


def _pq(spark: SparkSession, sf_dir: str):
    v = vectors(spark, sf_dir)
    return ivf.pq_add(ivf.pq_train(ivf.pq_create(DIM, PARTS, CODES), v), v)


def _books(spark: SparkSession, books) -> DataFrame:
    rows = [(s, c, books[s, c].tolist()) for s in range(books.shape[0]) for c in range(books.shape[1])]
    return exploded(spark.createDataFrame(rows, "part int, code int, centroid array<double>"), "centroid", "part", "code")


@query("pq_train", _WITH_CODES + f"SELECT part, list_id AS code, CAST(p - 1 AS INT) AS pos, round(c[p], 6) AS value FROM {_BOOKS}, range(1, {_WIDTH + 1}) r(p)")
def pq_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, ivf.pq_train(ivf.pq_create(DIM, PARTS, CODES), vectors(spark, sf_dir)).params["codebooks"])


@query("pq_encode", _WITH_CODES + "SELECT vec_id, part AS pos, list_id AS code FROM codes")
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pq(spark, sf_dir).tables["codes"].select("vec_id", F.posexplode("codes").alias("pos", "code")).withColumn("code", F.col("code").cast("int"))


@query("pq_decode", _WITH_CODES + f"SELECT vec_id, CAST(k.part * {_WIDTH} + p - 1 AS INT) AS pos, round(c[p]::FLOAT::DOUBLE, 5) AS value FROM codes d JOIN {_BOOKS} k ON d.part = k.part AND d.list_id = k.list_id, range(1, {_WIDTH + 1}) r(p)")
def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _pq(spark, sf_dir)
    back = ivf.pq_decode(index.tables["codes"], index.params["codebooks"])
    return back.select("vec_id", F.posexplode(V.double(F.col("embedding"))).alias("pos", "value")).withColumn("value", F.round("value", 5))


def _rescored(hits: str) -> str:
    """SQL of the k best of a short list by the vectors themselves."""
    return f"s AS MATERIALIZED ({hits}) " + _top(f"SELECT s.qid, s.vec_id, {_l2('q.q', 'v.e')} AS d FROM s JOIN q ON q.qid = s.qid JOIN v ON v.vec_id = s.vec_id")


_BY_CODES = _top(f"SELECT qid, vec_id, sum({_each('(q[d.part * ' + str(_WIDTH) + ' + i] - c[i]) * (q[d.part * ' + str(_WIDTH) + ' + i] - c[i])', 'q', 'c', _WIDTH)}) AS d FROM q, codes d JOIN {_BOOKS} k ON d.part = k.part AND d.list_id = k.list_id GROUP BY qid, vec_id", k=SHORTLIST, order="round(d, 9) ASC")


@query("pq_topk", f"{_WITH_CODES.rstrip()}, {_rescored(_BY_CODES)}")
def pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest by codes, put in order by the stored vectors."""
    v = vectors(spark, sf_dir)
    q = queries_of(v)
    return shown(search.rescored(ivf.pq_search(_pq(spark, sf_dir), q, SearchPlan(SHORTLIST)), v, q, K))


_WITH_RESIDUALS = (
    f"WITH {_V0}, {_kmeans(LISTS, 'l2', 'v0')}, {_assigned('a', _LAST)}, "
    f"vr AS MATERIALIZED (SELECT a.vec_id, list_transform(range(1, {DIM + 1}), lambda i: e[i] - c[i]) AS e FROM a JOIN v ON v.vec_id = a.vec_id JOIN {_LAST} k ON k.list_id = a.list_id), "
    f"{_SUBS.format(source='vr')}, {_kmeans(CODES, 'l2', 'vs', _WIDTH, name='b')}, {_assigned('codes', _BOOKS, 'l2', 'vs', _WIDTH)} "
)


def _ivfpq(spark: SparkSession, sf_dir: str):
    v = vectors(spark, sf_dir)
    return ivf.ivfpq_add(ivf.ivfpq_train(ivf.ivfpq_create(DIM, LISTS, PARTS, CODES), v), v)


@query("ivfpq_encode", _WITH_RESIDUALS + "SELECT a.list_id, d.vec_id, d.part AS pos, d.list_id AS code FROM codes d JOIN a ON a.vec_id = d.vec_id")
def ivfpq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _ivfpq(spark, sf_dir).tables["lists"]
    return coded.select("list_id", "vec_id", F.posexplode("codes").alias("pos", "code")).withColumn("code", F.col("code").cast("int"))


_PQ_L2 = _each(f"(p.q[d.part * {_WIDTH} + i] - k.c[d.part * {_WIDTH} + i] - b.c[i]) * (p.q[d.part * {_WIDTH} + i] - k.c[d.part * {_WIDTH} + i] - b.c[i])", "", "", _WIDTH)


_BY_RESIDUALS = _top(f"SELECT p.qid, d.vec_id, p.r, sum({_PQ_L2}) AS d FROM p JOIN {_LAST} k ON k.list_id = p.list_id JOIN a ON a.list_id = p.list_id JOIN codes d ON d.vec_id = a.vec_id JOIN {_BOOKS} b ON b.part = d.part AND b.list_id = d.list_id GROUP BY p.qid, d.vec_id, p.r", k=SHORTLIST, order="round(d, 9) ASC", tie="r, vec_id")


@query("ivfpq_topk", f"{_WITH_RESIDUALS.rstrip()}, {_PROBED.format(cost=_l2('q', 'k.c'), last=_LAST, n=PROBES)}, {_rescored(_BY_RESIDUALS)}")
def ivfpq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest by codes in the probed lists, put in order by the stored vectors."""
    v = vectors(spark, sf_dir)
    q = queries_of(v)
    return shown(search.rescored(ivf.ivfpq_search(_ivfpq(spark, sf_dir), q, SearchPlan(SHORTLIST, PROBES)), v, q, K))


def _recall(kind: str, exact: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How many of the exact neighbours the index gives."""
        found = QUERIES[kind](spark, sf_dir).select("qid", "vec_id", F.lit(1).alias("hit"))
        return QUERIES[exact](spark, sf_dir).join(found, ["qid", "vec_id"], "left").groupBy("qid").agg((F.count("hit") / F.lit(float(K))).alias("recall"))

    return run


for _name, _kind, _exact in (("recall_at_k", "ivf_topk", "flat_l2_topk"), ("ivf_ip_recall", "ivf_ip_topk", "flat_ip_topk"), ("pq_recall", "pq_topk", "flat_l2_topk"), ("ivfpq_recall", "ivfpq_topk", "flat_l2_topk")):
    QUERIES[_name] = _recall(_kind, _exact)
    SQL[_name] = f"WITH f AS ({SQL[_exact]}), i AS ({SQL[_kind]}) SELECT f.qid, count(i.vec_id) / {K}.0::DOUBLE AS recall FROM f LEFT JOIN i ON f.qid = i.qid AND f.vec_id = i.vec_id GROUP BY f.qid"


# -- neighbour graphs ---------------------------------------------------------------------------------


@query("hnsw_forward_edges", f"WITH {_V} SELECT qid AS node, rank AS slot, vec_id AS neighbor, distance FROM ({_top('SELECT a.vec_id AS qid, b.vec_id, ' + _l2('a.e', 'b.e') + ' AS d FROM v a JOIN v b ON b.vec_id < a.vec_id', k=LINKS)})")
def hnsw_forward_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(hnsw.forward_edges(vectors(spark, sf_dir), LINKS))


@query("knn_graph", f"WITH {_V} " + _top(f"SELECT a.vec_id AS qid, b.vec_id, {_l2('a.e', 'b.e')} AS d FROM v a JOIN v b ON a.vec_id != b.vec_id", k=LINKS))
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest others."""
    v = vectors(spark, sf_dir)
    hits = search.exact_hits(v, v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), LINKS + 1, "l2").where("qid != vec_id")
    return shown(search.ranked(hits, LINKS, "l2"))


def _graph(spark: SparkSession, sf_dir: str):
    v = vectors(spark, sf_dir)
    return hnsw.hnsw_add(hnsw.hnsw_create(DIM, LINKS, 64), v)


_EDGES = f"WITH {_V}, f AS MATERIALIZED (SELECT a AS node, b AS neighbor, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS slot FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_l2('a.e', 'b.e')} AS d FROM v a JOIN v b ON b.vec_id < a.vec_id) QUALIFY slot <= {LINKS})"
_OFFERS = "o AS (SELECT node, 0 AS late, slot AS turn, neighbor, d FROM f UNION ALL SELECT neighbor, 1, node, node, d FROM f), l AS (SELECT node, list([{'n': neighbor, 'd': d}] ORDER BY late, turn) AS offers FROM o GROUP BY node)"
_WORST = "list_position(list_transform(s, lambda e: e.d), list_max(list_transform(s, lambda e: e.d)))"
_SLOTS = f"list_reduce(offers, lambda s, x: CASE WHEN len(s) < {LINKS} THEN list_concat(s, x) WHEN list_max(list_transform(s, lambda e: e.d)) > x[1].d THEN list_concat(list_concat(s[1 : {_WORST} - 1], x), s[{_WORST} + 1 :]) ELSE s END)"


@query("hnsw_graph", f"{_EDGES}, {_OFFERS}, g AS (SELECT node, {_SLOTS} AS s FROM l) SELECT node, CAST(i - 1 AS INT) AS slot, s[i].n AS neighbor FROM g, range(1, {LINKS + 1}) r(i) WHERE i <= len(s)")
def hnsw_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).tables["graph"].select("node", F.posexplode("neighbors").alias("slot", "neighbor"))


@query("hnsw_degree", f"{_EDGES}, {_OFFERS} SELECT node, CAST(least(len(offers), {LINKS}) AS INT) AS degree FROM l")
def hnsw_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).tables["graph"].select("node", F.size("neighbors").alias("degree"))


@query("hnsw_topk")
def hnsw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(hnsw.hnsw_search(_graph(spark, sf_dir), queries_of(vectors(spark, sf_dir)), SearchPlan(K, 64)))


# -- texts ---------------------------------------------------------------------------------------------

_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(t, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_SIGNED = "CAST(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END AS BIGINT)"
_TOKENS = f"t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{X._UPPER}', '{X._LOWER}'), '[a-z0-9_]+')) AS t FROM documents), w AS MATERIALIZED (SELECT t, {_SIGNED} AS token_hash FROM (SELECT t, {_FNV} AS h FROM (SELECT DISTINCT t FROM t)))"


@query("token_hash", f"WITH {_TOKENS} SELECT t AS token, token_hash FROM w")
def token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of all different tokens, in built-in functions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select(F.explode(X.tokens(F.coalesce("text", F.lit("")))).alias("token")).distinct()
    return found.select("token", X.fnv1a_column(F.col("token")).alias("token_hash"))


_BOW = f"{_TOKENS}, s AS (SELECT doc_id, ((token_hash % {DIM}) + {DIM}) % {DIM} AS slot, count(*) AS n FROM t JOIN w USING (t) GROUP BY ALL), b AS (SELECT doc_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM s)"


@query("bow_embed", f"WITH {_BOW} SELECT doc_id, CAST(slot AS INT) AS pos, round(x::FLOAT::DOUBLE, 5) AS value FROM b")
def bow_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vector = docs.select("doc_id", X.embed_column(F.col("text"), DIM).alias("e"))
    return vector.select("doc_id", F.posexplode(V.double(F.col("e"))).alias("pos", "value")).where("value != 0").withColumn("value", F.round("value", 5))


_DENSE = f"{_BOW}, v AS MATERIALIZED (SELECT d.doc_id AS vec_id, list_transform(range({DIM}), lambda i: coalesce(map_extract(m, i)[1], 0)) AS e FROM documents d LEFT JOIN (SELECT doc_id, map_from_entries(list((CAST(slot AS BIGINT), x::FLOAT::DOUBLE))) AS m FROM b GROUP BY doc_id) USING (doc_id)), q AS (SELECT vec_id AS qid, e AS q FROM v WHERE vec_id % 50 = 0)"


@query("doc_topk", f"WITH {_DENSE} " + _top(f"SELECT qid, vec_id, {_ip('q', 'e')} AS d FROM q, v", order="d DESC"))
def doc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nearest to every fiftieth one, by their embeddings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    v = docs.select(F.col("doc_id").alias("vec_id"), X.embed_column(F.col("text"), DIM).alias("embedding"))
    return shown(search.flat_search(v, queries_of(v), K, "ip"))


@query("sha256_contract", "SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS contract_hash FROM documents")
def sha256_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", X.sha256_column(F.coalesce("text", F.lit(""))).alias("contract_hash"))




# -- specifications, contracts, versions ----------------------------------------------------------------

_SPACES = [("sp.one", 0, 64, "l2", "l2"), ("sp.two", 1, 32, "ip", "none"), ("sp.three", 2, 16, "l2", "none")]
_NEWER = [("sp.one", 0, 64, "ip", "l2"), ("sp.two", 1, 32, "ip", "none"), ("sp.three", 2, 24, "l2", "l2")]
_MINTS = [("m.a", 0, "sp.one"), ("m.b", 1, "sp.two"), ("m.c", 2, "sp.one"), ("m.d", 3, "sp.three"), ("m.e", 4, "sp.none"), ("m.f", 5, "sp.two")]
_TRACES = [("t.1", ["m.a", "m.b", "m.c"]), ("t.2", ["m.d"]), ("t.3", ["m.f", "m.x", "m.a", "m.f"])]
_EMBEDDERS = [(1, "big", "gpu", 4096, 8192), (2, "any", "any", 256, 0), (3, "plain", " CPU ", 512, 0), (4, "npu", "npu", 512, 0), (5, "none", "", 64, 0)]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    shown = lambda v: "[" + ", ".join(map(shown, v)) + "]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)})"


_S = _values("s", "space_id, ord, dim, metric, normalization", _SPACES)
_M = _values("m", "mint_id, ord, space_id", _MINTS)
_T = _values("t", "trace_id, steps", _TRACES)
_STEPS = "st AS (SELECT trace_id, CAST(i - 1 AS INT) AS ord, steps[i] AS source, steps[i + 1] AS target FROM t, range(1, 9) r(i) WHERE i <= len(steps))"


def _spec_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(_SPACES, "space_id string, ord int, dim int, metric string, normalization string"),
        spark.createDataFrame(_MINTS, "mint_id string, ord int, space_id string"),
        spark.createDataFrame(_TRACES, "trace_id string, steps array<string>"),
    )


@query("fk_violations", f"WITH {_S}, {_M}, {_T}, {_STEPS} SELECT 'mint' AS kind, mint_id AS id, space_id AS missing FROM m WHERE space_id NOT IN (SELECT space_id FROM s) UNION ALL SELECT 'trace', trace_id, source FROM st WHERE source NOT IN (SELECT mint_id FROM m)")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces, mints, traces = _spec_tables(spark)
    lost = governance.dangling(mints, spaces, "space_id").select(F.lit("mint").alias("kind"), F.col("mint_id").alias("id"), F.col("space_id").alias("missing"))
    steps = traces.select("trace_id", F.explode("steps").alias("mint_id"))
    return lost.unionByName(governance.dangling(steps, mints, "mint_id").select(F.lit("trace").alias("kind"), F.col("trace_id").alias("id"), F.col("mint_id").alias("missing")))


@query("trace_edges", f"WITH {_T}, {_STEPS} SELECT * FROM st WHERE target IS NOT NULL")
def trace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.trace_edges(_spec_tables(spark)[2])


@query(
    "spec_layout_offsets",
    f"WITH {_S}, {_M}, n AS (SELECT s.*, (SELECT count(*) FROM m WHERE m.space_id = s.space_id) AS n FROM s), p AS (SELECT *, coalesce(sum(dim * 4 * n) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n), "
    "k AS (SELECT *, CAST(row_number() OVER (PARTITION BY space_id ORDER BY ord) - 1 AS INT) AS index FROM m) SELECT space_id, mint_id, index, CAST(start + index * dim * 4 AS BIGINT) AS offset_bytes FROM k JOIN p USING (space_id)",
)
def spec_layout_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces, mints, _ = _spec_tables(spark)
    return governance.layout_offsets(spaces, mints)


_E = _values("e", "ord, id, hardware_class, min_ram_mb, min_vram_mb", _EMBEDDERS)
_CLASS = "CASE WHEN trim(hardware_class) = '' THEN 'cpu' ELSE lower(trim(hardware_class)) END"
_ABLE = f"min_ram_mb <= 2048 AND min_vram_mb <= 0 AND {_CLASS} IN ('any', 'cpu', 'npu')"


def _embedders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_EMBEDDERS, "ord int, id string, hardware_class string, min_ram_mb int, min_vram_mb int")


@query("embedder_supported", f"WITH {_E} SELECT id, {_ABLE} AS supported FROM e")
def embedder_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedders(spark).select("id", governance.supported(2048, 0, False, True).alias("supported"))


@query("embedder_select", f"WITH {_E} SELECT id FROM e WHERE {_ABLE} ORDER BY CASE WHEN {_CLASS} IN ('npu', 'any') THEN 0 ELSE 1 END, ord LIMIT 1")
def embedder_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.select_embedder(_embedders(spark), "npu", ram_mb=2048, vram_mb=0, gpu=False, npu=True).select("id")


@query("embedder_compatible", f"WITH {_E} SELECT a.id AS a, b.id AS b, a.min_ram_mb IS NOT DISTINCT FROM b.min_ram_mb AND a.min_vram_mb IS NOT DISTINCT FROM b.min_vram_mb AS compatible FROM e a JOIN e b ON a.ord < b.ord")
def embedder_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _embedders(spark).alias("a"), _embedders(spark).alias("b")
    pairs = a.join(b, F.col("a.ord") < F.col("b.ord"))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), governance.compatible("a", "b", ("min_ram_mb", "min_vram_mb")).alias("compatible"))


@query("space_compat_diff", f"WITH {_S}, {_values('z', 'space_id, ord, dim, metric, normalization', _NEWER)} SELECT space_id, field, true AS breaking FROM (SELECT s.space_id, unnest(['dim', 'metric', 'normalization']) AS field, unnest([s.dim != z.dim, s.metric != z.metric, s.normalization != z.normalization]) AS d FROM s JOIN z USING (space_id)) WHERE d")
def space_compat_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _spec_tables(spark)[0]
    return governance.space_changes(old, spark.createDataFrame(_NEWER, old.schema))


def _version(v: DataFrame) -> DataFrame:
    """A later version of the vectors: each moved along two dimensions."""
    moved = F.transform(V.double(F.col("embedding")), lambda x, i: x + F.when(i == 0, 0.05 * (F.col("vec_id") % 7)).when(i == 5, -0.1).otherwise(0.0))
    return v.select("vec_id", moved.alias("embedding"))


_MOVED = f"z AS MATERIALIZED (SELECT vec_id, list_transform(range(1, {DIM + 1}), lambda i: e[i] + CASE i WHEN 1 THEN 0.05::DOUBLE * (vec_id % 7) WHEN 6 THEN -0.1::DOUBLE ELSE 0 END) AS e FROM v)"
_STATS = "d AS (SELECT CAST(p - 1 AS INT) AS pos, avg(z.e[p]) - avg(v.e[p]) AS m, var_pop(z.e[p]) - var_pop(v.e[p]) AS s FROM v JOIN z USING (vec_id), range(1, 65) r(p) GROUP BY p)"


@query("variance_shift", f"WITH {_V}, {_MOVED}, {_STATS} SELECT pos, round(m, 6) + 0.0 AS mean_shift, round(s, 6) + 0.0 AS variance_shift FROM d")
def variance_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    shift = governance.dimension_shift(v, _version(v))
    return shift.select("pos", (F.round("mean_shift", 6) + 0.0).alias("mean_shift"), (F.round("variance_shift", 6) + 0.0).alias("variance_shift"))


@query("centroid_drift", f"WITH {_V}, {_MOVED}, {_STATS} SELECT round(sqrt(sum(m * m)), 6) AS drift FROM d")
def centroid_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return governance.centroid_drift(v, _version(v)).select(F.round("drift", 6).alias("drift"))


def _near(table: str) -> str:
    return f"(SELECT qid, vec_id FROM ({_top('SELECT q.vec_id AS qid, o.vec_id, ' + _l2('q.e', 'o.e') + f' AS d FROM {table} q JOIN {table} o ON q.vec_id != o.vec_id WHERE q.vec_id % 50 = 0')}))"


@query("neighborhood_churn", f"WITH {_V}, {_MOVED} SELECT a.qid, (count(*) - count(b.vec_id)) / count(*)::DOUBLE AS churn FROM {_near('v')} a LEFT JOIN {_near('z')} b ON a.qid = b.qid AND a.vec_id = b.vec_id GROUP BY a.qid")
def neighborhood_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return governance.neighborhood_churn(v, _version(v), queries_of(v), K)


def _published(spark: SparkSession, sf_dir: str) -> Generations:
    """Two generations: all vectors, then those with their later versions appended; the first one is active."""
    v = vectors(spark, sf_dir)
    kept = Generations(spark, files.scratch(spark, "generations"))
    first = search.flat_add(search.flat_create(DIM), v)
    kept.activate(kept.create(first, "first"))
    later = _version(v).withColumn("vec_id", -1 - F.col("vec_id"))
    kept.create(search.flat_add(first, later), "with later versions")
    return kept


_BOTH = f"{_V}, {_MOVED}, u AS MATERIALIZED (SELECT 1 AS gen_id, vec_id, e FROM v UNION ALL SELECT 2, vec_id, e FROM v UNION ALL SELECT 2, -1 - vec_id, list_transform(e, lambda x: x::FLOAT::DOUBLE) FROM z)"


@query("append_generations", f"WITH {_BOTH} SELECT CAST(gen_id AS BIGINT) AS gen_id, CASE gen_id WHEN 1 THEN 'first' ELSE 'with later versions' END AS label, CASE gen_id WHEN 1 THEN 'mounted' ELSE 'active' END AS state, count(*) AS n, count(DISTINCT vec_id) AS n_ids, round(avg({_norm('e')}), 6) AS mean_norm FROM u GROUP BY ALL")
def append_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both generations as they are stored after the second took over: the first one is unchanged."""
    kept = _published(spark, sf_dir)
    kept.activate(2)
    stored = None
    for generation in (1, 2):
        rows = spark.read.parquet(kept.path(generation)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))
        rows = rows.select(F.lit(generation).cast("long").alias("gen_id"), "*")
        stored = rows if stored is None else stored.unionByName(rows)
    return kept.table().select("gen_id", "label", "state").join(stored, "gen_id")


_SEARCHED = _top(f"SELECT gen_id, qid, vec_id, {_l2('q', 'u.e')} AS d FROM q, u").replace("SELECT qid, ", "SELECT gen_id, qid, ", 1).replace("PARTITION BY qid", "PARTITION BY gen_id, qid", 1)


@query("pinned_search", f"WITH {_BOTH} SELECT CAST(gen_id AS BIGINT) AS gen_id, * EXCLUDE (gen_id) FROM ({_SEARCHED})")
def pinned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches through a pin taken before another generation became the active one, and through one taken after."""
    kept, q = _published(spark, sf_dir), queries_of(vectors(spark, sf_dir))
    before = kept.pin_active()
    kept.activate(2)
    found = [kept.search(p, q, K).select(F.lit(p.generation).cast("long").alias("gen_id"), "*") for p in (before, kept.pin_active())]
    return shown(found[0].unionByName(found[1]))


@query("invariant_violations", f"WITH {_V}, {_MOVED} SELECT vec_id, 'norm_bound' AS rule FROM z WHERE {_norm('e')} < 0.99 OR {_norm('e')} > 1.01")
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.invariant_violations(_version(vectors(spark, sf_dir)), DIM, 0.99, 1.01)
