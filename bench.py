"""Times the headline queries and the five benchmark set-ups; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
tables and the cores.  Each query runs once to warm up and once timed, from a new
plan, to its last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
from pyspark.sql import SparkSession

from corvane import catalogue
from corvane.operators import hnsw, ivf, search
from corvane.plans.search import SearchPlan

QUERIES = ("flat_l2_topk", "flat_ip_topk", "flat_native_topk", "kmeans_l2", "ivf_topk", "pq_topk", "ivfpq_topk", "hnsw_forward_edges", "hnsw_topk", "bow_embed")


def frame(spark, rows, key, value):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"{key} long, {value} array<float>").repartition(8).cache()


def setups(spark):
    rng = np.random.default_rng(0)
    make = lambda dim: (frame(spark, rng.random((4096, dim), np.float32), "vec_id", "embedding"), frame(spark, rng.random((256, dim), np.float32), "qid", "q"))
    v, q = make(256)
    w, p = make(128)
    for df in (v, q, w, p):
        df.count()
    keep = lambda index: type(index)(index.kind, index.dim, index.metric, index.params, {k: t.cache() for k, t in index.tables.items()})
    lists = keep(ivf.ivf_add(ivf.ivf_train(ivf.ivf_create(128, 64), w), w))
    codes = keep(ivf.ivfpq_add(ivf.ivfpq_train(ivf.ivfpq_create(128, 64, 8, 256), w), w))
    graph = keep(hnsw.hnsw_add(hnsw.hnsw_create(128, 16, 64), w))
    return {
        "distance_l2_256x4096x256": lambda: search.flat_search(v, q, 10, "l2"),
        "distance_ip_256x4096x256": lambda: search.flat_search(v, q, 10, "ip"),
        "ivf_256x4096x128": lambda: ivf.ivf_search(lists, p, SearchPlan(10, 8)),
        "ivfpq_256x4096x128": lambda: ivf.ivfpq_search(codes, p, SearchPlan(10, 8)),
        "hnsw_256x4096x128": lambda: hnsw.hnsw_search(graph, p, SearchPlan(10, 32)),
    }


def timed(run) -> float:
    for _ in range(2):
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        took = time.time() - began
    return round(took, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("corvane-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(lambda name=name: catalogue.QUERIES[name](spark, sf_dir)) for name in QUERIES}
    times |= {name: timed(run) for name, run in setups(spark).items()}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()
    sys.stdout.flush()


if __name__ == "__main__":
    main()
