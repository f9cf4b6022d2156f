"""Requests that run in the background: search, add, train, load, pipeline, snapshot."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import wait as wait_for
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import hnsw, ivf, search
from .plans.search import Index, InvalidArgument, NotReady, SearchPlan

PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"

# What a request does, by what it asks and the index's kind.
SEARCH = {"flat": search.flat_index_search, "pq": ivf.pq_search, "ivf": ivf.ivf_search, "ivfpq": ivf.ivfpq_search, "hnsw": hnsw.hnsw_search}
ADD = {"flat": search.flat_add, "pq": ivf.pq_add, "ivf": ivf.ivf_add, "ivfpq": ivf.ivfpq_add, "hnsw": hnsw.hnsw_add}
TRAIN = {"flat": search.flat_add, "pq": ivf.pq_train, "ivf": ivf.ivf_train, "ivfpq": ivf.ivfpq_train}


def chosen(table: dict, index: Index) -> Callable:
    if index.kind not in table:
        raise InvalidArgument(f"not for a {index.kind} index")
    return table[index.kind]


@dataclass
class Request:
    number: int
    what: str
    work: Callable
    state: str = PENDING
    error: Exception | None = None
    value: object = None
    future: object = field(default=None, repr=False)

    @property
    def tag(self) -> str:
        return f"corvane-request-{self.number}"


class Engine:
    """A session with workers.  Requests wait in a queue of bounded length.

    A search's DataFrame is made and its rows fetched in the worker, so that a
    result is complete when its request is.
    """

    def __init__(self, spark: SparkSession, workers: int = 4):
        if workers <= 0:
            raise InvalidArgument(f"{workers} workers")
        self.spark, self.numbers = spark, itertools.count(1)
        self.room = threading.BoundedSemaphore(max(64, 8 * workers))
        self.pool: ThreadPoolExecutor | None = ThreadPoolExecutor(workers, "corvane")
        self.requests: dict[int, Request] = {}

    def stop(self) -> None:
        """Finish what is queued, then end the workers."""
        if self.pool:
            self.pool.shutdown(wait=True)
            self.pool = None

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    def submit(self, what: str, work: Callable, start: bool = True) -> Request:
        request = Request(next(self.numbers), what, work)
        self.requests[request.number] = request
        return self.schedule(request) if start else request

    def schedule(self, request: Request) -> Request:
        if self.pool is None:
            raise NotReady("the engine is stopped")
        if not self.room.acquire(blocking=False):
            request.state, request.error = FAILED, NotReady("the queue is full")
            raise request.error
        request.state = RUNNING
        request.future = self.pool.submit(self._run, request)
        return request

    def _run(self, request: Request) -> None:
        try:
            if request.state == CANCELLED:
                return
            self.spark.addTag(request.tag)
            value = request.work()
            if request.state != CANCELLED:
                request.value, request.state = value, COMPLETED
        except Exception as error:  # the request reports it
            if request.state != CANCELLED:
                request.error, request.state = error, FAILED
        finally:
            self.spark.removeTag(request.tag)
            self.room.release()

    def poll(self, request: Request) -> str:
        return request.state

    def wait(self, request: Request, timeout: float | None = None) -> str:
        if request.future:
            wait_for([request.future], timeout)
        return request.state

    def cancel(self, request: Request) -> None:
        """Any request that isn't completed becomes cancelled; its Spark jobs are interrupted."""
        if request.state == COMPLETED:
            raise InvalidArgument("the request is completed")
        request.state, request.error = CANCELLED, None
        self.spark.interruptTag(request.tag)

    def result(self, request: Request):
        self.wait(request)
        if request.state == FAILED:
            raise request.error
        if request.state != COMPLETED:
            raise NotReady(f"the request is {request.state}")
        return request.value

    # -- kinds of requests

    def submit_search(self, index: Index, queries: DataFrame, plan: SearchPlan) -> Request:
        return self.submit("search", lambda: chosen(SEARCH, index)(index, queries, plan).collect())

    def submit_add(self, index: Index, vectors: DataFrame) -> Request:
        return self.submit("add", lambda: chosen(ADD, index)(index, vectors))

    def submit_train(self, index: Index, vectors: DataFrame) -> Request:
        return self.submit("train", lambda: chosen(TRAIN, index)(index, vectors))

    def submit_snapshot(self, index: Index, path: str) -> Request:
        return self.submit("snapshot", lambda: hnsw.hnsw_snapshot(index, path))

    def submit_load(self, folder: str, space_id: str, metric: str) -> Request:
        from .sources.vectors import load_artifact

        return self.submit("load", lambda: load_artifact(self.spark, folder, space_id, metric))

    def submit_pipeline(self, compile: Callable | None, embed: Callable | None, spec: str, folder: str) -> Request:
        """Compile, then embed; both must be given, and an error in the first stops the second."""
        if not (compile and embed):
            raise NotReady("a pipeline needs both steps")

        def work():
            compile(spec, folder)
            return embed(spec, folder)

        return self.submit("pipeline", work)
