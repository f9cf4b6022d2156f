"""Indexes from streams: arriving vectors are assigned, appended and published as new generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..generations import MOUNTED, Generations
from ..operators.ivf import assign, trained
from ..operators.search import flat_add, flat_create
from ..plans.search import Index, NotReady


def publish_generations(stream: DataFrame, generations: Generations, dim: int, metric: str, checkpoint: str, label: str = "batch", **trigger) -> StreamingQuery:
    """Each micro-batch of (vec_id, embedding) makes and activates a generation of all vectors so far.

    A batch that runs again after a failure finds its own label: a generation that
    was made but not activated is activated, else nothing is left to do.
    """

    def publish(batch: DataFrame, number: int) -> None:
        name = f"{label}-{number}"
        if batch.isEmpty():
            return
        made = [g for g, v in generations.known.items() if v["label"] == name]
        if made:
            # Made by a run that ended before it was activated: it is the newest, and only mounted.
            if made[-1] == max(generations.known) and generations.known[made[-1]]["state"] == MOUNTED:
                generations.activate(made[-1])
            return
        index = flat_create(dim, metric)
        try:
            active = generations.active()
        except NotReady:  # the first one
            pass
        else:
            index = flat_add(index, batch.sparkSession.read.parquet(generations.path(active)))
        generations.activate(generations.create(flat_add(index, batch), name))

    return stream.select("vec_id", "embedding").writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_lists(stream: DataFrame, index: Index, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Arriving vectors go to the list files of a trained inverted-file index, partitioned by list_id."""
    assigned = assign(stream, trained(index.expect("ivf")), index.metric)
    return assigned.writeStream.format("parquet").partitionBy("list_id").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def search_stream(stream: DataFrame, generations: Generations, k: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Arriving queries (qid, q) against the generation that is active when the stream starts.

    The generation is pinned for the stream's life.  Each micro-batch's hits
    replace its own folder, so one that runs again leaves them once.
    """
    pin = generations.pin_active()

    def answer(batch: DataFrame, number: int) -> None:
        generations.search(pin, batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.select("qid", "q").writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
