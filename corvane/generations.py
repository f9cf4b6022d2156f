"""Immutable, pinnable generations of an index's vectors, in a folder of their own each."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators.search import flat_index_search
from .plans.search import Index, InvalidArgument, NotReady, SearchPlan
from .sources import files

MOUNTED, ACTIVE, RETIRED = "mounted", "active", "retired"


@dataclass(frozen=True)
class Pin:
    """A hold on a generation; searches through it read that generation whatever is active."""

    number: int
    generation: int


class Generations:
    """The generations under ``root``.

    A generation is written once and never changed.  One may be active; the
    pointer to it is one file, replaced in one step.  A retired generation goes
    when its last pin does.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.lock = threading.RLock()
        self.pins: dict[int, Pin] = {}
        self.given = 0
        known = f"{self.root}/generations.json"
        self.known: dict[int, dict] = {int(k): v for k, v in json.loads(files.read_text(spark, known)).items()} if files.exists(spark, known) else {}

    def _save(self) -> None:
        files.write_text(self.spark, f"{self.root}/generations.json", json.dumps(self.known))

    def _get(self, generation: int) -> dict:
        if generation not in self.known:
            raise InvalidArgument(f"no generation {generation}")
        return self.known[generation]

    def path(self, generation: int) -> str:
        return f"{self.root}/gen={generation}"

    def create(self, index: Index, label: str) -> int:
        """A mounted generation with the index's vectors as they are now."""
        if not 0 < len(label.encode()) <= 128:
            raise InvalidArgument("a label of 1 to 128 bytes")
        vectors = index.expect("flat").tables.get("vectors")
        if vectors is None:
            raise InvalidArgument("the index is empty")
        with self.lock:
            generation = max(self.known, default=0) + 1
            self.known[generation] = {"label": label, "state": MOUNTED, "dim": index.dim, "metric": index.metric}
        vectors.write.mode("overwrite").parquet(self.path(generation))  # what a run left that ended before it was known
        with self.lock:
            self._save()
        return generation

    def activate(self, generation: int) -> None:
        """Make it the active one; an earlier one again is a rollback."""
        with self.lock:
            own = self._get(generation)
            if own["state"] == RETIRED:
                raise NotReady(f"generation {generation} is retired")
            for other in self.known.values():
                if other["state"] == ACTIVE:
                    other["state"] = MOUNTED
            own["state"] = ACTIVE
            self._save()

    def active(self) -> int:
        for generation, own in self.known.items():
            if own["state"] == ACTIVE:
                return generation
        raise NotReady("no generation is active")

    def deactivate(self) -> None:
        with self.lock:
            self.known[self.active()]["state"] = MOUNTED
            self._save()

    def pin_active(self) -> Pin:
        with self.lock:
            self.given += 1
            pin = self.pins[self.given] = Pin(self.given, self.active())
            return pin

    def unpin(self, pin: Pin) -> None:
        with self.lock:
            if self.pins.get(pin.number) != pin:
                raise InvalidArgument("a pin that isn't held")
            del self.pins[pin.number]
            if self.known[pin.generation]["state"] == RETIRED:
                self._reclaim(pin.generation)

    def retire(self, generation: int) -> None:
        with self.lock:
            own = self._get(generation)
            if own["state"] != MOUNTED:
                raise NotReady(f"generation {generation} is {own['state']}")
            own["state"] = RETIRED
            self._save()
            self._reclaim(generation)

    def _reclaim(self, generation: int) -> None:
        if not any(p.generation == generation for p in self.pins.values()):
            files.remove(self.spark, self.path(generation))
            del self.known[generation]
            self._save()

    def label(self, generation: int) -> str:
        return self._get(generation)["label"]

    def index(self, pin: Pin) -> Index:
        if self.pins.get(pin.number) != pin:
            raise InvalidArgument("a pin that isn't held")
        own = self._get(pin.generation)
        return Index("flat", own["dim"], own["metric"], {}, {"vectors": self.spark.read.parquet(self.path(pin.generation))})

    def search(self, pin: Pin, queries: DataFrame, k: int) -> DataFrame:
        """Exact search of the pinned generation; k outside 1..rows is an error."""
        return flat_index_search(self.index(pin), queries, SearchPlan(k), strict=True)

    def table(self) -> DataFrame:
        rows = [(g, v["label"], self.path(g), v["state"], sum(p.generation == g for p in self.pins.values())) for g, v in sorted(self.known.items())]
        return self.spark.createDataFrame(rows, "gen_id long, label string, path string, state string, pins int")
