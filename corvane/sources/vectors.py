"""Raw vector payloads and artifact folders."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.search import flat_add, flat_create
from ..plans.search import Index, InvalidArgument
from . import files
from .spec import digest

MANIFEST, CONTRACTS, LAYOUT, PAYLOAD = "manifest.json", "contracts.json", "vector_layout.json", "vectors.bin"
#: Bytes that a task reads of a payload.
SPLIT_BYTES = 64 << 20


def read_vectors(spark: SparkSession, path: str, dim: int, count: int, offset: int = 0, label_base: int = 0) -> DataFrame:
    """vec_id, embedding of ``count`` vectors from byte ``offset`` on of a file of little-endian float32."""
    if dim <= 0 or count < 0 or offset < 0 or label_base not in (0, 1):
        raise InvalidArgument(f"dim {dim}, count {count}, offset {offset}")
    if not files.exists(spark, path) or files.size(spark, path) < offset + 4 * dim * count:
        raise InvalidArgument(f"{path} has no {count} vectors of {dim} from byte {offset}")
    each = max(1, SPLIT_BYTES // (4 * dim))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, n in zip(batch["start"], batch["n"], strict=True):
                with files.opened(path) as file:
                    file.seek(offset + 4 * dim * int(start))
                    rows = np.frombuffer(file.read(4 * dim * int(n)), "<f4").reshape(int(n), dim)
                for at in range(0, int(n), 8192):
                    piece = rows[at : at + 8192]
                    yield pd.DataFrame({"vec_id": np.arange(start + at, start + at + len(piece)) + label_base, "embedding": list(piece)})

    splits = [(s, min(each, count - s)) for s in range(0, count, each)]
    starts = spark.createDataFrame(splits, "start long, n long").repartition(max(1, len(splits)))
    return starts.mapInPandas(part, "vec_id long, embedding array<float>")


def space_layout(text: str, space_id: str) -> tuple[int, int, int]:
    """dim, count, offset of a space."""
    for s in json.loads(text).get("spaces", []):
        if s["space_id"] == space_id:
            return s["dim"], s["count"], s["offset_bytes"]
    raise InvalidArgument(f"no space {space_id} in the layout")


def _object_at(text: str, start: int) -> str:
    """The JSON object that begins at ``start``, as written."""
    _, end = json.JSONDecoder().raw_decode(text, start)
    return text[start:end]


def embedder_contract(text: str, check_hash=None, check_signature=None) -> dict:
    """The embedder's contract, valid: its fields filled, sizes not negative, and what the callables say."""
    tree = json.loads(text)
    if "spec" not in tree.get("embedder", {}):
        raise InvalidArgument("no embedder contract")
    own, spec = tree["embedder"], tree["embedder"]["spec"]
    wanted = ("id", "version", "input_schema", "model_hash", "config_hash", "hardware_class")
    empty = [k for k in wanted if not str(spec.get(k, "")).strip()] + [k for k in ("contract_hash",) if not own.get(k)] + ([] if spec.get("preprocess_chain") else ["preprocess_chain"])
    if empty or spec.get("min_ram_mb", 0) < 0 or spec.get("min_vram_mb", 0) < 0:
        raise InvalidArgument(f"embedder contract: {', '.join(empty) or 'a negative size'}")
    if check_hash and not check_hash(spec, own["contract_hash"]):
        raise InvalidArgument("embedder contract: its hash was rejected")
    if check_signature and not (str(own.get("signature", "")).strip() and check_signature(spec, own["signature"])):
        raise InvalidArgument("embedder contract: its signature was rejected")
    return own


def space_contract(text: str, space_id: str, dim: int, metric: str) -> dict:
    """The space's contract, valid: right dim and metric, a normalization, and the hash of its spec as written."""
    for m in re.finditer(r'"spec"\s*:\s*(?=\{)', text):
        raw = _object_at(text, m.end())
        spec = json.loads(raw)
        if spec.get("space_id") != space_id:
            continue
        entry = json.loads(_object_at(text, text.rindex("{", 0, m.start())))
        same = {"l2": "l2", "ip": "ip", "inner_product": "ip"}.get(spec.get("metric")) == metric
        if spec.get("dim") != dim or not same or not spec.get("normalization", "").strip() or digest(raw) != entry.get("contract_hash"):
            raise InvalidArgument(f"the contract of space {space_id} doesn't hold")
        return entry
    raise InvalidArgument(f"no contract of space {space_id}")


def load_artifact(spark: SparkSession, folder: str, space_id: str, metric: str, **hooks) -> Index:
    """The flat index of a space, from a folder of contracts, layout and payload; checked before any vector is read."""
    if not 0 < len(folder) <= 4000 or not 0 < len(space_id) <= 128:
        raise InvalidArgument("a path of 1 to 4000 and a space of 1 to 128 characters")
    for name in (CONTRACTS, LAYOUT, PAYLOAD):
        if not files.exists(spark, f"{folder}/{name}"):
            raise InvalidArgument(f"no {name} in {folder}")
    contracts = files.read_text(spark, f"{folder}/{CONTRACTS}")
    embedder_contract(contracts, **hooks)
    dim, count, offset = space_layout(files.read_text(spark, f"{folder}/{LAYOUT}"), space_id)
    if count <= 0:
        raise InvalidArgument(f"space {space_id} is empty")
    space_contract(contracts, space_id, dim, metric)
    return flat_add(flat_create(dim, metric), read_vectors(spark, f"{folder}/{PAYLOAD}", dim, count, offset))


def write_artifact(spark: SparkSession, spec, folder: str) -> None:
    """Manifest, contracts, layout and payload of a specification."""
    for name, data in ((MANIFEST, spec.manifest().encode()), (CONTRACTS, spec.contracts().encode()), (LAYOUT, spec.layout_json().encode()), (PAYLOAD, spec.payload())):
        files.write_bytes(spark, f"{folder}/{name}", data)
