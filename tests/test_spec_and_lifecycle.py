import json
import struct

import numpy as np
import pytest

from corvane import cli
from corvane.generations import Generations
from corvane.operators import bridges, hnsw, ivf, search
from corvane.plans.search import InvalidArgument, NotReady, SearchPlan
from corvane.runtime import CANCELLED, COMPLETED, FAILED, Engine
from corvane.sources import files, index_files
from corvane.sources.spec import Spec, digest, parse, real
from corvane.sources.vectors import load_artifact, read_vectors, space_contract, write_artifact
from corvane.streaming.publish import append_lists, publish_generations, search_stream

from .test_search import answer, queries, table

TEXT = """
spec_version: "0.1"
spec_id: demo_v1
title: Demo   # a comment
created_at: "2025-01-12T10:00:00Z"
owner: team
embedder:
  id: bow
  version: "0.1"
  input_schema: text_v1
  preprocess_chain:
    - lowercase
    - normalize:l2
  model_hash: sha256:m
  config_hash: sha256:c
  hardware_class: cpu
  min_ram_mb: 64
  min_vram_mb: 0
entry_mints: [a.start]
objectives:
  - objective_id: reach
    target_mints: [a.end]
    priority: 2
spaces:
  - space_id: s.a
    dim: 8
    metric: l2
    normalization: l2
    invariants:
      - type: dim
        equals: 8
      - type: metric
        allowed:
          - l2
          - ip
  - space_id: s.b
    dim: 4
    metric: ip
    normalization: none
mints:
  - mint_id: a.start
    space_id: s.a
    text: "Start: the #flow"
    tags: [x, "y z"]
    metadata:
      score: 7
      flags: [true, false, audit]
      policy:
        gates: {alpha: true, beta: false}
  - mint_id: b.only
    space_id: s.b
    text: Only one.
  - mint_id: a.end
    space_id: s.a
    text: The end.
corridors:
  - corridor_id: c
    space_id: s.a
    between: [a.start, a.end]
    width: 0.75
traces:
  - trace_id: t
    space_id: s.a
    steps: [a.start, a.end]
    confidence: 0.5
    metadata: {kind: "phase:two #7", n: 0.75}
"""


def test_parse_and_write():
    tree = parse(TEXT)
    assert tree["title"] == "Demo" and tree["mints"][0]["text"] == "Start: the #flow"
    spec = Spec.read(TEXT)
    manifest = spec.manifest()
    assert '"metadata": {"score": 7,"flags": [true,false,"audit"],"policy": {"gates": {"alpha": true,"beta": false}}}' in manifest
    assert '"allowed": ["l2","ip"]' in manifest and '"equals": 8' in manifest and '"width": 0.750000000000' in manifest
    assert '{"kind": "phase:two #7","n": 0.75}' in manifest
    assert json.loads(manifest)["mints"][2]["mint_id"] == "a.end"
    assert [real(x) for x in (0, 1.5, 10.25, 0.05)] == ["0.00000000000", "1.50000000000", "10.2500000000", "0.500000000000E-01"]
    dot = spec.dot()
    assert dot.count("style=dashed") == 1 and dot.count("->") == 2


def test_layout_groups_interleaved_spaces():
    layout = json.loads(Spec.read(TEXT).layout_json())
    assert layout["total_bytes"] == 80 and [s["offset_bytes"] for s in layout["spaces"]] == [0, 64]
    assert [m["mint_id"] for m in layout["spaces"][0]["mints"]] == ["a.start", "a.end"]
    assert len(Spec.read(TEXT).payload()) == 80


@pytest.mark.parametrize(
    "old, new", [("space_id: s.b\n    text", "space_id: s.x\n    text"), ("[a.start, a.end]\n    confidence", "[a.start, no]\n    confidence"), ("confidence: 0.5", "confidence: 1.5"), ("owner: team", "owner_: team"), ("dim: 4", "dim: 0"), ("entry_mints: [a.start]", "entry_mints: [zzz]")]
)
def test_invalid(old, new):
    assert old in TEXT
    with pytest.raises(InvalidArgument):
        Spec.read(TEXT.replace(old, new))


def test_artifact(spark, tmp_path):
    folder = str(tmp_path / "art")
    spec = Spec.read(TEXT)
    write_artifact(spark, spec, folder)
    index = load_artifact(spark, folder, "s.a", "l2")
    assert index.dim == 8 and index.tables["vectors"].count() == 2
    contracts = files.read_text(spark, f"{folder}/contracts.json")
    hashed = space_contract(contracts, "s.a", 8, "l2")["contract_hash"]
    assert hashed.startswith("sha256:")
    for space, metric, text in (("s.z", "l2", contracts), ("s.a", "ip", contracts), ("s.a", "l2", contracts.replace(hashed, "sha256:0" + hashed[8:]))):
        files.write_text(spark, f"{folder}/contracts.json", text)
        with pytest.raises(InvalidArgument):
            load_artifact(spark, folder, space, metric)
    files.write_text(spark, f"{folder}/contracts.json", contracts)
    files.remove(spark, f"{folder}/vectors.bin")
    with pytest.raises(InvalidArgument):
        load_artifact(spark, folder, "s.a", "l2")
    assert digest('{"space_id": "fixture.space","dim": 2,"metric": "l2","normalization": "none"}') == "sha256:c761b2699931aba1583df083fa99155e82b3ad08545bcb2e2ce3521034f80f88"


def test_read_vectors(spark, tmp_path):
    path = tmp_path / "v.bin"
    path.write_bytes(struct.pack("<9f", *range(9)))
    got = read_vectors(spark, str(path), 2, 3, 12).collect()
    assert [(r["vec_id"], r["embedding"]) for r in got] == [(0, [3, 4]), (1, [5, 6]), (2, [7, 8])]
    assert read_vectors(spark, str(path), 2, 0).count() == 0
    for bad in ((0, 1, 0), (2, -1, 0), (2, 1, -1), (2, 5, 0)):
        with pytest.raises(InvalidArgument):
            read_vectors(spark, str(path), *bad)


def test_index_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(40, 8)).astype(np.float32)
    v, q = table(spark, rows), queries(spark, rows[:3])
    made = {
        "flat": (search.flat_add(search.flat_create(8, "ip"), v), search.flat_index_search),
        "pq": (ivf.pq_add(ivf.pq_train(ivf.pq_create(8, 2, 8), v), v), ivf.pq_search),
        "ivf": (ivf.ivf_add(ivf.ivf_train(ivf.ivf_create(8, 4), v), v), ivf.ivf_search),
        "ivfpq": (ivf.ivfpq_add(ivf.ivfpq_train(ivf.ivfpq_create(8, 4, 2, 8), v), v), ivf.ivfpq_search),
        "hnsw": (hnsw.hnsw_add(hnsw.hnsw_create(8, 4, 16), v), hnsw.hnsw_search),
    }
    for name, (index, find) in made.items():
        path = str(tmp_path / name)
        index_files.save_index(index, spark, path)
        again = index_files.load_index(spark, path)
        assert again.kind == name and again.metric == index.metric
        want, got = answer(find(index, q, SearchPlan(4, 4))), answer(find(again, q, SearchPlan(4, 4)))
        assert {k: [i for i, _ in x] for k, x in got.items()} == {k: [i for i, _ in x] for k, x in want.items()}
        index_files.save_index(again, spark, path + "2")
        assert (tmp_path / name).read_bytes() == (tmp_path / (name + "2")).read_bytes()
    (tmp_path / "bad").write_bytes(b"IxF2\x01")
    with pytest.raises(InvalidArgument):
        index_files.load_index(spark, str(tmp_path / "bad"))


def test_generations(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "gens"))
    flat = lambda rows: search.flat_add(search.flat_create(2), table(spark, rows))
    with pytest.raises(NotReady):
        g.pin_active()
    a = g.create(flat([(0, 0), (10, 10)]), "early")
    b = g.create(flat([(100, 100), (2, 2)]), "late")
    q = queries(spark, [(1.9, 2.1)])
    g.activate(a)
    pin_a = g.pin_active()
    g.activate(b)
    pin_b = g.pin_active()
    assert answer(g.search(pin_a, q, 1))[0] == [(0, pytest.approx(8.02, abs=1e-4))]
    assert answer(g.search(pin_b, q, 1))[0] == [(1, pytest.approx(0.02, abs=1e-4))]
    with pytest.raises(InvalidArgument):
        g.search(pin_a, q, 3)
    with pytest.raises(NotReady):
        g.retire(b)
    g.activate(a)  # rollback
    g.retire(b)
    assert files.exists(spark, g.path(b))  # still pinned
    with pytest.raises(NotReady):
        g.activate(b)
    g.unpin(pin_b)
    assert not files.exists(spark, g.path(b))
    with pytest.raises(InvalidArgument):
        g.unpin(pin_b)
    assert Generations(spark, g.root).active() == a and g.label(a) == "early" and g.table().count() == 1
    with pytest.raises(InvalidArgument):
        g.create(flat([(0, 0)]), "x" * 129)


def test_engine(spark, tmp_path):
    v = table(spark, [(0, 0), (1, 1), (2, 2)])
    with Engine(spark, 2) as engine:
        trained = engine.result(engine.submit_train(ivf.ivf_create(2, 1), v))
        index = engine.result(engine.submit_add(trained, v))
        request = engine.submit_search(index, queries(spark, [(0.1, 0.1), (2.1, 2.0)]), SearchPlan(1))
        assert engine.wait(request) == COMPLETED and [r["vec_id"] for r in sorted(engine.result(request))] == [0, 2]
        bad = engine.submit_search(ivf.ivf_create(2, 1), queries(spark, [(0, 0)]), SearchPlan(1))
        assert engine.wait(bad) == FAILED
        with pytest.raises(InvalidArgument):
            engine.result(bad)
        waiting = engine.submit("idle", lambda: 1, start=False)
        engine.cancel(waiting)
        assert engine.poll(waiting) == CANCELLED
        with pytest.raises(InvalidArgument):
            engine.cancel(request)
        with pytest.raises(InvalidArgument):
            engine.result(engine.submit_train(hnsw.hnsw_create(2, 2), v))
        steps = []
        made = engine.submit_pipeline(lambda s, f: steps.append("compile"), lambda s, f: steps.append("embed"), "s", "f")
        assert engine.wait(made) == COMPLETED and steps == ["compile", "embed"]
        with pytest.raises(NotReady):
            engine.submit_pipeline(None, lambda s, f: None, "s", "f")
    with pytest.raises(NotReady):
        engine.submit("late", lambda: 1)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    table(spark, [(0, 0), (5, 5)]).coalesce(1).write.parquet(source)
    more = table(spark, [(9, 9)]).selectExpr("vec_id + 2 AS vec_id", "embedding").coalesce(1)
    more.write.mode("append").parquet(source)
    g = Generations(spark, str(tmp_path / "gens"))
    stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(source)
    publish_generations(stream, g, 2, "l2", str(tmp_path / "ckpt")).awaitTermination()
    assert len(g.known) == 2
    pin = g.pin_active()
    assert g.index(pin).tables["vectors"].count() == 3
    index = ivf.ivf_train(ivf.ivf_create(2, 2), table(spark, [(0, 0), (9, 9)]))
    append_lists(stream, index, str(tmp_path / "lists"), str(tmp_path / "ckpt2")).awaitTermination()
    got = {r["vec_id"]: r["list_id"] for r in spark.read.parquet(str(tmp_path / "lists")).collect()}
    assert got == {0: 0, 1: 1, 2: 1} or got == {0: 0, 1: 0, 2: 1}
    queries(spark, [(8, 8), (0, 1)]).coalesce(1).write.parquet(str(tmp_path / "q"))
    asked = spark.readStream.schema("qid long, q array<float>").parquet(str(tmp_path / "q"))
    search_stream(asked, g, 1, str(tmp_path / "hits"), str(tmp_path / "ckpt3")).awaitTermination()
    assert {r["qid"]: r["vec_id"] for r in spark.read.parquet(str(tmp_path / "hits")).collect()} == {0: 2, 1: 0}


def test_bridges(spark):
    links = bridges.Bridges()
    links.register("half", bridges.scale(0.5))
    links.register("moved", bridges.shift([1, 0]))
    links.register("swap", bridges.project(np.array([[0, 1], [1, 0], [1, 1]])))
    links.connect("a", "b", ["half", "moved", "swap"])
    got = links.cross(table(spark, [(2, 4)]), "a", "b").first()["embedding"]
    assert got == [2, 2, 4]
    steps = bridges.nearest_steps(queries(spark, [(0, 0.9), (3, 3)]), table(spark, [(0, 1), (4, 4)]))
    assert {r["qid"]: r["vec_id"] for r in steps.collect()} == {0: 0, 1: 1}
    for bad in (lambda: links.register("half", bridges.scale(2)), lambda: links.connect("a", "c", ["no"]), lambda: links.cross(table(spark, [(1, 1)]), "b", "a")):
        with pytest.raises(InvalidArgument):
            bad()


def test_cli(tmp_path, capsysbinary):
    path = tmp_path / "s.yaml"
    path.write_text(TEXT)
    assert cli.main(["validate", str(path)]) == 0
    assert cli.main(["compile", str(path), str(tmp_path / "out")]) == 0
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"manifest.json", "contracts.json", "vector_layout.json"}
    assert cli.main(["embed", str(path), str(tmp_path / "v.bin")]) == 0 and (tmp_path / "v.bin").stat().st_size == 80
    assert cli.main(["visualize", str(path)]) == 0 and capsysbinary.readouterr().out.startswith(b"digraph")
    path.write_text(TEXT.replace("dim: 4", "dim: 0"))
    assert cli.main(["canonicalize", str(path)]) == 1
    assert cli.main(["nothing"]) == 2
