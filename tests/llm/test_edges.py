"""Every operator on nulls, empty and long texts, repeated rows, extra columns, and no rows at all."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bits, exact, language, near, packing, pieces, pii, secrets, toxicity, winnow
from corvane.llm.queries import QUERIES, SQL
from corvane.llm.shared import filter_bits, flagged, shared_dir, without

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, digest string, _row string, bucket int"


def odd_rows():
    words = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    texts = [None, "", " \t\n", "a", "a", "one two", "one two three four five six seven", words, words + " end", "x" * 20_000, "é😀 ñ\u0085 b", "1 2 3", None, "a b c"]
    return [(i, t, "en" if i % 3 else None, None, None, "b", None, "r", i) for i, t in enumerate(texts)] + [(3, "a", "en", None, None, "b", None, "r", 0), (None, "one two", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": exact.exact_dedup,
    "near": near.near_duplicates,
    "secrets": lambda d: secrets.find_secrets(d, secrets.learn(d)),
    "language": lambda d: language.identify(d, language.learn(d)),
    "bits": bits.packed_tokens,
    "pieces": pieces.encode_pieces,
    "pii": pii.find_pii,
    "winnow": winnow.edited_fingerprints,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(odd, none, name):
    rows = OPERATORS[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_rows())
    assert OPERATORS[name](none).collect() == []


def test_packing_edges(odd, none):
    rows = packing.pack_documents(odd).collect()
    assert {str(r["doc_id"]) for r in rows} == {str(r[0]) for r in odd_rows()}
    assert packing.pack_documents(none).collect() == []


def test_toxicity_edges(odd, none, labels):
    lexicon = toxicity.learn(toxicity.labelled_sample(odd, labels))
    assert len(toxicity.score(odd, lexicon).collect()) == len(odd_rows())
    assert toxicity.score(none, lexicon).collect() == []
    bare = toxicity.learn(toxicity.labelled_sample(none, labels.limit(0)))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd, bare).collect()}
    assert all(0 <= s < toxicity.THRESHOLD for s in scores.values())


def test_pipeline_edges(spark, odd, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {r["doc_id"] for r in packed.collect()} == kept


def test_defined_results(odd):
    near_rows = {r["doc_id"]: r for r in near.near_duplicates(odd).collect()}
    assert [near_rows[i]["n_shingles"] for i in (0, 1, 2)] == [0, 0, 0] and near_rows[1]["component_id"] == 1
    assert near_rows[4]["component_id"] == 3 and near_rows[8]["component_id"] == 7
    assert near_rows[None]["component_id"] == 5 and not near_rows[None]["kept"]
    exact_rows = {r["doc_id"]: r for r in exact.exact_dedup(odd).collect()}
    assert exact_rows[12]["keep_id"] == 2 and exact_rows[0]["group_size"] == 4  # the longest original of empty ones
    assert exact_rows[4]["group_size"] == 3 and exact_rows[None]["keep_id"] == 5
    assert exact_rows[0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    lang = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, language.learn(odd)).collect()}
    assert lang[0] == lang[1] == lang[11] == "und" and lang[5] == "en"


REPEATED = [(0, "a"), (1, "a"), (1, "b c d"), (2, "z"), (2, "z"), (None, "q"), (None, "q")]


@pytest.mark.parametrize("from_files", [True, False])
def test_stages_drop_rows_not_ids(spark, tmp_path, from_files):
    """Repeated and null ids: one row of each text stays, no text is lost."""
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string").withColumn("source", F.lit("s"))
    if from_files:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    want = [(0, "a"), (1, "b c d"), (2, "z"), (None, "q")]
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    for operator in (exact.exact_dedup, near.near_duplicates):
        assert operator(docs).where("kept").count() == 4 and operator(docs).count() == len(REPEATED)


def test_content_is_found_by_its_locator(spark, tmp_path):
    spark.createDataFrame(REPEATED[:5], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    found = exact.exact_dedup(spark.read.parquet(str(tmp_path / "docs")))
    got = exact.content_at(spark, found.where("doc_id = 0").select("keep_id", "keep_locator")).collect()
    assert [(r["keep_id"], r["text"]) for r in got] == [(0, "a")]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared_dir(Session)
    assert filter_bits(1) == 1 << 16 and filter_bits(1 << 26) == 1 << 30 and filter_bits(1 << 31) == 0


def test_membership(spark):
    rows = spark.range(5_000).selectExpr("cast(id AS int) AS k", "'t' AS _flag")
    keys = spark.range(0, 5_000, 7).selectExpr("id AS k")
    few = flagged(rows, keys, "k", 1 << 16)
    assert few.columns == rows.columns
    got = {r["k"] for r in few.collect()}
    assert set(range(0, 5_000, 7)) <= got and len(got) < 1_500
    assert sorted(r["k"] for r in without(rows, keys, "k", 1 << 16).collect()) == [k for k in range(5_000) if k % 7]
    assert without(rows, keys.limit(0), "k").count() == 5_000


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(SQL) == {"op1_exact_dedup", "op2_near_duplicates"}
