"""Column names that operators use themselves, and values at the edge of what they take."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import packing, topk
from logloom.llm.common import tokenizer_path

NAMES = ("candidates", "raw", "_id", "_k", "_key", "_size", "_part", "_epochs", "_keep", "_cut", "spans", "score", "predicted", "words",
         "base", "key", "part", "size", "_rows", "component_id", "other_columns", "_text", "_toxic", "a.b")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_foreign_columns_and_their_values(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    body = "the sea was calm and the boats lay at the pier until the wind came from the north again and again "
    rows = [(i, f"{body * 3} boat number {i} of the harbour {i * 7}" if i % 3 else None, "en", "a", 5,
             *[f"{n} of {i}" for n in NAMES]) for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = out.collect()
    assert got or name == "toxicity"
    for r in got:
        assert [r[n] for n in NAMES] == [f"{n} of {r.doc_id}" for n in NAMES]
        assert (r.lang, r.source) == ("en", "a")


def test_long_runs_of_blanks_have_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    ids, whole = packing.Ids(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for blank in (" ", "\n", "\t", "　", " \t\n"):
        for before in ("", "word", "word."):
            for after in ("", "x", "'s", "!", "9"):
                text = before + blank * 15_000 + after + " end" + blank * 12_000
                assert list(memoryview(ids.of(text)).cast("I")) == whole.encode(text, add_special_tokens=False).ids


def test_very_long_texts_are_packed(spark):
    start = time.perf_counter()
    rows = [(1, " " * 10**7 + "a"), (2, "b" * 10**6), (3, "\n \t" * 10**6), (4, "x " * 10**6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(docs, tokenizer_path())
    tokens = {r.doc_id: (r.n, r.tokens) for r in got.groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens")).collect()}
    assert len(tokens) == 4 and all(n == t for n, t in tokens.values())
    assert time.perf_counter() - start < 120


def test_components_beyond_the_doubles_when_scaled(spark):
    rows = [(0, [1e307, 1.0]), (1, [1.0, 0.0]), (2, [-1e307, 0.0]), (50, [1e308, -1e308]), (3, [float("inf"), 0.0]), (4, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in got} == {0, 50} and 3 not in {r.vec_id for r in got}
    scores = {(r.query_id, r.vec_id): r.score for r in got}
    assert scores[0, 1] == 2**63 - 1 and scores[0, 2] == -(2**63)
