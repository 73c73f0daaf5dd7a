"""A corpus from raw documents to training sequences.

Five stages, each a ``(name, function)`` of ``STAGES``; a function takes
``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of
``docs``.

1. ``toxicity``: documents predicted toxic go.
2. ``ngram_jaccard``: of each group of near duplicates the smallest id stays. Texts
   are near duplicates from 80 percent of their distinct 5-word shingles (the query
   op4 has its own contract, 3 words and 90 percent).
3. ``pii``: personal data in the texts is replaced by its kind; all rows stay.
4. ``mixing``: sources meet their target weights; a row is there as often as it is
   taken, the one at a source's cut with the words inside the budget.
5. ``packing``: a row per piece of a training sequence.

Null ids, null texts, repeated rows and empty tables pass as each operator
defines; near duplicates keep rows without an id, and one of rows that repeat an
id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import jaccard, mixing, packing, pii, toxicity
from logloom.llm.common import materialize, sifted, table, tokenizer_path
from logloom.sources.materialize import new_folder


#: Word shingles and similarity of near duplicates in the corpus.
NEAR = jaccard.Join(words=5, percent=80)


#: Columns that a stage's operator does not use travel in one of this name, whatever their own.
CARRIED = "other_columns"


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    mine, other = ([F.col(f"`{c}`") for c in docs.columns if (c in used) == own] for own in (True, False))
    return docs.select(*mine, F.struct(*other).alias(CARRIED)) if other else docs


def _together(out: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return out.select(*[F.col(f"`{c}`" if c in used else f"{CARRIED}.`{c}`").alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("doc_id", "text")
    scored = toxicity.scores(_apart(docs, *used), table(spark, sf_dir, "labels"))
    return _together(scored.where("predicted = 0"), docs, *used)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = materialize(jaccard.linked(docs.select("doc_id", "text"), NEAR).where(F.col("doc_id").isNotNull()))
    # Of most documents one row stays; only rows that may be of the others are moved.
    own = F.count_if(F.col("doc_id") == F.col("component_id"))
    others = materialize(groups.groupBy("doc_id").agg(own.alias("_rows")).where("_rows <> 1"))
    may, stays = sifted(docs, others.select("doc_id"))
    parts = [stays, may.join(others, "doc_id", "left_anti")]
    again = others.where("_rows > 1").select("doc_id")
    if not again.isEmpty():
        parts.append(may.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("doc_id", "text", "n_chars")
    return _together(pii.redact(_apart(docs, *used)), docs, *used)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("doc_id", "text", "source", "n_chars")
    return _together(mixing.mixed_rows(_apart(docs, *used)), docs, *used)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, hashes and a tokenizer decide; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
