"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, extraction, jaccard, language, licenses, mixing, packing, pii, quality, topk, toxicity, trie, warc
import corpus_pipeline
from logloom.sources.materialize import new_folder

from .common import fold, materialize, table, tokenizer_path


def op1_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scores(docs, table(spark, sf_dir, "labels"), narrow=True)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op2_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark)}/warc"
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.payloads(warc.read(spark, path))
    # Digest and length are taken where the payload is read; it moves no further.
    narrow = found.select(
        "type", "record_id", "concurrent_to", "refers_to", "digest",
        F.octet_length("payload").cast("long").alias("bytes"),
        F.when(F.col("type") == "response", warc.base32_sha1(F.col("payload"))).alias("actual"),
        F.when(F.col("type") == "metadata", warc.page_id(F.col("block"))).alias("page_id"),
    )
    whole = materialize(warc.assembled(narrow).select(
        "capture_id", "response", F.col("metadata.page_id").alias("page_id")))
    # Responses that are revisited, spread like the revisits that look for them.
    salt = F.pmod(F.xxhash64("capture_id"), F.lit(warc.SALTS))
    revisits = whole.where("response.type = 'revisit'").withColumn("salt", salt)
    wanted = revisits.select(F.col("response.refers_to").alias("capture_id")).distinct()
    firsts = whole.join(wanted, "capture_id", "left_semi").select(
        F.col("capture_id").alias("_first"), F.col("page_id").alias("refers_to"),
        F.col("response.bytes").alias("_bytes"), F.col("response.actual").alias("_actual"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(warc.SALTS - 1).cast("long"))).alias("salt"))
    known = revisits.join(
        firsts, (F.col("response.refers_to") == F.col("_first")) & (revisits["salt"] == firsts["salt"]), "left"
    ).select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
             F.lit("revisit").alias("record_type"), "refers_to")
    own = whole.where("response.type = 'response'").select(
        "page_id", F.col("response.bytes").alias("payload_bytes"), F.col("response.actual").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(known)


def op3_topk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op5_language_words_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"))
    out = language.identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op6_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"] == 1)
    starts = F.transform(base, lambda m: m["start"])
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    # A notice or licence text of the method's own is surer than a mere phrase.
    score = F.when(F.exists("matches", lambda m: m["base"] == 0), 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"), score.alias("score"),
    )


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select("doc_id", *quality.BASE, "base_failed", "kept")


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Narrow: the candidates are found once, for fitting and for selecting.
    found = materialize(pii.candidates(docs).drop("text"))
    out = pii.selected(found, pii.fit(found))
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE_KINDS)],
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    "op1_toxicity_kneser_ney": op1_toxicity_kneser_ney,
    "op2_warc_assembly": op2_warc_assembly,
    "op3_topk_tiles": op3_topk_tiles,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_language_words_first": op5_language_words_first,
    "op6_license_templates": op6_license_templates,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_pii_boosting": op8_pii_boosting,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_html_extraction": op13_html_extraction,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_warc_assembly": warc.SQL,
    "op3_topk_tiles": topk.SQL,
    "op4_ngram_jaccard": jaccard.SQL,
    "op6_license_templates": licenses.SQL,
    "op7_quality_cascade": quality.SQL,
    "op11_prefix_trie": trie.SQL,
    "op12_collocations": collocations.SQL,
    "op13_html_extraction": extraction.SQL,
}
