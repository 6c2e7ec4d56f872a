"""Registered corpus queries: (spark, folder of parquet files) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwise.llm import (
    fingerprints,
    html_extraction,
    jaccard_join,
    language_id,
    minhash,
    mixing,
    packing,
    phrases,
    quality_rules,
    secrets,
    substring_dedup,
    toxicity,
    whitening,
)
from weekwise.session import SMALL_BATCHES, configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_quality_rules(spark, sf_dir):
    """Counts, ratios and the verdict of the threshold table for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).drop("text")


@query
def op8_secret_scans(spark, sf_dir):
    """Secrets of every document through a new blob ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.Ledger(spark)
    ledger.scan(docs)
    return secrets.digest(ledger.report(docs).select("doc_id", "spans"))


@query
def op2_substring_dedup(spark, sf_dir):
    """Words left after the removal of repeated windows of 35 words."""
    configure(spark, SMALL_BATCHES)
    return substring_dedup.removed_words(table(spark, sf_dir, "documents"), with_text=False)


@query
def op3_language_id(spark, sf_dir):
    """Language of every document by error-correcting output codes."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark, sf_dir):
    """Toxicity of every document by subword-bag embeddings."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return minhash.link(table(spark, sf_dir, "documents"))


@query
def op4_source_mixing(spark, sf_dir):
    """Words that a mix of all sources takes from every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op9_sequence_packing(spark, sf_dir):
    """Place of every token piece in sequences of 2048."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_document_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


@query
def op1_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op11_ngram_jaccard_join(spark, sf_dir):
    """Groups of documents linked by the Jaccard similarity of their word triples."""
    configure(spark, SMALL_BATCHES)
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


@query
def op12_phrase_collocations(spark, sf_dir):
    """The best phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op13_embedding_whitening(spark, sf_dir):
    """Whitened components of every embedding."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query
def pipeline(spark, sf_dir):
    """Token pieces of the corpus after all stages."""
    return corpus_pipeline.run(spark, sf_dir)
