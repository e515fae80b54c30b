"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.llm import decontaminate, langid, lines, minhash, packing, paragraphs, resampling, substrings, vectors, warc
from tablewright.llm.common import ship


def _table(spark, sf_dir, name):
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate components of all documents on 2-word shingles at similarity 0.8."""
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def _vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_suffix_array_dedup(spark, sf_dir):
    """What exact substring dedup removes from all documents, by document."""
    return substrings.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op8_sum_of_squares_packing(spark, sf_dir):
    """All documents, tokenised, in sequences of at most 4096 tokens."""
    return packing.packed_sequences(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op4_sorted_projection_near_dedup(spark, sf_dir):
    """Near-duplicate links and components of all embeddings of equal label at cosine 0.93."""
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_hierarchical_language_id(spark, sf_dir):
    """The language of every document, learnt from the labelled documents that are not held out."""
    return langid.predicted(_table(spark, sf_dir, "documents"))


def op1_line_dedup(spark, sf_dir):
    """Lines of all documents that fuzzy line dedup removes, by document."""
    return lines.report(_table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark, sf_dir):
    """Digest columns of the metadata and conversion records of all pages."""
    made = warc.build(_table(spark, sf_dir, "pages"))
    head = F.col("headers")
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", head["Content-Type"].alias("content_type"),
        head["Content-Length"].cast("long").alias("content_length"), head["WARC-Block-Digest"].alias("block_digest"), "payload_digest", "n_outlinks",
    )


def op5_paragraph_dedup(spark, sf_dir):
    """Paragraphs of all documents, of one word or more, and passages inside them that MinHash banding removes, by document."""
    return paragraphs.report(_table(spark, sf_dir, "documents"), least_words=1, passages=True)


def op6_importance_resampling(spark, sf_dir):
    """Importance weights of all documents and the Gumbel top-k sample of 85 % of them."""
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_template_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item's template, with the item and how much of it they hold."""
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    """The corpus pipeline's stages, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    """All queries by name."""
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"pipeline": pipeline}


def oracle_sql():
    """None: the operators here are held against brute-force versions in tests/llm."""
    return {}
