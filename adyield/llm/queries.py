"""One query per operator, over whole tables."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import (byte_pieces, grid_order, language_parse, maxscore, mixing, ngram_join, part_codes, quality_trees, sentence_spans,
               source_divergence, toxic_segments, url_reputation, warc)
from .registry import register, table


@register("op1_url_reputation", url_reputation.oracle())
def op1_url_reputation(spark, sf):
    """Rules and empirical-Bayes host reputation; a page's outcome is the quality label with its number as id."""
    outcomes = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.filter_urls(table(spark, sf, "pages"), outcomes)


@register("op2_quality_trees")
def op2_quality_trees(spark, sf):
    """Base rules and monotone boosted trees over document statistics."""
    return quality_trees.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op4_language_parse")
def op4_language_parse(spark, sf):
    """Language of every document by cross-parsing entropy."""
    return language_parse.predict(table(spark, sf, "documents"))


@register("op6_byte_pieces")
def op6_byte_pieces(spark, sf):
    """Ids of every document by the multilingual byte-level vocabulary, and the decoded bytes."""
    return byte_pieces.tokenise(table(spark, sf, "documents"),
                                public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                                with_ids=False)


@register("op7_mixing")
def op7_mixing(spark, sf):
    """Words taken of every document by the mix of all sources."""
    return mixing.taken(table(spark, sf, "documents"))


@register("op3_ngram_join")
def op3_ngram_join(spark, sf):
    """Components of documents whose 5-word shingle sets are at least 0.8 similar."""
    return ngram_join.linked(table(spark, sf, "documents"))


@register("op8_sentence_spans")
def op8_sentence_spans(spark, sf):
    """Every document's text without the passages that an earlier document holds."""
    return sentence_spans.dedup(table(spark, sf, "documents")).select("doc_id", "text", "n_units", "n_removed")


@register("op5_warc")
def op5_warc(spark, sf):
    """Pages written as WARC archives to the shared folder and read back."""
    folder = os.path.join(ensure_checkpoint_dir(spark), "warc-" + uuid.uuid4().hex[:12])
    pages = table(spark, sf, "pages")
    warc.write(pages, folder)
    found = warc.read(spark, folder, with_payload=False, id_type=dict(pages.dtypes)["page_id"])
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op9_toxic_segments")
def op9_toxic_segments(spark, sf):
    """Toxicity of every document from its maximum-scoring segments."""
    return toxic_segments.predict(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op10_grid_order")
def op10_grid_order(spark, sf):
    """Link counts and components of all vectors at cosine 0.95."""
    return grid_order.linked(table(spark, sf, "embeddings"))


@register("op11_source_divergence", source_divergence.oracle())
def op11_source_divergence(spark, sf):
    """Divergence between the sources of every language, and the terms that mark each source."""
    return source_divergence.audit(table(spark, sf, "documents"))


@register("op12_part_codes", part_codes.oracle())
def op12_part_codes(spark, sf):
    """Codes of all vectors by 16 codebooks of 64 entries."""
    return part_codes.compress(table(spark, sf, "embeddings"))


@register("op13_maxscore", maxscore.oracle())
def op13_maxscore(spark, sf):
    """The 20 best inner products of every vector whose id is divisible by 20."""
    return maxscore.search(table(spark, sf, "embeddings"))
