"""The corpus operators' queries, each over its whole tables with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .backoff import backoff_scores
from .common import table
from .ctph import compared_with_next
from .debruijn import remove_repeats
from .discriminant import quality_scores
from .minhash import near_duplicates
from .language import page_languages
from .mixing import mixed_words
from .multiindex import near_vectors
from .packing import packed
from .pseudonyms import pseudonymised


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers has a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The secret key of the session, spark.sextant.pseudonymKey; where it is unset, a random one, kept for the session:
    values are then linked inside it, and nobody can restore them after it."""
    name = "spark.sextant.pseudonymKey"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_stupid_backoff": lambda spark, d: backoff_scores(table(spark, d, "documents")),
    "op2_minhash_near_dedup": lambda spark, d: near_duplicates(table(spark, d, "documents")),
    "op3_nnls_packing": lambda spark, d: packed(table(spark, d, "documents"), vocabulary_path()),
    "op4_inverted_multi_index": lambda spark, d: near_vectors(table(spark, d, "embeddings")),
    "op5_source_mixing": lambda spark, d: mixed_words(table(spark, d, "documents")),
    "op6_substring_dedup": lambda spark, d: remove_repeats(table(spark, d, "documents")),
    "op7_feistel_pseudonyms": lambda spark, d: pseudonymised(table(spark, d, "documents").select("doc_id", "text"), pseudonym_key(spark)),
    "op8_context_triggered_hashes": lambda spark, d: compared_with_next(table(spark, d, "documents")),
    "op9_language_fusion": lambda spark, d: page_languages(table(spark, d, "pages"), table(spark, d, "documents")),
    "op10_quadratic_discriminant": lambda spark, d: quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
}
ORACLES: dict[str, str] = {
    "op1_stupid_backoff": oracles.BACKOFF,
    "op2_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op4_inverted_multi_index": oracles.NEAR_VECTORS,
    "op6_substring_dedup": oracles.REPEATS,
}
