"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import documents, read
from . import bytecodec, conversations, divergence, fingerprints, langid, lines, mixing, packing, quality, secrets, shards, simhash, tokens


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels all documents with a network that is trained on those that aren't held out."""
    return langid.identify(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups all documents by SimHash fingerprints of at most three differing bits."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds the secrets in all documents."""
    return secrets.find_secrets(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints all documents, their edited texts, and the likeness of each to its edited text and to the next one."""
    return fingerprints.edited_likeness(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return packing.pack(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures all documents and judges each by the rules and its group's thresholds."""
    return quality.judged(documents(spark, sf_dir))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of all documents."""
    return tokens.token_counts(documents(spark, sf_dir))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents in training order and returns the index of the shards."""
    return shards.materialise(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents: what each source's target is and how often each document is taken."""
    return mixing.mix(documents(spark, sf_dir))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes the lines that many sources share from all documents."""
    return lines.cleaned(documents(spark, sf_dir).select("doc_id", "text", "source")).drop("source")


def op11_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents by the ranks of the multilingual vocabulary and decodes them again."""
    return bytecodec.round_trip(documents(spark, sf_dir))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages all conversations and reports what is wrong with them and how they are repaired at the least cost."""
    return conversations.report(conversations.damaged(read(spark, sf_dir, "conversations")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of all documents diverges in its words from the other sources of its language, and from the language."""
    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_tokens": op7_tokens,
    "op8_shards": op8_shards,
    "op9_mixing": op9_mixing,
    "op10_lines": op10_lines,
    "op11_bytebpe": op11_bytebpe,
    "op12_conversations": op12_conversations,
    "op13_divergence": op13_divergence,
}

#: The others can't be told in SQL: they need hashes, models or tokenizers.  Tests hold each against a brute-force version.
SQL: dict[str, str] = {"op10_lines": lines.SQL, "op13_divergence": divergence.SQL}
