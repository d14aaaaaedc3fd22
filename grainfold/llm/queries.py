"""The operN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm import alignment, bpe, chat, decontam, langid, lexical, licenses, linedup, media, ngramjoin, sampling, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_frame(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linedup.drop_common_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, start of every benchmark item found in a document."""
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation and of conversation -7."""
    own = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    conv = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(conv.unionByName(spark.createDataFrame(own, conv.schema)))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as an 8-bit image, stored, read back and described."""
    return media.text_media(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, family, probability, template_cover, confirmed of every licence notice in the documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return ngramjoin.components(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives."""
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 best documents for each benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return sampling.compare_edited(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_chat_format": op4_chat_format,
    "op5_media": op5_media,
    "op6_language_id": op6_language_id,
    "op7_licenses": op7_licenses,
    "op8_token_count": op8_token_count,
    "op9_ngram_join": op9_ngram_join,
    "op10_warc": op10_warc,
    "op11_lexical_search": op11_lexical_search,
    "op12_fingerprints": op12_fingerprints,
    "op13_alignment": op13_alignment,
}


def oracles() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; op7's holds the weights, and so trains the model."""
    return {
        "op2_line_dedup": linedup.ORACLE_SQL,
        "op4_chat_format": chat.ORACLE_SQL,
        "op7_licenses": licenses.oracle_sql(),
        "op9_ngram_join": ngramjoin.ORACLE_SQL,
        "op10_warc": warc.ORACLE_SQL,
        "op11_lexical_search": lexical.ORACLE_SQL,
    }
