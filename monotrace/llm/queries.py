"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, backoff, best_fit, chunk_dedup, decontaminate, line_windows, packing, pfor, prefix_trie, quality, secret_scan, simhash, spotsigs
from .common import new_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    pfor.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), path)
    return pfor.digest(pfor.read_ids(spark, path))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def spotsigs_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links: classes of documents whose fingerprints are 0.8 alike or more."""
    return spotsigs.near_groups(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed (runs), removed (begin:end, comma-joined), kept_chars, kept_sha256."""
    out = chunk_dedup.remove_repeated_chunks(table(spark, sf_dir, "documents"))
    removed = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["begin"].cast("string"), r["end"].cast("string"))), ",")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_removed"), removed.alias("removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, comma-joined), kept_sha256."""
    out = line_windows.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_score and mean_log_score, rounded to 4 and 6 places."""
    out = backoff.backoff_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, most=4, most_wide=None)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("node")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack_documents,
        op2_token_files,
        op3_decontaminate,
        op4_spotsigs,
        spotsigs_groups,
        op5_quality,
        op6_chunk_dedup,
        op7_line_windows,
        op8_stupid_backoff,
        op9_secret_scan,
        op10_simhash,
        op11_alignment,
        op12_best_fit,
        op13_prefix_trie,
    )
}

ORACLES: dict[str, str] = {
    "op7_line_windows": line_windows.ORACLE,
    "op8_stupid_backoff": backoff.ORACLE,
    "op9_secret_scan": secret_scan.oracle(),
    "op13_prefix_trie": prefix_trie.oracle(),
}
