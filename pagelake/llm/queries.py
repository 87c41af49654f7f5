"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import conversation_trie, decontamination, filter_audit, fingerprints, html_text, language_id, near_duplicates, neighbours, oracles, packing, secret_scan, sharding, token_counts, warc_zip
from pagelake.llm.common import fresh, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(token_counts.TOKENIZER)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archived(spark, table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two deliveries against one ledger: the English documents, then all. What the first has scanned isn't scanned again."""
    docs, ledger = table(spark, sf_dir, "documents"), fresh(spark, "ledger")
    secret_scan.scan_unseen(docs.where("lang = 'en'"), ledger)
    found = secret_scan.secret_scan(docs, ledger)
    kinds = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{rule.kind}')) as long)").alias(f"n_{rule.kind}") for rule in secret_scan.RULES]
    spans = secret_scan.span_text(F.col("spans"))
    return found.select("doc_id", *kinds, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), "blob")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), fresh(spark, "slot-maps")
    first = sharding.first_map(sharding.slot_sizes(sharding.measured(docs)), 8)
    version = sharding.store_map(first, folder, 1)
    version = sharding.store_map(sharding.rebalanced(sharding.stored_map(spark, folder, version), 8), folder, version + 1)
    return sharding.shard_rows(docs, sharding.stored_map(spark, folder, version))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "component")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op13_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_warc_zip, op3_secret_scan, op4_language_id, op5_html_text,
        op6_fingerprints, op7_virtual_slots, op8_packing, op9_decontamination, op10_prefix_tree_join, op11_filter_audit, op12_conversation_trie, op13_block_neighbours,
    )
}
ORACLES = {"op2_warc_zip": oracles.OP2, "op3_secret_scan": oracles.OP3, "op9_decontamination": oracles.OP9, "op10_prefix_tree_join": oracles.OP10, "op11_filter_audit": oracles.OP11, "op12_conversation_trie": oracles.OP12, "op13_block_neighbours": oracles.OP13}
