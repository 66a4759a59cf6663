"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, langid, neardup, packing, quality, resampling, suffixes, tiff, toxicity, trie, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_snapshots": chat.query,
    "op2_language_id": langid.query,
    "op3_superminhash_neardup": neardup.query,
    "op4_toxicity_kneser_ney": toxicity.query,
    "op5_url_association_rules": urlfilter.query,
    "op6_byte_bpe": bpe.query,
    "op7_warc_members": warc.query,
    "op8_tiff_pages": tiff.query,
    "op9_sum_of_squares_packing": packing.query,
    "op10_quality_decision_list": quality.query,
    "op11_conversation_trie": trie.query,
    "op12_importance_resampling": resampling.query,
    "op13_difference_cover_dedup": suffixes.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_snapshots": chat.ORACLE,
    "op3_superminhash_neardup": neardup.ORACLE,
    "op7_warc_members": warc.ORACLE,
    "op11_conversation_trie": trie.ORACLE,
}
