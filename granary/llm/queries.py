"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from granary.llm import bpe, chat, fingerprints, huffman, ngram_join, packing, quality, secrets, sharding, urls

QUERIES = {
    "op1_chat_formatting": chat.query,
    "op2_packing": packing.query,
    "op3_token_files": huffman.query,
    "op4_quality_rules": quality.query,
    "op5_byte_bpe": bpe.query,
    "op6_secret_scans": secrets.query,
    "op7_ngram_join": ngram_join.query,
    "op8_sharding": sharding.query,
    "op9_fingerprints": fingerprints.query,
    "op10_url_filters": urls.query,
}

SQL = {
    "op1_chat_formatting": chat.SQL,
    "op4_quality_rules": quality.SQL,
    "op10_url_filters": urls.SQL,
}
