"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from . import chats, decontamination, filters, licences, mixing, pieces, pivots, quality, secrets, simhash, suffixes, tokens, whitening

QUERIES = {
    "op1_decontaminate": decontamination.op1_decontaminate,
    "op2_quality": quality.op2_quality,
    "op3_licences": licences.op3_licences,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_chat_format": chats.op5_chat_format,
    "op6_secrets": secrets.op6_secrets,
    "op7_mix": mixing.op7_mix,
    "op8_simhash_dedup": simhash.op8_simhash_dedup,
    "op9_repeated_passages": suffixes.op9_repeated_passages,
    "op10_embedding_dedup": pivots.op10_embedding_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_filter_audit": filters.op12_filter_audit,
    "op13_pieces": pieces.op13_pieces,
}
ORACLES = {
    "op1_decontaminate": decontamination.ORACLE,
    "op5_chat_format": chats.ORACLE,
    "op6_secrets": secrets.ORACLE,
    "op10_embedding_dedup": pivots.ORACLE,
    "op12_filter_audit": filters.ORACLE,
}
