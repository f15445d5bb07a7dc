"""Registered queries of the training-data operators, one per operator, and their checking SQL."""

from __future__ import annotations

from . import chat, forest, langid, mixing, neardup, packing, resampling, secrets, simhash, topk, urls, warc, whitening

QUERIES = {
    "op1_embedding_neardup": neardup.op1_embedding_neardup,
    "op2_warc_packages": warc.op2_warc_packages,
    "op3_mixing": mixing.op3_mixing,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_url_filters": urls.op5_url_filters,
    "op6_language_id": langid.op6_language_id,
    "op7_packing": packing.op7_packing,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_simhash": simhash.op9_simhash,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_nearest_neighbours": forest.op13_nearest_neighbours,
}
ORACLES = {
    "op1_embedding_neardup": neardup.ORACLE,
    "op2_warc_packages": warc.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op5_url_filters": urls.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
}
