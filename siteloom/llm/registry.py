"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from siteloom.llm import chat, embedding_dedup, html_extract, jaccard_join, langid, licenses, line_dedup, minhash, mixing, packing

QUERIES = {
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_fingerprints": minhash.op3_fingerprints,
    "op4_packing": packing.op4_packing,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_mixing": mixing.op6_mixing,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_chat_format": chat.op8_chat_format,
    "op9_language_id": langid.op9_language_id,
}

ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op5_license_scan": licenses.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_chat_format": chat.OP8_SQL,
}
