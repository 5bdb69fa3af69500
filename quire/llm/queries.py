"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bytepairs, html, mixing, packing, passages, phrases, quality, sharding, simhash, spelling, tokens, toxicity, vafile

QUERIES = {
    "op1_simhash": simhash.op1,
    "op2_quality": quality.op2,
    "op3_vafile": vafile.op3,
    "op4_shards": sharding.op4,
    "op5_packing": packing.op5,
    "op6_html": html.op6,
    "op7_passages": passages.op7,
    "op8_toxicity": toxicity.op8,
    "op9_mixing": mixing.op9,
    "op10_tokens": tokens.op10,
    "op11_bytepairs": bytepairs.op11,
    "op12_phrases": phrases.op12,
    "op13_spelling": spelling.op13,
}

ORACLE_SQL = {
    "op2_quality": quality.OP2_SQL,
    "op3_vafile": vafile.OP3_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
