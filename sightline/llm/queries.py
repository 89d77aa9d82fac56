"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from sightline.llm import bitsliced, cdc, chat, gif, linededup, mixing, packing, quality, simhash, toxicity

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_topk": bitsliced.op3_topk,
    "op4_mixing": mixing.op4_mixing,
    "op5_cdc": cdc.op5_cdc,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_gif": gif.op7_gif,
    "op8_simhash": simhash.op8_simhash,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
}

ORACLE: dict[str, str] = {
    "op1_chat": chat.ORACLE_OP1,
    "op3_topk": bitsliced.ORACLE_OP3,
    "op6_line_dedup": linededup.ORACLE_OP6,
}
