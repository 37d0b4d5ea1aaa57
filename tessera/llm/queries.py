"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, cnn, minhash, packing, quality_rules, sentencepiece_fst, sharding, topk, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_minhash": minhash.op2_minhash,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_sharding": sharding.op4_sharding,
    "op5_sentencepiece": sentencepiece_fst.op5_sentencepiece,
    "op6_topk": topk.op6_topk,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_classifier": cnn.op9_quality_classifier,
    "op10_chat": chat.op10_chat,
}
ORACLES = {
    "op1_warc": warc.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op6_topk": topk.ORACLE_SQL,
    "op10_chat": chat.ORACLE_SQL,
}
