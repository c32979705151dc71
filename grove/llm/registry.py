"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from grove.llm import chat, fingerprint, language, licences, mixing, near_dup, nearest, pieces, sharding, toxicity

QUERIES = {
    "op1_licences": licences.op1_licences,
    "op2_nearest": nearest.op2_nearest,
    "op3_language_id": language.op3_language_id,
    "op4_near_duplicates": near_dup.op4_near_duplicates,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_fingerprints": fingerprint.op6_fingerprints,
    "op7_pieces": pieces.op7_pieces,
    "op8_mix": mixing.op8_mix,
    "op9_chat": chat.op9_chat,
    "op10_shards": sharding.op10_shards,
}
SQL = {**licences.SQL, **mixing.SQL, **chat.SQL}
