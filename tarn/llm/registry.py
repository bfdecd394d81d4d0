"""The queries of the training-data operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from . import chat, fingerprints, language_id, near_dedup, packing, pii, quality, secret_scan, sentencepiece_io, sharding

QUERIES = {
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op10_pii": pii.op10_pii,
    "op9_sentencepiece": sentencepiece_io.op9_sentencepiece,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "fingerprint_matches": fingerprints.fingerprint_matches,
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op4_packing": packing.op4_packing,
    "op2_chat": chat.op2_chat,
    "op7_language_id": language_id.op7_language_id,
    "op5_quality": quality.op5_quality,
    "op8_sharding": sharding.op8_sharding,
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
    "fingerprint_matches": fingerprints.MATCHES_SQL,
    "op5_quality": quality.OP5_SQL,
}
