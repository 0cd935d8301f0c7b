"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, fingerprint, langid, line_dedup, mixing, secrets, sharding, simhash, substring

QUERIES = {
    "op1_collision_ann": ann.op1,
    "op2_tiered_compaction": sharding.op2,
    "op3_site_line_dedup": line_dedup.op3,
    "op4_language_id": langid.op4,
    "op5_iblt_fingerprints": fingerprint.op5,
    "op6_substring_dedup": substring.op6,
    "op7_simhash_covering": simhash.op7,
    "op8_source_mix": mixing.op8,
    "op9_bpe_rank_array": bpe.op9,
    "op10_secret_scan": secrets.op10,
}

ORACLES = {
    "op2_tiered_compaction": sharding.OP2_SQL,
    "op3_site_line_dedup": line_dedup.OP3_SQL,
    "op8_source_mix": mixing.OP8_SQL,
}
