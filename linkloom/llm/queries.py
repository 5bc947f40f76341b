"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from linkloom.llm import cooccurrence, leakage, lookalikes, mojibake, tokens, topn

QUERIES = {
    "p2_found": topn.p2_found,
    "p3_found": cooccurrence.p3_found,
    "p3_pairs": cooccurrence.p3_pairs,
    "p4_found": lookalikes.p4_found,
    "p6_ids": tokens.p6_ids,
    "p7_found": leakage.p7_found,
    "p7_kept": leakage.p7_kept,
    "p8_found": mojibake.p8_found,
    "p8_restored": mojibake.p8_restored,
}

SQL = {
    "p2_found": topn.P2_SQL,
    "p3_found": cooccurrence.P3_SQL,
    "p3_pairs": cooccurrence.P3_PAIRS_SQL,
    "p4_found": lookalikes.P4_SQL,
    "p7_found": leakage.P7_SQL,
    "p7_kept": leakage.P7_KEPT_SQL,
}
