"""Registered queries of the corpus operators and the SQL that must give the same rows where SQL can express them."""
from __future__ import annotations

from . import cutting, dedup, jaccard, lm, mixing, negatives, packing, pii, quality, repair, repetition, secrets, sharding

QUERIES = {
    "op1_kd_shards": sharding.op1_kd_shards,
    "op2_content_sort": dedup.op2_content_sort,
    "op3_curriculum": mixing.op3_curriculum,
    "op4_repetition": repetition.op4_repetition,
    "op5_sum_of_squares": packing.op5_sum_of_squares,
    "op6_weak_labels": quality.op6_weak_labels,
    "op7_deobfuscation": pii.op7_deobfuscation,
    "op8_heavy_light": jaccard.op8_heavy_light,
    "op9_entropy": secrets.op9_entropy,
    "op10_stupid_backoff": lm.op10_stupid_backoff,
    "op11_threshold_negatives": negatives.op11_threshold_negatives,
    "op12_column_generation": cutting.op12_column_generation,
    "op13_auction_repair": repair.op13_auction_repair,
}
SQL = {"op2_content_sort": dedup.SQL, "op4_repetition": repetition.SQL, "op8_heavy_light": jaccard.SQL, "op10_stupid_backoff": lm.SQL,
       "op11_threshold_negatives": negatives.SQL}
