"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from contextquarry.llm import decontaminate, divergence, exact_dedup, jaccard_join, line_dedup, mixing, packing, quality, secrets, sharding, substring_dedup, toxicity, turn_repair


def queries():
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_secrets": secrets.op4_secrets,
        "op5_packing": packing.op5_packing,
        "op6_sharding": sharding.op6_sharding,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_mixing": mixing.op8_mixing,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_quality": quality.op10_quality,
        "op11_divergence": divergence.op11_divergence,
        "op12_turn_repair": turn_repair.op12_turn_repair,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql():
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op2_substring_dedup": substring_dedup.OP2_SQL,
        "op4_secrets": secrets.OP4_SQL,
        "op7_jaccard_join": jaccard_join.OP7_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op11_divergence": divergence.OP11_SQL,
        "op12_turn_repair": turn_repair.OP12_SQL,
        "op13_line_dedup": line_dedup.OP13_SQL,
    }
