"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import chat, embedding_dedup, jaccard, line_dedup, lm_scoring, mixing, packing, pii, quality, token_store


def queries() -> dict:
    from corpus_pipeline import run

    return {
        "pipeline": run,
        "op1_mixing": mixing.op1_mixing,
        "op2_chat_format": chat.op2_chat_format,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_token_store": token_store.op5_token_store,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_packing": packing.op9_packing,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op2_chat_format": chat.OP2_SQL,
        "op3_jaccard_join": jaccard.OP3_SQL,
        "op4_embedding_dedup": embedding_dedup.OP4_SQL,
        "op6_quality_rules": quality.OP6_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
    }
