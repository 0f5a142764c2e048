"""Queries of this package and their SQL."""

from __future__ import annotations

from . import chat, exact_dedup, langid, maxent, media, near_dedup, packing, pieces, quality, runs, toxicity, turn_repair, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_chat_format": chat.op2,
        "op3_media_jpeg": media.op3,
        "op4_n_best_pieces": pieces.op4,
        "op5_warc_fixity": warc.op5,
        "op6_near_dedup": near_dedup.op6,
        "op7_quality": quality.op7,
        "op8_packing": packing.op8,
        "op9_language_id": langid.op9,
        "op10_exact_dedup": exact_dedup.op10,
        "op11_maxent": maxent.op11,
        "op12_periodic_runs": runs.op12,
        "op13_turn_repair": turn_repair.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_fixity": warc.OP5_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL, "op13_turn_repair": turn_repair.OP13_SQL}
