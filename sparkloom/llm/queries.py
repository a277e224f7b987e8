"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import chat, exact, fim, gru, language, matroska, mixing, packing, quality, rabitq, repair, sharding, simhash

QUERIES = {
    "op1_simhash_neardup": simhash.op1_simhash,
    "op2_quality_rff": quality.op2_quality,
    "op3_rabitq_ann": rabitq.op3_ann,
    "op4_gru_lm": gru.op4_lm,
    "op5_language_hierarchy": language.op5_language,
    "op6_matroska_columns": matroska.op6_media,
    "op7_bestfit_packing": packing.op7_packing,
    "op8_chat_prefix_target": chat.op8_chat,
    "op9_source_mixing": mixing.op9_mixing,
    "op10_rendezvous_sharding": sharding.op10_sharding,
    "op11_fim_arrow": fim.op11_fim,
    "op12_conversation_repair": repair.op12_repair,
    "op13_exact_dedup": exact.op13_exact,
}
ORACLES: dict[str, str] = {"op3_rabitq_ann": rabitq.ORACLE, "op8_chat_prefix_target": chat.ORACLE, "op9_source_mixing": mixing.ORACLE, "op11_fim_arrow": fim.ORACLE, "op12_conversation_repair": repair.ORACLE, "op13_exact_dedup": exact.ORACLE}
