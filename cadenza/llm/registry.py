"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import boilerplate, chat, decontamination, language, near_duplicates, packing, pseudonyms, quality, repeats, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_language": language.op2_language,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_line_dedup": boilerplate.op7_line_dedup,
    "op8_pii": pseudonyms.op8_pii,
    "op9_near_duplicates": near_duplicates.op9_near_duplicates,
    "op10_repeats": repeats.op10_repeats,
}
ORACLES = {
    "op3_chat_formatting": chat.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_line_dedup": boilerplate.ORACLE,
    "op9_near_duplicates": near_duplicates.ORACLE,
}
