"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tagmill.llm import ann, chat, decontam, langid, lm, mixing, neardup, toxicity, urlfilter, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_lm_score": lm.op2_lm_score,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_warc_archive": warc.op4_warc_archive,
    "op5_language_id": langid.op5_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_nearest": ann.op7_nearest,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_near_dedup": neardup.op9_near_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
}

ORACLES = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_decontaminate": decontam.OP3_SQL,
    "op4_warc_archive": warc.OP4_SQL,
    "op8_url_filter": urlfilter.OP8_SQL,
    "op9_near_dedup": neardup.OP9_SQL,
}
