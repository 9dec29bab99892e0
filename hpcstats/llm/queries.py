"""The operators' registered queries and their SQL, read by ``__spark_entry__``."""

from __future__ import annotations

from hpcstats.llm import chat, chosen_path, line_dedup, link_rank, mixing, packing, perplexity, phrase_dedup, pii, repair, run_merge, spelling, token_codes

QUERIES = {
    "op1_token_codes": token_codes.query,
    "op2_phrase_dedup": phrase_dedup.query,
    "op3_run_merge_dedup": run_merge.query,
    "op4_best_fit_pack": packing.query,
    "op5_chosen_path_join": chosen_path.query,
    "op6_pivotal_mix": mixing.query,
    "op7_quality_perplexity": perplexity.query,
    "op8_link_rank_urls": link_rank.query,
    "op9_chat_events": chat.query,
    "op10_pii_boosted": pii.query,
    "op11_cuckoo_lines": line_dedup.query,
    "op12_spelling_tries": spelling.query,
    "op13_conversation_repair": repair.query,
}

ORACLE_SQL = {
    "op3_run_merge_dedup": run_merge.ORACLE,
    "op9_chat_events": chat.ORACLE,
    "op11_cuckoo_lines": line_dedup.ORACLE,
    "op12_spelling_tries": spelling.ORACLE,
}
