"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from ledgerline.llm.common import untune  # noqa: F401 - what a session's other queries run first
from ledgerline.llm import decontaminate, near_dup, packing, prefix_trie, private_data, quality, runs, secrets, suffix_dedup, token_output, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_packing": packing.op2_packing,
        "op3_secret_scans": secrets.op3_secret_scans,
        "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
        "op5_token_output": token_output.op5_token_output,
        "op6_minhash_near_dedup": near_dup.op6_minhash_near_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_warc_derivatives": warc.op8_warc_derivatives,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_exact_top_k": topk.op10_exact_top_k,
        "op11_personal_data": private_data.op11_personal_data,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_conversation_prefix_trie": prefix_trie.op13_conversation_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_near_dedup": near_dup.SQL, "op9_decontamination": decontaminate.SQL, "op10_exact_top_k": topk.SQL, "op13_conversation_prefix_trie": prefix_trie.SQL}
