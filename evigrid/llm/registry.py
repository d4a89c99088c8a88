"""The queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import automata, chat, chosenpath, decontamination, interactions, licenses, packing, pii, quality, sketching, suffixes, tokenfiles, whitening


def queries() -> dict[str, Callable]:
    return {
        "op1_chat_role_repair": chat.op1,
        "op2_positional_index_decontamination": decontamination.op2,
        "op3_token_files": tokenfiles.op3,
        "op4_dominance_best_fit_packing": packing.op4,
        "op5_chosen_path_jaccard_join": chosenpath.op5,
        "op6_suffix_array_dedup": suffixes.op6,
        "op7_quality_log_likelihood": quality.op7,
        "op8_license_set_join": licenses.op8,
        "op9_suffix_automaton_dedup": automata.op9,
        "op10_pii_deobfuscation": pii.op10,
        "op11_filter_interaction_audit": interactions.op11,
        "op12_jacobi_whitening": whitening.op12,
        "op13_fast_sketch_near_dedup": sketching.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chosen_path_jaccard_join": chosenpath.OP5_SQL, "op8_license_set_join": licenses.op8_sql(), "op11_filter_interaction_audit": interactions.OP11_SQL}
