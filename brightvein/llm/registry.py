"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import chat, fingerprints, licenses, media, mixing, ngram_join, packing, periodic, pii, quality, repair, secrets, token_files

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_personal_data": pii.op2_personal_data,
    "op3_imatch_fingerprints": fingerprints.op3_imatch_fingerprints,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_retrieval_packing": packing.op5_retrieval_packing,
    "op6_bit_packed_tokens": token_files.op6_bit_packed_tokens,
    "op7_pivotal_mixing": mixing.op7_pivotal_mixing,
    "op8_secret_linking": secrets.op8_secret_linking,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
    "op11_motion_jpeg": media.op11_motion_jpeg,
    "op12_structure_repair": repair.op12_structure_repair,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
SQL = {"op1_chat_format": chat.SQL, "op9_quality_rules": quality.SQL}
