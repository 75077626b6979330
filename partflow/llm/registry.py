"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, attention_lm, decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, phrases, pii, quality, repeats, token_files, word_bpe

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_private_data": pii.op2_private_data,
    "op3_quality": quality.op3_quality,
    "op4_repeated_passages": repeats.op4_repeated_passages,
    "op5_lm_scores": attention_lm.op5_lm_scores,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_phrases": phrases.op11_phrases,
    "op12_alignment": alignment.op12_alignment,
    "op13_word_bpe": word_bpe.op13_word_bpe,
}

SQL = {
    "op2_private_data": pii.OP2_SQL,
    "op3_quality": quality.OP3_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_source_mixing": mixing.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_phrases": phrases.OP11_SQL,
}
