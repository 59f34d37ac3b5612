"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from captrix.llm import crf_language, dac_tokens, line_spread, main_text, piece_codec, positional_index, prob_minhash, quality_rules, suffix_dedup, warc_members

QUERIES = {
    "op3_suffix_dedup": suffix_dedup.op3,
    "op6_prob_minhash": prob_minhash.op6,
    "op4_line_spread": line_spread.op4,
    "op1_crf_language": crf_language.op1,
    "op5_positional_index": positional_index.op5,
    "op7_warc_members": warc_members.op7,
    "op10_main_text": main_text.op10,
    "op8_dac_tokens": dac_tokens.op8,
    "op2_piece_codec": piece_codec.op2,
    "op9_quality_divergence": quality_rules.op9,
}
ORACLES = {
    "op3_suffix_dedup": suffix_dedup.oracle(),
    "op6_prob_minhash": prob_minhash.oracle(),
    "op7_warc_members": warc_members.oracle(),
    "op4_line_spread": line_spread.oracle(),
    "op5_positional_index": positional_index.oracle(),
    "op9_quality_divergence": quality_rules.oracle(),
}
