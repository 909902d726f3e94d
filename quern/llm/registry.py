"""The operators' queries, and their SQL where SQL can express them."""

from . import chat_format, chat_repair, exact_dedup, hard_negatives, line_dedup, mixing, quality_knn, quality_rules, secret_scan, sentencepiece_codec, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_quality_classifier": quality_knn.op11_quality_classifier,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_chat_repair": chat_repair.op13_chat_repair,
}
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_url_filter": url_filter.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op6_chat_format": chat_format.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op8_mixing": mixing.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_chat_repair": chat_repair.SQL,
}
