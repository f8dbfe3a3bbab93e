"""The queries of this subpackage by name, and the SQL of those that SQL can state."""

from __future__ import annotations

from quarryline.llm import exact_dedup, html_extract, language_id, license_scan, lm_score, maxscore, mixing, ngram_join, packing, url_filter

QUERIES = {
    "op1_maxscore": maxscore.op1_maxscore,
    "op2_mix": mixing.op2_mix,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pack": packing.op4_pack,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_language_id": language_id.op10_language_id,
}

ORACLES = {
    "op1_maxscore": maxscore.ORACLE,
    "op2_mix": mixing.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
}
