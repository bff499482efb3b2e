"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, counts, divergence, language, licenses, lines, quality, rules, simhash, tiling, unigram, urls, whitening

QUERIES = {
    "op1_language": language.op1_language,
    "op2_quality": quality.op2_quality,
    "op3_sentencepiece": unigram.op3_sentencepiece,
    "op4_token_counts": counts.op4_token_counts,
    "op5_decontamination": tiling.op5_decontamination,
    "op6_simhash": simhash.op6_simhash,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_line_dedup": lines.op10_line_dedup,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_url_filter": urls.op8_url_filter,
    "op11_bpe": bpe.op11_bpe,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_whitening": whitening.op13_whitening,
}

SQL = {"op8_url_filter": urls.OP8_SQL, "op12_source_divergence": divergence.OP12_SQL}
