"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, hard_negatives, language_model, neighbours, packing, quality, sentencepiece_stream, sharding, simhash, token_files, url_filter, warc, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_packing": packing.op3_packing,
    "op4_token_files": token_files.op4_token_files,
    "op5_sharding": sharding.op5_sharding,
    "op6_warc": warc.op6_warc,
    "op7_sentencepiece": sentencepiece_stream.op7_sentencepiece,
    "op8_language_model": language_model.op8_language_model,
    "op9_url_filters": url_filter.op9_url_filters,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
}
