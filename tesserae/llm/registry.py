"""The queries of the text operators and, where SQL expresses them, their SQL."""

from __future__ import annotations

from . import align, bpe, decontaminate, language, licenses, merkle, oracle, pieces, quality, secrets, simhash, substrings, suffixes, url_filter

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_language_id": language.op2_language_id,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_suffix_array_dedup": suffixes.op5_suffix_array_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_simhash_dedup": simhash.op7_simhash_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_token_alignment": align.op12_token_alignment,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "quality_ablations": quality.quality_ablations,
}
ORACLE = {
    "op1_url_filters": url_filter.ORACLE,
    "op3_decontamination": oracle.DECONTAMINATION,
    "op4_license_scans": oracle.LICENSES,
    "op6_quality_rules": oracle.QUALITY,
    "op10_substring_dedup": oracle.SUBSTRINGS,
    "op13_merkle_manifest": oracle.MERKLE,
    "quality_ablations": oracle.ABLATIONS,
}
