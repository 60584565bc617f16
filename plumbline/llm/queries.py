"""The subpackage's registered queries and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from plumbline.llm import ann, differencing, divergence, language, license_scan, mixing, ngram_join, packing, pii, quality_model, quality_rules, token_files, whitening

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_pack,
        ann.op2_nearest,
        mixing.op3_mix,
        pii.op4_pii,
        quality_model.op5_quality,
        ngram_join.op6_ngram_join,
        license_scan.op7_license_scan,
        language.op8_language,
        quality_rules.op9_quality_rules,
        token_files.op10_token_files,
        divergence.op11_divergence,
        whitening.op12_whiten,
        differencing.op13_pack_even,
    )
}
ORACLES = {"op3_mix": mixing.OP3_SQL, "op6_ngram_join": ngram_join.OP6_SQL, "op8_language": language.OP8_SQL, "op9_quality_rules": quality_rules.OP9_SQL, "op11_divergence": divergence.OP11_SQL}
