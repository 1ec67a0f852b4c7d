"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import clustering, collocations, exact_dedup, licenses, line_dedup, lm_scoring, mixing, online_packing, order_minhash, packing, quality, simhash, suffix_dedup


def queries() -> dict:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_lm_scoring": lm_scoring.op6_lm_scoring,
        "op7_order_minhash": order_minhash.op7_order_minhash,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_phrase_collocations": collocations.op11_phrase_collocations,
        "op12_centroid_clustering": clustering.op12_centroid_clustering,
        "op13_online_packing": online_packing.op13_online_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op4_line_dedup": line_dedup.SQL, "op10_mix_sources": mixing.SQL, "op11_phrase_collocations": collocations.SQL, "op12_centroid_clustering": clustering.SQL}
