"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ball_codes, decontaminate, kd_sharding, licenses, packing, pii, quality, suffix_dedup, superminhash, training_order, url_filter, vector_graph, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_vector_graph": vector_graph.query,
    "op3_training_order": training_order.query,
    "op4_quality": quality.query,
    "op5_licenses": licenses.query,
    "op6_superminhash": superminhash.query,
    "op7_kd_sharding": kd_sharding.query,
    "op8_packing": packing.query,
    "op9_url_filter": url_filter.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_ball_codes": ball_codes.query,
    "op12_pii": pii.query,
    "op13_whitening": whitening.query,
}
SQL = {"op9_url_filter": url_filter.SQL, "op11_ball_codes": ball_codes.SQL}
