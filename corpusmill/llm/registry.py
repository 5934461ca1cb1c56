"""Queries of the pipeline operators and their DuckDB SQL."""

from __future__ import annotations

from corpusmill.llm import ctw, decontaminate, language_id, licenses, line_join, minhash_join, page_text, phrases, pq_join, raking, repeats, temporal_lists, vp_clusters

QUERIES = {
    "op1_ctw": ctw.op1_ctw,
    "op2_pq": pq_join.op2_pq,
    "op3_language_id": language_id.op3_language_id,
    "op4_url_lists": temporal_lists.op4_url_lists,
    "op5_repeats": repeats.op5_repeats,
    "op6_licenses": licenses.op6_licenses,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_minhash": minhash_join.op8_minhash,
    "op9_raking": raking.op9_raking,
    "op9_raking_converged": raking.op9_raking_converged,
    "op10_lines": line_join.op10_lines,
    "op11_page_text": page_text.op11_page_text,
    "op12_vp_clusters": vp_clusters.op12_vp_clusters,
    "op13_phrases": phrases.op13_phrases,
}
SQL = {"op7_decontaminate": decontaminate.op7_sql(), "op4_url_lists": temporal_lists.op4_sql(), "op9_raking": raking.op9_sql(), "op12_vp_clusters": vp_clusters.op12_sql(), "op13_phrases": phrases.op13_sql()}
