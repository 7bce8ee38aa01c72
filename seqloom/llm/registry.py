"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from seqloom.llm import bpe, langid, media, packing, phrases, pivots, ppm, runs, secrets, simhash, token_counts, urlfilter, winnowing

QUERIES = {
    "op1_ppm_score": ppm.op1_ppm_score,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_simhash_components": simhash.op4_simhash_components,
    "op5_packing": packing.op5_packing,
    "op6_bpe_encode": bpe.op6_bpe_encode,
    "op7_media": media.op7_media,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_winnowing": winnowing.op9_winnowing,
    "op10_language_id": langid.op10_language_id,
    "op11_pivot_links": pivots.op11_pivot_links,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_collocations": phrases.op13_collocations,
}
ORACLES: dict[str, str] = {"op8_url_filter": urlfilter.SQL, "op11_pivot_links": pivots.SQL, "op13_collocations": phrases.SQL}
