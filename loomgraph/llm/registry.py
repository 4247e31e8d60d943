"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from loomgraph.llm import bpe_tree, collocations, knn, language, licences, packing, personal, prefixes, quality, simhash, token_shards, urls, warc

QUERIES = {
    "op1_url_rules": urls.op1,
    "op2_licence_scan": licences.op2,
    "op3_personal_data": personal.op3,
    "op4_language_ppm": language.op4,
    "op5_voronoi_knn": knn.op5,
    "op6_byte_bpe_tree": bpe_tree.op6,
    "op7_quality_divergence": quality.op7,
    "op8_simhash_anchors": simhash.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_token_shards": token_shards.op10,
    "op11_collocations": collocations.op11,
    "op12_prefix_trie": prefixes.op12,
    "op13_warc_revisits": warc.op13,
}
ORACLE_SQL: dict[str, str] = {"op5_voronoi_knn": knn.OP5_SQL, "op11_collocations": collocations.OP11_SQL, "op13_warc_revisits": warc.OP13_SQL}
