"""The registered queries of this package and, where SQL can express them, their DuckDB forms."""

from barlab.llm import bpe, html, licenses, mixing, nearest, pii, ranked, simhash, spelling, superkmers, tokenfile, topk, toxicity

QUERIES = {
    "op1_token_files": tokenfile.op1_token_files,
    "op8_nn_descent": nearest.op8_nn_descent,
    "op10_pii": pii.op10_pii,
    "op5_toxicity_cnn": toxicity.op5_toxicity_cnn,
    "op3_html_tag_paths": html.op3_html_tag_paths,
    "op7_license_scan": licenses.op7_license_scan,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op6_bpe_transducer": bpe.op6_bpe_transducer,
    "op4_exact_topk": topk.op4_exact_topk,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op11_trie_pairs": spelling.op11_trie_pairs,
    "op12_range_maximum": ranked.op12_range_maximum,
    "op13_super_kmers": superkmers.op13_super_kmers,
}

ORACLE_SQL = {
    "op7_license_scan": licenses.sql(),
    "op4_exact_topk": topk.SQL,
    "op9_mix_sources": mixing.sql(),
    "op12_range_maximum": ranked.SQL,
    "op13_super_kmers": superkmers.SQL,
}
