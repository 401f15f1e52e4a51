"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from bindery.llm import licenses, linededup, lm, mixing, negatives, packing, quality, secrets, simhash, topk, toxicity, trie, warc

QUERIES = {
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op2_exact_topk": topk.op2_exact_topk,
    "op8_simhash": simhash.op8_simhash,
    "op10_license_scans": licenses.op10_license_scans,
    "op4_source_mix": mixing.op4_source_mix,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op1_quality_rules": quality.op1_quality_rules,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_hmm_scores": lm.op13_hmm_scores,
    "quality_ablations": quality.quality_ablations,
    "secret_ledger_rounds": secrets.secret_ledger_rounds,
}

ORACLES = {
    "op5_warc": warc.ORACLE,
    "op2_exact_topk": topk.ORACLE,
    "op10_license_scans": licenses.ORACLE,
    "op4_source_mix": mixing.ORACLE,
    "op7_line_dedup": linededup.ORACLE,
    "op9_secret_scans": secrets.ORACLE,
    "op1_quality_rules": quality.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "quality_ablations": quality.ABLATIONS_ORACLE,
    "secret_ledger_rounds": secrets.ROUNDS_ORACLE,
}
