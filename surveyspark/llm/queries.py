"""The registered queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from surveyspark.llm import op1_arc_warc, op2_decontaminate, op3_mixing, op4_minhash, op5_edit_counts, op6_imatch, op7_substrings, op8_pii, op9_toxicity, op10_line_dedup, op11_filter_audit, op12_packing, op13_trie

QUERIES = {
    "op1_arc_warc": (op1_arc_warc.query, op1_arc_warc.SQL),
    "op2_decontaminate": (op2_decontaminate.query, None),
    "op3_mixing": (op3_mixing.query, op3_mixing.SQL),
    "op4_minhash": (op4_minhash.query, op4_minhash.SQL),
    "op5_edit_counts": (op5_edit_counts.query, None),
    "op6_imatch": (op6_imatch.query, None),
    "op7_substrings": (op7_substrings.query, None),
    "op8_pii": (op8_pii.query, None),
    "op9_toxicity": (op9_toxicity.query, None),
    "op10_line_dedup": (op10_line_dedup.query, op10_line_dedup.SQL),
    "op11_filter_audit": (op11_filter_audit.query, op11_filter_audit.SQL),
    "op12_packing": (op12_packing.query, None),
    "op13_trie": (op13_trie.query, op13_trie.SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
