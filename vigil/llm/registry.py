"""Registered queries of the corpus operators and the SQL that some of them can be held against."""

from __future__ import annotations

from vigil.llm.decontamination import OP5_SQL, op5_benchmark_decontamination
from vigil.llm.html_text import op1_html_text
from vigil.llm.jaccard_join import op9_ngram_jaccard_join
from vigil.llm.language_crf import op11_language_crf
from vigil.llm.lm_scoring import op3_lm_scores
from vigil.llm.mixing import OP4_SQL, op4_mix_sources
from vigil.llm.periodic_runs import op13_periodic_runs
from vigil.llm.quality_rules import op10_quality_rules
from vigil.llm.suffix_dedup import op8_suffix_dedup
from vigil.llm.token_counts import op6_token_counts
from vigil.llm.token_store import op7_token_store
from vigil.llm.toxicity import op2_toxicity
from vigil.llm.whitening import op12_embedding_whitening

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scores": op3_lm_scores,
    "op4_mix_sources": op4_mix_sources,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_token_store": op7_token_store,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_language_crf": op11_language_crf,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op4_mix_sources": OP4_SQL,
    "op5_benchmark_decontamination": OP5_SQL,
}
