"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pagewright.llm import line_dedup, mixing
from pagewright.llm.hilbert_ann import op5_hilbert_neighbours
from pagewright.llm.imatch import op2_imatch_fingerprints
from pagewright.llm.language_id import op7_language_id
from pagewright.llm.line_dedup import op6_line_dedup
from pagewright.llm.mixing import op1_source_mixing
from pagewright.llm.ngram_join import op10_ngram_join
from pagewright.llm.packing import op8_best_fit_packing
from pagewright.llm.repeats import op4_suffix_dedup
from pagewright.llm.suffix_tree_lm import op3_lm_scoring
from pagewright.llm.toxicity import op9_toxicity


def queries() -> dict:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_imatch_fingerprints": op2_imatch_fingerprints,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_hilbert_neighbours": op5_hilbert_neighbours,
        "op6_line_dedup": op6_line_dedup,
        "op7_language_id": op7_language_id,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_toxicity": op9_toxicity,
        "op10_ngram_join": op10_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": mixing.oracle(), "op6_line_dedup": line_dedup.oracle()}
