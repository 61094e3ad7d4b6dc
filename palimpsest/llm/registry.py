"""Queries of this subpackage and the SQL that states the same, where SQL can."""

from __future__ import annotations

from palimpsest.llm.decontaminate import op7_decontaminate
from palimpsest.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from palimpsest.llm.hmm import op6_hmm_scores
from palimpsest.llm.mixing import op1_mix_sources
from palimpsest.llm.near_dedup import OP10_SQL, op10_near_dedup
from palimpsest.llm.quality import op5_quality_classifier
from palimpsest.llm.span_dedup import op8_span_dedup
from palimpsest.llm.suffix_dedup import OP3_SQL, op3_suffix_dedup
from palimpsest.llm.toxicity import op9_toxicity
from palimpsest.llm.warc import OP2_SQL, op2_warc_roundtrip

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc_roundtrip": op2_warc_roundtrip,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_hmm_scores": op6_hmm_scores,
    "op7_decontaminate": op7_decontaminate,
    "op8_span_dedup": op8_span_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
}
SQL = {"op2_warc_roundtrip": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op10_near_dedup": OP10_SQL}
