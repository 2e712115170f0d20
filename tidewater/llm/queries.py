"""Registered queries of the corpus operators, and SQL where it can express them."""

from tidewater.llm.alignment import op13_align_tokenizers
from tidewater.llm.classifier import op3_quality_classifier
from tidewater.llm.collocations import OP12_SQL, op12_collocations
from tidewater.llm.decontaminate import op1_decontaminate
from tidewater.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from tidewater.llm.html_text import op2_html_extraction
from tidewater.llm.jaccard_join import op7_jaccard_join
from tidewater.llm.line_dedup import OP4_SQL, op4_line_dedup
from tidewater.llm.mixing import OP10_SQL, op10_mix_sources
from tidewater.llm.ngram_lm import op6_lm_score
from tidewater.llm.pii import op9_pii
from tidewater.llm.sketch import op8_fingerprints
from tidewater.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_lm_score": op6_lm_score,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_fingerprints": op8_fingerprints,
    "op9_pii": op9_pii,
    "op10_mix_sources": op10_mix_sources,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_collocations": op12_collocations,
    "op13_align_tokenizers": op13_align_tokenizers,
}

ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op10_mix_sources": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_collocations": OP12_SQL}
