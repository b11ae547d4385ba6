"""The queries of the text operators, and the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from learnlens.llm.byte_bpe import op2_byte_bpe
from learnlens.llm.decontaminate import op3_decontamination
from learnlens.llm.language_id import op9_language_id
from learnlens.llm.line_dedup import OP7_SQL, op7_line_dedup
from learnlens.llm.near_dedup import OP6_SQL, op6_minhash_bayes
from learnlens.llm.periodic_runs import op13_periodic_runs
from learnlens.llm.quality_kn import op8_quality_kn
from learnlens.llm.stream_dedup import OP10_SQL, op10_stream_dedup
from learnlens.llm.suffix_dedup import op1_suffix_dedup
from learnlens.llm.token_alignment import op12_token_alignment
from learnlens.llm.token_counts import op11_token_counts
from learnlens.llm.token_planes import op5_token_planes
from learnlens.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_token_planes": op5_token_planes,
    "op6_minhash_bayes": op6_minhash_bayes,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_kn": op8_quality_kn,
    "op9_language_id": op9_language_id,
    "op10_stream_dedup": op10_stream_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op6_minhash_bayes": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op10_stream_dedup": OP10_SQL,
}
