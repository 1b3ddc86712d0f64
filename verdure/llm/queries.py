"""The queries and SQL of this subpackage."""

from __future__ import annotations

from verdure.llm.alignment import op13_alignment
from verdure.llm.attention_lm import op5_lm_scoring
from verdure.llm.byte_dedup import op3_suffix_array
from verdure.llm.decontaminate import op8_decontamination
from verdure.llm.fill_middle import op11_fill_middle
from verdure.llm.packing import op10_packing
from verdure.llm.pieces import op12_sentencepiece
from verdure.llm.quality_model import op6_quality_classifier
from verdure.llm.quality_rules import OP7_SQL, op7_quality_rules
from verdure.llm.simhash import op1_simhash
from verdure.llm.token_output import op2_token_output
from verdure.llm.warc import OP4_SQL, op4_warc
from verdure.llm.window_dedup import op9_substring_dedup

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_output": op2_token_output,
    "op3_suffix_array": op3_suffix_array,
    "op4_warc": op4_warc,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_fill_middle": op11_fill_middle,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op7_quality_rules": OP7_SQL}
