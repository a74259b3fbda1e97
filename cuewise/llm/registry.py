"""Every query of this subpackage; importing this module registers them."""

from cuewise.llm import op1_planes, op10_ngram_lm, op11_phrases, op12_pivot_topk, op13_variants, op2_decontaminate, op3_quality, op4_mixing, op5_tool_calls, op6_lsh_forest, op7_repeats, op8_main_text, op9_embeddings  # noqa: F401
from cuewise.llm.common import ORACLES, QUERIES  # noqa: F401
