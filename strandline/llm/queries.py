"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from strandline.llm.language import op5_language
from strandline.llm.lm import op2_lm
from strandline.llm.merkle import OP13_SQL, op13_merkle
from strandline.llm.mixing import OP1_SQL, op1_mixing
from strandline.llm.negatives import OP12_SQL, op12_negatives
from strandline.llm.neighbours import op10_neighbours
from strandline.llm.packing import op7_packing
from strandline.llm.pii import op6_pii
from strandline.llm.quality import op8_quality
from strandline.llm.rules import op9_quality_rules
from strandline.llm.sequences import op11_sequences
from strandline.llm.simhash import op4_simhash
from strandline.llm.toxicity import op3_toxicity


def queries() -> dict:
    return {"op1_mixing": op1_mixing, "op10_neighbours": op10_neighbours, "op11_sequences": op11_sequences, "op12_negatives": op12_negatives, "op13_merkle": op13_merkle, "op2_lm": op2_lm, "op3_toxicity": op3_toxicity, "op4_simhash": op4_simhash, "op5_language": op5_language, "op6_pii": op6_pii, "op7_packing": op7_packing, "op8_quality": op8_quality, "op9_quality_rules": op9_quality_rules}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op12_negatives": OP12_SQL, "op13_merkle": OP13_SQL}
