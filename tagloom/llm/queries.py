"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tagloom.llm.ann import op1_ann
from tagloom.llm.bpe import op8_bpe
from tagloom.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from tagloom.llm.langid import op9_langid
from tagloom.llm.mixing import OP10_SQL, op10_mixing
from tagloom.llm.pii import op3_pii
from tagloom.llm.sharding import op2_sharding
from tagloom.llm.simhash import op5_simhash
from tagloom.llm.substring_dedup import op4_substring_dedup
from tagloom.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_ann, op2_sharding, op3_pii, op4_substring_dedup, op5_simhash, op6_toxicity, op7_exact_dedup, op8_bpe, op9_langid, op10_mixing)}
ORACLES = {"op7_exact_dedup": OP7_SQL, "op10_mixing": OP10_SQL}
