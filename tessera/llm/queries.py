"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from tessera.llm import op3, op4, op5, op10
from tessera.llm.op1 import op1_language_id
from tessera.llm.op2 import op2_pii
from tessera.llm.op3 import op3_url_filter
from tessera.llm.op4 import op4_near_vectors
from tessera.llm.op5 import op5_top_k
from tessera.llm.op6 import op6_mix_sources
from tessera.llm.op7 import op7_pack
from tessera.llm.op8 import op8_token_rollup
from tessera.llm.op9 import op9_token_files
from tessera.llm.op10 import op10_ngram_join
from tessera.llm.op11 import op11_merkle_manifest
from tessera.llm.op12 import op12_spelling_variants
from tessera.llm.op13 import op13_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_language_id, op2_pii, op3_url_filter, op4_near_vectors, op5_top_k, op6_mix_sources, op7_pack, op8_token_rollup, op9_token_files, op10_ngram_join, op11_merkle_manifest, op12_spelling_variants, op13_suffix_dedup)}
ORACLE_SQL: dict[str, str] = {"op3_url_filter": op3.ORACLE, "op4_near_vectors": op4.ORACLE, "op5_top_k": op5.ORACLE, "op10_ngram_join": op10.ORACLE}
