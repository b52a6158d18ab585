"""The registered queries of this package and, where SQL can state them, their check SQL."""

from __future__ import annotations

from callstrata.llm import op07_warc, op08_decontam, op13_exact_dedup
from callstrata.llm.op01_html import op1_template_classes
from callstrata.llm.op02_pii import op2_weak_supervision
from callstrata.llm.op03_secrets import op3_secret_ownership
from callstrata.llm.op04_license import op4_license_rules
from callstrata.llm.op05_mixing import op5_source_mix
from callstrata.llm.op06_lsh_forest import op6_lsh_forest
from callstrata.llm.op09_hnsw import op9_hnsw_shards
from callstrata.llm.op10_toxicity import op10_nearest_examples
from callstrata.llm.op11_spelling import op11_bloom_variants
from callstrata.llm.op12_whitening import op12_block_whitening

QUERIES = {
    "op1_template_classes": op1_template_classes,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_secret_ownership": op3_secret_ownership,
    "op4_license_rules": op4_license_rules,
    "op5_source_mix": op5_source_mix,
    "op6_lsh_forest": op6_lsh_forest,
    "op7_warc_members": op07_warc.op7_warc_members,
    "op8_positional_index": op08_decontam.op8_positional_index,
    "op9_hnsw_shards": op9_hnsw_shards,
    "op10_nearest_examples": op10_nearest_examples,
    "op11_bloom_variants": op11_bloom_variants,
    "op12_block_whitening": op12_block_whitening,
    "op13_bloom_dedup": op13_exact_dedup.op13_bloom_dedup,
}
ORACLES = {
    "op7_warc_members": op07_warc.ORACLE,
    "op8_positional_index": op08_decontam.ORACLE,
    "op13_bloom_dedup": op13_exact_dedup.ORACLE,
}
