"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from docgrid.llm.chat import OP5_SQL, op5_chat_format
from docgrid.llm.decontam import op3_decontamination
from docgrid.llm.divergence import OP12_SQL, op12_source_divergence
from docgrid.llm.jaccard import op10_jaccard_join
from docgrid.llm.langid import op8_language_id
from docgrid.llm.mixing import op6_cube_mix
from docgrid.llm.quality import OP4_SQL, op4_quality_rules
from docgrid.llm.repair import OP13_SQL, op13_structure_repair
from docgrid.llm.scoring import op2_lm_scores
from docgrid.llm.secrets import op9_secret_scan
from docgrid.llm.sharding import op1_feistel_shards
from docgrid.llm.substrings import OP11_SQL, op11_substring_dedup
from docgrid.llm.suffixes import op7_suffix_dedup

QUERIES = {
    "op1_feistel_shards": op1_feistel_shards,
    "op2_lm_scores": op2_lm_scores,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_format": op5_chat_format,
    "op6_cube_mix": op6_cube_mix,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_structure_repair": op13_structure_repair,
}
ORACLES = {
    "op4_quality_rules": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op11_substring_dedup": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_structure_repair": OP13_SQL,
}
