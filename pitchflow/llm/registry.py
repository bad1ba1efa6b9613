"""The queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

import corpus_pipeline
from pitchflow.llm import op1_kdtree, op2_toxicity, op3_language, op4_tokens, op5_simhash, op6_packing, op7_lines, op8_rans, op9_mixing, op10_quality, op11_merkle, op12_licenses, op13_collocations

MODULES = (op1_kdtree, op2_toxicity, op3_language, op4_tokens, op5_simhash, op6_packing, op7_lines, op8_rans, op9_mixing, op10_quality, op11_merkle, op12_licenses, op13_collocations)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
