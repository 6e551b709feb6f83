"""The queries of this subpackage and their SQL, by name; __spark_entry__.py adds them if it finds this module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.decontaminate import op7_decontaminate
from foliospark.llm.hard_negatives import op11_hard_negatives
from foliospark.llm.hard_negatives import oracle as op11_oracle
from foliospark.llm.license_scan import op1_license_scan
from foliospark.llm.license_scan import oracle as op1_oracle
from foliospark.llm.line_dedup import op3_line_dedup
from foliospark.llm.line_dedup import oracle as op3_oracle
from foliospark.llm.merkle import op13_merkle_manifest
from foliospark.llm.merkle import oracle as op13_oracle
from foliospark.llm.packing import op9_packing
from foliospark.llm.packing import oracle as op9_oracle
from foliospark.llm.quality import op10_quality_rules
from foliospark.llm.simhash import op2_simhash
from foliospark.llm.substring_dedup import op6_substring_dedup
from foliospark.llm.suffix_dedup import op12_suffix_dedup
from foliospark.llm.token_counts import op8_token_counts
from foliospark.llm.tool_calls import op4_tool_calls
from foliospark.llm.tool_calls import oracle as op4_oracle
from foliospark.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_tool_calls": op4_tool_calls,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": op1_oracle(),
    "op3_line_dedup": op3_oracle(),
    "op4_tool_calls": op4_oracle(),
    "op9_packing": op9_oracle(),
    "op11_hard_negatives": op11_oracle(),
    "op13_merkle_manifest": op13_oracle(),
}
