"""Queries of this subpackage and their DuckDB SQL; __spark_entry__.py adds them where the subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import OP9_SQL, op9_decontamination
from .langid_kernel import op8_language
from .lattice_lm import op6_lattice_lm
from .packing import op5_packing
from .quality_gam import op1_quality
from .rules_forest import op2_rules
from .simhash import op7_simhash
from .token_output import op4_token_output
from .toxicity_cnn import op3_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_rules": op2_rules,
    "op3_toxicity": op3_toxicity,
    "op4_token_output": op4_token_output,
    "op5_packing": op5_packing,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op9_decontamination": OP9_SQL,
    "op10_warc": OP10_SQL,
}
