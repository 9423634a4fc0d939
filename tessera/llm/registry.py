"""The subpackage's queries by name and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontamination
from .kneser_ney import op6_language_model
from .merkle import op9_merkle
from .mixing import op3_mixing
from .near_dups import op8_simhash
from .passages import OP10_SQL, op10_passages
from .quality import op7_quality
from .secrets import op2_secrets
from .sharding import op4_sharding
from .toxicity import op5_toxicity


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_secrets": op2_secrets,
        "op3_mixing": op3_mixing,
        "op4_sharding": op4_sharding,
        "op5_toxicity": op5_toxicity,
        "op6_language_model": op6_language_model,
        "op7_quality": op7_quality,
        "op8_simhash": op8_simhash,
        "op9_merkle": op9_merkle,
        "op10_passages": op10_passages,
    }


def oracle_sql() -> dict:
    return {"op1_decontamination": OP1_SQL, "op10_passages": OP10_SQL}
