"""The registered queries of this package and their SQL."""

from __future__ import annotations

import importlib

#: query name -> (module, function, SQL constant or None)
TABLE = {
    "op6_suffix_dedup": ("suffixes", "op6_suffix_dedup", None),
    "op7_line_dedup": ("lines", "op7_line_dedup", None),
    "op10_license_scan": ("licenses", "op10_license_scan", None),
    "op3_substring_dedup": ("chunks", "op3_substring_dedup", None),
    "op4_decontaminate": ("decontaminate", "op4_decontaminate", None),
    "op5_token_output": ("tokens", "op5_token_output", None),
    "op1_toxicity": ("toxicity", "op1_toxicity", None),
    "op2_simhash": ("simhash", "op2_simhash", None),
    "op8_quality_rules": ("quality", "op8_quality_rules", "OP8_SQL"),
    "op9_mix_sources": ("mixing", "op9_mix_sources", "OP9_SQL"),
}


def _module(name: str):
    return importlib.import_module(f"tessera.llm.{name}")


def queries() -> dict:
    out = {name: getattr(_module(m), f) for name, (m, f, _) in TABLE.items()}
    return out


def oracle_sql() -> dict[str, str]:
    return {name: getattr(_module(m), sql) for name, (m, _, sql) in TABLE.items() if sql}
