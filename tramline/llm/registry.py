"""The training-data queries and their SQL, for the entry module."""

from __future__ import annotations

from importlib import import_module

#: query -> its module here, where a function of the same name makes it.
MODULES = {
    "op1_pii": "pii",
    "op2_line_dedup": "linededup",
    "op3_packing": "packing",
    "op4_token_output": "token_output",
    "op5_ngram_join": "ngram_join",
    "op6_ann": "ann",
    "op7_lm_score": "lm_score",
    "op8_decontamination": "decontaminate",
    "op9_warc": "warc",
    "op10_quality": "quality",
    "op11_spelling": "spelling",
    "op12_bestfit": "bestfit",
    "op13_runs": "periodic",
}

#: DuckDB SQL where it can express a query over whole tables.
from tramline.llm.oracle import SQL  # noqa: E402


def queries() -> dict:
    return {name: getattr(import_module(f"tramline.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
