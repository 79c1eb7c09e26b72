"""The subpackage's queries and their SQL, for the driver."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module with query(spark, sf_dir) and, where SQL can express it, SQL.
NAMES = {
    "op1_chat_format": "chat_format",
    "op2_token_binary": "token_binary",
    "op3_warc_zip": "warc",
    "op4_html_extract": "html_extract",
    "op5_license_scan": "license_scan",
    "op6_simhash": "simhash",
    "op7_secret_scan": "secret_scan",
    "op8_quality": "quality",
    "op9_decontaminate": "decontaminate",
    "op10_packing": "packing",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in NAMES.items()}
    return {name: sql for name, sql in found.items() if sql}
