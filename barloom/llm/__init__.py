"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["quality", "chat", "secrets", "simhash", "hosts", "warc", "langid", "html", "decontaminate", "mixing", "lexical", "spelling", "toxicity"]


def checks() -> list:
    return [importlib.import_module(f"barloom.llm.{name}").checks for name in MODULES]
