"""Synthetic relational data on Spark: plans, generation, validation, profiling, fitting, documents.

What a user needs stands here and is loaded when it is first used, so that plans can be read without
Spark. The operators for training-data corpora are in tabloom.llm and not part of this list.
"""

from __future__ import annotations

from importlib import import_module
from typing import Any

__version__ = "0.2.0"

#: name: module it comes from
_PLACES = {
    "Plan": "plans.spec", "Table": "plans.spec", "Column": "plans.spec", "Law": "plans.spec", "MetadataError": "plans.spec", "load": "plans.spec", "parse": "plans.spec", "dump": "plans.spec",
    "explain": "plans.explain", "Wizard": "plans.wizard",
    "generate": "operators.generate", "checks": "operators.validate", "violations": "operators.validate", "fit": "operators.fit", "infer": "operators.infer", "scan": "operators.scan",
    "load_tables": "sources.files", "read_tables": "sources.files", "write_tables": "sources.files", "SourceError": "sources.files",
    "write_documents": "sources.documents", "DocumentError": "sources.schemas", "document_violations": "sources.checks", "read_xml": "sources.xml", "ingest_xml": "sources.xml",
}
#: Names that differ in their modules.
_NAMES = {"load_tables": "load", "read_xml": "read", "ingest_xml": "ingest"}
__all__ = sorted(_PLACES)


def __getattr__(name: str) -> Any:
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PLACES[name]}"), _NAMES.get(name, name))
