"""Errors with stable codes and JSON payloads."""

from __future__ import annotations

import json
from typing import Any


class SkyledgerError(Exception):
    code = "skyledger_error"

    def __init__(self, message: str, **details: Any):
        super().__init__(message)
        self.details = details

    def payload(self) -> dict[str, Any]:
        return {"code": self.code, "message": str(self), **{k: v if isinstance(v, (str, int, float, bool, list, dict, type(None))) else str(v) for k, v in self.details.items()}}

    def to_json(self) -> str:
        return json.dumps(self.payload(), sort_keys=True)


def _error(name: str, code: str, base: type = SkyledgerError) -> type:
    return type(name, (base,), {"code": code, "__doc__": code.replace("_", " ").capitalize() + "."})


SchemaError = _error("SchemaError", "schema_error")
UnknownSchemaError = _error("UnknownSchemaError", "unknown_schema", SchemaError)
SchemaConflictError = _error("SchemaConflictError", "schema_conflict", SchemaError)
SourceMismatchError = _error("SourceMismatchError", "source_mismatch")
LeakageError = _error("LeakageError", "leakage")
TimePointError = _error("TimePointError", "time_point")
StationError = _error("StationError", "unknown_station")
SelectorError = _error("SelectorError", "selector")
ContractError = _error("ContractError", "contract")
EventError = _error("EventError", "event")
SettlementError = _error("SettlementError", "settlement")
TooEarlyError = _error("TooEarlyError", "too_early_to_settle", SettlementError)
DeferredError = _error("DeferredError", "deferred_market", SettlementError)
NoLiveDataError = _error("NoLiveDataError", "no_live_data")
UnknownSourceError = _error("UnknownSourceError", "unknown_source")
FormatError = _error("FormatError", "format")
HistoricalDepthError = _error("HistoricalDepthError", "historical_depth")
ModelError = _error("ModelError", "model")
IndexFormatError = _error("IndexFormatError", "index_format", FormatError)
MixedFrameError = _error("MixedFrameError", "mixed_frame")
CacheError = _error("CacheError", "cache")
