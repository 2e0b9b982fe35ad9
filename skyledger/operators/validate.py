"""Validation of a frame against a registered schema: types from the plan, contents in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError, SourceMismatchError
from ..schemas import KINDS, Schema, lookup

SAMPLES = 10


@dataclass(frozen=True)
class Report:
    schema_id: str
    rows: int
    problems: list[dict[str, Any]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.problems


_AUDIT: list[dict[str, Any]] = []


def audit_log() -> list[dict[str, Any]]:
    """What has been validated, oldest first; copies, so the log can't be changed."""
    return [dict(x) for x in _AUDIT]


def counts(df: DataFrame, schema: Schema) -> DataFrame:
    """One row: rows and, by column of the schema, <name>_nulls and, for enumerations, <name>_bad (values outside)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in schema.columns:
        if c.name in df.columns:
            aggs.append(F.count_if(F.col(c.name).isNull()).alias(f"{c.name}_nulls"))
            if c.kind == "enum":
                aggs.append(F.count_if(~F.col(c.name).isin(*c.values)).alias(f"{c.name}_bad"))
    return df.agg(*aggs)


def validate(df: DataFrame, schema_id: str, *, source: str | None = None, drift_reason: str | None = None, strict: bool = True) -> Report:
    """Checks, in order: the schema, the frame's source against those registered, one equal source in all rows, then columns (missing, type, nulls, enumerations). strict raises on the first report with problems."""
    schema = lookup(schema_id)
    if drift_reason is not None and not isinstance(drift_reason, str):
        raise SchemaError("a drift reason is a text")
    if source is not None and schema.sources and source not in schema.sources and drift_reason is None:
        raise SourceMismatchError(f"{source!r} isn't registered for {schema_id}", known=sorted(schema.sources))
    problems: list[dict[str, Any]] = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in schema.columns:
        if c.name not in types:
            if not c.nullable:
                problems.append({"column": c.name, "problem": "missing"})
        elif not isinstance(types[c.name], KINDS[c.kind]):
            problems.append({"column": c.name, "problem": "type", "found": types[c.name].simpleString(), "wanted": c.kind})
    row = counts(df, schema).first().asDict()
    for c in schema.columns:
        if not c.nullable and row.get(f"{c.name}_nulls"):
            problems.append({"column": c.name, "problem": "nulls", "count": row[f"{c.name}_nulls"]})
        if row.get(f"{c.name}_bad"):
            bad = [r[0] for r in df.select(c.name).filter(~F.col(c.name).isin(*c.values)).distinct().orderBy(c.name).limit(SAMPLES).collect()]
            problems.append({"column": c.name, "problem": "values", "count": row[f"{c.name}_bad"], "samples": bad})
    if source is not None:
        if "source" not in types:
            problems.append({"column": "source", "problem": "missing"})
        else:
            other = df.filter(~F.coalesce(F.col("source") == source, F.lit(False))).count()
            if other:
                problems.append({"column": "source", "problem": "rows of another source", "count": other})
    report = Report(schema_id, row["rows"], problems)
    _AUDIT.append({"schema_id": schema_id, "source": source, "rows": report.rows, "ok": report.ok, "drift_reason": drift_reason, "at": datetime.now(UTC).isoformat()})
    if strict and problems:
        raise SchemaError(f"{schema_id}: {len(problems)} problems", problems=problems)
    return report
