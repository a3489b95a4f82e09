"""Sinks: findings, append-only frames, write-once receipts, body-free evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import any_of
from ..operators.findings import set_hash

# fixed values: field names that may not appear in evidence
FORBIDDEN_FIELDS = ["text", "body", "content", "payload", "raw", "value", "original", "rewritten", "response_text", "actual_value",
                    "expected_value", "image", "images", "png", "jpeg", "media_bytes", "image_bytes"]


def write_findings(findings: DataFrame, path: str, identity: list[str], mode: str = "errorifexists") -> DataFrame:
    """Write findings partitioned by rule; returns the order-free digest of each artifact's set.

    Rows of one rule are spread over tasks by artifact, so a rule that fires
    everywhere is written by many tasks.
    """
    findings.repartition("rule", "artifact_id").write.mode(mode).partitionBy("rule").parquet(path)
    return set_hash(findings, ["artifact_id"], identity)


def append_frames(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def create_once(df: DataFrame, path: str) -> None:
    """Write a receipt that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def _walk(prefix: str, dtype: T.DataType):
    if isinstance(dtype, T.StructType):
        for field in dtype.fields:
            name = f"{prefix}.{field.name}" if prefix else field.name
            yield name, field.name, field.dataType
            yield from _walk(name, field.dataType)
    elif isinstance(dtype, T.ArrayType):
        yield from _walk(prefix, dtype.elementType)
    elif isinstance(dtype, T.MapType):
        yield from _walk(prefix, dtype.valueType)


def forbidden_columns(df: DataFrame, forbidden: list[str] | None = None) -> list[str]:
    """Paths of forbidden names and binary fields at any depth of the schema."""
    banned = {f.lower() for f in (forbidden or FORBIDDEN_FIELDS)}
    return [path for path, name, dtype in _walk("", df.schema) if name.lower() in banned or isinstance(dtype, T.BinaryType)]


def _forbidden_key(value: Column, dtype: T.DataType, banned: list[str]) -> Column | None:
    """Whether a value holds a forbidden map key at any depth; None where its type holds no map."""
    if isinstance(dtype, T.StructType):
        parts = [p for p in (_forbidden_key(value[f.name], f.dataType, banned) for f in dtype.fields) if p is not None]
        return F.coalesce(any_of(parts), F.lit(False)) if parts else None
    if isinstance(dtype, T.ArrayType):
        inner = lambda x: _forbidden_key(x, dtype.elementType, banned)
        return F.coalesce(F.exists(value, inner), F.lit(False)) if inner(F.lit(None)) is not None else None
    if isinstance(dtype, T.MapType):
        parts = [F.exists(F.map_keys(value), lambda k: F.lower(k).isin(banned))] if isinstance(dtype.keyType, T.StringType) else []
        if _forbidden_key(F.lit(None), dtype.valueType, banned) is not None:
            parts.append(F.exists(F.map_values(value), lambda v: _forbidden_key(v, dtype.valueType, banned)))
        return F.coalesce(any_of([F.coalesce(p, F.lit(False)) for p in parts]), F.lit(False)) if parts else None
    return None


def assert_body_free(df: DataFrame, forbidden: list[str] | None = None) -> DataFrame:
    """Fail on a forbidden field; return the rows that hold a forbidden map key, at any depth of structs, arrays and maps."""
    found = forbidden_columns(df, forbidden)
    if found:
        raise ValueError("evidence holds body fields: " + ", ".join(found))
    bad = _forbidden_key(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, [f.lower() for f in (forbidden or FORBIDDEN_FIELDS)])
    return df.where(bad if bad is not None else F.lit(False))


def to_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace text columns by their length and hash."""
    keep = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*keep, *[F.length(c).alias(c + "_chars") for c in columns], *[F.sha2(c, 256).alias(c + "_sha256") for c in columns])
