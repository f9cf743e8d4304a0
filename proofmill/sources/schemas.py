"""A folder of published schemas, NAME.schema.json, and its registry of payload variants."""

from __future__ import annotations

import json
from pathlib import Path

from ..operators.schema_check import NOT_PAYLOADS

SUFFIX, VARIANTS = ".schema.json", "variant-registry.json"


def read_schemas(folder: str) -> dict[str, dict]:
    """Schemas by name, in order of names."""
    return {p.name.removesuffix(SUFFIX): json.loads(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob(f"*{SUFFIX}"))}


def record_types(schemas: dict[str, dict]) -> list[str]:
    """The types of records that have a schema of their payloads."""
    return [name for name in schemas if name not in NOT_PAYLOADS]


def read_variants(folder: str) -> dict[str, dict]:
    """Variants by the name of their artifact: record_type, discriminator_field and discriminator_value; none without a registry."""
    path = Path(folder) / VARIANTS
    found = json.loads(path.read_text(encoding="utf-8")).get("variants", []) if path.is_file() else []
    return {v["artifact_name"]: v for v in reversed(found)}
