"""Identifiers of the form urn:NAMESPACE:KIND:UUID."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("pkg", "sub", "cmp", "dat", "act", "rec", "asx")
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def pattern(namespace: str) -> str:
    return f"^urn:{namespace}:({'|'.join(KINDS)}):({_UUID})$"


def is_urn(urn: Column, namespace: str = "evidence") -> Column:
    return F.coalesce(F.rlike(urn, F.lit(pattern(namespace))), F.lit(False))


def urn_kind(urn: Column, namespace: str = "evidence") -> Column:
    """The kind; empty where it isn't such an identifier."""
    return F.regexp_extract(F.coalesce(urn, F.lit("")), pattern(namespace), 1)


def urn_uuid(urn: Column, namespace: str = "evidence") -> Column:
    return F.regexp_extract(F.coalesce(urn, F.lit("")), pattern(namespace), 2)


def new_urn(kind: str, namespace: str = "evidence") -> Column:
    return F.concat(F.lit(f"urn:{namespace}:{kind}:"), F.uuid())
