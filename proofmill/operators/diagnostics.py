"""The codes of structural findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Number, severity, category, what it says.
CODES = [
    ("001", "fatal", "schema", "unsupported core version"), ("002", "fatal", "schema", "manifest missing or invalid"),
    ("003", "error", "schema", "unknown record type"), ("004", "fatal", "schema", "record or payload invalid"),
    ("010", "fatal", "integrity", "file hash differs"), ("011", "fatal", "integrity", "Merkle root differs"),
    ("012", "fatal", "integrity", "signature invalid"), ("013", "fatal", "integrity", "signature algorithm not allowed"),
    ("014", "fatal", "integrity", "hash index incomplete"), ("020", "error", "reference", "reference to nothing"),
    ("021", "error", "reference", "identifier defined twice"), ("022", "error", "reference", "record file not found"),
    ("023", "error", "reference", "attachment not found"), ("025", "error", "reference", "record count differs"),
    ("026", "error", "reference", "record id used twice"), ("027", "warning", "reference", "attachment hash differs"),
    ("030", "error", "profile", "unknown profile"), ("031", "error", "profile", "other catalog version"),
    ("032", "info", "profile", "provision not effective yet"), ("033", "error", "profile", "catalog of another core version"),
    ("040", "error", "evaluation", "required evidence missing"), ("041", "warning", "evaluation", "evidence too old"),
    ("042", "info", "evaluation", "gap acknowledged"), ("043", "error", "evaluation", "pointer invalid"), ("044", "error", "evaluation", "rule id used twice"),
    ("045", "error", "evaluation", "rule can't be evaluated"), ("050", "fatal", "format", "malformed line"),
    ("051", "fatal", "format", "JSON not canonical"), ("052", "error", "format", "unsafe path"),
    ("053", "error", "format", "extension changes an outcome"), ("060", "warning", "merge", "merge conflict"),
]
SEVERITY = {c: s for c, s, _, _ in CODES}
CATEGORY = {c: k for c, _, k, _ in CODES}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"EV-{c}", s, k, m) for c, s, k, m in CODES], "code string, severity string, category string, meaning string")


def diagnostic(df: DataFrame, code: str, message: Column, path: Column) -> DataFrame:
    """Rows of df as findings: package_id, code, severity, category, message, path."""
    return df.select("package_id", F.lit(f"EV-{code}").alias("code"), F.lit(SEVERITY[code]).alias("severity"), F.lit(CATEGORY[code]).alias("category"), message.alias("message"), path.cast("string").alias("path"))
