"""Records that arrive as a stream: the compiled rules' counts are kept up to date, outcomes are read from them at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Rule
from ..plans.rules import flagged


def rule_counts(records: DataFrame, packages: DataFrame, rules: list[Rule], instant: str) -> DataFrame:
    """(package_id, key, rule, n, ok) of a stream of records, for output mode update or complete.

    State is a row for each package, subject and rule that has records; records themselves aren't kept. key is a subject,
    or stands for records without one or for all records, as in plans.rules. packages is a table, not a stream.
    """
    return flagged(records, packages, rules, instant).groupBy("package_id", "key", "rule").agg(F.count("*").alias("n"), F.count_if("satisfied").alias("ok"))


def findings_by_window(records: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(package_id, record_type, window, n) of a stream of records with event-time windows; those later than `late` are left out."""
    at = F.try_to_timestamp(F.replace("timestamp", F.lit("Z"), F.lit("+00:00")))
    timed = records.withColumn("at", at).where("at is not null").withWatermark("at", late)
    return timed.groupBy("package_id", "record_type", F.window("at", width)).agg(F.count("*").alias("n"))
