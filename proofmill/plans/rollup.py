"""Outcomes of rules rolled up to provisions, profiles and an exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["package_id", "subject_id", "profile_id", "provision_id"]


def gaps(records: DataFrame) -> DataFrame:
    """(package_id, provision_id) for which a gap in the evidence is acknowledged by a record, of whichever subject."""
    return records.where("record_type = 'evidence_gap'").select("package_id", F.explode("provisions_addressed").alias("provision_id")).distinct()


def provision_summary(results: DataFrame, gap: DataFrame | None = None) -> DataFrame:
    """One row per package, subject, profile and provision: the first of these that holds.

    no rules: not-assessed; a rule of severity fail failed: not-satisfied; an error: not-assessed; all skipped: skipped;
    a gap acknowledged: gap-acknowledged; a rule of severity warning failed: partially-satisfied; else satisfied.
    """
    failed = F.col("outcome") == "failed"
    seen = F.flatten(F.array_sort(F.collect_list(F.struct("rule", "evidence_refs")))["evidence_refs"])
    df = results.groupBy(*KEY).agg(
        F.count_if(failed & (F.col("severity") == "fail")).alias("fail_count"), F.count_if(failed & (F.col("severity") == "warning")).alias("warning_count"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_count"), F.count_if(F.col("outcome") == "error").alias("error_count"), F.count("outcome").alias("n_rules"),
        F.array_distinct(seen).alias("evidence_refs"),
    )
    if gap is None:
        df = df.withColumn("gap", F.lit(False))
    else:
        df = df.join(gap.withColumn("gap", F.lit(True)), ["package_id", "provision_id"], "left").withColumn("gap", F.coalesce("gap", F.lit(False)))
    outcome = (
        F.when(F.col("n_rules") == 0, "not-assessed").when(F.col("fail_count") > 0, "not-satisfied").when(F.col("error_count") > 0, "not-assessed")
        .when(F.col("skipped_count") == F.col("n_rules"), "skipped").when(F.col("gap"), "gap-acknowledged").when(F.col("warning_count") > 0, "partially-satisfied").otherwise("satisfied")
    )
    return df.select(*KEY, outcome.alias("provision_outcome"), "fail_count", "warning_count", "skipped_count", "evidence_refs")


def profile_summary(summary: DataFrame) -> DataFrame:
    """(profile_id, total, passed, gaps, text)."""
    df = summary.groupBy("profile_id").agg(F.count("*").alias("total"), F.count_if(F.col("provision_outcome") == "satisfied").alias("passed"), F.count_if(F.col("provision_outcome") == "gap-acknowledged").alias("gaps"))
    text = F.format_string("%s: %d/%d provisions passed", "profile_id", "passed", "total")
    return df.withColumn("text", F.concat(text, F.when(F.col("gaps") > 0, F.format_string(", %d gap acknowledged", "gaps")).otherwise("")))


def error_union(diagnostics: DataFrame, results: DataFrame) -> DataFrame:
    """Structural diagnostics and failed rules, as one table."""
    failed = results.where("outcome = 'failed'").select("rule_id", "provision_id", "severity", "outcome", "message")
    return diagnostics.unionByName(failed, allowMissingColumns=True)


def exit_codes(packages: DataFrame, diagnostics: DataFrame, summary: DataFrame) -> DataFrame:
    """(package_id, exit_code) of each package, as exit_code."""
    fatal = diagnostics.where("severity = 'fatal'").select("package_id", F.lit(2).alias("c"))
    missed = summary.where("provision_outcome = 'not-satisfied'").select("package_id", F.lit(1).alias("c"))
    worst = fatal.unionByName(missed).groupBy("package_id").agg(F.max("c").alias("c"))
    return packages.select("package_id").distinct().join(worst, "package_id", "left").select("package_id", F.coalesce("c", F.lit(0)).alias("exit_code"))


def exit_code(diagnostics: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: 2 with a fatal diagnostic, else 1 with a provision that isn't satisfied, else 0."""
    fatal = diagnostics.agg(F.max(F.when(F.col("severity") == "fatal", 2).otherwise(0)).alias("c"))
    missed = summary.agg(F.max(F.when(F.col("provision_outcome") == "not-satisfied", 1).otherwise(0)).alias("c"))
    return fatal.unionByName(missed).agg(F.coalesce(F.max("c"), F.lit(0)).alias("exit_code"))
