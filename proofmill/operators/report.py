"""Reports: summaries as Markdown lines, made by Spark; the assessment as canonical JSON for one package."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical

#: Evidence references and findings that a report shows of each kind.
SHOWN_REFS, SHOWN_FINDINGS = 5, 10


def markdown_lines(summary: DataFrame) -> DataFrame:
    """(package_id, profile_id, provision_id, subject_id, line): a Markdown table row for each provision."""
    refs = F.array_join(F.slice("evidence_refs", 1, SHOWN_REFS), ", ")
    more = F.when(F.size("evidence_refs") > SHOWN_REFS, F.format_string(" and %d more", F.size("evidence_refs") - SHOWN_REFS)).otherwise("")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "profile_id", "provision_id", F.coalesce("subject_id", F.lit("package")), "provision_outcome", F.concat(refs, more)), F.lit(" |"))
    return summary.select("package_id", "profile_id", "provision_id", "subject_id", line.alias("line"))


def top_findings(diagnostics: DataFrame, shown: int = SHOWN_FINDINGS) -> DataFrame:
    """The first findings by severity, code and path: a report's head, not a filter."""
    rank = F.expr("array_position(array('fatal', 'error', 'warning', 'info'), severity)")
    return diagnostics.orderBy(rank, "code", "path").limit(shown)


def assessment(package_id: str, results: DataFrame, summary: DataFrame, diagnostics: DataFrame, instant: str) -> str:
    """Canonical JSON of one package's assessment. It has a row for each rule and subject, so it is for one bundle; write
    the tables themselves for many."""
    mine = lambda df, *order: [json.loads(x.j) for x in df.where(F.col("package_id") == package_id).orderBy(*order).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    return canonical({
        "package_id": package_id, "evaluation_instant": instant, "rule_results": mine(results, "profile_id", "provision_id", "subject_id", "rule"),
        "provision_summary": mine(summary, "profile_id", "provision_id", "subject_id"), "diagnostics": mine(diagnostics, "code", "path"),
    })
