"""Reports, streams of records, and detached signatures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from proofmill.functions import signing
from proofmill.operators.report import assessment, markdown_lines, top_findings
from proofmill.plans.catalog import Rule
from proofmill.plans.rollup import provision_summary
from proofmill.plans.rules import flagged, rule_results
from proofmill.sources import testdata as T
from proofmill.streaming.rules import findings_by_window, rule_counts

RULES = [Rule("prof", "art-1", "r1", "has_record_type", {"type": "view"}), Rule("prof", "art-1", "r2", "field_value", {"record_type": "click", "field": "/payload/k", "op": "lt", "value": 90}, "warning")]


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return rule_results(T.event_records(spark, sf_dir), T.event_subjects(spark, sf_dir), T.packages(spark).where("package_id = 'events'"), RULES, T.EVENTS_AT)


def test_reports(spark, results):
    summary = provision_summary(results)
    lines = [r.line for r in markdown_lines(summary).collect()]
    assert len(lines) == summary.count() and all(x.startswith("| prof | art-1 | ") for x in lines)
    found = spark.createDataFrame([("events", f"EV-0{i % 3}", ("info", "fatal", "error")[i % 3], "c", "m", f"p{i:02d}") for i in range(30)], "package_id string, code string, severity string, category string, message string, path string")
    assert {r.severity for r in top_findings(found).collect()} == {"fatal"} and top_findings(found).count() == 10
    text = assessment("events", results, summary, found, T.EVENTS_AT)
    assert text == assessment("events", results.repartition(3), summary, found.repartition(2), T.EVENTS_AT)
    parsed = json.loads(text)
    assert len(parsed["rule_results"]) == results.count() and len(parsed["diagnostics"]) == 30


def test_streamed_counts_are_those_of_a_table(spark, sf_dir, tmp_path):
    records, packages = T.event_records(spark, sf_dir), T.packages(spark)
    records.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for name, df in (("counts", rule_counts(stream, packages, RULES, T.EVENTS_AT)), ("windows", findings_by_window(stream, late="40 days"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    want = {(r.key, r.rule): (r.n, r.ok) for r in flagged(records, packages, RULES, T.EVENTS_AT).groupBy("key", "rule").agg(F.count("*").alias("n"), F.count_if("satisfied").alias("ok")).collect()}
    assert {(r.key, r.rule): (r.n, r.ok) for r in spark.table("counts").collect()} == want
    assert spark.table("windows").groupBy().sum("n").first()[0] == records.count()


@pytest.mark.parametrize("alg", ["RS256", "ES256"])
def test_signatures(spark, alg):
    private, public = signing.key_pair(spark, alg)
    _, other = signing.key_pair(spark, alg)
    mark = signing.sign(spark, b"payload", private, alg, kid="k1")
    assert mark.count(".") == 2 and signing.verify(spark, mark, b"payload", public)
    assert not signing.verify(spark, mark, b"payloae", public) and not signing.verify(spark, mark, b"payload", other)
    assert not any(signing.verify(spark, x, b"payload", public) for x in ("", "a.b", "a..b", mark.replace("..", ".x."), mark[:-4]))
