"""What grows with the records is done once and nowhere in one task: read from plans, and from rows."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest

from proofmill.plans.atoms import atoms_of
from proofmill.plans.catalog import Rule
from proofmill.plans.rules import _counts
from proofmill.queries import QUERIES
from proofmill.sources import testdata as T


@contextmanager
def shuffled(spark):
    """Plans as they are where no table is small."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.debug.maxToStringFields": "1000"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def explained(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_shared_evidence_is_joined_last(spark, sf_dir):
    """Behind a further join the evidence of all subjects could be shuffled by package, to one task."""
    with shuffled(spark):
        lines = QUERIES["evidence_refs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: re.search(r"\w", line).start()
    (at,) = [i for i, line in enumerate(lines) if "AS refs2#" in line]
    above, now = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < now:
            above, now = [*above, line.strip(" :+-").split()[0]], depth(line)
    assert above.count("Join") == 1 and "Aggregate" not in above


@pytest.mark.parametrize("name", ["op_evidence_freshness", "op_evidence_freshness_package_time", "profile_summary"])
def test_records_are_answered_once(spark, sf_dir, name, capsys):
    with shuffled(spark):
        text = explained(QUERIES[name](spark, sf_dir), capsys)
    # the records of a scan that isn't reused have payloads or instants among their columns
    read = re.findall(r"\) Scan parquet *\s*\nOutput \[\d+\]: (\[.*?\])\s*\n", text)
    assert len([x for x in read if re.search(r"\bts#", x)]) == 1


@pytest.mark.parametrize("name", ["catalogs_as_table", "op_evidence_freshness_package_time", "op_attachment_exists", "op_field_value_in"])
def test_answers_are_compiled_with_the_joins_about_them(spark, sf_dir, name):
    """Else each record is written as a row for each atom in between, and its readings are read anew."""
    with shuffled(spark):
        lines = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    answers = [re.sub(r"^[ :+-]+", "", line) for line in lines if re.search(r"AS satisfied#", line)]
    assert answers and all(line.startswith("*(") for line in answers)


def test_atoms_of_packages_are_not_counted_by_subject(spark, sf_dir):
    ask = lambda kind, whole: Rule("p", "a", kind, "has_record_type", {"type": kind}, package_scope=whole)
    records, packages = T.event_records(spark, sf_dir), T.packages(spark)
    rules = [ask("view", True), ask("click", False), ask("purchase", True), ask("purchase", False)]
    atoms = atoms_of(rules, T.EVENTS_AT)
    own, shared, whole = _counts(records, packages, atoms, False)
    both = {r.atom for r in own.select("atom").distinct().collect()}
    assert both == {atoms.of_rule[1], atoms.of_rule[2]} == {r.atom for r in shared.collect()} and {r.atom for r in whole.collect()} == both | {atoms.of_rule[0]}
    assert {r.atom: r.n3 for r in whole.collect()}[atoms.of_rule[0]] == records.where("record_type = 'view'").count()
