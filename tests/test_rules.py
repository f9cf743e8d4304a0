"""The rule plan on small bundles made by hand, and all combinations of the roll-up."""

from __future__ import annotations

import itertools

import pytest

from proofmill.plans.catalog import catalog_diagnostics, catalog_rules, lint, provision_rules, selected
from proofmill.plans.rollup import exit_code, gaps, provision_summary
from proofmill.plans.rules import rule_results

AT = "2025-06-01T00:00:00Z"
RECORD = "package_id string, record_id string, record_type string, timestamp string, lifecycle_phase string, obligation_role string, subject_refs array<string>, component_refs array<string>, dataset_refs array<string>, actor_refs array<string>, payload string, attachments array<struct<path:string,hash:string,media_type:string,attachment_type:string>>, attestation_signature string, seq long, provisions_addressed array<string>"


def record(rid, kind, subjects=(), payload="{}", stamp="2025-05-01T00:00:00Z", role=None, attachments=(), provisions=(), package="p"):
    return (package, rid, kind, stamp, None, role, list(subjects), [], [], [], payload, [("x", "h", m, a) for m, a in attachments], None, int(rid[1:]), list(provisions))


@pytest.fixture(scope="module")
def outcome(spark):
    def run(records, rules, subjects=(("p", "s1", "high-risk", ["text"]), ("p", "s2", None, [])), instant=AT):
        recs = spark.createDataFrame(records, RECORD)
        subs = spark.createDataFrame(list(subjects), "package_id string, subject_id string, risk string, modalities array<string>")
        packages = spark.createDataFrame([("p", AT)], "package_id string, package_time string")
        rules = [r for p in rules for r in provision_rules("prof", p)]
        found = rule_results(recs, subs, packages, rules, instant)
        return {(r.subject_id, r.rule_id): (r.outcome, r.evidence_refs) for r in found.collect()}

    return run


def provision(*rules, **more):
    return {"provision_id": "art-1", "rules": [{"rule_id": f"r{i}", **r} for i, r in enumerate(rules)], **more}


def test_shared_and_own_records_and_evidence_order(outcome):
    rows = [record("r3", "a", ["s1"]), record("r1", "a"), record("r2", "a", ["s2"]), record("r4", "b", ["s1", "s1"])]
    found = outcome(rows, [provision({"rule": "has_record_type", "params": {"type": "a", "min_count": 2}}, {"rule": "has_record_type", "params": {"type": "b"}})])
    assert found == {("s1", "r0"): ("passed", ["r1", "r3"]), ("s2", "r0"): ("passed", ["r1", "r2"]), ("s1", "r1"): ("passed", ["r4"]), ("s2", "r1"): ("failed", [])}


def test_no_records_at_all(outcome):
    found = outcome([], [provision({"rule": "has_record_type", "params": {"type": "a"}}, {"rule": "field_present", "params": {"record_type": "a", "field": "/payload/x"}}, {"rule": "entity_linked", "params": {"record_type": "a", "entity_type": "odd"}})])
    assert {k: v[0] for k, v in found.items() if k[0] == "s1"} == {("s1", "r0"): "failed", ("s1", "r1"): "passed", ("s1", "r2"): "passed"}


def test_empty_values_count_as_present(outcome):
    rows = [record(f"r{i}", "a", payload=f'{{"x": {x}}}') for i, x in enumerate(('""', "[]", "{}", "0", "false"))]
    rule = {"rule": "field_present", "params": {"record_type": "a", "field": "/payload/x"}}
    assert outcome(rows, [provision(rule)])["s1", "r0"][0] == "passed"
    assert outcome([*rows, record("r9", "a", payload='{"x": null}')], [provision(rule)])["s1", "r0"] == ("failed", [f"r{i}" for i in range(5)])


def test_attachments_count_records(outcome):
    rows = [record("r1", "a", attachments=[("pdf", "report"), ("pdf", "report")]), record("r2", "a", attachments=[("txt", "log")])]
    found = outcome(rows, [provision(
        {"rule": "attachment_kind_exists", "params": {"record_type": "a", "attachment_type": "report", "min_count": 2}},
        {"rule": "attachment_exists", "params": {"record_type": "a", "media_type": "txt"}}, {"rule": "attachment_exists", "params": {"record_type": "a", "media_type": "png"}},
    )])
    assert [found["s1", f"r{i}"][0] for i in range(3)] == ["failed", "passed", "failed"]


def test_freshness_of_all_types_but_extensions(outcome):
    rule = {"rule": "evidence_freshness", "params": {"max_days": 31}}
    assert outcome([record("r1", "a")], [provision(rule)])["s1", "r0"][0] == "passed"
    assert outcome([record("r1", "a"), record("r2", "b", stamp="2020-01-01T00:00:00Z")], [provision(rule)])["s1", "r0"][0] == "failed"
    assert outcome([record("r1", "a"), record("r2", "x-b", stamp="2020-01-01T00:00:00Z")], [provision(rule)])["s1", "r0"][0] == "passed"
    assert outcome([record("r1", "a", stamp="yesterday")], [provision(rule)])["s1", "r0"][0] == "failed"


def test_scopes_and_conditions(outcome):
    rows = [record("r1", "a", role="provider")]
    has = {"rule": "has_record_type", "params": {"type": "a"}}
    found = outcome(rows, [provision(
        {**has, "scope": {"obligation_roles": ["deployer"]}}, {**has, "scope": {"risk_classifications": ["high-risk"]}}, {**has, "scope": {"modalities": ["audio"]}},
        {**has, "condition": {"if_system_type": ["gpai"]}}, {**has, "condition": {"if_provision_effective": True}}, effective_date="2026-01-01",
    )])
    assert [found["s1", f"r{i}"][0] for i in range(5)] == ["failed", "passed", "failed", "skipped", "skipped"]
    assert [found["s2", f"r{i}"][0] for i in range(5)] == ["failed", "skipped", "passed", "passed", "skipped"]


def test_applicability_and_package_scope(outcome):
    has = {"rule": "has_record_type", "params": {"type": "a"}}
    assert set(outcome([], [provision(has, applicable_to=["gpai"])])) == {("s2", "r0")}
    found = outcome([record("r1", "a", ["s1"]), record("r2", "a")], [provision(has, evaluation_scope="package")])
    assert found == {(None, "r0"): ("passed", ["r1", "r2"])}
    assert set(outcome([], [provision(has)], subjects=[("other", "s", "x", [])])) == {(None, "r0"), ("s", "r0")}


def test_catalog_checks():
    catalog = {"template_id": "t", "provisions": [{"provision_id": "a", "effective_date": "2030-01-01", "rules": [{"rule_id": "r", "rule": "field_present", "params": {"record_type": "k", "field": "/payload/none"}}, {"rule_id": "r", "rule": "exists_where", "params": {"record_type": "k", "field": "/payload/x", "op": "ne", "value": None}}]}]}
    assert [c for c, _ in catalog_diagnostics(catalog, AT)] == ["EV-044", "EV-032"]
    assert [why for _, why in lint(catalog, {"k": {"x"}})] == ["k has no field none", "ne null holds where the field is missing"]
    assert [p["provision_id"] for p in selected([{"provision_id": x} for x in ("art", "art-1", "b")], ["art-1.2", "b"])] == ["art", "art-1", "b"]
    assert len(catalog_rules(catalog, ["a.1"])) == 2
    with pytest.raises(ValueError):
        provision_rules("t", {"provision_id": "a", "rules": [{"rule_id": "r", "rule": "has_record_type", "severity": "dire"}]})


def test_every_combination_rolls_up_by_precedence(spark):
    kinds = [(s, o) for s in ("fail", "warning", "info") for o in ("passed", "failed", "skipped", "error")]
    cases = [c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(kinds, n)]
    rows = [("p", f"s{k}", "prof", f"art-{g}", i, f"r{i}", s, o, [f"e{i}", "e0"]) for k, c in enumerate(cases) for g in (0, 1) for i, (s, o) in enumerate(c)]
    df = spark.createDataFrame(rows, "package_id string, subject_id string, profile_id string, provision_id string, rule int, rule_id string, severity string, outcome string, evidence_refs array<string>")
    acknowledged = gaps(spark.createDataFrame([("p", "evidence_gap", ["art-1"]), ("p", "evidence_gap", ["art-1"])], "package_id string, record_type string, provisions_addressed array<string>"))

    def want(c, gap):
        if ("fail", "failed") in c:
            return "not-satisfied"
        if any(o == "error" for _, o in c):
            return "not-assessed"
        if all(o == "skipped" for _, o in c):
            return "skipped"
        return "gap-acknowledged" if gap else "partially-satisfied" if ("warning", "failed") in c else "satisfied"

    found = provision_summary(df, acknowledged).collect()
    assert len(found) == 2 * len(cases)
    for r in found:
        c = cases[int(r.subject_id[1:])]
        assert r.provision_outcome == want(c, r.provision_id == "art-1"), (c, r)
        assert r.evidence_refs == list(dict.fromkeys(x for i in range(len(c)) for x in (f"e{i}", "e0")))


def test_exit_codes(spark):
    none = spark.createDataFrame([], "severity string")
    fatal = spark.createDataFrame([("fatal",)], "severity string")
    bad, good = (spark.createDataFrame([(x,)], "provision_outcome string") for x in ("not-satisfied", "satisfied"))
    assert [exit_code(d, s).first()[0] for d, s in ((none, good), (none, bad), (fatal, good))] == [0, 1, 2]
