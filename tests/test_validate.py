"""Bundles validated as a whole: made by hand, and golden ones where a folder of them is given."""

from __future__ import annotations

import json
import os
from collections import Counter
from pathlib import Path

import pytest

from proofmill.plans.catalog import UnknownProfile, catalog_digest, catalog_ids, catalog_rules, find_catalog, provision_ids, read_catalog
from proofmill.plans.validate import validate, validate_path
from proofmill.sources import bundle
from proofmill.sources.schemas import read_schemas

AT = "2025-06-01T00:00:00Z"
CATALOG = {
    "template_id": "cat", "version": "1.2.0", "provisions": [
        {"provision_id": "art-1", "evaluation": [{"rule_id": "a", "rule": "has_record_type", "params": {"type": "log", "min_count": 2}}, {"rule_id": "b", "rule": "field_present", "params": {"record_type": "log", "field": "/payload/x"}, "severity": "warning"}]},
        {"provision_id": "art-2", "required_evidence_types": ["log", "plan"], "minimum_evidence_count": {"log": 3}, "evaluation": []},
        {"provision_id": "art-3", "effective_date": "2030-01-01", "evaluation_scope": "package", "evaluation": [{"rule_id": "a", "rule": "bundle_signed", "params": {}, "condition": {"if_provision_effective": True}}]},
    ],
}
#: Folders of catalogs, of golden bundles and of test vectors with their assessments, and of schemas, in the published form.
CATALOGS, GOLDEN, VECTORS, SCHEMAS = (os.environ.get(x) for x in ("CATALOG_DIR", "GOLDEN_DIR", "VECTOR_DIR", "SCHEMA_DIR"))


def manifest(profiles=({"profile_id": "cat", "applicable_provisions": []},), **more):
    return {
        "metadata": {"package_id": "urn:p", "timestamp": "2025-01-01T00:00:00Z"}, "versioning": {"core_version": "1.0.0"}, "subjects": [{"subject_id": "urn:s", "risk_classification": "high-risk"}],
        "entities": {"components": [{"component_id": "urn:c", "subject_refs": ["urn:s"]}], "relationships": [{"source_ref": "urn:s", "target_ref": "urn:c"}]}, "profiles": list(profiles), **more,
    }


def log(i, **more):
    return {"record_id": f"r{i}", "record_type": "log", "timestamp": "2025-05-01T00:00:00Z", "payload": {"x": i}, "entity_refs": {"subject_refs": ["urn:s"]}, **more}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("bundles")
    bundle.write_bundle(str(root / "good"), manifest(), {"log": [log(i) for i in range(3)], "plan": [{**log(7), "record_type": "plan"}]}, {"a.txt": b"a"})
    wrong = manifest([{"profile_id": "cat", "applicable_provisions": ["art-1.4"]}, {"profile_id": "none", "applicable_provisions": []}])
    wrong["entities"] = {"components": [{"component_id": "urn:c", "subject_refs": ["urn:gone"]}, {"component_id": "urn:c"}], "relationships": [{"source_ref": "urn:s", "target_ref": "urn:nothing"}]}
    bundle.write_bundle(str(root / "wrong"), wrong, {"log": [log(1), log(1, attachments=[{"path": "artifacts/none.txt"}], entity_refs={"dataset_refs": ["urn:d"]})]})
    path = root / "wrong/records/log.jsonl"
    path.write_text(path.read_text() + "{oops\n")
    (root / "wrong/records/unlisted.jsonl").write_text(json.dumps(log(9)) + "\n")
    (root / "wrong/signatures").mkdir()
    (root / "wrong/signatures/a.jws").write_text("no.dots")
    bundle.write_bundle(str(root / "old"), manifest(versioning={"core_version": "2.1"}), {"log": [log(1)]})
    (root / "bare").mkdir()
    (root / "bare/x.txt").write_text("x")
    return root


def test_all_packages_at_once(spark, root):
    found = validate(spark, str(root), [CATALOG], AT)
    codes = {p: Counter(r.code for r in found.findings.collect() if r.package_id == p) for p in ("good", "wrong", "old", "bare")}
    assert codes == {
        "good": {"EV-044": 1, "EV-032": 1}, "old": {"EV-001": 1}, "bare": {"EV-002": 1},
        "wrong": {"EV-044": 1, "EV-030": 1, "EV-050": 1, "EV-010": 1, "EV-014": 1, "EV-012": 1, "EV-020": 3, "EV-021": 1, "EV-023": 1, "EV-026": 1},
    }
    outcomes = {(r.package_id, r.subject_id, r.provision_id): r.provision_outcome for r in found.summary.collect()}
    assert outcomes == {("good", "urn:s", "art-1"): "satisfied", ("good", "urn:s", "art-2"): "satisfied", ("good", None, "art-3"): "skipped", ("wrong", "urn:s", "art-1"): "satisfied"}
    assert {r.package_id: r.exit_code for r in found.exit_codes.collect()} == {"good": 0, "wrong": 2, "old": 2, "bare": 2}
    assert {(r.package_id, r.version, r.digest) for r in found.profiles.collect()} == {("good", "1.2.0", catalog_digest(CATALOG)), ("wrong", "1.2.0", catalog_digest(CATALOG))}


def test_a_folder_or_an_archive_of_one_bundle(spark, root, tmp_path):
    bundle.pack(str(root / "good"), str(tmp_path / "good.tar.gz"), 1_700_000_000)
    for path in (root / "good", tmp_path / "good.tar.gz"):
        found = validate_path(spark, str(path), str(tmp_path / "out"), [CATALOG], AT, profiles=["cat", "other"])
        assert sorted((r.package_id, r.code) for r in found.findings.collect()) == [("good", "EV-030"), ("good", "EV-032"), ("good", "EV-044")]
        assert sorted((r.rule_id, r.outcome) for r in found.results.collect()) == [("a", "passed"), ("a", "skipped"), ("art-2-log-exists", "passed"), ("art-2-plan-exists", "passed"), ("b", "passed")]


def test_catalogs_are_listed_and_found(tmp_path):
    (tmp_path / "cat.json").write_text(json.dumps(CATALOG))
    assert catalog_ids(str(tmp_path)) == ["cat"] and provision_ids(find_catalog(str(tmp_path), "cat")) == ["art-1", "art-2", "art-3"]
    with pytest.raises(UnknownProfile):
        find_catalog(str(tmp_path), "other")
    assert [r.rule_id for r in catalog_rules(CATALOG)] == ["a", "b", "art-2-log-exists", "art-2-plan-exists", "a"]


@pytest.mark.skipif(not CATALOGS, reason="no folder of published catalogs")
def test_published_catalogs_give_all_of_their_rules():
    catalogs = [read_catalog(str(p)) for p in sorted(Path(CATALOGS).glob("*.json"))]
    rules = [r for c in catalogs for r in catalog_rules(c)]
    assert (len(catalogs), sum(len(provision_ids(c)) for c in catalogs), len(rules)) == (11, 61, 201) and not [r for r in rules if r.defect()]


def published(spark, folder):
    """The bundles of a folder as one call, held against the assessments beside them: outcomes, findings, digests."""
    catalogs, schemas = [read_catalog(str(p)) for p in sorted(Path(CATALOGS).glob("*.json"))], read_schemas(SCHEMAS) if SCHEMAS else None
    want = {p.name.removesuffix(".acef-assessment.json"): json.loads(p.read_text()) for p in Path(folder).glob("*assessment.json")}
    (instant,) = {w["evaluation_instant"] for w in want.values()}
    found = validate(spark, str(folder), catalogs, instant, schemas=schemas)
    summary, results, findings, profiles = (x.collect() for x in (found.summary, found.results, found.findings, found.profiles))
    assert {r.package_id for r in summary} <= set(want)
    for name, w in want.items():
        mine = lambda rows, name=name: [r for r in rows if r.package_id == name]
        assert Counter((r.profile_id, r.provision_id, r.subject_id, r.provision_outcome, r.fail_count, r.warning_count, r.skipped_count) for r in mine(summary)) == Counter((s["profile_id"], s["provision_id"], (s["subject_scope"] or [None])[0], s["provision_outcome"], s["fail_count"], s["warning_count"], s["skipped_count"]) for s in w["provision_summary"]), name
        assert Counter((r.rule_id, r.subject_id, r.outcome) for r in mine(results)) == Counter((r["rule_id"], (r["subject_scope"] or [None])[0], r["outcome"]) for r in w["results"]), name
        codes = lambda found: Counter(c[-3:] for c in found if SCHEMAS or c[-3:] > "004")
        assert codes(r.code for r in mine(findings)) == codes(e["code"] for e in w.get("structural_errors") or []), name
        assert {f"{r.profile_id}:{r.version}": r.digest for r in mine(profiles)} == (w.get("template_digests") or {}), name
    return len(want)


@pytest.mark.skipif(not (CATALOGS and GOLDEN), reason="no folder of golden bundles")
def test_golden_bundles_have_their_published_outcomes(spark):
    assert published(spark, GOLDEN) == 6


@pytest.mark.skipif(not (CATALOGS and VECTORS), reason="no folder of test vectors")
def test_vectors_have_their_published_outcomes(spark):
    assert sum(published(spark, p) for p in sorted(Path(VECTORS).iterdir()) if p.is_dir()) == 19
