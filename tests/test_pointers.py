"""Pointers over the whole envelope, dates with and without zones, and rules of many catalogs in one plan."""

from __future__ import annotations

import json
import operator

import pytest

from proofmill.plans.atoms import atoms_of
from proofmill.plans.catalog import Rule, provision_rules
from proofmill.plans.rules import evidence_rows, rule_results
from proofmill.sources import bundle

AT = "2025-06-01T00:00:00Z"


def rule(operator, rule_id, **params):
    return Rule("cat", "art-1", rule_id, operator, {"record_type": "log", **params})


@pytest.fixture(scope="module")
def bundles(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pointers")
    lines = [
        {"record_id": "r1", "record_type": "log", "timestamp": "2025-05-01T00:00:00Z", "payload": {"0": "member", "list": ["x", {"0": None}], "deep": {"a/b": {"~": 1}}}, "entity_refs": {"subject_refs": ["s"]},
         "attachments": [{"path": "artifacts/a"}], "attestation": {"signature": "sig"}, "collector": {"name": "tool"}, "retention": {"min_retention_days": 5}, "access_policy": {"roles": ["a"], "none": None}, "odd": 1},
        {"record_id": "r2", "record_type": "log", "timestamp": "2025-05-01T00:00:00Z", "payload": ["zero", "one"], "collector": "text", "attestation": {}},
        {"record_id": "r3", "record_type": "log", "timestamp": "2025-05-01T00:00:00Z"},
    ]
    bundle.write_bundle(str(root / "p"), {"metadata": {"package_id": "p"}}, {"log": lines})
    return bundle.read_records(spark, str(root))[0].cache()


def satisfied(spark, records, rules, **more):
    packages = spark.createDataFrame([("p", AT)], "package_id string, package_time string")
    found = {r.rule_id: set() for r in rules}
    names = [r.rule_id for r in rules]
    for r in evidence_rows(records, packages, rules, AT).where("key = '\u0000all'").collect():
        found[names[r.rule]].add(r.record_id)
    return found


def test_pointers_find_what_the_whole_record_has(spark, bundles):
    wanted = {  # what is present, by the record as pointers see it: members that are null left out, others at their defaults
        "/attachments/0/path": {"r1"}, "/attachments/0/media_type": {"r1"}, "/attachments/0/description": {"r1"}, "/attachments/1": set(), "/attachments": {"r1", "r2", "r3"}, "/attestation/signature": {"r1"}, "/attestation/method": {"r1"},
        "/attestation/signed_fields/0": {"r1"}, "/entity_refs/subject_refs/0": {"r1"}, "/entity_refs/actor_refs": {"r1", "r2", "r3"}, "/payload/0": {"r1", "r2"}, "/payload/list/1/0": set(), "/payload/list/1": {"r1"}, "/payload/list/01": set(),
        "/payload/list/-": set(), "/payload/deep/a~1b/~0": {"r1"}, "/payload": {"r1", "r2", "r3"}, "": {"r1", "r2", "r3"}, "/": set(), "/trust_level": {"r1", "r2", "r3"}, "/confidentiality": {"r1", "r2", "r3"}, "/lifecycle_phase": set(), "/collector/name": {"r1"},
        "/collector/version": {"r1"}, "/retention/legal_basis": {"r1"}, "/access_policy/roles/0": {"r1"}, "/access_policy/none": set(), "/odd": set(), "/record_id/0": set(), "/elsewhere/x": set(),
    }
    found = satisfied(spark, bundles, [rule("field_present", p, field=p) for p in wanted])
    found["/payload"].add("r3")  # a record without payload: the default is an empty one
    assert found == wanted


def test_values_of_the_whole_record_are_compared(spark, bundles):
    cases = [("/payload/0", "eq", "member", {"r1"}), ("/payload/1", "eq", "one", {"r2"}), ("/retention/min_retention_days", "gte", 5, {"r1"}), ("/entity_refs/subject_refs", "eq", ["s"], {"r1"}), ("/trust_level", "regex", "^self", {"r1", "r2", "r3"}), ("/payload/list", "gt", ["w"], {"r1"}), ("/attachments/0/path", "in", ["artifacts/a", 1], {"r1"}), ("/odd", "ne", 1, {"r1", "r2", "r3"}), ("/payload/0", "unknown", 1, set())]
    rules = [rule("exists_where", str(i), field=p, op=op, value=v) for i, (p, op, v, _) in enumerate(cases)]
    assert satisfied(spark, bundles, rules) == {str(i): want for i, (*_, want) in enumerate(cases)}


RECORD = "package_id string, record_id string, record_type string, timestamp string, lifecycle_phase string, obligation_role string, subject_refs array<string>, component_refs array<string>, dataset_refs array<string>, actor_refs array<string>, payload string, attachments array<struct<path:string,hash:string,media_type:string,attachment_type:string>>, attestation_signature string, seq long"


def outcomes(spark, packages, rules, instant):
    """Outcomes of rules by package; packages: name to (its own time, the timestamp of its one record, or None for no record)."""
    records = spark.createDataFrame([(p, "r0", "log", t, None, None, [], [], [], [], "{}", [], None, 0) for p, (_, t) in packages.items() if t], RECORD)
    subjects = spark.createDataFrame([], "package_id string, subject_id string, risk string, modalities array<string>")
    times = spark.createDataFrame([(p, at) for p, (at, _) in packages.items()], "package_id string, package_time string")
    return {(r.package_id, r.rule_id): r.outcome for r in rule_results(records, subjects, times, rules, instant, evidence=False).collect()}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_freshness_does_not_depend_on_the_session(spark, zone):
    by_instant = {"2025-05-31T00:00:00Z": "passed", "2025-05-30T23:59:59Z": "failed", "2025-05-31T05:30:00+05:30": "passed", "2025-05-31T00:00:00+00:01": "failed", "2025-05-31T00:00:00": "error", "2025-05-31": "error", "soon": "failed"}
    by_day = {"2025-05-31T00:00:00": "passed", "2025-05-30T23:59": "failed", "2025-05-31": "passed", "2025-05-31T00:00:00Z": "error", "no": "failed"}
    by_nothing = {"2025-05-31T00:00:00": "passed", "x": "passed", None: "passed"}
    fresh = lambda name, base, at=None: Rule("cat", "art-1", name, "evidence_freshness", {"max_days": 1, "reference_date": base}, effective_date=at)
    rules = [fresh("instant", "validation_time"), fresh("day", "obligation_effective_date", "2025-06-01"), fresh("never", "obligation_effective_date", "never"), fresh("package", "package_time")]
    stamps = sorted({*by_instant, *by_day, *by_nothing} - {None}) + [None]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = outcomes(spark, {str(t): ("2025-06-01T00:00:00Z" if t in by_instant else None, t) for t in stamps}, rules, AT)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for name, want in (("instant", by_instant), ("day", by_day), ("never", by_nothing), ("package", by_instant)):
        assert {t: found[str(t), name] for t in want} == want, name
    assert found["no", "package"] == "passed" and found["None", "instant"] == "passed"  # no date to be fresh by, no record


def fresh_in(spark, zone, days, stamps):
    """Outcomes by time and reference date, at an instant thirty days before which the clocks of New York differed."""
    at = "2024-03-31T00:30:00Z"
    rules = [Rule("cat", "art-1", base, "evidence_freshness", {"max_days": days, "reference_date": base}) for base in ("validation_time", "package_time")]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        return outcomes(spark, {t: (at, t) for t in stamps}, rules, at)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_are_whole_days_where_clocks_change(spark, zone):
    found = fresh_in(spark, zone, 30, ["2024-03-01T00:30:00Z", "2024-03-01T00:29:59Z"])
    assert found == {(t, base): outcome for t, outcome in (("2024-03-01T00:30:00Z", "passed"), ("2024-03-01T00:29:59Z", "failed")) for base in ("validation_time", "package_time")}


def test_all_dates_are_fresh_for_very_many_days(spark):
    assert set(fresh_in(spark, "UTC", 10**9, ["2024-03-01T00:30:00Z", "0001-01-01T00:00:00Z"]).values()) == {"passed"}


def test_integers_that_doubles_do_not_tell_apart(spark):
    """Atoms with small and large operands, of all kinds, in one plan."""
    big = 1 << 53
    values = [big - 1, big, big + 1, -big - 1, 10**20, 10**20 + 1, 7, 7.5, True, "7", None, [big + 1], {"a": 1}]
    asked = [(op, x) for op in ("eq", "ne", "gt", "gte", "lt", "lte") for x in (7, big, big + 1, -big - 1, 10**20 + 1, "7", [big + 1])]
    asked += [("in", [big + 1, 7]), ("in", [1, "7", [big + 1]]), ("in", [7.5, 10**20]), ("in", "7"), ("in", [])]
    rules = [rule("exists_where", str(i), field="/payload/v", op=op, value=x) for i, (op, x) in enumerate(asked)]
    records = spark.createDataFrame([(f"p{k}", "r0", "log", AT, None, None, [], [], [], [], json.dumps({"v": v}), [], None, 0) for k, v in enumerate(values)], RECORD)
    subjects = spark.createDataFrame([], "package_id string, subject_id string, risk string, modalities array<string>")
    times = spark.createDataFrame([(f"p{k}", AT) for k in range(len(values))], "package_id string, package_time string")
    found = {(r.package_id, r.rule_id): r.outcome == "passed" for r in rule_results(records, subjects, times, rules, AT, evidence=False).collect()}
    for k, v in enumerate(values):
        for i, (op, x) in enumerate(asked):
            if op == "in":
                want = isinstance(x, list) and v is not None and v in x
            elif op in ("eq", "ne"):
                want = (v is not None and v == x) == (op == "eq")
            else:
                try:
                    want = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}[op](v, x)
                except TypeError:
                    want = False
            assert found[f"p{k}", str(i)] is want, (v, op, x)


def test_patterns_of_both_dialects(spark):
    rules = [rule("exists_where", x, field="/record_id", op="regex", value=v) for x, v in (("named", "^(?P<first>r)0"), ("theirs-only", "(?(1)a|b)"))]
    assert outcomes(spark, {"p": (AT, AT)}, rules, AT) == {("p", "named"): "passed", ("p", "theirs-only"): "error"}


def test_equal_questions_of_many_catalogs_are_one_atom():
    provision = {"provision_id": "a", "evaluation": [{"rule_id": "r", "rule": "has_record_type", "params": {"type": "log", "min_count": n}} for n in (1, 2)] + [{"rule_id": "f", "rule": "field_present", "params": {"record_type": "log", "field": "/payload/x"}}]}
    rules = [r for k in range(50) for r in provision_rules(f"cat-{k}", provision)]
    atoms = atoms_of(rules, AT)
    assert len(rules) == 150 and len(atoms.rows) == 2 and set(atoms.of_rule) == set(range(150))


def test_the_plan_does_not_grow_with_rules(spark, bundles):
    def lines(n):
        rules = [rule("exists_where", str(i), field=f"/payload/x{i}", op="eq", value=i) for i in range(n)]
        subjects = spark.createDataFrame([], "package_id string, subject_id string, risk string, modalities array<string>")
        packages = spark.createDataFrame([("p", AT)], "package_id string, package_time string")
        return len(rule_results(bundles, subjects, packages, rules, AT, evidence=False)._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert lines(1) == lines(200)


def test_profiles_asked_of_packages(spark):
    rules = [*provision_rules("one", {"provision_id": "a.1", "evaluation": [{"rule_id": "r1", "rule": "has_record_type", "params": {"type": "log"}}]}), *provision_rules("two", {"provision_id": "b", "evaluation": [{"rule_id": "r2", "rule": "has_record_type", "params": {"type": "none"}}]})]
    records = spark.createDataFrame([(p, "r", "log", AT, None, None, [], [], [], [], json.dumps({}), [], None, 1) for p in ("p", "q", "z")], RECORD)
    subjects = spark.createDataFrame([("q", "s", None, [])], "package_id string, subject_id string, risk string, modalities array<string>")
    packages = spark.createDataFrame([(p, AT) for p in ("p", "q", "z")], "package_id string, package_time string")
    asked = spark.createDataFrame([("p", "one", ["a.1-x"]), ("p", "two", ["c"]), ("q", "two", None), ("q", "one", [])], "package_id string, profile_id string, declared array<string>")
    found = rule_results(records, subjects, packages, rules, AT, evidence=False, asked=asked).collect()
    assert {(r.package_id, r.subject_id, r.rule_id, r.outcome) for r in found} == {("p", None, "r1", "passed"), ("q", "s", "r1", "passed"), ("q", "s", "r2", "failed")}
