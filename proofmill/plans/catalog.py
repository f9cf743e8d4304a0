"""Rule catalogs: read, normalised and checked on the driver before any data is touched."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..functions.canonical import canonical

EXISTS = {"has_record_type", "attachment_exists", "exists_where", "attachment_kind_exists", "bundle_signed", "record_attested"}
FORALL = {"field_present", "field_value", "evidence_freshness", "entity_linked"}
REQUIRED = {
    "has_record_type": ("type",), "field_present": ("record_type", "field"), "field_value": ("record_type", "field", "op", "value"),
    "evidence_freshness": ("max_days",), "attachment_exists": ("record_type",), "entity_linked": ("record_type", "entity_type"),
    "exists_where": ("record_type", "field", "op", "value"), "attachment_kind_exists": ("record_type", "attachment_type"),
    "bundle_signed": (), "record_attested": ("record_type",),
}
SEVERITIES = ("fail", "warning", "info")

# A catalog's members and what they are where they are left out; a digest is over all of them.
_CATALOG = {
    "template_id": None, "template_name": "", "version": "1.0.0", "jurisdiction": "", "source_legislation": "", "instrument_type": "", "legal_force": "",
    "instrument_status": "final", "default_effective_date": None, "superseded_by": None, "applicable_system_types": [], "provisions": [], "test_vectors": [],
}
_PROVISION = {
    "provision_id": None, "provision_name": "", "normative_text_ref": "", "description": "", "effective_date": None, "applicable_to": [], "sub_provisions": [],
    "required_evidence_types": [], "minimum_evidence_count": {}, "evidence_freshness_max_days": None, "retention_years": None, "evaluation": [],
    "tiered_requirements": None, "evaluation_scope": None,
}
_PART = {"provision_id": None, "normative_text_ref": "", "description": ""}
_RULE = {"rule_id": None, "rule": None, "params": {}, "severity": "fail", "message": "", "scope": None, "condition": None}
_SCOPE = {"risk_classifications": [], "obligation_roles": [], "lifecycle_phases": [], "modalities": []}
_CONDITION = {"if_provision_effective": None, "if_system_type": []}


class UnknownProfile(LookupError):
    """No catalog has this id."""


@dataclass(frozen=True)
class Rule:
    profile_id: str
    provision_id: str
    rule_id: str
    operator: str
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "fail"
    message: str = ""
    roles: tuple[str, ...] = ()
    phases: tuple[str, ...] = ()
    modalities: tuple[str, ...] = ()
    risks: tuple[str, ...] = ()
    if_effective: bool = False
    if_system_type: tuple[str, ...] = ()
    applicable_to: tuple[str, ...] = ()
    effective_date: str | None = None
    package_scope: bool = False

    @property
    def existential(self) -> bool:
        return self.operator in EXISTS

    @property
    def min_count(self) -> int:
        if self.operator == "bundle_signed":
            return int(self.params.get("min_signatures", 1))
        return 1 if self.operator == "attachment_exists" else int(self.params.get("min_count", 1))

    def defect(self) -> str | None:
        """Why the rule can't be evaluated on any data; None if it can."""
        if self.operator not in REQUIRED:
            return f"unknown operator {self.operator}"
        missing = [p for p in REQUIRED[self.operator] if p not in self.params]
        return f"missing parameter {missing[0]}" if missing else None


def provision_rules(profile_id: str, provision: dict) -> list[Rule]:
    """The rules of one provision, which catalogs have under `evaluation` (or `rules`); one without rules gets one for each
    evidence type that it requires."""
    least = provision.get("minimum_evidence_count") or {}
    raw = provision.get("evaluation") or provision.get("rules") or [
        {"rule_id": f"{provision['provision_id']}-{kind}-exists", "rule": "has_record_type", "params": {"type": kind, "min_count": least.get(kind, 1)}, "message": f"needs {least.get(kind, 1)} of {kind}"}
        for kind in provision.get("required_evidence_types") or []
    ]
    out = []
    for r in raw:
        if r.get("severity", "fail") not in SEVERITIES:
            raise ValueError(f"{r.get('rule_id')}: unknown severity {r['severity']!r}")
        scope, condition = r.get("scope") or {}, r.get("condition") or {}
        out.append(Rule(
            profile_id, provision["provision_id"], r["rule_id"], r["rule"], dict(r.get("params") or {}), r.get("severity", "fail"), r.get("message", ""),
            tuple(scope.get("obligation_roles") or ()), tuple(scope.get("lifecycle_phases") or ()), tuple(scope.get("modalities") or ()), tuple(scope.get("risk_classifications") or ()),
            bool(condition.get("if_provision_effective")), tuple(condition.get("if_system_type") or ()),
            tuple(provision.get("applicable_to") or ()), provision.get("effective_date"), provision.get("evaluation_scope") == "package",
        ))
    return out


def selected(provisions: list[dict], declared: list[str] | None) -> list[dict]:
    """Provisions that a profile declares: by exact id or as a parent, with `.` or `-` behind; all, if none are declared."""
    if not declared:
        return list(provisions)
    hit = lambda p: any(d == p or d.startswith((f"{p}.", f"{p}-")) for d in declared)
    return [p for p in provisions if hit(p["provision_id"])]


def catalog_rules(catalog: dict, declared: list[str] | None = None) -> list[Rule]:
    return [r for p in selected(catalog["provisions"], declared) for r in provision_rules(catalog["template_id"], p)]


def read_catalog(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def catalog_ids(folder: str) -> list[str]:
    """The ids of a folder's catalogs, which are the names of its JSON files."""
    return sorted(p.stem for p in Path(folder).glob("*.json"))


def find_catalog(folder: str, profile_id: str) -> dict:
    if profile_id not in catalog_ids(folder):
        raise UnknownProfile(profile_id)
    return read_catalog(str(Path(folder) / f"{profile_id}.json"))


def provision_ids(catalog: dict) -> list[str]:
    return [p["provision_id"] for p in catalog.get("provisions") or []]


def _filled(value: dict, members: dict) -> dict:
    return {k: value.get(k, default) for k, default in members.items()}


def catalog_digest(catalog: dict) -> str:
    """SHA-256 of the canonical catalog with all of its known members; others are left out."""
    whole = _filled(catalog, _CATALOG)
    whole["provisions"] = [_filled(p, _PROVISION) for p in whole["provisions"]]
    for p in whole["provisions"]:
        p["sub_provisions"] = [_filled(x, _PART) for x in p["sub_provisions"]]
        p["evaluation"] = [_filled(r, _RULE) for r in p["evaluation"]]
        for r in p["evaluation"]:
            r["scope"] = r["scope"] if r["scope"] is None else _filled(r["scope"], _SCOPE)
            r["condition"] = r["condition"] if r["condition"] is None else _filled(r["condition"], _CONDITION)
    return f"sha256:{hashlib.sha256(canonical(whole).encode()).hexdigest()}"


def repeated_rule_ids(catalog: dict) -> list[str]:
    """Rule ids, once for each time that they come again."""
    rules = [r for p in catalog["provisions"] for r in provision_rules(catalog["template_id"], p)]
    return [k for k, n in Counter(r.rule_id for r in rules).items() for _ in range(n - 1)]


def late_provisions(catalog: dict, instant: str) -> list[str]:
    """Provisions that aren't effective yet."""
    return [p["provision_id"] for p in catalog["provisions"] if p.get("effective_date") and instant < p["effective_date"]]


def catalog_diagnostics(catalog: dict, instant: str) -> list[tuple[str, str]]:
    """(code, message): rule ids used twice, provisions that aren't effective yet."""
    return [("EV-044", f"duplicate rule id {k}") for k in repeated_rule_ids(catalog)] + [("EV-032", f"{p} isn't effective yet") for p in late_provisions(catalog, instant)]


def lint(catalog: dict, fields: dict[str, set[str]]) -> list[tuple[str, str]]:
    """(rule_id, what is suspicious): pointers to payload fields that the record type doesn't have, and `ne null`, which
    records without the field satisfy. fields: the payload fields of each record type."""
    out = []
    for r in (r for p in catalog["provisions"] for r in provision_rules(catalog["template_id"], p)):
        pointer, kind = r.params.get("field", ""), r.params.get("record_type")
        steps = pointer.split("/")
        if len(steps) > 2 and steps[1] == "payload" and kind in fields and steps[2] not in fields[kind]:
            out.append((r.rule_id, f"{kind} has no field {steps[2]}"))
        if r.params.get("op") == "ne" and "value" in r.params and r.params["value"] is None:
            out.append((r.rule_id, "ne null holds where the field is missing"))
    return out
