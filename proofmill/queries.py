"""The engine's queries over the synthetic tables, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.urn import is_urn, urn_kind, urn_uuid
from .operators import bundles, integrity, merkle, references, schema_check
from .operators.diagnostics import registry
from .plans.catalog import Rule, catalog_rules, provision_rules
from .plans.rollup import error_union, exit_code, gaps, profile_summary, provision_summary
from .plans.rules import rule_results
from .sources import testdata as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- rules over events

_RULE_COLUMNS = ["subject_id", "rule_id", "n_match", "n_satisfied", "outcome"]

_EVENTS = """
rec AS (SELECT event_id, event_type, ts, event_id % 50 = 0 AS shared, user_id::VARCHAR AS subject_id, value,
  CASE event_id % 3 WHEN 0 THEN 'design' WHEN 1 THEN 'deployment' END AS phase,
  CASE WHEN event_id % 4 < 2 THEN 'provider' WHEN event_id % 4 = 2 THEN 'deployer' END AS role,
  json_extract(props, '$.k')::DOUBLE AS k FROM events),
subj AS (SELECT DISTINCT c_custkey::VARCHAR AS subject_id, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment ELSE '' END AS risk, r_name AS modality
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey IN (SELECT user_id FROM events))
"""


def _rule_sql(rule: Rule, match: str, sat: str, skip: str = "false", error: str = "false", where: str = "true", off: str = "false") -> str:
    """One rule's outcome for each subject, from SQL conditions on a record r and a subject s."""
    holds = f"ok >= {rule.min_count}" if rule.existential else "ok = n"
    return f"""
SELECT subject_id, '{rule.rule_id}' AS rule_id, n::BIGINT AS n_match, ok::BIGINT AS n_satisfied,
  CASE WHEN {skip} THEN 'skipped' WHEN {error} THEN 'error' WHEN {holds} THEN 'passed' ELSE 'failed' END AS outcome
FROM (SELECT s.subject_id, s.risk, s.modality, count(*) FILTER (WHERE r.event_id IS NOT NULL AND coalesce({match}, false) AND NOT ({off})) AS n,
  count(*) FILTER (WHERE r.event_id IS NOT NULL AND coalesce({match}, false) AND coalesce({sat}, false) AND NOT ({off})) AS ok
  FROM subj s LEFT JOIN rec r ON r.shared OR r.subject_id = s.subject_id WHERE {where} GROUP BY ALL)"""


def _rule(operator: str, rule_id: str = "r", **params) -> Rule:
    return Rule("profile", "art-1", rule_id, operator, params)


#: name: [(rule, match, satisfied, further conditions)]
_SPECS: dict[str, list[tuple]] = {
    "op_has_record_type": [(_rule("has_record_type", f"h{n}", type="purchase", min_count=n), "event_type = 'purchase'", "true", {}) for n in (0, 1, 15)],
    "op_field_present": [(_rule("field_present", "present", record_type="view", field="/payload/k"), "event_type = 'view'", "k IS NOT NULL", {}), (_rule("field_present", "absent", record_type="view", field="/payload/none"), "event_type = 'view'", "false", {}), (_rule("field_present", "phase", record_type="view", field="/lifecycle_phase"), "event_type = 'view'", "phase IS NOT NULL", {})],
    "op_evidence_freshness": [(_rule("evidence_freshness", "week", max_days=7), "true", "ts >= TIMESTAMP '2024-01-24 00:00:00'", {}), (_rule("evidence_freshness", "month", max_days=31), "true", "ts >= TIMESTAMP '2023-12-31 00:00:00'", {})],
    "op_evidence_freshness_package_time": [(_rule("evidence_freshness", "package", max_days=19, reference_date="package_time"), "true", "ts >= TIMESTAMP '2024-01-01 00:00:00'", {}), (_rule("evidence_freshness", "package2", max_days=10, reference_date="package_time"), "true", "ts >= TIMESTAMP '2024-01-10 00:00:00'", {})],
    "op_evidence_freshness_effective_date": [(replace(_rule("evidence_freshness", "date", max_days=5, reference_date="obligation_effective_date"), effective_date="2024-01-08T00:00:00Z"), "true", "ts >= TIMESTAMP '2024-01-03 00:00:00'", {}), (replace(_rule("evidence_freshness", "invalid", max_days=5, reference_date="obligation_effective_date"), effective_date="soon"), "true", "true", {})],
    "op_entity_linked": [(_rule("entity_linked", e, record_type=t, entity_type=e), f"event_type = '{t}'", ok, {}) for e, t, ok in (("subject", "view", "NOT shared"), ("component", "purchase", "true"), ("actor", "click", "event_id % 2 = 1"), ("dataset", "signup", "false"))]
    + [(_rule("entity_linked", "odd", record_type="error", entity_type="thing"), "event_type = 'error'", "false", {"error": "n > 0"}), (_rule("entity_linked", "odd-none", record_type="nothing", entity_type="thing"), "false", "false", {})],
    "op_exists_where": [(_rule("exists_where", f"e{n}", record_type="click", field="/payload/k", op="gt", value=50, min_count=n), "event_type = 'click'", "k > 50", {}) for n in (1, 8)],
    "op_record_attested": [(_rule("record_attested", f"a{n}", record_type="signup", min_count=n), "event_type = 'signup'", "value > 50", {}) for n in (1, 6)],
    "empty_set_semantics": [(_rule("has_record_type", "exists", type="nothing"), "false", "false", {}), (_rule("field_present", "forall", record_type="nothing", field="/payload/k"), "false", "false", {}), (_rule("exists_where", "where", record_type="nothing", field="/payload/k", op="ne", value=1), "false", "false", {})],
    "missing_path_semantics": [(_rule("exists_where", f"missing-{op}", record_type="view", field="/payload/none", op=op, value=v), "event_type = 'view'", "true" if op == "ne" else "false", {}) for op, v in (("eq", 1), ("ne", 1), ("gt", 1), ("gte", 1), ("lt", 1), ("lte", 1), ("in", [1]), ("regex", "1"))],
    "type_gating": [(_rule("exists_where", "text", record_type="view", field="/payload/k", op="eq", value="1"), "event_type = 'view'", "false", {}), (_rule("exists_where", "order", record_type="view", field="/record_type", op="gt", value=1), "event_type = 'view'", "false", {}), (_rule("exists_where", "regex", record_type="view", field="/payload/k", op="regex", value="1"), "event_type = 'view'", "false", {})],
    "rule_errors": [(_rule("no_such_operator", "unknown"), "false", "false", {"error": "true"}), (_rule("field_value", "no-value", record_type="view", field="/payload/k", op="eq"), "false", "false", {"error": "true"}), (_rule("field_value", "bad-regex", record_type="view", field="/record_type", op="regex", value="("), "false", "false", {"error": "true"}), (_rule("field_value", "long-regex", record_type="view", field="/record_type", op="regex", value="a" * 1025), "false", "false", {"error": "true"})],
    "pointers_outside_payload": [
        (_rule("field_present", "signature", record_type="signup", field="/attestation/signature"), "event_type = 'signup'", "value > 50", {}), (_rule("exists_where", "subject", record_type="view", field="/entity_refs/subject_refs/0", op="regex", value="^1", min_count=2), "event_type = 'view'", "NOT r.shared AND r.subject_id LIKE '1%'", {}),
        (_rule("field_value", "component", record_type="purchase", field="/entity_refs/component_refs", op="eq", value=["c1"]), "event_type = 'purchase'", "true", {}), (_rule("field_present", "actor", record_type="click", field="/entity_refs/actor_refs/0"), "event_type = 'click'", "event_id % 2 = 1", {}),
        (_rule("exists_where", "phase", record_type="view", field="/lifecycle_phase", op="in", value=["design", 1]), "event_type = 'view'", "phase = 'design'", {}), (_rule("field_present", "beyond", record_type="view", field="/entity_refs/subject_refs/1"), "event_type = 'view'", "false", {}),
    ],
    "scope_role": [(replace(_rule("has_record_type", "role", type="view", min_count=8), roles=("deployer",)), "event_type = 'view' AND role = 'deployer'", "true", {}), (replace(_rule("has_record_type", "no-role", type="view"), roles=("",)), "event_type = 'view' AND coalesce(role, '') = ''", "true", {})],
    "scope_phase": [(replace(_rule("field_value", "phase", record_type="click", field="/payload/k", op="lt", value=95), phases=("design", "deployment")), "event_type = 'click' AND phase IN ('design', 'deployment')", "k < 95", {})],
    "scope_modality": [(replace(_rule("has_record_type", "modality", type="view", min_count=5), modalities=("ASIA", "EUROPE")), "event_type = 'view'", "true", {"off": "s.modality NOT IN ('ASIA', 'EUROPE')"}), (replace(_rule("field_present", "modality-all", record_type="view", field="/payload/none"), modalities=("ASIA",)), "event_type = 'view'", "false", {"off": "s.modality <> 'ASIA'"})],
    "scope_risk_skip": [(replace(_rule("has_record_type", "risk", type="view"), risks=("BUILDING", "MACHINERY")), "event_type = 'view'", "true", {"skip": "risk NOT IN ('BUILDING', 'MACHINERY')"})],
    "condition_effective": [(replace(_rule("has_record_type", "later", type="view"), if_effective=True, effective_date="2025-01-01"), "event_type = 'view'", "true", {"skip": "true"}), (replace(_rule("has_record_type", "now", type="view"), if_effective=True, effective_date="2023-01-01"), "event_type = 'view'", "true", {})],
    "condition_system_type": [(replace(_rule("has_record_type", "system", type="view"), if_system_type=("BUILDING",)), "event_type = 'view'", "true", {"skip": "risk <> '' AND risk <> 'BUILDING'"})],
    "applicable_to": [(replace(_rule("has_record_type", "applicable", type="view"), applicable_to=("BUILDING", "AUTOMOBILE")), "event_type = 'view'", "true", {"where": "s.risk IN ('', 'BUILDING', 'AUTOMOBILE')"})],
    "subject_or_shared": [(_rule("has_record_type", f"shared{n}", type="error", min_count=n), "event_type = 'error'", "true", {}) for n in (40, 50, 60)],
    "required_evidence_sugar": [
        (r, f"event_type = '{r.params['type']}'", "true", {})
        for r in provision_rules("profile", {"provision_id": "art-9", "required_evidence_types": ["view", "nothing"], "minimum_evidence_count": {"view": 12}})
    ],
}
for _op, _value, _sql in (("eq", 7, "k = 7"), ("ne", 7, "k <> 7"), ("gt", 90, "k > 90"), ("gte", 5, "k >= 5"), ("lt", 99, "k < 99"), ("lte", 99.5, "k <= 99.5"), ("in", [1, 2, 3, "4"], "k IN (1, 2, 3)")):
    _SPECS[f"op_field_value_{_op}"] = [(_rule("field_value", "all", record_type="signup", field="/payload/k", op=_op, value=_value), "event_type = 'signup'", _sql, {}), (_rule("exists_where", "some", record_type="signup", field="/payload/k", op=_op, value=_value, min_count=3), "event_type = 'signup'", _sql, {})]
_SPECS["op_field_value_regex"] = [(_rule("field_value", "all", record_type="signup", field="/record_id", op="regex", value="[0-9]{2}"), "event_type = 'signup'", "regexp_matches(event_id::VARCHAR, '[0-9]{2}')", {}), (_rule("exists_where", "some", record_type="signup", field="/record_id", op="regex", value="^1.*5$"), "event_type = 'signup'", "regexp_matches(event_id::VARCHAR, '^1.*5$')", {})]


def _events_rules(spark: SparkSession, sf_dir: str, rules: list[Rule], evidence: bool = False) -> DataFrame:
    return rule_results(T.event_records(spark, sf_dir), T.event_subjects(spark, sf_dir), T.packages(spark).where("package_id = 'events'"), rules, T.EVENTS_AT, T.event_signatures(spark, sf_dir), evidence)


for _name, _specs in _SPECS.items():
    query(_name, f"WITH {_EVENTS}" + " UNION ALL ".join(_rule_sql(r, m, s, **more) for r, m, s, more in _specs))(lambda spark, sf_dir, rules=[s[0] for s in _specs]: _events_rules(spark, sf_dir, rules).select(*_RULE_COLUMNS))


@query("op_bundle_signed", f"""WITH {_EVENTS}, sig AS (SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'RS256' ELSE 'ES256' END AS alg FROM supplier WHERE s_suppkey % 4 = 0),
c AS (SELECT 'any' AS rule_id, 3 AS least, count(*) AS n FROM sig UNION ALL SELECT 'rs', 1, count(*) FROM sig WHERE alg = 'RS256' UNION ALL SELECT 'many', 1000, count(*) FROM sig WHERE alg = 'ES256')
SELECT subject_id, rule_id, n::BIGINT AS n_match, n::BIGINT AS n_satisfied, CASE WHEN n >= least THEN 'passed' ELSE 'failed' END AS outcome FROM subj, c""")
def op_bundle_signed(spark, sf_dir):
    rules = [_rule("bundle_signed", "any", min_signatures=3), _rule("bundle_signed", "rs", required_alg=["RS256"]), _rule("bundle_signed", "many", min_signatures=1000, required_alg=["ES256"])]
    return _events_rules(spark, sf_dir, rules).select(*_RULE_COLUMNS)


@query("package_scope", """SELECT 'all' AS rule_id, count(*) AS n_match, count(*) AS n_satisfied, CASE WHEN count(*) >= 100 THEN 'passed' ELSE 'failed' END AS outcome FROM events WHERE event_type = 'view'
UNION ALL SELECT 'fields', count(*), count(*) FILTER (WHERE json_extract(props, '$.k')::DOUBLE < 99), CASE WHEN count(*) = count(*) FILTER (WHERE json_extract(props, '$.k')::DOUBLE < 99) THEN 'passed' ELSE 'failed' END FROM events WHERE event_type = 'click'""")
def package_scope(spark, sf_dir):
    rules = [replace(_rule("has_record_type", "all", type="view", min_count=100), package_scope=True), replace(_rule("field_value", "fields", record_type="click", field="/payload/k", op="lt", value=99), package_scope=True)]
    return _events_rules(spark, sf_dir, rules).select("rule_id", "n_match", "n_satisfied", "outcome")


@query("evidence_refs", f"""WITH {_EVENTS} SELECT s.subject_id, coalesce(string_agg(r.event_id::VARCHAR, ',' ORDER BY r.event_id), '') AS refs
FROM subj s LEFT JOIN rec r ON (r.shared OR r.subject_id = s.subject_id) AND event_type = 'purchase' AND k > 80 GROUP BY s.subject_id""")
def evidence_refs(spark, sf_dir):
    rule = _rule("exists_where", "refs", record_type="purchase", field="/payload/k", op="gt", value=80)
    return _events_rules(spark, sf_dir, [rule], True).select("subject_id", F.array_join("evidence_refs", ",").alias("refs"))


# ---------------------------------------------------------------- rules over orders

_ORDER_RULES = [
    (_rule("attachment_exists", "any", record_type="1-URGENT"), "true"), (_rule("attachment_exists", "media", record_type="1-URGENT", media_type="F"), "l_linestatus = 'F'"),
    (_rule("attachment_kind_exists", "kind", record_type="1-URGENT", attachment_type="R"), "l_returnflag = 'R'"), (_rule("attachment_kind_exists", "kinds", record_type="1-URGENT", attachment_type="A", min_count=3), "l_returnflag = 'A'"),
]


def _orders_sql(rule: Rule, item: str) -> str:
    return f"""SELECT c.c_custkey::VARCHAR AS subject_id, '{rule.rule_id}' AS rule_id, count(o.o_orderkey)::BIGINT AS n_match, (count(*) FILTER (WHERE o.has))::BIGINT AS n_satisfied,
CASE WHEN count(*) FILTER (WHERE o.has) >= {rule.min_count} THEN 'passed' ELSE 'failed' END AS outcome FROM customer c LEFT JOIN
(SELECT o_orderkey, o_custkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE {item}) AS has FROM orders WHERE o_orderpriority = '1-URGENT') o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey"""


def _orders_rules(spark: SparkSession, sf_dir: str, rules: list[Rule]) -> DataFrame:
    return rule_results(T.order_records(spark, sf_dir), T.order_subjects(spark, sf_dir), T.packages(spark).where("package_id = 'orders'"), rules, T.ORDERS_AT, evidence=False)


for _name, _some in (("op_attachment_exists", _ORDER_RULES[:2]), ("op_attachment_kind_exists", _ORDER_RULES[2:])):
    query(_name, " UNION ALL ".join(_orders_sql(r, i) for r, i in _some))(lambda spark, sf_dir, rules=[r for r, _ in _some]: _orders_rules(spark, sf_dir, rules).select(*_RULE_COLUMNS))


# ---------------------------------------------------------------- roll-up

CATALOG = {
    "template_id": "demo",
    "provisions": [
        {"provision_id": "art-1", "evaluation": [{"rule_id": "1a", "rule": "has_record_type", "params": {"type": "purchase", "min_count": 12}, "severity": "fail"}, {"rule_id": "1b", "rule": "exists_where", "params": {"record_type": "view", "field": "/payload/k", "op": "gt", "value": 97}, "severity": "warning"}]},
        {"provision_id": "art-2", "applicable_to": ["BUILDING", "MACHINERY"], "evaluation": [{"rule_id": "2a", "rule": "evidence_freshness", "params": {"max_days": 30}, "severity": "warning"}, {"rule_id": "2b", "rule": "record_attested", "params": {"record_type": "click", "min_count": 5}, "severity": "info"}]},
        {"provision_id": "art-3", "evaluation": [{"rule_id": "3a", "rule": "no_such_rule", "severity": "warning"}, {"rule_id": "3b", "rule": "has_record_type", "params": {"type": "signup", "min_count": 10}, "severity": "fail"}]},
        {"provision_id": "art-4", "evaluation": [{"rule_id": "4a", "rule": "has_record_type", "params": {"type": "view"}, "severity": "fail", "scope": {"risk_classifications": ["BUILDING"]}}]},
    ],
}
_CATALOG_SPECS = [
    ("art-1", "fail", "event_type = 'purchase'", "true", {}), ("art-1", "warning", "event_type = 'view'", "k > 97", {}),
    ("art-2", "warning", "true", "ts >= TIMESTAMP '2024-01-01 00:00:00'", {"where": "s.risk IN ('', 'BUILDING', 'MACHINERY')"}), ("art-2", "info", "event_type = 'click'", "value > 50", {"where": "s.risk IN ('', 'BUILDING', 'MACHINERY')"}),
    ("art-3", "warning", "false", "false", {"error": "true"}), ("art-3", "fail", "event_type = 'signup'", "true", {}), ("art-4", "fail", "event_type = 'view'", "true", {"skip": "risk <> 'BUILDING'"}),
]
_RESULTS = f"WITH {_EVENTS}, res AS (" + " UNION ALL ".join(f"SELECT *, '{p}' AS provision_id, '{sev}' AS severity FROM ({_rule_sql(r, m, s, **more)})" for r, (p, sev, m, s, more) in zip(catalog_rules(CATALOG), _CATALOG_SPECS, strict=True)) + ")"
_SUMMARY = _RESULTS + """, summ AS (SELECT subject_id, provision_id, CASE WHEN count(*) FILTER (WHERE outcome = 'failed' AND severity = 'fail') > 0 THEN 'not-satisfied'
WHEN count(*) FILTER (WHERE outcome = 'error') > 0 THEN 'not-assessed' WHEN count(*) FILTER (WHERE outcome = 'skipped') = count(*) THEN 'skipped' WHEN provision_id IN ({gap}) THEN 'gap-acknowledged'
WHEN count(*) FILTER (WHERE outcome = 'failed' AND severity = 'warning') > 0 THEN 'partially-satisfied' ELSE 'satisfied' END AS provision_outcome,
count(*) FILTER (WHERE outcome = 'failed' AND severity = 'fail') AS fail_count, count(*) FILTER (WHERE outcome = 'failed' AND severity = 'warning') AS warning_count, count(*) FILTER (WHERE outcome = 'skipped') AS skipped_count
FROM res GROUP BY subject_id, provision_id)"""


def _catalog_results(spark, sf_dir) -> DataFrame:
    return _events_rules(spark, sf_dir, catalog_rules(CATALOG))


@query("rule_results_all", _RESULTS + " SELECT subject_id, rule_id, provision_id, severity, n_match, n_satisfied, outcome FROM res")
def rule_results_all(spark, sf_dir):
    return _catalog_results(spark, sf_dir).select("subject_id", "rule_id", "provision_id", "severity", "n_match", "n_satisfied", "outcome")


@query("provision_rollup", _SUMMARY.format(gap="''") + " SELECT * FROM summ")
def provision_rollup(spark, sf_dir):
    return provision_summary(_catalog_results(spark, sf_dir)).select("subject_id", "provision_id", "provision_outcome", "fail_count", "warning_count", "skipped_count")


@query("rollup_gap", _SUMMARY.format(gap="SELECT 'art-' || (event_id % 7) FROM events WHERE event_type = 'error' AND value > 99") + " SELECT * FROM summ")
def rollup_gap(spark, sf_dir):
    """Errors of great value stand for acknowledged gaps."""
    marks = T.table(spark, sf_dir, "events").where("event_type = 'error' and value > 99").select(F.col("event_id").cast("string").alias("record_id"))
    acknowledged = T.event_records(spark, sf_dir).join(marks, "record_id", "left_semi").withColumn("record_type", F.lit("evidence_gap"))
    return provision_summary(_catalog_results(spark, sf_dir), gaps(acknowledged)).select("subject_id", "provision_id", "provision_outcome", "fail_count", "warning_count", "skipped_count")


@query("provision_selection_prefix", f"WITH {_EVENTS}, p AS (SELECT unnest(['art-1', 'art-4']) AS provision_id) SELECT provision_id, count(*) AS n FROM subj, p GROUP BY provision_id")
def provision_selection(spark, sf_dir):
    """art-1 is declared by its part art-1.2, art-4 by art-4-b; art-3 isn't by art-30."""
    rules = [replace(r, risks=()) for r in catalog_rules(CATALOG, ["art-1.2", "art-4-b", "art-30"])]
    return provision_summary(_events_rules(spark, sf_dir, rules)).groupBy("provision_id").agg(F.count("*").alias("n"))


@query("profile_summary", _SUMMARY.format(gap="''") + """ SELECT 'demo' AS profile_id, count(*) AS total, count(*) FILTER (WHERE provision_outcome = 'satisfied') AS passed, 0::BIGINT AS gaps,
'demo: ' || count(*) FILTER (WHERE provision_outcome = 'satisfied') || '/' || count(*) || ' provisions passed' AS text FROM summ""")
def profiles(spark, sf_dir):
    return profile_summary(provision_summary(_catalog_results(spark, sf_dir)))


@query("error_union", _RESULTS + """ SELECT NULL AS code, rule_id, provision_id, severity, count(*) AS n FROM res WHERE outcome = 'failed' GROUP BY ALL
UNION ALL SELECT 'EV-020', NULL, NULL, 'error', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""")
def errors(spark, sf_dir):
    both = error_union(dangling(spark, sf_dir), _catalog_results(spark, sf_dir))
    return both.groupBy("code", "rule_id", "provision_id", "severity").agg(F.count("*").alias("n"))


@query("exit_code", _SUMMARY.format(gap="''") + " SELECT (CASE WHEN count(*) FILTER (WHERE provision_outcome = 'not-satisfied') > 0 THEN 1 ELSE 0 END)::INTEGER AS exit_code FROM summ")
def code(spark, sf_dir):
    return exit_code(dangling(spark, sf_dir), provision_summary(_catalog_results(spark, sf_dir)))


# ---------------------------------------------------------------- structural checks


def dangling(spark, sf_dir) -> DataFrame:
    refs = T.table(spark, sf_dir, "lineitem").select(F.lit("p").alias("package_id"), F.col("l_partkey").cast("string").alias("ref"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("path"))
    defined = T.table(spark, sf_dir, "part").where("p_size < 40").select(F.lit("p").alias("package_id"), F.col("p_partkey").cast("string").alias("urn"))
    return references.dangling(refs, defined)


query("dangling_refs", "SELECT 'EV-020' AS code, 'nothing is ' || l_partkey AS message, l_orderkey || ':' || l_linenumber AS path FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")(lambda spark, sf_dir: dangling(spark, sf_dir).select("code", "message", "path"))


@query("dangling_record_refs", "SELECT (CASE WHEN event_id % 50 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n, event_id::VARCHAR AS path FROM events WHERE (event_id % 50 <> 0 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AND event_type = 'purchase'")
def dangling_record_refs(spark, sf_dir):
    defined = T.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.lit("events").alias("package_id"), F.col("c_custkey").cast("string").alias("urn"))
    found = references.dangling(references.record_refs(T.event_records(spark, sf_dir).where("record_type = 'purchase'")), defined)
    return found.groupBy("path").agg(F.count("*").cast("int").alias("n")).where("n > 1").select("n", "path")


@query("dangling_refs_of_records", """SELECT 'EV-020' AS code, 'nothing is ' || ref AS message, path FROM (
SELECT user_id::VARCHAR AS ref, event_id::VARCHAR AS path FROM events WHERE event_id % 50 <> 0 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'c1', event_id::VARCHAR FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'a1', event_id::VARCHAR FROM events WHERE event_type = 'click' AND event_id % 2 = 1)""")
def dangling_refs_of_records(spark, sf_dir):
    """Every dangling reference of all records; dangling_record_refs has only purchases with several."""
    defined = T.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.lit("events").alias("package_id"), F.col("c_custkey").cast("string").alias("urn"))
    return references.dangling(references.record_refs(T.event_records(spark, sf_dir)), defined).select("code", "message", "path")


@query("duplicate_urn", "SELECT n || ' is first defined at ' || first AS message, path FROM (SELECT o_custkey AS n, o_orderkey::VARCHAR AS path, first_value(o_orderkey::VARCHAR) OVER w AS first, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE k > 1")
def duplicate_urn(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(F.lit("p").alias("package_id"), F.col("o_custkey").cast("string").alias("urn"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("seq"))
    return references.defined_twice(rows).select("message", "path")


_KEYED = "l_orderkey || ':' || l_linenumber"


@query("duplicate_record_id", f"SELECT 'occurrence ' || k AS message, id AS path FROM (SELECT {_KEYED} AS id, row_number() OVER (PARTITION BY {_KEYED} ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k > 1")
def duplicate_record_id(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select(F.lit("p").alias("package_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("record_id"), F.struct("l_partkey", "l_suppkey").alias("seq"))
    return references.repeated_records(rows).select("message", "path")


@query("count_mismatch", "SELECT 'EV-025' AS code, want || ' listed, ' || have || ' found' AS message, o_orderpriority AS path FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus <> 'P') AS want, count(*) AS have FROM orders GROUP BY 1) WHERE want <> have")
def count_mismatch(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select(F.lit("p").alias("package_id"), F.col("o_orderpriority").alias("record_type"), "o_orderstatus")
    expected = orders.where("o_orderstatus <> 'P'").groupBy("package_id", "record_type", "o_orderstatus").agg(F.count("*").alias("count"))
    return references.count_differences(expected, orders).select("code", "message", "path")


@query("missing_file", "SELECT 'EV-022' AS code, o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_file(spark, sf_dir):
    listed = T.table(spark, sf_dir, "orders").select(F.lit("p").alias("package_id"), F.col("o_orderkey").cast("string").alias("path"))
    files = T.table(spark, sf_dir, "lineitem").select(F.lit("p").alias("package_id"), F.col("l_orderkey").cast("string").alias("path"))
    return references.missing_files(listed, files).select("code", "path")


_BAD = "CASE WHEN page_id % 9 = 0 THEN sha256(html || 'x') ELSE sha256(html) END"


@query("attachment_hash_mismatch", f"SELECT 'EV-027' AS code, 'index has ' || sha256(html) AS message, format('artifacts/{{:06d}}.html', page_id) AS path FROM pages WHERE {_BAD} <> sha256(html)")
def attachment_hash(spark, sf_dir):
    wrong = F.when(F.col("page_id") % 9 == 0, F.sha2(F.concat("html", F.lit("x")), 256)).otherwise(F.sha2("html", 256))
    attached = T.table(spark, sf_dir, "pages").select(F.concat(F.lit("pages-"), F.floor(F.col("page_id") / 25).cast("string")).alias("package_id"), F.format_string("artifacts/%06d.html", "page_id").alias("path"), F.concat(F.lit("sha256:"), wrong).alias("hash"))
    return references.hash_differences(attached, T.file_hashes(spark, sf_dir)).select("code", "message", "path")


_SCHEMA = {"type": "object", "required": ["k", "j"], "properties": {"k": {"type": "integer", "minimum": 3, "maximum": 97, "enum": list(range(90))}}}


#: Thresholds of the catalogs of `catalogs_as_table`, each a catalog of three rules.
_MANY = range(40)


@query("catalogs_as_table", """WITH k AS (SELECT event_id, event_type, event_id % 3 AS phase, json_extract(props, '$.k')::DOUBLE AS k FROM events), c AS (SELECT unnest(range(40)) AS i)
SELECT 'cat-' || i AS profile_id, 'views' AS rule_id, count(*) AS n_match, count(*) AS n_satisfied, CASE WHEN count(*) >= 15 * i THEN 'passed' ELSE 'failed' END AS outcome FROM c, k WHERE event_type = 'view' AND (i % 2 = 0 OR phase = 0) GROUP BY i
UNION ALL SELECT 'cat-' || i, 'clicks', count(*), count(*) FILTER (k > 5 * (i % 10)), CASE WHEN count(*) FILTER (k > 5 * (i % 10)) >= i THEN 'passed' ELSE 'failed' END FROM c, k WHERE event_type = 'click' GROUP BY i
UNION ALL SELECT 'cat-' || i, 'signups', count(*), count(*) FILTER (k <= 80 + i), CASE WHEN count(*) FILTER (k > 80 + i) = 0 THEN 'passed' ELSE 'failed' END FROM c, k WHERE event_type = 'signup' GROUP BY i""")
def catalogs_as_table(spark, sf_dir):
    """Rules of forty catalogs, asked of the package as a whole; half of the clicks' questions are the same in several."""
    rules = []
    for i in _MANY:
        views = {"rule_id": "views", "rule": "has_record_type", "params": {"type": "view", "min_count": 15 * i}} | ({} if i % 2 == 0 else {"scope": {"lifecycle_phases": ["design"]}})
        clicks = {"rule_id": "clicks", "rule": "exists_where", "params": {"record_type": "click", "field": "/payload/k", "op": "gt", "value": 5 * (i % 10), "min_count": i}}
        signups = {"rule_id": "signups", "rule": "field_value", "params": {"record_type": "signup", "field": "/payload/k", "op": "lte", "value": 80 + i}}
        rules += catalog_rules({"template_id": f"cat-{i}", "provisions": [{"provision_id": "art-1", "evaluation_scope": "package", "evaluation": [views, clicks, signups]}]})
    return _events_rules(spark, sf_dir, rules).select("profile_id", "rule_id", "n_match", "n_satisfied", "outcome")


#: The schema of an order with its items: of the kinds of keywords that published schemas have, and one that refers to itself.
_ORDER_SCHEMA = {
    "$defs": {"item": {"type": "object", "required": ["flag"], "properties": {"flag": {"enum": ["A", "N"]}, "q": {"type": "integer", "maximum": 45}, "part": {"oneOf": [{"minimum": 100}, {"maximum": 150}]}, "items": {"items": {"$ref": "#/$defs/item"}}}, "additionalProperties": {"type": "string"}}},
    "type": "object", "properties": {"items": {"minItems": 2, "items": {"$ref": "#/$defs/item"}}, "status": {"const": "O"}}, "additionalProperties": False,
}


@query("schema_walk", """WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders),
i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS n, l_quantity::INT AS q, l_partkey AS part, l_returnflag AS flag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
f AS (SELECT o_orderkey AS k, '/status' AS p, 'const' AS w FROM o WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, '', 'additionalProperties' FROM o WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, '/items', 'minItems' FROM o WHERE (SELECT count(*) FROM i WHERE i.k = o_orderkey) < 2 UNION ALL SELECT k, '/items/' || n || '/flag', 'enum' FROM i WHERE flag NOT IN ('A', 'N') AND n % 5 <> 4
UNION ALL SELECT k, '/items/' || n || '/flag', 'required' FROM i WHERE n % 5 = 4 UNION ALL SELECT k, '/items/' || n || '/q', 'maximum' FROM i WHERE q > 45 UNION ALL SELECT k, '/items/' || n || '/part', 'oneOf' FROM i WHERE part BETWEEN 100 AND 150
UNION ALL SELECT k, '/items/' || n || '/items/0/flag', 'required' FROM i WHERE n = 1)
SELECT 'EV-004' AS code, w || ' violated' AS message, k || '/payload' || p AS path FROM f""")
def schema_walk(spark, sf_dir):
    """All orders with their items as documents; each second item holds an item of its own."""
    o, item = T.table(spark, sf_dir, "orders"), F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    items = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    inner = F.array(F.struct(F.lit("x").alias("other")))
    each = F.transform("l", lambda x, n: F.struct(F.when(n % 5 != 4, x["l_returnflag"]).alias("flag"), x["l_quantity"].cast("int").alias("q"), x["l_partkey"].alias("part"), F.when(n == 1, inner).alias("items")))
    empty = F.array().cast("array<struct<flag:string,q:int,part:bigint,items:array<struct<other:string>>>>")
    text = F.to_json(F.struct(F.coalesce(each, empty).alias("items"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 7 == 0, 1).alias("odd")))
    rows = o.join(items, "o_orderkey", "left").select(F.lit("orders").alias("package_id"), F.col("o_orderkey").cast("string").alias("record_id"), F.lit("order").alias("record_type"), text.alias("payload"))
    return schema_check.schema_findings(rows, {"order": _ORDER_SCHEMA}).select("code", "message", "path")


@query("schema_check", """WITH v AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'view'), e AS (
SELECT event_id, '/payload/j' AS p, 'required' AS w FROM v UNION ALL SELECT event_id, '/payload/k', 'minimum' FROM v WHERE k < 3 UNION ALL SELECT event_id, '/payload/k', 'maximum' FROM v WHERE k > 97 UNION ALL SELECT event_id, '/payload/k', 'enum' FROM v WHERE k >= 90 OR k < 0)
SELECT 'EV-004' AS code, w || ' violated' AS message, event_id || p AS path FROM e UNION ALL SELECT 'EV-003', 'unknown type ' || event_type, event_id::VARCHAR FROM events WHERE event_type <> 'view'""")
def schema_findings(spark, sf_dir):
    return schema_check.schema_findings(T.event_records(spark, sf_dir), {"view": _SCHEMA}).select("code", "message", "path")


_PATHS = "CASE page_id % 6 WHEN 0 THEN '/' || url WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN './b' WHEN 3 THEN 'a\\b' WHEN 4 THEN 'a/b..c/' || page_id ELSE 'records/' || page_id END"


@query("path_safety", f"SELECT page_id, path FROM (SELECT page_id, {_PATHS} AS path FROM pages) WHERE contains(path, chr(92)) OR starts_with(path, '/') OR list_contains(string_split(path, '/'), '.') OR list_contains(string_split(path, '/'), '..')")
def path_safety(spark, sf_dir):
    path = F.expr(_PATHS.replace("'a\\b'", "'a\\\\b'"))
    return T.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(~references.safe_path(F.col("path")))


@query("urn_parse", """WITH u AS (SELECT event_id, 'urn:evidence:' || CASE event_id % 3 WHEN 0 THEN 'rec' WHEN 1 THEN 'sub' ELSE 'odd' END || ':' || regexp_replace(md5(event_id::VARCHAR), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS urn FROM events)
SELECT event_id, event_id % 3 <> 2 AS valid, CASE event_id % 3 WHEN 0 THEN 'rec' WHEN 1 THEN 'sub' ELSE '' END AS kind, CASE WHEN event_id % 3 = 2 THEN '' ELSE right(urn, 36) END AS uuid FROM u""")
def urn_parse(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "rec").when(F.col("event_id") % 3 == 1, "sub").otherwise("odd")
    uuid = F.regexp_replace(F.md5(F.col("event_id").cast("string").cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    df = T.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("urn:evidence:"), kind, F.lit(":"), uuid).alias("urn"))
    return df.select("event_id", is_urn(F.col("urn")).alias("valid"), urn_kind(F.col("urn")).alias("kind"), urn_uuid(F.col("urn")).alias("uuid"))


QUERIES["diagnostic_registry"] = lambda spark, sf_dir: registry(spark)

# ---------------------------------------------------------------- hashes

_FILES = "SELECT 'pages-' || (page_id // 25) AS package_id, format('artifacts/{:06d}.html', page_id) AS path, sha256(coalesce(html, '')) AS sha256, page_id FROM pages"
query("content_hash", f"SELECT package_id, path, sha256 FROM ({_FILES})")(T.file_hashes)


@query("hash_diff_full_outer", f"""WITH f AS ({_FILES}), e AS (SELECT package_id, path, CASE WHEN page_id % 11 = 0 THEN 'bad' ELSE sha256 END AS s FROM f WHERE page_id % 7 <> 0), a AS (SELECT * FROM f WHERE page_id % 5 <> 0)
SELECT CASE WHEN s IS NULL OR sha256 IS NULL THEN 'EV-014' ELSE 'EV-010' END AS code, package_id, path FROM e FULL JOIN a USING (package_id, path) WHERE s IS DISTINCT FROM sha256""")
def hash_diff(spark, sf_dir):
    files = T.file_hashes(spark, sf_dir).withColumn("n", F.regexp_extract("path", r"(\d+)", 1).cast("int"))
    expected = files.where("n % 7 <> 0").withColumn("sha256", F.when(F.col("n") % 11 == 0, "bad").otherwise(F.col("sha256")))
    return integrity.hash_differences(expected, files.where("n % 5 <> 0")).select("code", "package_id", "path")


@query("merkle_root", f"""WITH RECURSIVE f AS ({_FILES}), l AS (SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY path) - 1 AS i, sha256(encode(path) || '\\x00'::BLOB || encode(sha256)) AS h, 0 AS lvl, count(*) OVER (PARTITION BY package_id) AS n FROM f),
t AS (SELECT package_id, i, h, lvl, n FROM l UNION ALL SELECT package_id, i // 2, CASE WHEN count(*) = 2 THEN sha256(unhex(min_by(h, i)) || unhex(max_by(h, i))) ELSE min(h) END, lvl + 1, (n + 1) // 2 FROM t WHERE n > 1 GROUP BY package_id, i // 2, lvl, n)
SELECT package_id, (SELECT count(*) FROM f WHERE f.package_id = t.package_id) AS n_leaves, h AS root FROM t WHERE n = 1""")
def merkle_root(spark, sf_dir):
    return merkle.merkle_roots(T.file_hashes(spark, sf_dir))


@query("merkle_proofs", f"""WITH RECURSIVE f AS ({_FILES}), l AS (SELECT package_id, path, row_number() OVER (PARTITION BY package_id ORDER BY path) - 1 AS i, sha256(encode(path) || '\\x00'::BLOB || encode(sha256)) AS h, 0 AS lvl, count(*) OVER (PARTITION BY package_id) AS n FROM f),
t AS (SELECT package_id, i, h, lvl, n FROM l UNION ALL SELECT package_id, i // 2, CASE WHEN count(*) = 2 THEN sha256(unhex(min_by(h, i)) || unhex(max_by(h, i))) ELSE min(h) END, lvl + 1, (n + 1) // 2 FROM t WHERE n > 1 GROUP BY package_id, i // 2, lvl, n)
SELECT l.package_id, l.path, l.i::BIGINT AS i, coalesce(string_agg(CASE WHEN t.i % 2 = 0 THEN '<' ELSE '>' END || t.h, '' ORDER BY t.lvl), '') AS proof, true AS holds
FROM l LEFT JOIN t ON t.package_id = l.package_id AND t.i = xor(l.i >> t.lvl, 1) GROUP BY l.package_id, l.path, l.i""")
def merkle_proofs(spark, sf_dir):
    files = T.file_hashes(spark, sf_dir)
    proofs = merkle.merkle_proofs(files).join(merkle.merkle_roots(files), "package_id")
    text = F.array_join(F.transform("proof", lambda s: F.concat(F.when(s["left"], "<").otherwise(">"), s["hash"])), "")
    return proofs.select("package_id", "path", F.col("i").cast("long").alias("i"), text.alias("proof"), (merkle.proven_root(F.col("leaf"), F.col("proof")) == F.col("root")).alias("holds"))


@query("bundle_digest", f"""SELECT package_id, 'sha256:' || sha256('{{' || string_agg('"' || path || '":"' || sha256 || '"', ',' ORDER BY path) || '}}') AS digest FROM ({_FILES}) GROUP BY package_id""")
def bundle_digest(spark, sf_dir):
    return integrity.bundle_digests(T.file_hashes(spark, sf_dir))


@query("bundle_chain", f"""WITH d AS (SELECT package_id, 'sha256:' || sha256('{{' || string_agg('"' || path || '":"' || sha256 || '"', ',' ORDER BY path) || '}}') AS digest FROM ({_FILES}) GROUP BY package_id)
SELECT 'pages-' || ((replace(package_id, 'pages-', ''))::INT + 1) AS package_id, digest AS prior_package_ref FROM d""")
def chain(spark, sf_dir):
    digests = integrity.bundle_digests(T.file_hashes(spark, sf_dir))
    new = digests.select(F.concat(F.lit("pages-"), (F.replace("package_id", F.lit("pages-"), F.lit("")).cast("int") + 1).cast("string")).alias("package_id"), F.col("package_id").alias("prior_package_id"))
    return bundles.chained(new, digests).select("package_id", "prior_package_ref")


_JWS = "CASE c_custkey % 5 WHEN 0 THEN 'nodots' WHEN 1 THEN rtrim(translate(to_base64(encode('{\"alg\":\"none\"}')), '+/', '-_'), '=') || '..s' ELSE rtrim(translate(to_base64(encode('{\"alg\":\"' || CASE c_custkey % 2 WHEN 0 THEN 'RS256' ELSE 'ES256' END || '\"}')), '+/', '-_'), '=') || '..s' END"


@query("jws_header_scan", "SELECT c_custkey::VARCHAR AS path, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE CASE c_custkey % 2 WHEN 0 THEN 'RS256' ELSE 'ES256' END END AS alg, CASE c_custkey % 5 WHEN 0 THEN '012' WHEN 1 THEN '013' END AS code FROM customer")
def jws_scan(spark, sf_dir):
    alg = F.when(F.col("c_custkey") % 5 == 1, "none").when(F.col("c_custkey") % 2 == 0, "RS256").otherwise("ES256")
    head = F.rtrim(F.translate(F.base64(F.encode(F.concat(F.lit('{"alg":"'), alg, F.lit('"}')), "utf-8")), "+/", "-_"), F.lit("="))
    rows = T.table(spark, sf_dir, "customer").select(F.lit("p").alias("package_id"), F.col("c_custkey").cast("string").alias("path"), F.when(F.col("c_custkey") % 5 == 0, "nodots").otherwise(F.concat(head, F.lit("..s"))).alias("content"))
    return integrity.signature_headers(rows).select("path", "alg", "code")


# ---------------------------------------------------------------- algebra of bundles

_ITEMS = f"SELECT {_KEYED} AS record_id, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, (l_suppkey % 3)::INTEGER AS pkg, l_partkey AS seq, l_suppkey AS s2 FROM lineitem"


def _items(spark, sf_dir) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("record_id"), T.iso("l_shipdate").alias("timestamp"), (F.col("l_suppkey") % 3).cast("int").alias("pkg"), F.col("l_partkey").alias("seq"), F.col("l_suppkey").alias("s2"))


@query("merge_keep_latest_records", f"SELECT * FROM ({_ITEMS}) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY timestamp DESC, pkg DESC, seq DESC, s2 DESC) = 1")
def merge_latest(spark, sf_dir):
    return bundles.merged(_items(spark, sf_dir), ["record_id"], "timestamp", ["pkg", "seq", "s2"])


_SUBJECTS = "SELECT c_mktsegment AS name, c_nationkey % 5 AS type, lpad((c_custkey % 97)::VARCHAR, 3, '0') AS stamp, c_custkey AS seq FROM customer"


@query("merge_keep_latest_subjects", f"SELECT * FROM ({_SUBJECTS}) QUALIFY row_number() OVER (PARTITION BY name, type ORDER BY stamp DESC, seq DESC) = 1")
def merge_subjects(spark, sf_dir):
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") % 5).alias("type"), F.lpad((F.col("c_custkey") % 97).cast("string"), 3, "0").alias("stamp"), F.col("c_custkey").alias("seq"))
    return bundles.merged(rows, ["name", "type"], "stamp", ["seq"])


@query("merge_keep_all", f"SELECT pkg, count(*) AS n, count(DISTINCT record_id) AS ids FROM ({_ITEMS}) GROUP BY pkg")
def merge_all(spark, sf_dir):
    return bundles.merged(_items(spark, sf_dir), ["record_id"], "timestamp", [], "keep_all").groupBy("pkg").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("ids"))


@query("merge_conflicts", f"SELECT record_id, count(*) - 1 AS n FROM ({_ITEMS}) GROUP BY record_id HAVING count(*) > 1")
def merge_conflicts(spark, sf_dir):
    return bundles.conflicts(_items(spark, sf_dir), ["record_id"])


@query("merge_conflict_findings", f"""SELECT 'merged' AS package_id, 'EV-060' AS code, 'warning' AS severity, record_id AS path
FROM (SELECT record_id, unnest(range(1, count(*))) AS i FROM ({_ITEMS}) GROUP BY record_id)""")
def merge_conflict_findings(spark, sf_dir):
    return bundles.conflict_findings(_items(spark, sf_dir), "record_id", "merged").select("package_id", "code", "severity", "path")


@query("merge_first_wins", f"SELECT * FROM ({_ITEMS}) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY pkg, seq, s2) = 1")
def merge_first(spark, sf_dir):
    return bundles.first_wins(_items(spark, sf_dir), ["record_id"], ["pkg", "seq", "s2"])


def _redact_sql(where: str) -> str:
    h = "sha256('{\"k\":' || json_extract_string(props, '$.k') || '}')"
    return f"""SELECT event_id::VARCHAR AS record_id, CASE WHEN {where} THEN '{{"_redacted":true,"_commitment":"sha256:' || {h} || '"}}' ELSE props END AS payload,
CASE WHEN {where} THEN 'hash-committed' WHEN event_id % 10 = 0 THEN 'regulator-only' ELSE 'public' END AS confidentiality, CASE WHEN {where} THEN 'sha256-commitment:' || {h} END AS redaction_method FROM events"""


for _name, _where, _args in (("redact_by_type", "event_type = 'view'", {"types": ["view"]}), ("redact_by_level", "event_id % 10 = 0", {"levels": ["regulator-only"]}), ("redact_nothing", "false", {})):
    query(_name, _redact_sql(_where))(lambda spark, sf_dir, args=_args: bundles.redacted(T.event_records(spark, sf_dir), **args).select("record_id", "payload", "confidentiality", "redaction_method"))


@query("verify_redaction", "SELECT event_id::VARCHAR AS record_id, event_type = 'view' AND event_id % 4 <> 0 AS holds FROM events")
def verify_redaction(spark, sf_dir):
    records = T.event_records(spark, sf_dir)
    hidden = bundles.redacted(records, types=["view"], commit=bundles.plain_commitment).select("record_id", "redaction_method")
    shown = records.select("record_id", F.when(F.col("seq") % 4 == 0, '{"k":-1}').otherwise(F.col("payload")).alias("payload"))
    return hidden.join(shown, "record_id").select("record_id", bundles.redaction_holds(F.col("redaction_method"), F.col("payload"), bundles.plain_commitment).alias("holds"))


_SORTED = "SELECT event_type AS record_type, event_id::VARCHAR AS record_id, row_number() OVER (PARTITION BY event_type ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), event_id::VARCHAR) AS position FROM events"


@query("sort_and_shard", f"SELECT record_type, record_id, position::INTEGER AS position, ((position - 1) // 300 + 1)::INTEGER AS shard FROM ({_SORTED})")
def shard(spark, sf_dir):
    return bundles.sharded(T.event_records(spark, sf_dir), 300).select("record_type", "record_id", F.col("position").cast("int").alias("position"), "shard")


@query("record_files_index", f"""WITH s AS (SELECT record_type, (position - 1) // 300 + 1 AS shard FROM ({_SORTED})), m AS (SELECT record_type, max(shard) AS many FROM s GROUP BY 1)
SELECT record_type, CASE WHEN many = 1 THEN 'records/' || record_type || '.jsonl' ELSE 'records/' || record_type || '/' || record_type || '.' || lpad(shard::VARCHAR, 4, '0') || '.jsonl' END AS path, count(*) AS count FROM s JOIN m USING (record_type) GROUP BY ALL""")
def files_index(spark, sf_dir):
    return bundles.record_files(bundles.sharded(T.event_records(spark, sf_dir), 300)).select("record_type", "path", "count")


@query("shard_by_bytes")
def shard_bytes(spark, sf_dir):
    records = T.event_records(spark, sf_dir).withColumn("size", F.octet_length("payload") + 1)
    return bundles.sharded_by_size(records, rows=500, size=4_000).select("record_type", "record_id", "position", "shard")
