"""What rules ask of a single record, as a table.

Many rules of many catalogs ask the same of a record: that it is of a type, that a pointer finds something, that what it
finds compares with an operand. Each such question is an atom, a row of a table that is joined to the records by their
type. One plan answers all of them, however many rules and catalogs there are: pointers, operators and operands are data.
What a pointer finds is looked up and read once a record, however many atoms ask about it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import EXACT, INPUT_CHARS, OPERATORS, RuleError, Value, at_position, below, checked_pattern, depth, order, pointer_tokens, same, value_of
from .catalog import Rule

ENTITY = {"subject": "subject_refs", "component": "component_refs", "dataset": "dataset_refs", "actor": "actor_refs"}
#: The type that stands for all types but extensions.
ANY = "\u0000any"
SCHEMA = (
    "atom int, kind string, roles array<string>, phases array<string>, test string, inside boolean, steps array<string>, op string, operand string, "
    "pattern string, wanted string, days int, since string, by_package boolean"
)
#: No two dates are so many days apart.
DAYS = 10_000_000
#: Tests of what a pointer finds.
VALUED = ("present", "compare")
_READINGS = {"present": "boolean", "num": "double", "whole": "decimal(38,0)", "str": "string", "nested": "string"}
_DAY = 86_400_000_000


@dataclass
class Atoms:
    """rows: as SCHEMA; of_rule: a rule's number to its atom's; defects: why other rules can't be evaluated."""

    rows: list[tuple] = field(default_factory=list)
    of_rule: dict[int, int] = field(default_factory=dict)
    defects: dict[int, str] = field(default_factory=dict)
    outside: bool = False  # a pointer leads out of payloads
    by_package: bool = False
    lists: int = 0  # so many lists within each other are ordered
    of_subjects: set[int] = field(default_factory=set)  # atoms of rules that are asked of each subject

    @property
    def kinds(self) -> set[str]:
        return {r[1] for r in self.rows}

    @property
    def tests(self) -> set[str]:
        return {r[4] for r in self.rows}

    @property
    def ops(self) -> set[str]:
        return {r[7] for r in self.rows if r[4] == "compare"}

    @property
    def readings(self) -> set[str]:
        """The readings of a value that some operand can be compared with."""
        out = set()
        for op, text in ((r[7], r[8]) for r in self.rows if r[4] == "compare"):
            operand = json.loads(text)
            for x in operand if op == "in" and isinstance(operand, list) else [operand]:
                if isinstance(x, bool | int | float):
                    out |= {"num", "whole"} if isinstance(x, int) and abs(x) >= EXACT else {"num"}
                elif x is not None:
                    out.add("str" if isinstance(x, str) else "nested")
        return out

    def places(self) -> tuple[dict[tuple, int], list[int]]:
        """The distinct (kind, whether a value is found, inside, steps) with their numbers, and the number of each atom's."""
        keys = [(r[1], r[4] in VALUED, r[5], tuple(r[6])) if r[4] in VALUED else (r[1], False, False, ()) for r in self.rows]
        numbers: dict[tuple, int] = {}
        return numbers, [numbers.setdefault(k, len(numbers)) for k in keys]


def _question(rule: Rule, instant: str) -> dict[str, Any]:
    """What one rule asks of a record; RuleError if it can't be asked."""
    p, op = rule.params, rule.operator
    kind = p["type"] if op == "has_record_type" else p.get("record_type")
    asked: dict[str, Any] = {"kind": ANY if op == "evidence_freshness" else kind, "roles": sorted(rule.roles), "phases": sorted(rule.phases), "test": op}
    if op in ("field_present", "field_value", "exists_where"):
        steps = pointer_tokens(p["field"])
        inside = steps[:1] == ["payload"]
        asked |= {"test": "present" if op == "field_present" else "compare", "inside": inside, "steps": steps[inside:]}
        if op != "field_present":
            asked |= {"op": p["op"] if p["op"] in OPERATORS else "never", "operand": json.dumps(p["value"])}
            if p["op"] == "regex" and isinstance(p["value"], str):
                asked["pattern"] = checked_pattern(p["value"])
    elif op == "evidence_freshness":
        base = p.get("reference_date", "validation_time")
        asked |= {"days": max(-DAYS, min(DAYS, int(p["max_days"]))), "by_package": base == "package_time", "since": None if base == "package_time" else (rule.effective_date or instant) if base == "obligation_effective_date" else instant}
    elif op in ("attachment_exists", "attachment_kind_exists"):
        asked["wanted"] = p.get("media_type") if op == "attachment_exists" else p["attachment_type"]
    elif op == "entity_linked":
        asked["wanted"] = p["entity_type"]
    return asked


def atoms_of(rules: list[Rule], instant: str) -> Atoms:
    """The distinct questions of rules."""
    out, numbers = Atoms(), {}
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
    for i, r in enumerate(rules):
        if why := r.defect():
            out.defects[i] = why
            continue
        if r.operator == "bundle_signed":
            continue
        try:
            asked = _question(r, instant)
        except (RuleError, TypeError, ValueError, AttributeError) as e:
            out.defects[i] = str(e)
            continue
        key = json.dumps(asked, sort_keys=True)
        if key not in numbers:
            numbers[key] = len(out.rows)
            row = {"roles": [], "phases": [], "inside": False, "steps": [], "by_package": False} | asked
            out.rows.append((len(out.rows), *(row.get(n) for n in names)))
            out.outside |= asked["test"] in ("present", "compare") and not asked["inside"]
            out.by_package |= row["by_package"]
            if asked.get("op") in ("gt", "gte", "lt", "lte"):
                out.lists = max(out.lists, depth(json.loads(asked["operand"])))
        out.of_rule[i] = numbers[key]
        if not r.package_scope:
            out.of_subjects.add(numbers[key])
    return out


def atom_table(spark: SparkSession, atoms: Atoms) -> DataFrame:
    """The atoms with their operands and instants read; as many rows as catalogs on the driver have questions. place: the
    number of what they ask about; asked: whether a rule of theirs is asked of each subject."""
    rows = [(*r, place, r[0] in atoms.of_subjects) for r, place in zip(atoms.rows, atoms.places()[1], strict=True)]
    df = spark.createDataFrame(rows, SCHEMA + ", place int, asked boolean").withColumn("o", F.try_parse_json("operand")).withColumn("since", _instant(F.col("since")))
    df = df.withColumn("one", _read(value_of(F.col("o"))))
    if "in" not in atoms.ops:
        return df
    each = F.transform(F.try_variant_get("o", "$", "array<variant>"), lambda x: _read(value_of(x)))
    df = df.withColumn("__each", F.when(F.col("op") == "in", each))
    # as `same` has it: numbers by their exact readings where both have one
    plain = F.filter("__each", lambda m: m["whole"].isNull())
    members = [F.col("__each")[n].alias(n) for n in ("num", "whole", "str", "nested")]
    return df.withColumn("members", F.struct(*members, plain["num"].alias("plain"))).drop("__each")


def _read(v: Value) -> Column:
    """The readings of a value. Integers that doubles tell apart have no exact one: two such compare as doubles, and so does
    one with any other number."""
    whole = F.when(F.abs(v.num) >= float(EXACT), v.whole)
    return F.struct(*[(whole if n == "whole" else getattr(v, n)).alias(n) for n in _READINGS])


# ---------------------------------------------------------------- records


def whole_record(records: DataFrame) -> Column:
    """A record as pointers see it, a VARIANT: members that are null left out, others at their defaults. The line it came
    from (raw), where records have one, gives what has no column."""
    have, columns = set(records.columns), []
    for c in ("record_id", "record_type", "provisions_addressed", "timestamp", "lifecycle_phase", "obligation_role", "confidentiality", "redaction_method", "trust_level"):
        if c in have:
            columns.append(F.col(c))
    refs = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ENTITY.values() if c in have]
    columns += [F.struct(*refs).alias("entity_refs"), F.coalesce("__payload", F.parse_json(F.lit("{}"))).alias("payload")]
    if "raw" not in have:
        none = F.array().cast(records.schema["attachments"].dataType)
        signature = F.when(F.length("attestation_signature") > 0, F.struct(F.col("attestation_signature").alias("signature")))
        columns += [F.coalesce("attachments", none).alias("attachments"), signature.alias("attestation")]
    else:
        line = F.try_parse_json("raw")
        text = lambda v, name, default=None: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(default)).alias(name)
        attached = F.transform(F.try_variant_get(line, "$.attachments", "array<variant>"), lambda a: F.struct(text(a, "path"), text(a, "hash"), text(a, "media_type", "application/octet-stream"), text(a, "attachment_type"), text(a, "description", "")))
        one = lambda name: F.try_variant_get(line, f"$.{name}", "variant")
        there = lambda name: F.size(F.try_variant_get(one(name), "$", "map<string,variant>")) > 0
        attest, keep, by = one("attestation"), one("retention"), one("collector")
        fields = F.coalesce(F.try_variant_get(attest, "$.signed_fields", "array<string>"), F.array(F.lit("/payload")))
        columns += [
            F.coalesce(attached, F.array().cast("array<struct<path:string,hash:string,media_type:string,attachment_type:string,description:string>>")).alias("attachments"),
            F.when(there("attestation"), F.struct(text(attest, "method", "jws"), text(attest, "signer", ""), fields.alias("signed_fields"), text(attest, "signature", ""))).alias("attestation"),
            F.when(there("retention"), F.struct(F.try_variant_get(keep, "$.min_retention_days", "long").alias("min_retention_days"), text(keep, "retention_start_event", "record_creation"), text(keep, "legal_basis", ""))).alias("retention"),
            F.when(there("collector"), F.struct(text(by, "name"), text(by, "version", ""))).alias("collector"),
            F.when(there("access_policy"), one("access_policy")).alias("access_policy"),
        ]
    return F.parse_json(F.to_json(F.struct(*columns)))


def _instant(text: Column) -> Column:
    """(at, aware) of an ISO 8601 date or date and time: the instant in microseconds, where a text without a zone is read as
    if in UTC, and whether it has one. at is null if it isn't such a text. The session's zone has no part in it."""
    usual = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")
    plus = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    aware = plus.rlike(r"^.{10}.+[+-]\d\d(:?\d\d)?$")
    zoned = F.when(aware, plus).when(F.length(plus) <= 10, F.concat(plus, F.lit("T00:00:00+00:00"))).otherwise(F.concat(plus, F.lit("+00:00")))
    formed = plus.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d(:\d\d(:\d\d([.,]\d+)?)?)?([+-]\d\d(:?\d\d)?)?)?$")
    short = F.regexp_replace(zoned, r"^(.{10})[T ](\d\d)([+-].*)$", "$1T$2:00$3")
    full = F.when(usual, text).when(formed, F.regexp_replace(short, r"([+-]\d\d)(\d\d)$", "$1:$2"))
    return F.struct(F.unix_micros(F.try_to_timestamp(full)).alias("at"), F.when(usual, True).otherwise(aware).alias("aware"))


def _answers(atoms: Atoms) -> tuple[Column, Column]:
    """(satisfied, fails): whether a record satisfies an atom, and whether it can't be told, which is an error of the rule.

    What no atom asks isn't part of them, nor are lambdas: so they are compiled as one with the joins about them."""
    a = lambda name: F.col(f"a.{name}")
    readings = atoms.readings

    def value(of: str, raw: Column) -> Value:
        return Value(*(F.col(f"{of}.{n}") if n in readings | {"present"} else F.lit(None).cast(t) for n, t in _READINGS.items()), raw=raw)

    def chosen(asked: set[str], which: Column, answers: dict[str, Column]) -> Column:
        out = F.lit(None).cast("boolean")
        for name, answer in answers.items():
            out = F.when(which == name, answer).otherwise(out) if name in asked else out
        return out

    v, operand = value("__read", F.col("__v")), value("a.one", a("o"))
    equal, sign = same(v, operand), order(v, operand, atoms.lists)
    text = F.col("__read.str")
    answers = {
        "eq": equal, "regex": (F.length(text) <= INPUT_CHARS) & F.rlike(text, a("pattern")),
        "gt": sign > 0, "gte": sign >= 0, "lt": sign < 0, "lte": sign <= 0,
    }
    if "in" in atoms.ops:
        among = lambda name, x: F.coalesce(F.array_contains(a(f"members.{name}"), x), F.lit(False))
        number = F.when(v.whole.isNotNull(), among("whole", v.whole) | among("plain", v.num)).otherwise(among("num", v.num))
        answers["in"] = number | among("str", v.str) | among("nested", v.nested)
    answers = {op: v.present & x for op, x in answers.items()} | {"ne": ~v.present | ~equal}
    since = F.when(a("by_package"), F.col("__package_since.at")).otherwise(F.col("a.since.at"))
    of_zone = F.when(a("by_package"), F.col("__package_since.aware")).otherwise(F.col("a.since.aware"))
    own = F.col("__own.at")
    linked = F.lit(None).cast("boolean")
    for name, column in ENTITY.items():
        linked = F.when(a("wanted") == name, F.size(column) > 0).otherwise(linked)
    tests = {
        "has_record_type": F.lit(True), "present": F.col("__v").isNotNull() & ~F.is_variant_null("__v"), "compare": chosen(atoms.ops, a("op"), answers),
        "evidence_freshness": since.isNull() | (own >= since - a("days").cast("long") * _DAY),
        "attachment_exists": F.when(a("wanted").isNull(), F.size("attachments") > 0).otherwise(F.array_contains(F.col("attachments.media_type"), a("wanted"))),
        "attachment_kind_exists": F.array_contains(F.col("attachments.attachment_type"), a("wanted")),
        "entity_linked": linked, "record_attested": F.length("attestation_signature") > 0,
    }
    errors = {"evidence_freshness": since.isNotNull() & own.isNotNull() & (of_zone != F.col("__own.aware")), "entity_linked": ~a("wanted").isin(*ENTITY)}
    ok, fails = (chosen(atoms.tests, a("test"), x) for x in (tests, errors))
    return F.coalesce(ok, F.lit(False)), F.coalesce(fails, F.lit(False))


def _found(records: DataFrame, atoms: Atoms) -> DataFrame:
    """A row for each record and place that atoms ask about: kind, place, and what is found there (__v) with its readings."""
    spark, (numbers, _) = records.sparkSession, atoms.places()
    places = spark.createDataFrame([(i, kind, valued, inside, list(steps)) for (kind, valued, inside, steps), i in numbers.items()], "place int, kind string, valued boolean, inside boolean, steps array<string>")
    kinds = F.lit(ANY) if atoms.kinds == {ANY} else F.explode(F.array("record_type", F.lit(ANY))) if ANY in atoms.kinds else F.col("record_type")
    records = records.withColumn("kind", kinds)
    if not any(valued for _, valued, _, _ in numbers):
        nothing = F.struct(*[(F.lit(False) if n == "present" else F.lit(None).cast(t)).alias(n) for n, t in _READINGS.items()])
        return records.join(F.broadcast(places.select("place", "kind")), "kind").withColumns({"__v": F.lit(None).cast("variant"), "__read": nothing})
    records = records.withColumn("__payload", F.try_parse_json("payload"))
    records = records.withColumn("__whole", whole_record(records) if atoms.outside else F.lit(None).cast("variant"))
    # members are looked up in maps that are made once a record; steps below those are walked for each place that has any
    members = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    records = records.withColumns({"__of_payload": members("__payload"), "__of_whole": members("__whole")})
    rows = records.join(F.broadcast(places), "kind")
    either = lambda inner, outer: F.when(F.col("inside"), F.col(inner)).otherwise(F.col(outer))
    base, step = either("__payload", "__whole"), F.get("steps", F.lit(0))
    found = first = F.coalesce(F.try_element_at(either("__of_payload", "__of_whole"), step), at_position(base, step))
    if any(len(steps) > 1 for *_, steps in numbers):
        more = F.slice("steps", F.lit(2), F.greatest(F.lit(0), F.size("steps") - 1))
        found = F.when(F.size("steps") == 1, first).otherwise(F.aggregate(more, first, below))
    found = F.when(F.size("steps") == 0, base).otherwise(found)
    rows = rows.withColumn("__v", F.when(F.col("valued"), found)).withColumn("__type", F.coalesce(F.schema_of_variant("__v"), F.lit("VOID")))
    return rows.withColumn("__read", _read(value_of(F.col("__v"), F.col("__type"))))


def answered(records: DataFrame, packages: DataFrame, atoms: Atoms) -> DataFrame:
    """(package_id, record_id, seq, subject_refs, atom, asked, satisfied, fails): a row for each record and atom in whose scope it is."""
    if atoms.by_package:
        records = records.join(packages.select("package_id", _instant(F.col("package_time")).alias("__package_since")), "package_id", "left")
    else:
        records = records.withColumn("__package_since", F.lit(None).cast("struct<at:bigint,aware:boolean>"))
    # instants are read once a record, not for each atom
    records = records.withColumn("__own", _instant(F.col("timestamp")) if "evidence_freshness" in atoms.tests else F.lit(None).cast("struct<at:bigint,aware:boolean>"))
    table = atom_table(records.sparkSession, atoms)
    table = table.select("place", F.struct(*[c for c in table.columns if c not in ("place", "kind", "inside", "steps")]).alias("a"))
    rows = _found(records, atoms).join(F.broadcast(table), "place")
    within = lambda names, column: (F.size(names) == 0) | F.array_contains(names, F.coalesce(column, F.lit("")))
    rows = rows.where(within("a.roles", "obligation_role") & within("a.phases", "lifecycle_phase") & ((F.col("kind") != ANY) | ~F.col("record_type").startswith("x-")))
    ok, fails = _answers(atoms)
    return rows.select("package_id", "record_id", "seq", "subject_refs", F.col("a.atom").alias("atom"), F.col("a.asked").alias("asked"), ok.alias("satisfied"), fails.alias("fails"))
