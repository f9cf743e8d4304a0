"""A JSON Schema subset compiled to Columns over VARIANT values: type, enum, const, pattern, minimum, maximum, minItems, items,
contains, required, properties, additionalProperties, oneOf, anyOf, allOf and references within a schema. Formats aren't enforced.

`problems` compiles one schema into one expression; findings over tables walk the values by an automaton of all schemas
(schema_walk), whose plan doesn't grow with the schemas."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import _equal, value_of, variant_name
from .diagnostics import CATEGORY, SEVERITY, diagnostic
from .schema_walk import DEEP, _is_number, _referred, violations

#: Schemas of a published folder that aren't of payloads.
MANIFEST, ENVELOPE, NOT_PAYLOADS = "manifest", "record-envelope", ("manifest", "record-envelope", "assessment-bundle", "template")
_FOUND = "array<struct<word:string,pointer:string>>"


#: Whether a value of this kind, as a number this, is of a type; 1.0 is an integer.
_KINDS = {
    "string": lambda k, _: k == "STRING", "boolean": lambda k, _: k == "BOOLEAN", "null": lambda k, _: k == "VOID",
    "array": lambda k, _: k.startswith("ARRAY"), "object": lambda k, _: k.startswith("OBJECT"),
    "number": lambda k, _: _is_number(k), "integer": lambda k, v: _is_number(k) & F.coalesce(v == F.floor(v), F.lit(False)),
}


def _terms(schema: Any, base: Column, path: str, pointer: str, root: dict, within: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """(single, many): Columns that are a violation or null, and Columns that are arrays of violations, of the value at `path` of
    `base`. Pointers are relative to base. within: the references that led here."""
    if isinstance(schema, bool):
        there = F.try_variant_get(base, path, "variant").isNotNull()
        return ([] if schema else [F.when(there, F.struct(F.lit("false").alias("word"), F.lit(pointer).alias("pointer")))]), []
    found = F.try_variant_get(base, path, "variant")
    v, kind, there = value_of(found), F.coalesce(F.schema_of_variant(found), F.lit("VOID")), found.isNotNull()
    bad: list[tuple[str, str, Column]] = []
    single: list[Column] = []
    many: list[Column] = []

    def also(sub: Any, more: str = "", name: str = "", refs: tuple[str, ...] = within) -> None:
        one, several = _terms(sub, base, path + more, pointer + name, root, refs)
        single.extend(one)
        many.extend(several)

    def holds(sub: Any) -> Column:
        return F.size(problems(sub, base, root, path, "", within)) == 0

    def say(word: str, ok: Column) -> None:
        bad.append((pointer, word, there & ~F.coalesce(ok, F.lit(False))))

    if (ref := schema.get("$ref")) is not None:
        if ref in within:
            raise ValueError(f"the schema contains itself by {ref!r}")
        also(_referred(root, ref), refs=(*within, ref))
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = F.lit(False)
        for k in kinds:
            ok = ok | _KINDS[k](kind, v.num)
        say("type", ok)
    if "enum" in schema:
        ok = F.lit(False)
        for x in schema["enum"]:
            ok = ok | _same(v, kind, x)
        say("enum", ok)
    if "const" in schema:
        say("const", _same(v, kind, schema["const"]))
    if "pattern" in schema:
        bad.append((pointer, "pattern", v.str.isNotNull() & ~F.rlike(v.str, F.lit(schema["pattern"]))))
    if "minimum" in schema:
        bad.append((pointer, "minimum", F.coalesce((v.num < float(schema["minimum"])) & (kind != "BOOLEAN"), F.lit(False))))
    if "maximum" in schema:
        bad.append((pointer, "maximum", F.coalesce((v.num > float(schema["maximum"])) & (kind != "BOOLEAN"), F.lit(False))))
    for word, want in (("oneOf", lambda n: n == 1), ("anyOf", lambda n: n >= 1)):
        if word in schema:
            passed = F.lit(0)
            for sub in schema[word]:
                passed = passed + F.when(holds(sub), 1).otherwise(0)
            say(word, want(passed))
    for sub in schema.get("allOf", ()):
        also(sub)

    if {"minItems", "items", "contains"} & set(schema):
        members = F.when(kind.startswith("ARRAY"), F.try_variant_get(base, path, "array<variant>"))
        if "minItems" in schema:
            bad.append((pointer, "minItems", F.coalesce(F.size(members) < schema["minItems"], F.lit(False))))
        if (item := schema.get("items", True)) is not True:
            if isinstance(item, dict) and DEEP & set(item):
                many.append(_each(members, lambda m, i: (m, i.cast("string")), item, pointer, root, within))
            else:
                fit = F.forall(members, lambda m: F.size(problems(item, m, root, "$", "", within)) == 0)
                bad.append((pointer, "items", kind.startswith("ARRAY") & ~F.coalesce(fit, F.lit(False))))
        if "contains" in schema:
            fits = F.exists(members, lambda m: F.size(problems(schema["contains"], m, root, "$", "", within)) == 0)
            bad.append((pointer, "contains", kind.startswith("ARRAY") & ~F.coalesce(fits, F.lit(False))))
    for name in schema.get("required", ()):
        bad.append((f"{pointer}/{name}", "required", kind.startswith("OBJECT") & F.try_variant_get(base, path + variant_name(name), "variant").isNull()))
    named = schema.get("properties") or {}
    for name, sub in named.items():
        also(sub, variant_name(name), "/" + name)
    if (rest := schema.get("additionalProperties", True)) is not True:
        members = F.when(kind.startswith("OBJECT"), F.map_entries(F.try_variant_get(base, path, "map<string,variant>")))
        others = F.filter(members, lambda e: ~e["key"].isin(*named)) if named else members
        if rest is False:
            bad.append((pointer, "additionalProperties", F.coalesce(F.size(others) > 0, F.lit(False))))
        else:
            many.append(_each(others, lambda e, _: (e["value"], e["key"]), rest, pointer, root, within))
    single += [F.when(is_bad, F.struct(F.lit(word).alias("word"), F.lit(at).alias("pointer"))) for at, word, is_bad in bad]
    return single, many


def _same(v, kind: Column, x: Any) -> Column:
    return (kind == "VOID") if x is None else _equal(v, x)


def _each(members: Column, parts, schema: Any, pointer: str, root: dict, within: tuple[str, ...]) -> Column:
    """The violations of a schema by members of an array or object; parts gives a member's value and step."""

    def of_member(m: Column, i: Column) -> Column:
        value, step = parts(m, i)
        return F.transform(problems(schema, value, root, "$", "", within), lambda x: F.struct(x["word"].alias("word"), F.concat(F.lit(pointer + "/"), step, x["pointer"]).alias("pointer")))

    return F.coalesce(F.flatten(F.transform(members, of_member)), F.array().cast(_FOUND))


def problems(schema: Any, value: Column, root: dict | None = None, path: str = "$", pointer: str = "", within: tuple[str, ...] = ()) -> Column:
    """Array of (word, pointer): each violated keyword of a schema by the value at `path` of a VARIANT; empty where there is
    no value. Members that are objects or arrays are looked into one by one; of oneOf and anyOf only the keyword is reported."""
    single, many = _terms(schema, value, path, pointer, schema if root is None else root, within)
    own = F.filter(F.array(*single), lambda x: x.isNotNull()) if single else F.array().cast(_FOUND)
    return F.concat(own.cast(_FOUND), *many) if many else own.cast(_FOUND)


def _findings(values: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Findings for values (package_id, code, start, text, schema), walked by the automaton of all schemas."""
    found = violations(values.select("package_id", "code", "start", "text", "schema"), schemas)
    of = lambda table: F.when(F.col("code") == "002", table["002"]).otherwise(table["004"])
    return found.select("package_id", F.concat(F.lit("EV-"), "code").alias("code"), of(SEVERITY).alias("severity"), of(CATEGORY).alias("category"), F.concat("word", F.lit(" violated")).alias("message"), F.concat("start", "at").alias("path"))


def _value(code: str, start: Column, text: str, schema: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), start.alias("start"), F.col(text).alias("text"), schema.alias("schema"))


def _of_payload() -> Column:
    return F.when(F.col("payload").isNotNull() & (F.col("payload") != "{}"), _value("004", F.concat("record_id", F.lit("/payload")), "payload", F.col("record_type")))


def _of_envelope() -> Column:
    return _value("004", F.coalesce("record_id", F.lit("")), "raw", F.lit(ENVELOPE))


def _values(rows: DataFrame, *values: Column) -> DataFrame:
    return rows.select("package_id", F.inline(F.filter(F.array(*values), lambda x: x.isNotNull())))


def unknown_types(records: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A 003 for each record of a type without schema that isn't an extension (x-)."""
    unknown = records.where(~F.col("record_type").isin(*schemas) & ~F.col("record_type").startswith("x-"))
    return diagnostic(unknown, "003", F.concat(F.lit("unknown type "), "record_type"), F.col("record_id"))


def schema_findings(records: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Findings for records (package_id, record_id, record_type, payload as JSON text) by schemas of payloads. Unknown types
    are 003 unless they are extensions (x-); every violated keyword is a 004; empty payloads aren't checked."""
    out = unknown_types(records, schemas)
    return out.unionByName(_findings(_values(records, _of_payload()), schemas)) if schemas else out


def all_findings(manifests: DataFrame, records: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """What schemas by name say of manifests (package_id, raw), of records' envelopes (raw) and of payloads, in one walk of
    one reading of the records: a 002 for each violation by a manifest, a 004 by a record, 003 for unknown types. A
    manifest or an envelope is checked if its schema is there, payloads if any schema of theirs is."""
    payloads = {name: schema for name, schema in schemas.items() if name not in NOT_PAYLOADS}
    of_records = [*([_of_payload()] if payloads else []), *([_of_envelope()] if ENVELOPE in schemas else [])]
    parts = [_values(records, *of_records)] if of_records else []
    parts += [_values(manifests, _value("002", F.lit(""), "raw", F.lit(MANIFEST)))] if MANIFEST in schemas else []
    held = payloads | {name: schemas[name] for name in (MANIFEST, ENVELOPE) if name in schemas}
    values = parts[0] if len(parts) < 2 else parts[0].unionByName(parts[1])
    return _findings(values, held).unionByName(unknown_types(records, payloads)) if payloads else _findings(values, held)
