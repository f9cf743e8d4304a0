"""JSON pointers and typed, two-valued comparisons as Columns.

A value found by a pointer is kept as four typed readings, and a comparison picks the reading that fits its operand.
Nothing is cast across types: the string "10" isn't greater than the number 5. Predicates are never null.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Limits on patterns and on the strings they are matched with.
PATTERN_CHARS, INPUT_CHARS = 1_024, 1_000_000
#: From here on doubles don't tell all integers apart.
EXACT = 1 << 53
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "regex")

_ENVELOPE = ("record_id", "record_type", "timestamp", "lifecycle_phase", "obligation_role", "confidentiality", "redaction_method", "trust_level")
_REFS = ("subject_refs", "component_refs", "dataset_refs", "actor_refs")


class RuleError(ValueError):
    """A rule that can't be evaluated."""


@dataclass(frozen=True)
class Value:
    """present; num where it is a number or boolean; whole, exactly, where it is an integer; str where it is a string; nested as canonical JSON where it is an array or object; raw, the VARIANT itself."""

    present: Column
    num: Column
    whole: Column
    str: Column
    nested: Column
    raw: Column | None = None


def pointer_tokens(pointer: str) -> list[str]:
    """The steps of an RFC 6901 pointer."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise RuleError(f"pointer {pointer!r} doesn't begin with /")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def variant_name(name: str) -> str:
    """The step of a variant path to a member. The paths know no escapes: a name with both kinds of quotes can't be written."""
    if "'" not in name:
        return f"['{name}']"
    if '"' in name:
        raise RuleError(f"no path leads to the name {name!r}")
    return f'["{name}"]'


def is_position(step: str) -> bool:
    return re.fullmatch(r"0|[1-9]\d*", step) is not None


def variant_path(tokens: list[str]) -> str | None:
    """A path for try_variant_get that finds what the steps of a pointer do; None where only `below` does: a number leads to
    a member or a position as the value has it, and some names can't be written."""
    if any(is_position(t) or "'" in t and '"' in t for t in tokens):
        return None
    return "$" + "".join(map(variant_name, tokens))


def below(v: Column, step: Column) -> Column:
    """What one step of a pointer finds in a VARIANT: an object's member of that name, or an array's element at that position."""
    return F.coalesce(F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), step), at_position(v, step))


def at_position(v: Column, step: Column) -> Column:
    """An array's element at the position that a step names."""
    at = F.when(step.rlike("^(0|[1-9][0-9]{0,8})$"), step.cast("int"))
    return F.get(F.try_variant_get(v, "$", "array<variant>"), at)


def found_at(v: Column, tokens: list[str]) -> Column:
    """The VARIANT that a pointer's steps find in v; null if there is none."""
    if (path := variant_path(tokens)) is not None:
        return F.try_variant_get(v, path, "variant")
    for t in tokens:
        v = below(v, F.lit(t))
    return v


def value_of(v: Column, kind: Column | None = None) -> Value:
    """The readings of a VARIANT column. kind: its type, where that is known already."""
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID")) if kind is None else kind
    is_num = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
    num = F.when(is_num, F.try_variant_get(v, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double"))
    whole = F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\(\d+, *0\)$"), F.try_variant_get(v, "$", "decimal(38,0)"))
    nested = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(v))
    return Value(v.isNotNull() & (kind != "VOID"), num, whole, F.when(kind == "STRING", F.try_variant_get(v, "$", "string")), nested, v)


def value_at(pointer: str, payload: Column, whole: Column | None = None) -> Value:
    """What a pointer finds in a record whose payload is the given VARIANT column. whole: the record itself as a VARIANT;
    without it only the columns of an envelope are found."""
    tokens = pointer_tokens(pointer)
    null_num, null_whole, null_str = F.lit(None).cast("double"), F.lit(None).cast("decimal(38,0)"), F.lit(None).cast("string")
    if tokens and tokens[0] == "payload":
        return value_of(found_at(payload, tokens[1:]))
    if whole is not None:
        return value_of(found_at(whole, tokens))
    if len(tokens) == 1 and tokens[0] in _ENVELOPE:
        c = F.col(tokens[0])
        return Value(c.isNotNull(), null_num, null_whole, c.cast("string"), null_str)
    if len(tokens) == 2 and tokens[0] == "entity_refs" and tokens[1] in _REFS:
        return Value(F.col(tokens[1]).isNotNull(), null_num, null_whole, null_str, F.to_json(tokens[1]))
    return Value(F.lit(False), null_num, null_whole, null_str, null_str)


def _numbers(v: Value, operand: bool | int | float, holds: Callable[[Column, Column], Column]) -> Column:
    """holds(value, operand): exactly between integers that doubles don't tell apart, else as doubles."""
    as_double = holds(v.num, F.lit(float(operand)))
    if isinstance(operand, int) and EXACT <= abs(operand) < 10**38:
        return F.when(v.whole.isNotNull(), holds(v.whole, F.lit(str(operand)).cast("decimal(38,0)"))).otherwise(as_double)
    return as_double


def _equal(v: Value, operand: Any) -> Column:
    if operand is None:
        return F.lit(False)
    if isinstance(operand, bool | int | float):
        return F.coalesce(_numbers(v, operand, operator.eq), F.lit(False))
    if isinstance(operand, str):
        return F.coalesce(v.str == F.lit(operand), F.lit(False))
    return F.coalesce(v.nested == F.to_json(F.parse_json(F.lit(json.dumps(operand)))), F.lit(False))


def same(a: Value, b: Value) -> Column:
    """Whether two values are equal; values of different types aren't, but a boolean is the number 0 or 1."""
    numbers = F.when(a.whole.isNotNull() & b.whole.isNotNull(), a.whole == b.whole).otherwise(a.num == b.num)
    return F.coalesce(numbers, a.str == b.str, a.nested == b.nested, F.lit(False))


def depth(operand: Any) -> int:
    """How many lists an operand has within each other."""
    return 1 + max(map(depth, operand), default=0) if isinstance(operand, list) else 0


def order(a: Value, b: Value, lists: int = 0) -> Column:
    """-1, 0 or 1 as a is less than, equal to or greater than b; null where they can't be ordered. Lists are ordered by
    their first elements that differ, or else by length, as far as `lists` of them lie within each other."""

    def sign(x: Column, y: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)

    plain = F.coalesce(F.when(a.whole.isNotNull() & b.whole.isNotNull(), sign(a.whole, b.whole)).otherwise(sign(a.num, b.num)), sign(a.str, b.str))
    if not lists:
        return plain
    x, y = (F.try_variant_get(v.raw, "$", "array<variant>") for v in (a, b))
    shared = F.least(F.size(x), F.size(y))

    def differs(p: Column) -> Column:
        v, w = value_of(p["v"]), value_of(p["w"])
        return ~same(v, w) & (v.present | w.present)

    pairs = F.zip_with(F.slice(x, F.lit(1), shared), F.slice(y, F.lit(1), shared), lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    first = F.get(F.filter(pairs, differs), F.lit(0))
    by_elements = F.when(first.isNotNull(), order(value_of(first["v"]), value_of(first["w"]), lists - 1)).otherwise(sign(F.size(x), F.size(y)))
    return F.coalesce(plain, F.when(x.isNotNull() & y.isNotNull(), by_elements))


def checked_pattern(pattern: Any) -> str:
    """The pattern as it is matched; an error if it is too long or no pattern, here or there."""
    if len(pattern) > PATTERN_CHARS:
        raise RuleError("the pattern is too long")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RuleError(f"the pattern is invalid: {e}") from e
    pattern = pattern.replace("(?P<", "(?<")
    if (session := SparkSession.getActiveSession()) is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(pattern)
        except Py4JJavaError as e:
            raise RuleError(f"the pattern is invalid: {pattern!r}") from e
    return pattern


def compared(v: Value, op: str, operand: Any) -> Column:
    """op on a value. A missing or null value satisfies `ne` alone; types that can't be ordered satisfy nothing but `ne`."""
    if op == "eq":
        return v.present & _equal(v, operand)
    if op == "ne":
        return ~v.present | ~_equal(v, operand)
    if op in ("gt", "gte", "lt", "lte"):
        holds = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}[op]
        if isinstance(operand, bool | int | float):
            return v.present & F.coalesce(_numbers(v, operand, holds), F.lit(False))
        if isinstance(operand, list) and v.raw is not None:
            sign = order(v, value_of(F.parse_json(F.lit(json.dumps(operand)))), depth(operand))
            return v.present & F.coalesce(holds(sign, F.lit(0)), F.lit(False))
        return v.present & F.coalesce(holds(v.str, F.lit(operand)), F.lit(False)) if isinstance(operand, str) else F.lit(False)
    if op == "in":
        found = F.lit(False)
        for x in operand if isinstance(operand, list) else []:
            found = found | _equal(v, x)
        return v.present & found
    if op == "regex":
        if not isinstance(operand, str):
            return F.lit(False)
        pattern = checked_pattern(operand)
        return v.present & F.coalesce((F.length(v.str) <= INPUT_CHARS) & F.rlike(v.str, F.lit(pattern)), F.lit(False))
    return F.lit(False)
