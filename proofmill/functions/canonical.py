"""RFC 8785 canonical JSON, SHA-256 and Merkle roots."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def number_text(x: float) -> str:
    """A double as ECMAScript prints it."""
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    if x == 0:
        return "0"
    sign, digits = "-" if x < 0 else "", repr(abs(x))
    mantissa, _, power = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)  # the value is 0.DIGITS * 10 ** point
    all_digits = whole + part
    lead = len(all_digits) - len(all_digits.lstrip("0"))
    all_digits, point = all_digits.lstrip("0").rstrip("0"), point - lead
    n = len(all_digits)
    if n <= point <= 21:
        return sign + all_digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{all_digits[:point]}.{all_digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{all_digits}"
    e = point - 1
    return f"{sign}{all_digits[0]}{'.' + all_digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical(value: Any) -> str:
    """The canonical text of a JSON value: members by UTF-16 code units, no white space."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value) if abs(value) <= 1 << 53 else number_text(float(value))
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    return "[" + ",".join(map(canonical, value)) + "]"


def canonical_or_none(text: str | None) -> str | None:
    """Canonical form of a JSON text; None if it isn't JSON."""
    try:
        return None if text is None else canonical(json.loads(text))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(canonical_or_none)


def leaf(path: Column, digest: Column) -> Column:
    """A Merkle leaf: SHA-256 of path, a zero byte and the hex digest."""
    return F.sha2(F.concat(F.encode(path, "utf-8"), F.lit(b"\0"), F.encode(digest, "utf-8")), 256)


def merkle_root(leaves: Column) -> Column:
    """The root over an array of hex leaves in order, folded level by level; an odd last node moves up as it is. The
    array has a leaf for each file of one bundle. Parents are hashed from the bytes of their children's hex."""
    empty = F.lit(hashlib.sha256(b"").hexdigest())

    def level(nodes: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
        up = F.transform(pairs, lambda i: F.when(2 * i + 1 < F.size(nodes), F.sha2(F.concat(F.unhex(F.get(nodes, 2 * i)), F.unhex(F.get(nodes, 2 * i + 1))), 256)).otherwise(F.get(nodes, 2 * i)))
        return F.when(F.size(nodes) > 1, up).otherwise(nodes)

    return F.when(F.size(leaves) == 0, empty).otherwise(F.get(F.aggregate(F.sequence(F.lit(1), F.lit(40)), leaves, level), F.lit(0)))
