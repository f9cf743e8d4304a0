"""Typed comparisons against the same rules written down in plain Python."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from proofmill.functions.predicates import RuleError, compared, order, pointer_tokens, value_at, value_of

VALUES = [None, True, False, 0, 1, -3, 10, 2.5, 10.0, 1e300, "", "10", "abc", "ä", [], [1], ["a", 1], {}, {"a": 1}, {"a": 1.0}, {"b": [None]}]
OPERANDS = [None, True, 0, 1, 10, 2.5, "", "10", "b", [1], {"a": 1}]
ORDERS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def number(x):
    return isinstance(x, int | float)


def expected(op, actual, operand):
    if actual is None:
        return op == "ne"
    if op in ("eq", "ne"):
        return (actual == operand) == (op == "eq")
    if op == "in":
        return isinstance(operand, list) and actual in operand
    if op == "regex":
        return isinstance(actual, str) and isinstance(operand, str) and re.search(operand, actual) is not None
    try:
        return ORDERS[op](actual, operand)
    except TypeError:
        return False


@pytest.mark.parametrize("op", ["eq", "ne", "gt", "gte", "lt", "lte", "in", "regex"])
def test_comparisons(spark, op):
    rows = [(i, json.dumps({"v": v})) for i, v in enumerate(VALUES)] + [(len(VALUES), "{}")]
    operands = [[1, "abc", None], ["10"], 5] if op == "in" else OPERANDS
    df = spark.createDataFrame(rows, "i int, payload string").withColumn("p", F.parse_json("payload"))
    value = value_at("/payload/v", F.col("p"))
    found = df.select("i", *[compared(value, op, o).alias(f"c{k}") for k, o in enumerate(operands)]).collect()
    for r in found:
        actual = VALUES[r.i] if r.i < len(VALUES) else None
        for k, o in enumerate(operands):
            assert r[f"c{k}"] is expected(op, actual, o), (op, actual, o)


def test_lists_are_ordered_by_their_first_elements_that_differ(spark):
    lists = [[], [1], [1, 2], [2], [1.0, 2], [True], ["a"], ["a", 1], ["a", "b"], [None], [None, 1], [[1], 2], [[1, 0]], [[1], "x"], [{}], [{}, 1], [10**17], [10**17 + 1], 1, "a"]
    rows = [(i, k, json.dumps(a), json.dumps(b)) for i, a in enumerate(lists) for k, b in enumerate(lists)]
    df = spark.createDataFrame(rows, "i int, k int, a string, b string").select("i", "k", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    for r in df.select("i", "k", order(value_of(F.col("a")), value_of(F.col("b")), 2).alias("sign")).collect():
        want = [expected(op, lists[r.i], lists[r.k]) for op in ("lt", "lte", "gt", "gte")]
        assert ([False] * 4 if r.sign is None else [r.sign < 0, r.sign <= 0, r.sign > 0, r.sign >= 0]) == want, (lists[r.i], lists[r.k])


def test_pointers(spark):
    payload = json.dumps({"a/b": {"~c": [10, {"x y": "deep"}]}, "it's": 1, "0": {"1": "member"}, "both'\"": 7})
    df = spark.createDataFrame([(payload,)], "payload string").withColumn("p", F.parse_json("payload"))
    at = lambda pointer: value_at(pointer, F.col("p"))
    row = df.select(at("/payload/a~1b/~0c/0").num.alias("n"), at("/payload/a~1b/~0c/1/x y").str.alias("s"), at("/payload/it's").num.alias("q"), at("/payload/a~1b/none").present.alias("m"), at("/elsewhere").present.alias("e")).first()
    assert (row.n, row.s, row.q, row.m, row.e) == (10.0, "deep", 1.0, False, False)
    row = df.select(at("/payload/0/1").str.alias("s"), at("/payload/both'\"").num.alias("n"), at("/payload/a~1b/~0c/01").present.alias("m"), at("/payload/a~1b/~0c/2").present.alias("b")).first()
    assert (row.s, row.n, row.m, row.b) == ("member", 7.0, False, False)
    with pytest.raises(RuleError):
        pointer_tokens("payload/x")


def test_null_payloads_are_missing(spark):
    df = spark.createDataFrame([(None,), ("not json",), ('{"v": null}',)], "payload string").withColumn("p", F.try_parse_json("payload"))
    value = value_at("/payload/v", F.col("p"))
    assert [tuple(r) for r in df.select(compared(value, "ne", 1), compared(value, "eq", 1)).collect()] == [(True, False)] * 3


def test_integers_beyond_doubles_are_compared_exactly(spark):
    big = 1 << 53
    values = [big - 1, big, big + 1, big + 2, -big - 1, 10**20, 10**20 + 1, float(big), 1.5]
    df = spark.createDataFrame([(i, json.dumps({"v": v})) for i, v in enumerate(values)], "i int, payload string").withColumn("p", F.parse_json("payload"))
    value = value_at("/payload/v", F.col("p"))
    cases = [(op, o) for op in ("eq", "ne", "gt", "gte", "lt", "lte") for o in (big, big + 1, -big - 1, 10**20 + 1)]
    for r in df.select("i", *[compared(value, op, o).alias(f"c{k}") for k, (op, o) in enumerate(cases)]).collect():
        assert [r[f"c{k}"] for k in range(len(cases))] == [expected(op, values[r.i], o) for op, o in cases]
