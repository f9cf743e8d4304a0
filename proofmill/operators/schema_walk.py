"""JSON Schemas held against values by walking: a table of schema states, and the values' own paths.

Schemas are compiled to an automaton. A state is what one (sub)schema asks of a value; an object's member or an array's
element leads on to the states of the subschemas for it. Documents are rows (document, path, state, value): a level of the
walk joins them to the table of states; what a state says of its value goes on as it is, and what the value holds is open
to the next level. Levels are narrow steps of one plan, which doesn't grow with the number of schemas or their keywords. A
schema may contain itself; then the depth of the documents, counted once, says how many levels there are.

Of oneOf, anyOf, contains and items of plain values only the keyword is reported. Each branch, or each element, is
walked under a condition that the row carries; how many of them failed is counted by condition, from the innermost out.
Where there are conditions, documents are dealt out by a hash of theirs before the walk, so that one is walked and counted
in one place: there is one walk, and no shuffle behind it. A oneOf or anyOf whose branches lead nowhere asks nothing but
of the value itself, so it is settled where the value is read, without rows of its own.

Rows that say nothing and lead nowhere end before a level's rows are made.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Value, same, value_of

#: Elements with these keywords are looked into one by one; of others an array has one violation, `items`.
DEEP = {"properties", "required", "additionalProperties", "items", "$ref", "allOf"}
_READINGS = ("present", "num", "whole", "str", "nested")
_CONDITION = "struct<id:int,word:string,branches:array<array<int>>>"
#: branch: a position among branches or elements; at: the pointer of the value that the condition is about.
_TRAIL = "array<struct<id:int,at:string,branch:int>>"
_TYPES = {"string", "boolean", "null", "array", "object", "number", "integer"}
#: What a state asks of the value itself; names: the members that it has something to say of.
_OWN = {
    "never": "boolean", "types": "array<string>", "enum": "array<string>", "const": "string", "pattern": "string", "minimum": "double", "maximum": "double",
    "min_items": "int", "required": "array<string>", "closed": "boolean", "names": "array<string>",
}
#: What says where a state leads to: needed for no more than the rows that lead on.
_NEXT = ["required", "members", "rest", "elements", "each", "some", "each_id", "some_id", "choices"]
_BRANCHES = f"array<array<struct<{','.join(f'{n}:{t}' for n, t in _OWN.items())}>>>"
_STATE = (
    f"state int, {', '.join(f'{n} {t}' for n, t in _OWN.items())}, members map<string,array<int>>, rest array<int>, elements array<int>, each array<int>, some array<int>, "
    f"each_id int, some_id int, choices array<{_CONDITION}>, settled array<struct<word:string,branches:{_BRANCHES}>>"
)


@dataclass
class Automaton:
    """rows: as _STATE; roots: the first states of each schema; levels: how long the longest walk is, None if there is none;
    inner: how many conditions can lie within each other."""

    rows: list[dict] = field(default_factory=list)
    roots: dict[str, list[int]] = field(default_factory=dict)
    levels: int | None = 0
    inner: int = 0


def _referred(root: dict, ref: str) -> Any:
    if not ref.startswith("#"):
        raise ValueError(f"{ref!r} isn't within the schema")
    found: Any = root
    for step in ref[1:].split("/")[1:]:
        found = found[step.replace("~1", "/").replace("~0", "~")]
    return found


def compiled(schemas: dict[str, Any]) -> Automaton:
    """The automaton of schemas by name."""
    out = Automaton()
    known: dict[tuple[str, int], list[int]] = {}
    conditions = iter(range(1 << 30))
    keep = []  # subschemas are told apart by identity, so none may go meanwhile

    def states(name: str, root: Any, schema: Any) -> list[int]:
        """The states that a value of this schema is in: its own, and those of what it refers to or has all of."""
        if schema is True or schema == {}:
            return []
        if (found := known.get((name, id(schema)))) is not None:
            return found
        keep.append(schema)
        found = known[name, id(schema)] = []
        row: dict[str, Any] = {"state": len(out.rows), "never": schema is False, "closed": False, "members": {}, "choices": []}
        out.rows.append(row)
        found.append(row["state"])
        if schema is False:
            return found
        sub = lambda s: states(name, root, s)
        if "type" in schema:
            row["types"] = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if "enum" in schema:
            row["enum"] = [json.dumps(x) for x in schema["enum"]]
        if "const" in schema:
            row["const"] = json.dumps(schema["const"])
        row |= {"pattern": schema.get("pattern"), "min_items": schema.get("minItems"), "required": list(schema.get("required", ()))}
        row |= {k: float(schema[k]) for k in ("minimum", "maximum") if k in schema}
        row["members"] = {k: sub(s) for k, s in (schema.get("properties") or {}).items()}
        rest = schema.get("additionalProperties", True)
        row["closed"], row["rest"] = rest is False, sub(rest) if rest is not False else []
        item = schema.get("items", True)
        plain = item is not True and not (isinstance(item, dict) and DEEP & set(item))
        row |= {"elements": [] if plain else sub(item), "each": sub(item) if plain else [], "some": sub(schema["contains"]) if "contains" in schema else None}
        row |= {"each_id": next(conditions), "some_id": next(conditions)}
        row["choices"] = [(next(conditions), word, [sub(s) for s in schema[word]]) for word in ("oneOf", "anyOf") if word in schema]
        for s in [*([_referred(root, schema["$ref"])] if "$ref" in schema else []), *schema.get("allOf", ())]:
            found += [x for x in sub(s) if x not in found]
        return found

    for name, schema in schemas.items():
        out.roots[name] = states(name, schema, schema)
    _closed(known)
    _measured(out)
    return out


def _closed(known: dict[tuple[str, int], list[int]]) -> None:
    """References within references: a state brings those of what it refers to, also where that was still being compiled."""
    own = {found[0]: found for found in known.values() if found}
    moved = True
    while moved:
        moved = False
        for found in known.values():
            for x in list(found):
                for y in own.get(x, ()):
                    if y not in found:
                        found.append(y)
                        moved = True


def _measured(out: Automaton) -> None:
    """levels and inner: the longest walk, and the most conditions on one."""
    to: list[set[tuple[int, int]]] = []  # of each state: (next state, 1 if under a condition)
    for r in out.rows:
        plain = [*r["members"].values(), r.get("rest") or [], r.get("elements") or []]
        under = [r.get("each") or [], r.get("some") or [], *(b for _, _, branches in r["choices"] for b in branches)]
        to.append({(x, 0) for xs in plain for x in xs} | {(x, 1) for xs in under for x in xs})
    # a condition within itself can't be counted from the innermost out
    seen: dict[int, set[int]] = {}

    def reached(first: int) -> set[int]:
        if first not in seen:
            seen[first], todo = {first}, [first]
            while todo:
                for x, _ in to[todo.pop()]:
                    if x not in seen[first]:
                        seen[first].add(x)
                        todo.append(x)
        return seen[first]

    for start, steps in enumerate(to):
        if any(u and start in reached(x) for x, u in steps):
            raise ValueError("a schema contains itself within oneOf, anyOf, contains or items of plain values")
    from_roots = set().union(*(reached(x) for xs in out.roots.values() for x in xs))
    cyclic = any(x in reached(y) for x in from_roots for y, _ in to[x])

    def longest(weigh: Callable[[int], int]) -> int:
        """The longest walk from a root by the weights of its steps; no cycle of states may have any."""
        best, moved = dict.fromkeys(from_roots, 0), True
        while moved:
            moved = False
            for x in from_roots:
                if (most := max((best[y] + weigh(u) for y, u in to[x]), default=0)) > best[x]:
                    best[x], moved = most, True
        return max((best[x] for xs in out.roots.values() for x in xs), default=0)

    out.levels, out.inner = None if cyclic else longest(lambda _: 1), longest(lambda u: u)


def _leading(row: dict) -> list[list[int]]:
    """The states that a row leads on to under the conditions that it is under itself."""
    return [xs for xs in (*row["members"].values(), row.get("rest"), row.get("elements")) if xs]


def _conditional(row: dict) -> list[list[int]]:
    """The states that a row leads to under a condition of its own."""
    return [xs for xs in (row.get("each"), row.get("some"), *(b for _, _, branches in row["choices"] for b in branches)) if xs]


def settled(automaton: Automaton) -> Automaton:
    """The automaton with the oneOf and anyOf that are about the value itself taken out of `choices`, as `settled`.

    A value that comes into one state by two ways has two rows there, whose equal conditions are counted as one. That can't
    be where no more than one of the states that a value is in leads on; schemas for which this isn't so stay as they are."""

    def at_end(x: int) -> bool:
        r = automaton.rows[x]
        return not (_leading(r) or _conditional(r) or r.get("some") is not None or r["choices"])

    rows = [dict(r) for r in automaton.rows]
    for roots in automaton.roots.values():
        seen, todo, single = set(), [roots], True
        while todo:
            together = todo.pop()
            single = single and sum(bool(_leading(rows[x])) for x in together) < 2
            for x in set(together) - seen:
                seen.add(x)
                todo += [*_leading(rows[x]), *_conditional(rows[x])]
        for x in seen if single else ():
            ends = [c for c in rows[x]["choices"] if all(at_end(y) for b in c[2] for y in b)]
            rows[x]["settled"] = [(word, [[_own(automaton.rows[y]) for y in b] for b in branches]) for _, word, branches in ends]
            rows[x]["choices"] = [c for c in rows[x]["choices"] if c not in ends]
    # what asks nothing, as a state that only refers to another, needs no rows
    asks = lambda r: r["never"] or r["closed"] or r.get("required") or any(r.get(k) is not None for k in ("types", "enum", "const", "pattern", "minimum", "maximum", "min_items"))
    idle = {x for x, r in enumerate(rows) if not asks(r) and at_end(x)}
    kept = lambda xs: xs and [x for x in xs if x not in idle]
    for r in rows:
        r["members"] = {k: kept(xs) for k, xs in r["members"].items()}
        r |= {k: kept(r[k]) for k in ("rest", "elements", "each", "some") if k in r}
        r["choices"] = [(i, word, [kept(b) for b in branches]) for i, word, branches in r["choices"]]
    out = Automaton(rows, {name: kept(xs) for name, xs in automaton.roots.items()})
    _measured(out)
    return out


def _own(row: dict) -> tuple:
    """What a row asks of the value itself, as _OWN."""
    known = {**row, "names": list(row["members"]), "types": row.get("types") if _TYPES.issuperset(row.get("types") or ()) else None}
    return tuple(known.get(n) for n in _OWN)


def state_table(spark: SparkSession, automaton: Automaton) -> DataFrame:
    """The states as rows, as many as the schemas on the driver have subschemas."""
    names = [f.name for f in spark.createDataFrame([], _STATE).schema]
    df = spark.createDataFrame([tuple({**r, **dict(zip(_OWN, _own(r), strict=True))}.get(n) for n in names) for r in automaton.rows], _STATE)
    read = lambda v: F.struct(*[getattr(v, n).alias(n) for n in _READINGS], F.is_variant_null(v.raw).alias("null"))

    def asked(s: Callable[[str], Column]) -> dict[str, Column]:
        """Constants as readings, and those among them that are strings."""
        enum, const = F.transform(s("enum"), lambda t: read(value_of(F.parse_json(t)))), F.when(s("const").isNotNull(), F.array(read(value_of(F.parse_json(s("const"))))))
        texts = {f"{n}_texts": F.array_compact(F.transform(xs, lambda x: x["str"])) for n, xs in (("enum", enum), ("const", const))}
        return {"enum": enum, "const": const, **texts}

    def branch(x: Column) -> Column:
        others = [F.coalesce(x["never"] | x["closed"], F.lit(False)), *(x[n].isNotNull() for n in ("types", "enum", "const", "pattern", "min_items")), F.coalesce(F.size(x["required"]), F.lit(0)) > 0]
        of = {n: x[n] for n in _OWN} | asked(lambda n: x[n]) | {"others": reduce(or_, others)}
        return F.struct(*[c.alias(n) for n, c in of.items()])

    compares = F.exists("settled", lambda c: F.exists(F.flatten(c["branches"]), lambda x: x["enum"].isNotNull() | x["const"].isNotNull()))
    parsed = F.transform("settled", lambda c: F.struct(c["word"].alias("word"), F.transform(c["branches"], lambda b: F.transform(b, branch)).alias("branches")))
    has = lambda *xs: F.greatest(*[F.coalesce(F.size(x), F.lit(0)) for x in xs]) > 0
    df = df.withColumns({
        **asked(F.col), "settled": parsed, "compares": F.col("enum").isNotNull() | F.col("const").isNotNull() | F.coalesce(compares, F.lit(False)),
        "of_object": (F.cardinality("members") > 0) | has("rest", "required"), "of_array": has("elements", "each") | F.col("some").isNotNull(), "of_any": F.size("choices") > 0,
    })
    return df.select(*[c for c in df.columns if c not in _NEXT or c == "required"], F.struct(*_NEXT).alias("next"))


def _brackets(text: Column) -> Column:
    """The brackets of a JSON text, empty ones in a row as one: as deep as the text, and the same for many texts."""
    return F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++', ""), r"(?:\{\}|\[\])++", "{}")


def _depth(brackets: Column) -> Column:
    """How deeply objects and arrays lie within each other in a JSON text, by its brackets."""
    change = lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
    step = lambda a, c: F.struct((a["now"] + change(c)).alias("now"), F.greatest(a["most"], a["now"] + change(c)).alias("most"))
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")


def _read(rows: DataFrame) -> DataFrame:
    """Rows with the readings of their value, made once each: __members, __elements, __kind, __value."""
    rows = rows.withColumn("__members", F.try_variant_get("v", "$", "map<string,variant>"))
    rows = rows.withColumn("__elements", F.when(F.col("__members").isNull(), F.try_variant_get("v", "$", "array<variant>")))
    plain = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
    rows = rows.withColumn("__kind", F.when(F.col("__members").isNotNull(), "OBJECT").when(F.col("__elements").isNotNull(), "ARRAY").otherwise(plain))
    v = value_of(F.col("v"), F.col("__kind"))
    readings = {n: getattr(v, n) for n in _READINGS}
    readings["nested"] = F.when(F.col("s.compares"), v.nested)
    leads = (F.col("s.of_object") & (F.col("__kind") == "OBJECT")) | (F.col("s.of_array") & (F.col("__kind") == "ARRAY")) | F.col("s.of_any")
    rows = rows.withColumns({"__value": F.struct(*[c.alias(n) for n, c in readings.items()]), "__leads": F.coalesce(leads, F.lit(False))})
    rows = rows.withColumns(_words())
    # of rows that lead nowhere nothing but what they say is carried further
    return rows.withColumns({"s": F.when(F.col("__leads"), F.col("s.next")), **{c: F.when(F.col("__leads"), F.col(c)) for c in ("__members", "__elements")}}).drop("__value")


_SAID = "struct<word:string,id:int,total:int>"
_ROW = f"array<struct<at:string,state:int,v:variant,trail:{_TRAIL},said:{_SAID}>>"


def _saying(word: Column, at: Column, i: Column | None = None, total: Column | None = None) -> Column:
    """A row that isn't open any more: a violation or, with an id, a condition on a value and how many branches it has."""
    none = F.lit(None).cast("int")
    said = F.struct(word.alias("word"), (none if i is None else i).alias("id"), (none if total is None else total.cast("int")).alias("total"))
    return F.struct(at.alias("at"), none.alias("state"), F.lit(None).cast("variant").alias("v"), F.col("trail").alias("trail"), said.alias("said"))


def _simple(s: Callable[[str], Column]) -> list[tuple[str, Column]]:
    """(keyword, whether the value violates it), of what a state asks of the value itself; without lambdas."""
    v, kind, members = Value(*(F.col(f"__value.{n}") for n in _READINGS)), F.col("__kind"), F.col("__members")
    number = _is_number(kind)
    name = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind == "ARRAY", "array").when(kind == "OBJECT", "object").when(number, "number").otherwise("")
    is_of = F.array_contains(s("types"), name) | (F.array_contains(s("types"), "integer") & number & F.coalesce(v.num == F.floor(v.num), F.lit(False)))
    return [
        ("false", s("never")), ("type", ~is_of), *((word, v.str.isNotNull() & ~F.array_contains(s(f"{word}_texts"), v.str)) for word in ("enum", "const")),
        ("pattern", v.str.isNotNull() & ~F.rlike(v.str, s("pattern"))), ("minimum", (v.num < s("minimum")) & (kind != "BOOLEAN")), ("maximum", (v.num > s("maximum")) & (kind != "BOOLEAN")),
        ("minItems", F.size("__elements") < s("min_items")), ("additionalProperties", s("closed") & (F.size(F.array_except(F.map_keys(members), s("names"))) > 0)),
    ]


def _compared(s: Callable[[str], Column]) -> list[tuple[str, Column]]:
    """As _simple, of constants against values that aren't strings: with lambdas."""
    v, kind = Value(*(F.col(f"__value.{n}") for n in _READINGS)), F.col("__kind")
    among = lambda xs: F.exists(xs, lambda x: F.when(x["null"], kind == "VOID").otherwise(same(v, Value(*(x[n] for n in _READINGS)))))
    return [(word, F.when(v.str.isNull() & s(word).isNotNull(), ~among(s(word)))) for word in ("enum", "const")]


def _absent(s: Callable[[str], Column]) -> Column:
    return F.filter(s("required"), lambda r: (F.col("__kind") == "OBJECT") & ~F.coalesce(F.map_contains_key("__members", r), F.lit(False)))


def _words() -> dict[str, Column]:
    """The keywords that a row's value violates itself, __words with commas between and __more, whose lambdas are only met by
    rows that need them. They keep both out of the method that the join is compiled to, else that would be too long for the
    JVM to compile any further."""
    s = lambda name: F.col(f"s.{name}")

    def fails(asked: Column) -> Column:
        of = lambda name: asked[name]
        bad = {word: F.coalesce(one, F.lit(False)) for word, one in (*_simple(of), *((f"{w} of no string", one) for w, one in _compared(of)), ("required", F.size(_absent(of)) > 0))}
        bounds = bad.pop("minimum") | bad.pop("maximum")
        return bounds | (of("others") & reduce(or_, bad.values()))

    def unmet(c: Column) -> Column:
        passed = F.size(F.filter(c["branches"], lambda b: ~F.exists(b, fails)))
        return F.when(c["word"] == "oneOf", passed != 1).otherwise(passed < 1)

    compared = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(word)) for word, bad in _compared(s)]))
    choices = F.transform(F.filter("s.settled", unmet), lambda c: c["word"])
    return {
        "__words": F.concat_ws(",", *[F.when(F.coalesce(bad, F.lit(False)), word) for word, bad in _simple(s)]),
        "__more": F.when(F.size("s.settled") > 0, F.concat(compared, choices)).when(s("compares") & F.col("__value.str").isNull(), compared),
    }


def _violations() -> list[Column]:
    """Arrays of rows: what a row's state s says of its value."""
    at = F.col("at")
    words = [F.when(F.col("__words") != "", F.split("__words", ",")), F.col("__more")]
    return [*(F.transform(x, lambda w: _saying(w, at)) for x in words), F.transform(_absent(lambda name: F.col(f"s.{name}")), lambda r: _saying(F.lit("required"), F.concat(at, F.lit("/"), r)))]


def _marks() -> list[Column]:
    """Arrays of rows: the conditions that a row's state has on its value."""
    elements, at = F.size("__elements"), F.col("at")
    of_arrays = [F.when((elements >= 0) & wanted, _saying(F.lit(word), at, F.col(f"s.{i}"), elements)) for i, word, wanted in (("each_id", "items", F.size("s.each") > 0), ("some_id", "contains", F.col("s.some").isNotNull()))]
    return [F.array_compact(F.array(*of_arrays)), F.transform("s.choices", lambda c: _saying(c["word"], at, c["id"], F.size(c["branches"])))]


def _opened() -> list[Column]:
    """Arrays of rows: what a row's state leads to."""

    def rows(states: Column, at: Column, v: Column, trail: Column) -> Column:
        return F.transform(states, lambda t: F.struct(at.alias("at"), t.alias("state"), v.alias("v"), trail.alias("trail"), F.lit(None).cast(_SAID).alias("said")))

    def under(i: Column, branch: Column) -> Column:
        return F.concat("trail", F.array(F.struct(i.alias("id"), F.col("at").alias("at"), branch.cast("int").alias("branch"))))

    empty = F.array().cast("array<int>")
    below = lambda step: F.concat(F.col("at"), F.lit("/"), step)
    elements = F.transform("__elements", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    is_told = (F.cardinality("s.members") > 0) | (F.size("s.rest") > 0)
    of_object = F.when(is_told, F.flatten(F.transform(F.map_entries("__members"), lambda m: rows(F.coalesce(F.try_element_at("s.members", m["key"]), "s.rest", empty), below(m["key"]), m["value"], F.col("trail")))))
    in_array = lambda e: F.concat(
        rows(F.coalesce("s.elements", empty), below(e["i"].cast("string")), e["x"], F.col("trail")), rows(F.coalesce("s.each", empty), below(e["i"].cast("string")), e["x"], under(F.col("s.each_id"), e["i"])),
        rows(F.coalesce("s.some", empty), below(e["i"].cast("string")), e["x"], under(F.col("s.some_id"), e["i"])),
    )
    of_array = F.when((F.size("s.elements") > 0) | (F.size("s.each") > 0) | (F.size("s.some") > 0), F.flatten(F.transform(elements, in_array)))
    branches = F.flatten(F.transform("s.choices", lambda c: F.flatten(F.transform(c["branches"], lambda b, i: rows(b, F.col("at"), F.col("v"), under(c["id"], i))))))
    return [of_object, of_array, branches]


def violations(values: DataFrame, schemas: dict[str, Any]) -> DataFrame:
    """(columns of values but text and schema, word, at): each violated keyword, and the JSON pointer of where.

    values has text, the JSON of a value, and schema, the name of the schema it is held against. Texts that aren't JSON
    and names without schema have no violations. Other columns must be scalars, and not named doc, place, word or at.
    """
    whole, spark = compiled(schemas), values.sparkSession
    automaton = settled(whole)
    keep = [c for c in values.columns if c not in ("text", "schema")]
    levels = automaton.levels
    if levels is None:
        # each step goes into the document, but for those to a branch, which are conditions
        brackets = values.select(_brackets(F.col("text")).alias("b")).distinct()
        levels = (brackets.agg(F.max(_depth(F.col("b"))).alias("d")).first().d or 0) + automaton.inner
    roots = spark.createDataFrame([(name, x) for name, xs in automaton.roots.items() for x in xs], "schema string, state int")
    table = state_table(spark, automaton)
    table = F.broadcast(table.select("state", F.struct(*[c for c in table.columns if c != "state"]).alias("s")))
    values = values.withColumn("place", F.xxhash64(*keep, "text", "schema"))
    if whole.inner:
        values = values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "place")
    rows = values.withColumns({"v": F.try_parse_json("text"), "doc": F.monotonically_increasing_id()}).where("v is not null").join(F.broadcast(roots), "schema")
    rows = rows.select(*keep, "place", "doc", F.lit("").alias("at"), "state", "v", F.array().cast(_TRAIL).alias("trail"), F.lit(None).cast(_SAID).alias("said"))
    own = F.array(F.struct("at", "state", "v", "trail", "said")).cast(_ROW)
    none = F.array().cast(_ROW)
    for level in range(levels + 1):
        parts = [*_violations(), *(_marks() if automaton.inner else []), *(_opened() if level < levels else [])]
        stepped = F.when(F.col("said").isNotNull(), own).when(F.col("__leads") | (F.col("__words") != "") | F.coalesce(F.size("__more") > 0, F.lit(False)), F.flatten(F.array(*[F.coalesce(x.cast(_ROW), none) for x in parts]))).otherwise(none)
        rows = _read(rows.join(table, "state", "left")).select(*keep, "place", "doc", F.inline(stepped))
    rows = rows.select(*keep, "place", "doc", "trail", "at", "said.word", "said.id", "said.total")
    if not automaton.inner:
        return rows.select(*keep, "word", "at")
    # the innermost first: violations under a condition count a branch as failed, and may make a violation of what is above
    rows = rows.withColumn("times", F.lit(1).cast("long"))
    for depth in range(automaton.inner, 0, -1):
        last, under = F.element_at("trail", -1), F.col("id").isNull() & (F.size("trail") == depth)
        told = rows.select(
            *keep, "place", "doc", F.when(under, F.slice("trail", 1, depth - 1)).otherwise(F.col("trail")).alias("trail"), F.when(under, last["id"]).otherwise(F.col("id")).alias("id"),
            F.when(under, last["at"]).otherwise(F.col("at")).alias("at"), F.when(F.col("id").isNull() & ~under, F.col("word")).alias("own"), F.when(F.col("id").isNotNull(), F.col("word")).alias("word"), "total",
            F.when(under, last["branch"]).alias("branch"), "times",
        )
        counted = told.groupBy(*keep, "place", "doc", "trail", "id", "at", "own").agg(F.max("word").alias("word"), F.max("total").alias("total"), F.count_distinct("branch").alias("failed"), F.sum("times").alias("times"))
        passed, here = F.col("total") - F.col("failed"), F.col("id").isNotNull() & (F.size("trail") == depth - 1)
        bad = F.when(F.col("word") == "oneOf", passed != 1).when(F.col("word") == "items", F.col("failed") > 0).otherwise(passed <= 0)
        rows = counted.where(~here | bad).select(
            *keep, "place", "doc", "trail", "at", F.coalesce("own", "word").alias("word"), F.when(~here, F.col("id")).alias("id"), F.when(~here, F.col("total")).alias("total"), F.when(here, F.lit(1).cast("long")).otherwise(F.col("times")).alias("times"),
        )
    return rows.select(*keep, "word", "at", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*keep, "word", "at")
