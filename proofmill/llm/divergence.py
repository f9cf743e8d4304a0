"""Source divergence: how far each source's terms lie from those of the other sources of its language, exactly.

A distance of two sources sums a price f(p, q) over all kept terms, where p and q depend on the term's counts alone. Most
counts are zero, so the sum is put together by inclusion and exclusion over the terms that occur (the supports):

    V f(0, 0)  +  over g's terms f(c, 0) - f(0, 0)  +  over h's terms f(0, d) - f(0, 0)  +  over terms of both f(c, d) - f(c, 0) - f(0, d) + f(0, 0)

The one-sided sums need a group's histogram of counts only; a join of the postings by term prices what both have; the
constant covers the rest.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, tidy

#: Probabilities are whole parts of this.
SCALE = 1_000_000_000
#: Different terms that a task counts before it hands the counts on.
HELD = 300_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("d", pa.int64())])


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a (lang, source), summed as far as a task's memory goes."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (c, d) in held.items():
            terms = list(c)
            columns = [[lang] * len(terms), [source] * len(terms), [t.decode() for t in terms], [c[t] for t in terms], [d[t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)
        held.clear()

    new = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            c, d = held[lang, source]
            own = Counter(_TERM.findall((text.as_py() or "").encode().lower()))
            before = len(c)
            c.update(own)
            d.update(own.keys())
            new += len(c) - before
            if new > HELD:
                yield from flush()
                new = 0
    yield from flush()


def _p(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (c + 1) / (n + v)); 1 where there are no terms at all."""
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (c + 1).cast("decimal(19,0)"), F.greatest(n + v, F.lit(1)).cast("decimal(20,0)"))
    return F.lit(1) + whole


def _price(p: Column, q: Column) -> Column:
    """floor((p - q) squared / q), as a decimal so that sums are exact."""
    return F.call_function("div", (p - q) * (p - q), q).cast("decimal(20,0)")


def divergence(documents: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: for each group (lang, source) every other source of the language, by
    the summed price of all kept terms; part `term`: the `top` terms that occur in the group and are likelier there than in
    the whole language, by their price against the language.

    Terms are runs of letters A-Z, a-z and of anything beyond ASCII, A-Z lower-cased; a language keeps those of at least
    `least_docs` of its documents (rows). Null text, lang and source are empty. A group without terms has pairs like any
    other. Ranks count from 1 by value, descending, then item. A language without kept terms has values 0. Repeated rows
    are documents of their own; other columns are ignored.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = bounded_batches(documents).select(*text)
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, c long, d long")
    counts = stored(counts.groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d")))

    # kept terms, and the sizes of languages and groups
    kept = counts.groupBy("lang", "term").agg(F.sum("c").alias("of_lang"), F.sum("d").alias("d")).where(F.col("d") >= least_docs)
    kept = stored(kept.select("lang", "term", "of_lang"))
    langs = stored(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_n")))
    postings = stored(counts.join(kept, ["lang", "term"]).select("lang", "term", "source", "c", "of_lang"))
    sums = postings.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("support"))
    groups = documents.select(*text[:2]).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.na.fill(0, ["n", "support", "v", "lang_n"]))

    # terms against their language
    of = postings.join(groups, ["lang", "source"]).withColumns({"p": _p(F.col("c"), F.col("n"), F.col("v")), "q": _p(F.col("of_lang"), F.col("lang_n"), F.col("v"))})
    terms = of.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _price(F.col("p"), F.col("q")).cast("long").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # ordered pairs of sources, with what one side alone decides
    g = groups.select("lang", "v", F.col("source").alias("g"), F.col("n").alias("n_g"), F.col("support").alias("s_g"))
    h = groups.select("lang", F.col("source").alias("h"), F.col("n").alias("n_h"), F.col("support").alias("s_h"))
    pairs = stored(g.join(h, "lang").where("g <> h"))
    price = lambda c, d: _price(_p(c, F.col("n_g"), F.col("v")), _p(d, F.col("n_h"), F.col("v")))
    zero = F.lit(0)
    histogram = stored(postings.groupBy("lang", "source", "c").agg(F.count("*").alias("terms")))
    total = [F.sum("value").alias("value")]
    ones = []
    for side in ("g", "h"):
        own = histogram.withColumnRenamed("source", side).join(pairs, ["lang", side])
        value = (price(F.col("c"), zero) if side == "g" else price(zero, F.col("c"))) - price(zero, zero)
        ones.append(own.select("lang", "g", "h", (value * F.col("terms").cast("decimal(18,0)")).cast("decimal(38,0)").alias("value")).groupBy("lang", "g", "h").agg(*total))

    # what both have: postings of a term, joined; equal counts of two groups are priced once
    a = postings.select("lang", "term", F.col("source").alias("g"), F.col("c").alias("x"))
    b = postings.select("lang", "term", F.col("source").alias("h"), F.col("c").alias("y"))
    both = a.join(b, ["lang", "term"]).where("g < h").groupBy("lang", "g", "h", "x", "y").agg(F.count("*").alias("terms"))
    ways = F.explode(F.array(F.struct("g", "h", "x", "y"), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("y").alias("x"), F.col("x").alias("y"))))
    both = both.select("lang", "terms", ways.alias("w")).select("lang", "terms", "w.*").join(pairs, ["lang", "g", "h"])
    value = price(F.col("x"), F.col("y")) - price(F.col("x"), zero) - price(zero, F.col("y")) + price(zero, zero)
    both = both.select("lang", "g", "h", (value * F.col("terms").cast("decimal(18,0)")).cast("decimal(38,0)").alias("value")).groupBy("lang", "g", "h").agg(*total)

    nothing = pairs.select("lang", "g", "h", (price(zero, zero) * F.col("v").cast("decimal(18,0)")).cast("decimal(38,0)").alias("value"))
    whole = nothing.unionByName(ones[0]).unionByName(ones[1]).unionByName(both).groupBy("lang", "g", "h").agg(F.sum("value").cast("long").alias("value"))
    whole = whole.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), "value").withColumn("rank", F.row_number().over(best))
    return whole.unionByName(terms)
