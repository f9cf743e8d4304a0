"""Algebra of bundles: merge, redact, sort and shard, chain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from .diagnostics import diagnostic

SHARD_RECORDS, SHARD_BYTES = 100_000, 256 * 1024 * 1024
STRATEGIES = ("keep_latest", "keep_all", "fail")


class MergeConflict(ValueError):
    """Two inputs have the same key under the strategy `fail`."""


def merged(rows: DataFrame, key: list[str], at: str, order: list[str], strategy: str = "keep_latest") -> DataFrame:
    """One row per key under keep_latest (the greatest `at`; of ties the last in `order`), all rows under keep_all, an
    error under `fail` if any key comes twice. Nulls in `at` are the earliest."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "keep_all":
        return rows
    if strategy == "fail":
        if rows.groupBy(*key).count().where("count > 1").take(1):
            raise MergeConflict(f"{key} isn't unique")
        return rows
    others = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*others), F.struct(F.coalesce(at, F.lit("")), *order))
    return rows.groupBy(*key).agg(best.alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in others]).select(rows.columns)


def conflicts(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): how often a key comes again after the first time."""
    return rows.groupBy(*key).agg((F.count("*") - 1).alias("n")).where("n > 0")


def conflict_findings(rows: DataFrame, key: str, package: str) -> DataFrame:
    """A finding for each time that a key comes again among the merged inputs; `package` names what they are merged into."""
    again = conflicts(rows, [key]).select(F.lit(package).alias("package_id"), key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return diagnostic(again, "060", F.concat(F.lit(f"{key} comes from several inputs: "), F.coalesce(F.col(key).cast("string"), F.lit("none"))), F.col(key))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in others]).select(rows.columns)


def commitment(payload: Column) -> Column:
    """SHA-256 of a payload's canonical JSON. Where no number may print with an exponent Spark's own printing of a
    parsed value is canonical already, and Python isn't needed: see `plain`."""
    return F.sha2(canonical_json(payload), 256)


def plain_commitment(payload: Column) -> Column:
    """As commitment, for payloads whose numbers are integers of up to 15 digits: DataFrame functions only."""
    return F.sha2(F.to_json(F.parse_json(payload)), 256)


def redacted(records: DataFrame, types: list[str] = (), levels: list[str] = (), method: str = "sha256-commitment", commit=commitment) -> DataFrame:
    """Records of these types or levels of confidentiality with a commitment in place of their payload; with neither, none.
    Only the chosen records go through `commit`; the others are read beside them and stay as they are."""
    if not types and not levels:
        return records
    chosen = F.coalesce(F.col("record_type").isin(*types), F.lit(False)) | F.coalesce(F.col("confidentiality").isin(*levels), F.lit(False))
    h = commit(F.col("payload"))
    changed = {"payload": F.concat(F.lit('{"_redacted":true,"_commitment":"sha256:'), h, F.lit('"}')), "confidentiality": F.lit("hash-committed"), "redaction_method": F.concat(F.lit(f"{method}:"), h)}
    hidden = records.where(chosen).select(*[changed[c].alias(c) if c in changed else F.col(c) for c in records.columns])
    return records.where(~chosen).unionByName(hidden)


def redaction_holds(method: Column, payload: Column, commit=commitment) -> Column:
    """Whether a redacted record's commitment is that of the given payload; false without one."""
    return F.coalesce(F.contains(method, F.lit(":")) & (F.element_at(F.split(method, ":"), -1) == commit(payload)), F.lit(False))


def sharded(records: DataFrame, rows: int = SHARD_RECORDS) -> DataFrame:
    """records with `position` (by timestamp text and record_id within package and type) and `shard`, by number of rows.

    Records are numbered within the hour that their timestamp's text begins with, and counts of the hours before are added, so
    a large type isn't sorted in one task. Null timestamps come first, as an hour of their own."""
    kind, hour = ["package_id", "record_type"], F.substring(F.col("timestamp").cast("string"), 1, 13)
    within = Window.partitionBy(*kind, "__hour").orderBy("timestamp", "record_id")
    before = Window.partitionBy(*kind).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    timed = records.withColumn("__hour", hour)
    counts = timed.groupBy(*kind, "__hour").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    left, right = timed.withColumn("__n", F.row_number().over(within)).alias("r"), counts.alias("c")
    same = F.lit(True)
    for c in (*kind, "__hour"):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    placed = left.join(right, same).select("r.*", (F.col("__n") + F.col("__before")).cast("long").alias("position")).drop("__n", "__hour")
    return placed.withColumn("shard", (F.floor((F.col("position") - 1) / rows) + 1).cast("int"))


def sharded_by_size(records: DataFrame, rows: int = SHARD_RECORDS, size: int = SHARD_BYTES) -> DataFrame:
    """(package_id, record_type, record_id, position, shard): a new shard begins at `rows` records, or where a record would
    take a shard that isn't empty beyond `size` bytes. Records have a `size` column. Going from record to record, this is
    sequential within a type; only ids and sizes are sent to Python, in order, and nothing but the running sums is held."""

    def split(batches):
        last, n, total, shard, position = None, 0, 0, 1, 0
        for df in batches:
            shards, positions = [], []
            for package, kind, s in zip(df["package_id"], df["record_type"], df["size"], strict=True):
                if (package, kind) != last:
                    last, n, total, shard, position = (package, kind), 0, 0, 1, 0
                if n and (n >= rows or total + s > size):
                    n, total, shard = 0, 0, shard + 1
                n, total, position = n + 1, total + s, position + 1
                shards.append(shard)
                positions.append(position)
            yield pd.DataFrame({"package_id": df["package_id"], "record_type": df["record_type"], "record_id": df["record_id"], "position": positions, "shard": shards})

    ordered = records.select("package_id", "record_type", "record_id", "timestamp", "size").repartition("package_id", "record_type").sortWithinPartitions("package_id", "record_type", "timestamp", "record_id")
    kinds = dict(records.dtypes)
    return ordered.mapInPandas(split, f"package_id {kinds['package_id']}, record_type {kinds['record_type']}, record_id {kinds['record_id']}, position long, shard int")


def record_files(shards: DataFrame) -> DataFrame:
    """The index of record files: (package_id, record_type, path, count)."""
    per = Window.partitionBy("package_id", "record_type")
    df = shards.groupBy("package_id", "record_type", "shard").agg(F.count("*").alias("count")).withColumn("many", F.max("shard").over(per))
    path = F.when(F.col("many") == 1, F.format_string("records/%s.jsonl", "record_type")).otherwise(F.format_string("records/%s/%s.%04d.jsonl", "record_type", "record_type", "shard"))
    return df.select("package_id", "record_type", path.alias("path"), "count")


def chained(packages: DataFrame, digests: DataFrame) -> DataFrame:
    """New packages that refer to their predecessor (prior_package_id) by its digest."""
    prior = digests.select(F.col("package_id").alias("prior_package_id"), F.col("digest").alias("prior_package_ref"))
    return packages.drop("prior_package_ref").join(prior, "prior_package_id", "left")
