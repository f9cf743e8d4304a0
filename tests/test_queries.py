"""Every query of the engine gives the rows of its SQL; those without SQL are checked here in other ways."""

from __future__ import annotations

import pytest
from comparing import rows_of, rows_of_sql

from proofmill.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names, rows = rows_of_sql(duck, SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == rows


def test_only_two_queries_have_no_sql():
    assert set(QUERIES) - set(SQL) == {"diagnostic_registry", "shard_by_bytes"}


def test_registry_codes_are_unique(spark, sf_dir):
    codes = [r.code for r in QUERIES["diagnostic_registry"](spark, sf_dir).collect()]
    assert len(codes) == len(set(codes)) == 31


def test_shards_by_bytes_are_those_of_a_plain_loop(spark, sf_dir):
    from pyspark.sql import functions as F

    from proofmill.operators.bundles import sharded_by_size

    rows = [("p", f"t{i % 2}", f"r{i:03d}", f"2024-01-{i % 28 + 1:02d}", (i * 37) % 90) for i in range(200)]
    df = spark.createDataFrame(rows, "package_id string, record_type string, record_id string, timestamp string, size long")
    found = {r.record_id: r.shard for r in sharded_by_size(df, rows=7, size=200).collect()}
    want = {}
    for kind in ("t0", "t1"):
        shard, n, total = 1, 0, 0
        for _, _, rid, _, size in sorted((r for r in rows if r[1] == kind), key=lambda r: (r[3], r[2])):
            if n and (n >= 7 or total + size > 200):
                shard, n, total = shard + 1, 0, 0
            want[rid], n, total = shard, n + 1, total + size
    assert found == want
    assert QUERIES["shard_by_bytes"](spark, sf_dir).agg(F.count("*")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_entry_point_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert {"provision_outcome", "provision_id"} <= set(df.columns) and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dangling_references_of_all_records(spark, sf_dir):
    found = QUERIES["dangling_refs_of_records"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(event_id as string) path", "event_type"), "path")
    assert {r.event_type for r in found.select("event_type").distinct().collect()} > {"purchase"}
    assert found.groupBy("path").count().where("count = 1").count() > 0


def test_orders_of_every_priority_are_walked(spark, sf_dir):
    """Every order whose status isn't O has a finding by its status; none is left out."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = QUERIES["schema_walk"](spark, sf_dir).where("path like '%/payload/status'").selectExpr("cast(substring_index(path, '/', 1) as long) o_orderkey")
    want = orders.where("o_orderstatus <> 'O'")
    assert sorted(r.o_orderkey for r in found.collect()) == sorted(r.o_orderkey for r in want.collect())
    assert want.select("o_orderpriority").distinct().count() == 5
