"""Merkle trees in rounds, against a plain fold."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from proofmill.operators.merkle import merkle_proofs, merkle_roots, unproven


def plain_root(files: dict[str, str]) -> str:
    level = [hashlib.sha256(f"{p}\0{h}".encode()).digest() for p, h in sorted(files.items())]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def named(sizes, rnd=random.Random(3)):
    return {f"p{k}": {f"{rnd.choice(['artifacts', 'records'])}/{rnd.randrange(10**9)}-{i}": hashlib.sha256(b"%d" % i).hexdigest() for i in range(n)} for k, n in enumerate(sizes)}


@pytest.mark.parametrize("run", [2, 4, 1024])
def test_roots_and_proofs(spark, run):
    packages = named([1, 2, 3, 5, 7, 8] if run == 2 else [1, 2, 5, 17, 31, 33, 64])
    df = spark.createDataFrame([(k, p, h) for k, files in packages.items() for p, h in files.items()], "package_id string, path string, sha256 string")
    roots = merkle_roots(df, run)
    assert {r.package_id: (r.n_leaves, r.root) for r in roots.collect()} == {k: (len(f), plain_root(f)) for k, f in packages.items()}
    proofs = merkle_proofs(df, run).join(df, ["package_id", "path"])
    assert proofs.count() == df.count() and unproven(proofs, roots).count() == 0
    other = proofs.withColumn("sha256", F.when(F.col("i") == 0, F.sha2(F.lit(b"other"), 256)).otherwise(F.col("sha256")))
    assert {r.package_id for r in unproven(other, roots).collect()} == set(packages)
    assert unproven(proofs.limit(1), roots.limit(0)).count() == 1


def test_a_package_of_a_hundred_thousand_files(spark):
    files = {f"artifacts/{i:07d}": hashlib.sha256(b"%d" % i).hexdigest() for i in range(100_000)}
    df = spark.range(100_000).select(F.lit("p").alias("package_id"), F.format_string("artifacts/%07d", "id").alias("path"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sha256"))
    assert [(r.n_leaves, r.root) for r in merkle_roots(df).collect()] == [(100_000, plain_root(files))]
