"""Content hashes, their index, Merkle roots, digests and signature headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diagnostics import diagnostic
from .merkle import merkle_roots

ALGORITHMS = ("RS256", "ES256")


def hash_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Findings from an index (package_id, path, sha256) held against actual hashes."""
    e, a = expected.select("package_id", "path", F.col("sha256").alias("want")), actual.select("package_id", "path", F.col("sha256").alias("have"))
    both = e.join(a, ["package_id", "path"], "full").where(~F.col("want").eqNullSafe(F.col("have")))
    absent = both.where("want is null or have is null")
    return diagnostic(absent, "014", F.when(F.col("have").isNull(), "listed, but not found").otherwise("found, but not listed"), F.col("path")).unionByName(
        diagnostic(both.where("want is not null and have is not null"), "010", F.lit("hash mismatch"), F.col("path"))
    )


def root_differences(roots: DataFrame, hashes: DataFrame) -> DataFrame:
    """Findings from Merkle files (package_id, root) whose root isn't that of the hashes (package_id, path, sha256), or can't be read."""
    both = roots.join(merkle_roots(hashes).select("package_id", F.col("root").alias("have")), "package_id", "left").where("root is null or have is null or root <> have")
    return diagnostic(both, "011", F.when(F.col("root").isNull(), "no root can be read").otherwise("Merkle root differs"), F.lit("hashes/merkle-tree.json"))


def manifest_findings(packages: DataFrame, manifests: DataFrame) -> DataFrame:
    """Findings from packages (package_id) and their manifests (package_id, m): none, or one without metadata or with a
    version that isn't a number; a core version other than 1. Such packages aren't looked into any further."""
    major = F.split(F.coalesce("m.versioning.core_version", F.lit("1.0.0")), r"\.")[0].try_cast("int")
    df = packages.select("package_id").distinct().join(manifests, "package_id", "left").withColumns({"none": F.col("m").isNull() | F.col("m.metadata").isNull(), "major": major})
    missing = diagnostic(df.where("none or major is null"), "002", F.lit("manifest missing or invalid"), F.lit("manifest.json"))
    other = diagnostic(df.where("not none and major <> 1"), "001", F.concat(F.lit("core version "), "m.versioning.core_version"), F.lit("/versioning/core_version"))
    return missing.unionByName(other)


def unknown_profiles(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Findings from profiles asked for (package_id, profile_id) that aren't among the known ones (profile_id)."""
    unknown = asked.join(known.select("profile_id").distinct(), "profile_id", "left_anti")
    return diagnostic(unknown, "030", F.concat(F.lit("no catalog "), F.coalesce("profile_id", F.lit("null"))), F.lit("/profiles"))


def bundle_digests(hashes: DataFrame) -> DataFrame:
    """(package_id, digest): SHA-256 of the canonical JSON object from paths to hashes."""
    rows = hashes.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("x"))
    member = F.transform("x", lambda e: F.concat(F.substring(F.to_json(F.array(e["path"])), F.lit(2), F.length(F.to_json(F.array(e["path"]))) - 2), F.lit(':"'), e["sha256"], F.lit('"')))
    return rows.select("package_id", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("{"), F.array_join(member, ","), F.lit("}")), 256)).alias("digest"))


def signature_headers(signatures: DataFrame) -> DataFrame:
    """(package_id, path, alg, code) of detached signatures (package_id, path, content): code is null, or 012 where the
    form is wrong, or 013 where the algorithm isn't allowed."""
    parts = F.split(F.trim("content"), r"\.", -1)
    padded = F.concat(F.translate(F.get(parts, F.lit(0)), "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(F.get(parts, F.lit(0))), F.lit(4))))
    header = F.try_to_binary(padded, F.lit("base64")).cast("string")
    df = signatures.select("package_id", "path", (F.size(parts) == 3).alias("three"), F.get_json_object(header, "$.alg").alias("alg"))
    return df.select("package_id", "path", "alg", F.when(~F.col("three") | F.col("alg").isNull(), "012").when(~F.col("alg").isin(*ALGORITHMS), "013").alias("code"))
