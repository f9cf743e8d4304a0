"""Referential checks as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import diagnostic


def dangling(refs: DataFrame, defined: DataFrame) -> DataFrame:
    """References (package_id, ref, path) to nothing that is defined (package_id, urn). Null and empty ones aren't references."""
    return diagnostic(refs.where("ref <> ''").join(defined.select("package_id", F.col("urn").alias("ref")).distinct(), ["package_id", "ref"], "left_anti"), "020", F.concat(F.lit("nothing is "), "ref"), F.col("path"))


def record_refs(records: DataFrame) -> DataFrame:
    """The references in the four arrays of records, as (package_id, ref, path)."""
    all_refs = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("subject_refs", "component_refs", "dataset_refs", "actor_refs")])
    return records.select("package_id", F.explode(all_refs).alias("ref"), F.col("record_id").alias("path"))


def manifest_refs(manifests: DataFrame) -> DataFrame:
    """The references of relationships, components and datasets in manifests (package_id, m), as (package_id, ref, path)."""

    def each(column: str, ref: str, name: str) -> DataFrame:
        rows = manifests.select("package_id", F.posexplode(f"m.entities.{column}").alias("i", "x"))
        refs = F.col(f"x.{ref}") if ref == "subject_refs" else F.array(f"x.{ref}")
        return rows.select("package_id", F.explode(refs).alias("ref"), F.concat(F.lit(f"/entities/{column}/"), F.col("i").cast("string"), F.lit(f"/{name}")).alias("path"))

    out = each("relationships", "source_ref", "source_ref").unionByName(each("relationships", "target_ref", "target_ref"))
    return out.unionByName(each("components", "subject_refs", "subject_refs")).unionByName(each("datasets", "subject_refs", "subject_refs"))


def manifest_urns(manifests: DataFrame) -> DataFrame:
    """What manifests define, as (package_id, urn, path, seq): the package, subjects, components, datasets and actors."""
    out = manifests.select("package_id", F.col("m.metadata.package_id").alias("urn"), F.lit("/metadata/package_id").alias("path"), F.lit(0).alias("kind"), F.lit(0).alias("i"))
    lists = (("m.subjects", "subject_id", "/subjects"), ("m.entities.components", "component_id", "/entities/components"), ("m.entities.datasets", "dataset_id", "/entities/datasets"), ("m.entities.actors", "actor_id", "/entities/actors"))
    for kind, (column, name, place) in enumerate(lists, 1):
        rows = manifests.select("package_id", F.posexplode(column).alias("i", "x"))
        out = out.unionByName(rows.select("package_id", F.col(f"x.{name}").alias("urn"), F.concat(F.lit(f"{place}/"), F.col("i").cast("string")).alias("path"), F.lit(kind).alias("kind"), "i"))
    return out.where("urn <> ''").select("package_id", "urn", "path", F.struct("kind", "i").alias("seq"))


def defined_twice(defined: DataFrame) -> DataFrame:
    """All definitions of an identifier but the first: defined has (package_id, urn, path, seq)."""
    order = Window.partitionBy("package_id", "urn").orderBy("seq", "path")
    rows = defined.withColumns({"k": F.row_number().over(order), "first": F.first("path").over(order)})
    return diagnostic(rows.where("k > 1"), "021", F.concat("urn", F.lit(" is first defined at "), "first"), F.col("path"))


def repeated_records(records: DataFrame) -> DataFrame:
    """Every occurrence of a record id after the first."""
    rows = records.withColumn("k", F.row_number().over(Window.partitionBy("package_id", "record_id").orderBy("seq")))
    return diagnostic(rows.where("k > 1"), "026", F.concat(F.lit("occurrence "), F.col("k").cast("string")), F.col("record_id"))


def missing_files(listed: DataFrame, files: DataFrame, code: str = "022") -> DataFrame:
    """Listed paths (package_id, path) without a file (package_id, path): record files, or attachments by code 023."""
    return diagnostic(listed.join(files.select("package_id", "path").distinct(), ["package_id", "path"], "left_anti"), code, F.lit("no such file"), F.col("path"))


def hash_differences(attachments: DataFrame, hashes: DataFrame) -> DataFrame:
    """Attachments (package_id, path, hash) whose hash isn't the indexed one (package_id, path, sha256)."""
    both = attachments.where("hash <> ''").join(hashes, ["package_id", "path"]).where(F.regexp_replace("hash", "^sha256:", "") != F.col("sha256"))
    return diagnostic(both, "027", F.concat(F.lit("index has "), "sha256"), F.col("path"))


def count_differences(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Types listed in a manifest (package_id, record_type, count) whose number of records is another."""
    want = expected.groupBy("package_id", "record_type").agg(F.sum("count").alias("want"))
    have = records.groupBy("package_id", "record_type").agg(F.count("*").alias("have"))
    both = want.join(have, ["package_id", "record_type"], "left").withColumn("have", F.coalesce("have", F.lit(0))).where("want <> have")
    return diagnostic(both, "025", F.format_string("%d listed, %d found", "want", "have"), F.col("record_type"))


def safe_path(path):
    """Whether a relative path stays inside of its bundle."""
    return ~F.contains(path, F.lit("\\")) & ~path.startswith("/") & (path != "") & ~F.exists(F.split(path, "/"), lambda s: s.isin(".", ".."))


def unsafe_paths(paths: DataFrame) -> DataFrame:
    return diagnostic(paths.where(~F.coalesce(safe_path(F.col("path")), F.lit(False))), "052", F.lit("unsafe path"), F.col("path"))
