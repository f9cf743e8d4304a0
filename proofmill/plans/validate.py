"""Bundles validated as a whole: read, checked, held against catalogs and rolled up, any number of them in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, references
from ..operators.diagnostics import diagnostic
from ..operators.schema_check import all_findings
from ..sources import bundle
from .catalog import catalog_digest, catalog_rules, late_provisions, repeated_rule_ids
from .rollup import exit_codes, gaps, provision_summary
from .rules import is_selected, rule_results


@dataclass
class Validation:
    """findings: package_id, code, severity, category, message, path. results: as rule_results. summary: as provision_summary.
    profiles: package_id, profile_id, version, digest of the catalogs held against each package. exit_codes: package_id,
    exit_code."""

    findings: DataFrame
    results: DataFrame
    summary: DataFrame
    profiles: DataFrame
    exit_codes: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def asked_profiles(manifests: DataFrame, profiles: list[str] | None) -> DataFrame:
    """(package_id, profile_id, declared): the profiles that each package is held against, which are those of its manifest
    unless others are asked for, and the provisions its manifest declares for each; null if it doesn't."""
    own = manifests.select("package_id", F.inline("m.profiles")).select("package_id", "profile_id", F.col("applicable_provisions").alias("declared")).dropDuplicates(["package_id", "profile_id"])
    if profiles is None:
        return own
    wanted = manifests.select("package_id", F.explode(F.array(*map(F.lit, profiles)).cast("array<string>")).alias("profile_id"))
    return wanted.join(own, ["package_id", "profile_id"], "left")


def structure_findings(spark: SparkSession, root: str, only: str | None, manifests: DataFrame, records: DataFrame) -> DataFrame:
    """What is wrong with hashes, signatures and references of the packages that have these manifests."""
    mine = lambda df: df.join(manifests.select("package_id"), "package_id", "left_semi")
    files = mine(bundle.bundle_files(spark, root, only))
    indexed = mine(bundle.indexed_hashes(spark, root, only))
    with_index = files.where(F.col("path") == bundle.INDEX).select("package_id").distinct()
    readable = indexed.select("package_id").distinct()
    no_index = diagnostic(manifests.join(readable, "package_id", "left_anti"), "014", F.lit("no index of hashes can be read"), F.lit(bundle.INDEX))
    checked = lambda df: df.join(with_index, "package_id", "left_semi").join(readable, "package_id", "left_semi")
    headers = integrity.signature_headers(checked(bundle.read_signatures(spark, root, only)))
    listed = manifests.select("package_id", F.inline("m.record_files"))
    attached = records.select("package_id", F.inline("attachments")).where("path <> ''")
    return _union([
        no_index, integrity.hash_differences(checked(indexed), checked(bundle.actual_hashes(spark, root, only))),
        integrity.root_differences(checked(bundle.read_roots(spark, root, only)), checked(indexed)),
        *[diagnostic(headers.where(F.col("code") == code), code, F.concat(F.lit("signature with algorithm "), F.coalesce("alg", F.lit("none"))), F.col("path")) for code in ("012", "013")],
        references.dangling(references.record_refs(records).unionByName(references.manifest_refs(manifests)), references.manifest_urns(manifests)),
        references.defined_twice(references.manifest_urns(manifests)), references.repeated_records(records),
        references.missing_files(listed.where("path <> ''"), files, "022"), references.missing_files(attached, files, "023"),
        references.unsafe_paths(listed.where("path <> ''")), references.hash_differences(attached, indexed), references.count_differences(listed, records),
    ])


def validate(spark: SparkSession, root: str, catalogs: list[dict], instant: str, profiles: list[str] | None = None, schemas: dict[str, dict] | None = None, only: str | None = None, manifest: str = bundle.MANIFESTS, evidence: bool = False) -> Validation:
    """All packages under root (or the one named `only`) against the catalogs that their manifests name, or `profiles`.

    A package without a readable manifest, or of another core version, has that finding alone. Record files are those that
    the manifest lists. schemas: of payloads, by record type, and of manifests and envelopes by the names `manifest` and
    `record-envelope`, as read_schemas gives them; what has no schema isn't checked. All rules of all catalogs are one table, which the
    records are read for once. evidence: as in rule_results.
    """
    packages = bundle.read_packages(spark, root, only)
    all_manifests = bundle.read_manifests(spark, root, only, manifest)
    barred = integrity.manifest_findings(packages, all_manifests)
    manifests = all_manifests.join(barred.select("package_id").distinct(), "package_id", "left_anti")
    listed = manifests.select("package_id", F.inline("m.record_files")).where(references.safe_path(F.col("path"))).select("package_id", "path").distinct()
    records, malformed = bundle.read_records(spark, root, only, listed)

    asked = asked_profiles(manifests, profiles)
    known = spark.createDataFrame([(c["template_id"], c.get("version", "1.0.0"), catalog_digest(c)) for c in catalogs], "profile_id string, version string, digest string")
    times = manifests.select("package_id", F.col("m.metadata.timestamp").alias("package_time"))
    subjects = manifests.select("package_id", F.inline("m.subjects")).select("package_id", "subject_id", F.col("risk_classification").alias("risk"), "modalities")
    headers = integrity.signature_headers(bundle.read_signatures(spark, root, only)).where("code is null or code = '013'").select("package_id", "alg")
    rules = [r for c in catalogs for r in catalog_rules(c)]
    asking = times.join(asked.join(F.broadcast(known.select("profile_id")), "profile_id", "left_semi").select("package_id").distinct(), "package_id", "left_semi")
    results = rule_results(records, subjects, asking, rules, instant, headers, evidence, asked)
    summary = provision_summary(results, gaps(records))

    parts = [barred, malformed, structure_findings(spark, root, only, manifests, records), integrity.unknown_profiles(asked, known), *catalog_findings(spark, asked, catalogs, instant)]
    parts += [all_findings(manifests, records, schemas)] if set(schemas or {}) - {"assessment-bundle", "template"} else []
    findings = _union(parts)
    return Validation(findings, results, summary, asked.join(known, "profile_id").select("package_id", "profile_id", "version", "digest"), exit_codes(packages, findings, summary))


def catalog_findings(spark: SparkSession, asked: DataFrame, catalogs: list[dict], instant: str) -> list[DataFrame]:
    """Of the profiles asked of packages: rule ids that are used again, and declared provisions that aren't effective yet."""
    said = lambda of: F.broadcast(spark.createDataFrame([(c["template_id"], x) for c in catalogs for x in of(c)], "profile_id string, id string"))
    repeated, late = asked.join(said(repeated_rule_ids), "profile_id"), asked.join(said(lambda c: late_provisions(c, instant)), "profile_id")
    return [
        diagnostic(repeated, "044", F.concat(F.lit("rule id used again: "), "id"), F.col("profile_id")),
        diagnostic(late.where(is_selected(F.col("declared"), F.col("id"))), "032", F.concat("id", F.lit(" isn't effective yet")), F.col("profile_id")),
    ]


def validate_path(spark: SparkSession, path: str, into: str, catalogs: list[dict], instant: str, **more) -> Validation:
    """validate for a bundle's folder, its archive (which is unpacked under `into`), or a folder of bundles."""
    root, only = bundle.located(path, into)
    return validate(spark, root, catalogs, instant, only=only, **more)
