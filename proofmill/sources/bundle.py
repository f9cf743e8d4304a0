"""Bundles on disk: a manifest, JSONL record files, artifacts, hash indexes and signatures, read and written by Spark.

ROOT may hold any number of bundles, one folder each: ROOT/NAME/{manifest.json, records/**.jsonl, artifacts/*,
hashes/content-hashes.json, hashes/merkle-tree.json, signatures/*.jws}. NAME is the package_id.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical, canonical_or_none
from ..operators.diagnostics import diagnostic

#: A manifest's name as it is written, and the pattern of names that are read.
MANIFEST, MANIFESTS = "manifest.json", "*manifest.json"
INDEX = "hashes/content-hashes.json"
MAX_BYTES, MAX_FILES, MAX_FILE = 10 << 30, 100_000, 1 << 30

RECORD = (
    "record_id string, record_type string, provisions_addressed array<string>, timestamp string, lifecycle_phase string, obligation_role string, "
    "confidentiality string, redaction_method string, trust_level string, "
    "entity_refs struct<subject_refs:array<string>,component_refs:array<string>,dataset_refs:array<string>,actor_refs:array<string>>, payload variant, "
    "attachments array<struct<path:string,hash:string,media_type:string,attachment_type:string,description:string>>, "
    "attestation struct<method:string,signer:string,signed_fields:array<string>,signature:string>"
)
MANIFEST_SCHEMA = (
    "metadata struct<package_id:string,timestamp:string,prior_package_ref:string>, versioning struct<core_version:string,profiles_version:string>, "
    "subjects array<struct<subject_id:string,subject_type:string,name:string,version:string,risk_classification:string,modalities:array<string>>>, "
    "entities struct<components:array<struct<component_id:string,name:string,type:string,subject_refs:array<string>>>,datasets:array<struct<dataset_id:string,name:string,subject_refs:array<string>>>,"
    "actors:array<struct<actor_id:string,role:string,name:string>>,relationships:array<struct<source_ref:string,target_ref:string,relationship_type:string>>>, "
    "profiles array<struct<profile_id:string,template_version:string,applicable_provisions:array<string>>>, record_files array<struct<path:string,record_type:string,count:bigint>>"
)


def _under(root: str, only: str | None) -> str:
    return root if only is None else f"{root.rstrip('/')}/{only}"


def _placed(spark: SparkSession, df: DataFrame, root: str, column: str = "file") -> DataFrame:
    """package_id and the path within the bundle, from a file's path: the first step below root, and the others."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    depth = len(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/").split("/"))
    inside = F.regexp_replace(column, "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")  # the path without scheme and host
    steps = F.transform(F.split(inside, "/"), lambda s: F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    return df.withColumns({"package_id": F.get(steps, F.lit(depth)), "path": F.array_join(F.slice(steps, depth + 2, F.greatest(F.lit(0), F.size(steps) - depth - 1)), "/")})


def _texts(spark: SparkSession, root: str, only: str | None, names: str, whole: bool = True) -> DataFrame:
    """Text files by a pattern of their names: value, file, package_id, path."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(_under(root, only), wholetext=whole)
    return _placed(spark, text.withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "nth": F.monotonically_increasing_id()}), root)


def read_manifests(spark: SparkSession, root: str, only: str | None = None, manifest: str = MANIFESTS) -> DataFrame:
    """package_id, the manifest's members and its text; `m` is null where a manifest isn't JSON. manifest: a pattern of its name."""
    return _texts(spark, root, only, manifest).where("not contains(path, '/')").select("package_id", F.from_json("value", MANIFEST_SCHEMA).alias("m"), F.col("value").alias("raw"))


def read_lines(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """Lines of all record files that aren't blank: package_id, path, line (from 0), value. Files are split: a block's first
    line has the number of lines of the blocks before, of which there is a row each."""
    lines = _texts(spark, root, only, "*.jsonl", whole=False).where("startswith(path, 'records/')")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    before = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).drop("n")
    numbered = lines.join(before, ["file", "block"]).withColumn("line", F.col("before") + F.col("nth") - F.col("first"))
    return numbered.where("value rlike '[^ \\t]'").select("package_id", "path", "line", "value")


def read_records(spark: SparkSession, root: str, only: str | None = None, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, diagnostics): malformed lines are findings instead of records. Absent trust level, confidentiality and
    media types get their defaults. listed: only these files (package_id, path) count; else all there are. seq orders a
    package's records by file and line."""
    lines = read_lines(spark, root, only)
    if listed is not None:
        lines = lines.join(listed, ["package_id", "path"], "left_semi")
    files = lines.select("package_id", "path").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("package_id").orderBy("path")))
    lines = lines.withColumns({"r": F.from_json("value", RECORD), "ok": F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")})
    bad = diagnostic(lines.where("not ok"), "050", F.concat(F.lit("malformed line "), (F.col("line") + 1).cast("string")), F.col("path"))
    refs = lambda c: F.coalesce(F.col(f"r.entity_refs.{c}"), F.array().cast("array<string>")).alias(c)
    attachments = F.transform("r.attachments", lambda a: F.struct(a["path"].alias("path"), a["hash"].alias("hash"), F.coalesce(a["media_type"], F.lit("application/octet-stream")).alias("media_type"), a["attachment_type"].alias("attachment_type")))
    records = lines.where("ok").join(files, ["package_id", "path"]).select(
        "package_id", "path", (F.col("nth").cast("long") * (1 << 40) + F.col("line")).alias("seq"), "r.record_id", "r.record_type", "r.provisions_addressed", "r.timestamp", "r.lifecycle_phase", "r.obligation_role",
        F.coalesce("r.confidentiality", F.lit("public")).alias("confidentiality"), "r.redaction_method", F.coalesce("r.trust_level", F.lit("self-attested")).alias("trust_level"),
        *map(refs, ("subject_refs", "component_refs", "dataset_refs", "actor_refs")), F.to_json("r.payload").alias("payload"), attachments.alias("attachments"), F.col("r.attestation.signature").alias("attestation_signature"), F.col("value").alias("raw"),
    )
    return records, bad


def _files(spark: SparkSession, root: str, only: str | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_under(root, only)).withColumn("file", F.col("path")).drop("path")
    return _placed(spark, files, root).where("path <> ''")


def bundle_files(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """(package_id, path) of all files; they aren't read."""
    return _files(spark, root, only).select("package_id", "path")


def actual_hashes(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """(package_id, path, sha256) of manifests, records and artifacts: of canonical JSON for .json, of canonical lines for .jsonl, else of bytes."""
    files = _files(spark, root, only).where("path rlike '^(records|artifacts)/' or path rlike '^[^/]*manifest[.]json$'")

    @F.pandas_udf("binary")
    def normal(content: pd.Series, path: pd.Series) -> pd.Series:
        def one(raw: bytes, name: str) -> bytes:
            if name.endswith(".json"):
                text = canonical_or_none(raw.decode("utf-8", "replace"))
                return raw if text is None else text.encode()
            lines = [canonical_or_none(x) for x in raw.decode("utf-8", "replace").splitlines() if x.strip()]
            return raw if None in lines else "".join(f"{x}\n" for x in lines).encode()

        return pd.Series([one(c, p) for c, p in zip(content, path, strict=True)])

    body = F.when(F.col("path").endswith(".json") | F.col("path").endswith(".jsonl"), normal("content", "path")).otherwise(F.col("content"))
    return files.select("package_id", "path", F.sha2(body, 256).alias("sha256"))


def read_packages(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """package_id of each folder that has any file, with a manifest or without."""
    return bundle_files(spark, root, only).select("package_id").distinct()


def read_roots(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """(package_id, root) of the Merkle files; root is null where it can't be read."""
    return _texts(spark, root, only, "merkle-tree.json").where("path = 'hashes/merkle-tree.json'").select("package_id", F.from_json("value", "root string")["root"].alias("root"))


def indexed_hashes(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    return _texts(spark, root, only, "content-hashes.json").where(F.col("path") == INDEX).select("package_id", F.explode(F.from_json("value", "map<string,string>")).alias("path", "sha256"))


def read_signatures(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """(package_id, path, content) of signatures that aren't blank."""
    text = _texts(spark, root, only, "*.jws").where("path rlike '^signatures/[^/]+$' and value rlike '[^ \\t\\r\\n]'")
    return text.select("package_id", "path", F.col("value").alias("content"))


def located(path: str, into: str) -> tuple[str, str | None]:
    """(root, name) of a bundle's folder or archive, which is unpacked under `into`; (path, None) of a folder of bundles."""
    if Path(path).is_file():
        found = Path(unpack(path, into))
        return str(found.parent), found.name
    if any(Path(path).glob(MANIFESTS)):
        return str(Path(path).resolve().parent), Path(path).resolve().name
    return path, None


def write_bundle(folder: str, manifest: dict, records: dict[str, list[dict]], artifacts: dict[str, bytes] = {}) -> str:  # noqa: B006
    """One bundle as canonical files; returns its Merkle root. A driver-side builder for bundles made by hand; tables of
    records are written with write_records."""
    import hashlib

    root = Path(folder)
    files: dict[str, bytes] = {f"artifacts/{k}": v for k, v in artifacts.items()}
    listed = []
    for kind, rows in sorted(records.items()):
        rows = sorted(rows, key=lambda r: (r.get("timestamp", ""), r.get("record_id", "")))
        files[f"records/{kind}.jsonl"] = "".join(canonical(r) + "\n" for r in rows).encode()
        listed.append({"path": f"records/{kind}.jsonl", "record_type": kind, "count": len(rows)})
    files[MANIFEST] = canonical({**manifest, "record_files": listed}).encode()
    hashes = {p: hashlib.sha256(b).hexdigest() for p, b in sorted(files.items())}
    level = [hashlib.sha256(f"{p}\0{h}".encode()).digest() for p, h in hashes.items()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    files["hashes/content-hashes.json"] = canonical(hashes).encode()
    files["hashes/merkle-tree.json"] = canonical({"leaves": [{"path": p, "hash": h} for p, h in hashes.items()], "root": level[0].hex()}).encode()
    for path, body in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    return level[0].hex()


def write_records(shards: DataFrame, root: str) -> None:
    """Sharded records with a `line` column as text files under package_id=/record_type=/shard=, in order of position."""
    keys = ["package_id", "record_type", "shard"]
    shards.repartition(*keys).sortWithinPartitions(*keys, "position").select(*keys, F.col("line").alias("value")).write.partitionBy(*keys).text(root)


def pack(folder: str, archive: str, mtime: int) -> None:
    """A bundle as a reproducible tar.gz: sorted names, fixed owners and modes, times of the manifest."""
    body = io.BytesIO()
    with tarfile.open(fileobj=body, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for p in sorted(Path(folder).rglob("*"), key=lambda p: p.relative_to(folder).as_posix()):
            info = tarfile.TarInfo(f"{Path(folder).name}/{p.relative_to(folder).as_posix()}")
            info.mtime, info.mode = mtime, 0o755 if p.is_dir() else 0o644
            info.type = tarfile.DIRTYPE if p.is_dir() else tarfile.REGTYPE
            data = b"" if p.is_dir() else p.read_bytes()
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    packed = bytearray(gzip.compress(body.getvalue(), 6, mtime=0))
    packed[9] = 255
    Path(archive).write_bytes(packed)


def unpack(archive: str, folder: str) -> str:
    """Extract an archive after checking its names, kinds and sizes; returns the bundle's folder."""
    total = 0
    with tarfile.open(archive, "r:gz") as tar:
        members = tar.getmembers()
        if len(members) > MAX_FILES:
            raise ValueError("too many files in the archive")
        for m in members:
            path = PurePosixPath(m.name)
            total += m.size
            if path.is_absolute() or ".." in path.parts or "\\" in m.name or not (m.isfile() or m.isdir()):
                raise ValueError(f"unsafe entry {m.name!r}")
            if m.size > MAX_FILE or total > MAX_BYTES:
                raise ValueError("the archive is too large")
        tar.extractall(folder, filter="data")
    return str(Path(folder) / PurePosixPath(members[0].name).parts[0])


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
