"""Bundles written, read, tampered with, merged, redacted and packed; canonical JSON."""

from __future__ import annotations

import hashlib
import json
import math
import struct
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill.functions.canonical import canonical, leaf, merkle_root, number_text
from proofmill.operators import bundles, integrity
from proofmill.operators.references import unsafe_paths
from proofmill.operators.schema_check import schema_findings
from proofmill.plans.validate import asked_profiles
from proofmill.sources import bundle


def test_numbers_print_as_in_ecmascript():
    # Published examples of the canonical form.
    for bits, text in (("0000000000000000", "0"), ("8000000000000000", "0"), ("0000000000000001", "5e-324"), ("7fefffffffffffff", "1.7976931348623157e+308"), ("4340000000000000", "9007199254740992"), ("444b1ae4d6e2ef4e", "999999999999999700000"), ("444b1ae4d6e2ef50", "1e+21"), ("3eb0c6f7a0b5ed8c", "9.999999999999997e-7"), ("3eb0c6f7a0b5ed8d", "0.000001"), ("41b3de4355555554", "333333333.33333325")):
        assert number_text(struct.unpack(">d", bytes.fromhex(bits))[0]) == text
    with pytest.raises(ValueError):
        number_text(math.inf)


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_read_back(x):
    assert float(number_text(x)) == x


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda v: st.lists(v) | st.dictionaries(st.text(), v), max_leaves=12)


@settings(max_examples=60)
@given(json_values)
def test_canonical_form_is_stable(value):
    text = canonical(value)
    assert canonical(json.loads(text)) == text


def test_member_order_is_by_utf16():
    assert canonical({"\U0001f600": 1, "דּ": 2, "a": 3}) == '{"a":3,"\U0001f600":1,"דּ":2}'


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_merkle_roots(spark, n):
    leaves = [(f"f{i}", hashlib.sha256(b"%d" % i).hexdigest()) for i in range(n)]
    level = [hashlib.sha256(f"{p}\0{h}".encode()).digest() for p, h in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    want = level[0].hex() if level else hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([(leaves,)], "x array<struct<p:string,h:string>>")
    assert df.select(merkle_root(F.transform("x", lambda x: leaf(x["p"], x["h"])))).first()[0] == want


MANIFEST = {"metadata": {"package_id": "b1", "timestamp": "2025-01-01T00:00:00Z"}, "versioning": {"core_version": "1.0"}, "subjects": [{"subject_id": "s1", "risk_classification": "high-risk", "modalities": ["text"]}]}
ROWS = [{"record_id": f"r{i}", "record_type": "event_log", "timestamp": f"2025-01-0{3 - i}T00:00:00Z", "payload": {"n": i, "x": 1e21}, "entity_refs": {"subject_refs": ["s1"]}, "attachments": [{"path": "artifacts/a.txt", "hash": "h"}]} for i in range(3)]


@pytest.fixture
def root(tmp_path):
    bundle.write_bundle(str(tmp_path / "in" / "b1"), MANIFEST, {"event_log": ROWS}, {"a.txt": b"hello"})
    return tmp_path / "in"


def test_reading_what_was_written(spark, root):
    records, bad = bundle.read_records(spark, str(root))
    rows = sorted(records.collect(), key=lambda r: r.seq)
    assert [r.record_id for r in rows] == ["r2", "r1", "r0"] and bad.count() == 0  # files are sorted by time
    assert rows[0].package_id == "b1" and rows[0].confidentiality == "public" and rows[0].subject_refs == ["s1"] and rows[0].attachments[0].media_type == "application/octet-stream"
    m = bundle.read_manifests(spark, str(root)).first().m
    assert m.metadata.package_id == "b1" and m.record_files[0]["count"] == 3


def findings(spark, root):
    return {(r.code, r.path) for r in integrity.hash_differences(bundle.indexed_hashes(spark, str(root)), bundle.actual_hashes(spark, str(root))).collect()}


def test_tampering_is_found(spark, root):
    assert findings(spark, root) == set()
    roots = integrity.merkle_roots(bundle.actual_hashes(spark, str(root))).first()
    assert roots.root == json.loads((root / "b1/hashes/merkle-tree.json").read_text())["root"] and roots.n_leaves == 3
    (root / "b1/artifacts/a.txt").write_bytes(b"hullo")
    (root / "b1/artifacts/new.txt").write_bytes(b"new")
    path = root / "b1/records/event_log.jsonl"
    path.write_text("\n".join(json.dumps(json.loads(x), indent=None) for x in path.read_text().splitlines()) + "\n\n")  # other spacing, same content
    assert findings(spark, root) == {("EV-010", "artifacts/a.txt"), ("EV-014", "artifacts/new.txt")}


def test_malformed_lines_are_findings(spark, root):
    path = root / "b1/records/event_log.jsonl"
    path.write_text(path.read_text() + "\n{oops\n[1]\n")
    records, bad = bundle.read_records(spark, str(root))
    assert records.count() == 3 and sorted(r.message for r in bad.collect()) == ["malformed line 5", "malformed line 6"]


def test_archives_are_reproducible_and_safe(tmp_path, root):
    one, two = tmp_path / "1.tar.gz", tmp_path / "2.tar.gz"
    bundle.pack(str(root / "b1"), str(one), 1_700_000_000)
    bundle.pack(str(root / "b1"), str(two), 1_700_000_000)
    assert one.read_bytes() == two.read_bytes()
    out = bundle.unpack(str(one), str(tmp_path / "out"))
    assert Path(out, "artifacts/a.txt").read_bytes() == b"hello"
    import io
    import tarfile

    with tarfile.open(tmp_path / "bad.tar.gz", "w:gz") as tar:
        tar.addfile(tarfile.TarInfo("../evil"), io.BytesIO())
    with pytest.raises(ValueError):
        bundle.unpack(str(tmp_path / "bad.tar.gz"), str(tmp_path / "out2"))


def test_merging(spark):
    rows = spark.createDataFrame([("a", "2024", 1, "old"), ("a", "2025", 2, "new"), ("b", "2024", 1, "tie1"), ("b", "2024", 2, "tie2"), ("c", None, 1, "only")], "id string, at string, input int, v string")
    take = lambda df: {r.id: r.v for r in df.collect()}
    assert take(bundles.merged(rows, ["id"], "at", ["input"])) == {"a": "new", "b": "tie2", "c": "only"}
    assert take(bundles.first_wins(rows, ["id"], ["input"])) == {"a": "old", "b": "tie1", "c": "only"}
    assert bundles.merged(rows, ["id"], "at", ["input"], "keep_all").count() == 5
    assert {r.id: r.n for r in bundles.conflicts(rows, ["id"]).collect()} == {"a": 1, "b": 1}
    with pytest.raises(bundles.MergeConflict):
        bundles.merged(rows, ["id"], "at", ["input"], "fail")
    with pytest.raises(ValueError):
        bundles.merged(rows, ["id"], "at", ["input"], "newest")


def test_redaction_round_trip(spark):
    rows = spark.createDataFrame([("a", "public", None, '{"x": 1e21, "a": "é"}'), ("b", "secret", None, '{"y": 2}'), ("c", "public", None, "{}")], "record_type string, confidentiality string, redaction_method string, payload string")
    done = {r.record_type: r for r in bundles.redacted(rows, types=["a"], levels=["secret"]).collect()}
    digest = hashlib.sha256(canonical({"x": 1e21, "a": "é"}).encode()).hexdigest()
    assert done["a"].redaction_method == f"sha256-commitment:{digest}" and done["b"].confidentiality == "hash-committed" and done["c"].payload == "{}"
    held = spark.createDataFrame([(done["a"].redaction_method, '{"a":"é","x":1000000000000000000000}'), (done["a"].redaction_method, "{}"), ("nocolon", "{}"), (None, "{}")], "m string, p string")
    assert [r[0] for r in held.select(bundles.redaction_holds(F.col("m"), F.col("p"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize(("n", "shards"), [(99_999, 1), (100_000, 1), (100_001, 2), (200_000, 2)])
def test_shards_by_count(spark, n, shards):
    rows = spark.range(n).select(F.lit("p").alias("package_id"), F.lit("t").alias("record_type"), F.lpad(F.col("id").cast("string"), 8, "0").alias("record_id"), F.lit("2025").alias("timestamp"))
    files = bundles.record_files(bundles.sharded(rows)).collect()
    assert len(files) == shards and sum(f["count"] for f in files) == n
    assert files[0].path == "records/t.jsonl" if shards == 1 else {f.path for f in files} == {"records/t/t.0001.jsonl", "records/t/t.0002.jsonl"}


def test_unsafe_paths(spark):
    bad = ["/a", "a\\b", "../a", "a/./b", "", None]
    df = spark.createDataFrame([("p", x) for x in [*bad, "records/a.jsonl", "a..b"]], "package_id string, path string")
    assert unsafe_paths(df).count() == len(bad)


def test_schema_findings(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "pattern": "^x"}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "e": {"enum": ["u", None]}, "l": {"type": "array", "minItems": 1, "items": {"type": "number"}}}}
    payloads = ['{"a":"x","n":3,"e":"u","l":[1]}', "{}", '{"n":0}', '{"a":"y","n":9.5,"e":"v","l":[]}', '{"a":"x","l":["s"]}', "not json"]
    rows = [("p", f"r{i}", "k", p) for i, p in enumerate(payloads)] + [("p", "r9", "odd", "{}"), ("p", "r8", "x-odd", "{}")]
    found = {(r.code, r.message.split()[0], r.path) for r in schema_findings(spark.createDataFrame(rows, "package_id string, record_id string, record_type string, payload string"), {"k": schema}).collect()}
    assert found == {("EV-004", "required", "r2/payload/a"), ("EV-004", "minimum", "r2/payload/n"), ("EV-004", "pattern", "r3/payload/a"), ("EV-004", "type", "r3/payload/n"), ("EV-004", "maximum", "r3/payload/n"), ("EV-004", "enum", "r3/payload/e"), ("EV-004", "minItems", "r3/payload/l"), ("EV-004", "items", "r4/payload/l"), ("EV-003", "unknown", "r9")}


def test_wrong_roots_manifests_versions_and_profiles_are_found(spark, tmp_path):
    good = {"metadata": {"package_id": "p"}, "versioning": {"core_version": "1.2.0"}, "profiles": [{"profile_id": "known"}]}
    for name, more in {"fine": {}, "root": {}, "broken": {}, "gone": {}, "unread": {}, "two": {"versioning": {"core_version": "2.0.0"}}, "odd": {"profiles": [{"profile_id": "known"}, {"profile_id": "other"}]}}.items():
        bundle.write_bundle(str(tmp_path / name), {**good, **more}, {}, {"a.txt": b"hello"})
    tree = tmp_path / "root/hashes/merkle-tree.json"
    tree.write_text(json.dumps({**json.loads(tree.read_text()), "root": "0" * 64}))
    (tmp_path / "unread/hashes/merkle-tree.json").write_text("{")
    (tmp_path / "broken/manifest.json").write_text("{")
    (tmp_path / "gone/manifest.json").unlink()
    known = spark.createDataFrame([("known",)], "profile_id string")
    where = str(tmp_path)
    manifests = bundle.read_manifests(spark, where)
    found = integrity.manifest_findings(bundle.read_packages(spark, where), manifests)
    found = found.unionByName(integrity.unknown_profiles(asked_profiles(manifests, None), known))
    found = found.unionByName(integrity.root_differences(bundle.read_roots(spark, where), bundle.indexed_hashes(spark, where)))
    assert sorted((r.package_id, r.code) for r in found.collect()) == [("broken", "EV-002"), ("gone", "EV-002"), ("odd", "EV-030"), ("root", "EV-011"), ("two", "EV-001"), ("unread", "EV-011")]


def test_artifacts_in_a_folder_named_records_are_no_records(spark, root):
    (root / "b1/artifacts/records").mkdir()
    (root / "b1/artifacts/records/a b.jsonl").write_text('{"record_id": "no"}\n')
    assert bundle.read_records(spark, str(root))[0].count() == 3
    assert {(r.package_id, r.path) for r in bundle.bundle_files(spark, str(root)).collect()} >= {("b1", "artifacts/records/a b.jsonl"), ("b1", "manifest.json")}
    assert [r.package_id for r in bundle.read_packages(spark, str(root)).collect()] == ["b1"]


def test_lines_are_numbered_in_files_read_in_blocks(spark, tmp_path):
    (tmp_path / "b/records").mkdir(parents=True)
    for name, n in (("one", 3_000), ("two", 5)):
        (tmp_path / f"b/records/{name}.jsonl").write_text("".join(f'{{"record_id": "{name}{i}", "payload": {{"x": "{"y" * (i % 50)}"}}}}\n' + "\n" * (i % 3 == 0) for i in range(n)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        records, bad = bundle.read_records(spark, str(tmp_path))
        rows = records.orderBy("seq").select("record_id", "seq").collect()
        lines = {r.value[15:].split('"')[0]: r.line for r in bundle.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r.record_id for r in rows] == [f"one{i}" for i in range(3_000)] + [f"two{i}" for i in range(5)] and bad.count() == 0
    assert lines == {f"{name}{i}": i + (i + 2) // 3 for name, n in (("one", 3_000), ("two", 5)) for i in range(n)}


def test_whole_numbers_with_a_point_are_integers(spark):
    rows = [("p", f"r{i}", "k", p) for i, p in enumerate(('{"n":1.0,"l":[2.0]}', '{"n":1.5,"l":[0.5]}', '{"n":2e3}', '{"n":"1"}'))]
    schema = {"properties": {"n": {"type": "integer"}, "l": {"items": {"type": "integer"}}}}
    found = {r.path for r in schema_findings(spark.createDataFrame(rows, "package_id string, record_id string, record_type string, payload string"), {"k": schema}).collect()}
    assert found == {"r1/payload/n", "r1/payload/l", "r3/payload/n"}


def test_shards_of_many_hours_and_null_timestamps(spark):
    rows = [("p", "t" if i % 3 else None, f"r{i:03d}", None if i % 11 == 0 else f"2024-01-0{i % 3 + 1}T{(i * 7) % 24:02d}:{i % 60:02d}:00Z") for i in range(200)]
    found = bundles.sharded(spark.createDataFrame(rows, "package_id string, record_type string, record_id string, timestamp string"), 30).collect()
    assert len(found) == 200
    for kind in ("t", None):
        own = sorted((r for r in rows if r[1] == kind), key=lambda r: (r[3] or "", r[2]))
        want = {r[2]: (i + 1, i // 30 + 1) for i, r in enumerate(own)}
        assert {r.record_id: (r.position, r.shard) for r in found if r.record_type == kind} == want


def test_only_chosen_records_are_redacted(spark):
    kinds = "package_id string, record_type string, record_id string, payload string, confidentiality string, redaction_method string"
    df = spark.createDataFrame([("p", "a", "1", "{}", "public", None), ("p", None, "2", "{}", None, None), ("p", "b", "3", None, "secret", "old")], kinds)
    found = {r.record_id: (r.confidentiality, r.redaction_method and r.redaction_method[:10]) for r in bundles.redacted(df, types=["a"]).collect()}
    assert found == {"1": ("hash-committed", "sha256-com"), "2": (None, None), "3": ("secret", "old")}
    assert bundles.redacted(df).collect() == df.collect()
