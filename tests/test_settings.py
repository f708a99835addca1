"""The settings artifact: round trip, and one test per way to damage it."""

import datetime as dt
import hashlib
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from boardlake.operators import settings

DAY = dt.datetime(2026, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def tables(spark):
    documents = spark.createDataFrame(
        [(2, "user", "s", "recipe-1", 7, 2, 21, 20, DAY, DAY), (1, "global", "s", "recipe-2", None, 1, 10, None, DAY, DAY), (3, "user", "s", "recipe-1", None, 0, None, None, DAY, None)],
        "id long, scope string, subject_id string, document_key string, owner_user_id long, current_revision int, current_version_id long, active_version_id long, created_at timestamp_ntz, updated_at timestamp_ntz")
    versions = spark.createDataFrame(
        [(10, 1, 1, 1, '{"b": 1.0, "a": {"y": [1, null], "x": "é\\"/\\n"}}', 5, None, None, DAY), (20, 2, 1, 1, "{}", None, "first", None, DAY.replace(microsecond=1500)),
         (21, 2, 2, 1, '{"n": 12345678901234567890}', 5, "", 20, DAY), (99, 4, 1, 1, "{}", 5, "of no document", None, DAY)],
        "id long, document_id long, revision int, schema_version int, payload string, created_by long, reason string, source_version_id long, created_at timestamp_ntz")
    activations = spark.createDataFrame(
        [(5, 2, 21, "k-1", "c", "applied", 2, "[]", 7, None, DAY, None)],
        "id long, document_id long, requested_version_id long, idempotency_key string, request_checksum string, status string, observed_target_revision int, diagnostics string, requested_by long, reason string, created_at timestamp_ntz, completed_at timestamp_ntz")
    return documents, versions.withColumn("checksum", settings.payload_checksum(F.col("payload"))), activations


@pytest.fixture
def root(tables, tmp_path):
    settings.write_export(*tables, str(tmp_path / "out"), "2026-02-03T00:00:00Z", part_items=2)
    return tmp_path / "out"


def part_files(root):
    return [p for p in pathlib.Path(root, "parts").iterdir() if p.name.startswith("part-") and p.stat().st_size]


def rewrite(folder, change):
    """Change every line of the files of a folder."""
    for path in pathlib.Path(folder).iterdir():
        if path.name.startswith("part-"):
            lines = path.read_text(encoding="utf-8").splitlines(keepends=True)
            path.write_text("".join(map(change, lines)), encoding="utf-8")
            pathlib.Path(folder, f".{path.name}.crc").unlink(missing_ok=True)


def issues(spark, root, schemas=None):
    found = settings.verify_export(settings.read_export(spark, str(root)), schemas)
    return sorted((r["issue"], r["collection"], r["id"]) for r in found.collect())


def test_an_export_comes_back(spark, root, tables):
    documents, versions, activations = tables
    back = settings.read_export(spark, str(root))
    order = [c for _, c, _, _ in settings.COLLECTIONS["documents"]]
    assert back.documents.select(order).orderBy("id").collect() == documents.select(order).orderBy("id").collect()
    columns = [c for _, c, _, _ in settings.COLLECTIONS["versions"] if c != "payload"]
    assert back.versions.select(columns).orderBy("id").collect() == versions.where("id <> 99").select(columns).orderBy("id").collect()
    assert [json.loads(r["payload"]) for r in back.versions.orderBy("id").collect()] == [json.loads(r["payload"]) for r in versions.where("id <> 99").orderBy("id").collect()]
    assert back.activations.count() == 1 and issues(spark, root) == []


def test_lines_are_canonical_and_in_the_total_order(spark, root):
    lines = [line for p in part_files(root) for line in p.read_text(encoding="utf-8").strip().split("\n")]
    lines.sort(key=lambda line: json.loads(line)["part"])
    parts = [json.loads(line) for line in lines]
    for line, part in zip(lines, parts):
        assert line == json.dumps(part, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert part["formatVersion"] == 1
    assert [d["id"] for p in parts for d in p["documents"]] == [1, 3, 2]
    assert [v["id"] for p in parts for v in p["versions"]] == [10, 20, 21]
    version = parts[0]["versions"][0]
    assert version["checksum"] == hashlib.sha256(json.dumps(version["payload"], sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert version["createdAt"] == "2026-01-02T03:04:05" and parts[0]["versions"][1]["createdAt"] == "2026-01-02T03:04:05.001500"


def test_a_changed_payload_is_found(spark, root):
    rewrite(root / "parts", lambda t: t.replace("12345678901234567890", "12345678901234567891"))
    assert issues(spark, root) == [("manifest-checksum", None, None), ("version-checksum", "versions", "21")]


def test_a_changed_word_is_found(spark, root):
    rewrite(root / "parts", lambda t: t.replace("applied", "failed"))
    assert issues(spark, root) == [("manifest-checksum", None, None)]


def test_a_lost_part_is_found(spark, root):
    rewrite(root / "parts", lambda t: "" if '"part":1' in t else t)
    found = issues(spark, root)
    assert ("count", "parts", None) in found and ("count", "versions", None) in found and ("manifest-checksum", None, None) in found
    # Document 2 stood in the lost part.
    assert ("unknown-document", "versions", "20") in found


def test_an_unreadable_part_is_found(spark, root):
    rewrite(root / "parts", lambda t: t[: len(t) // 2] + "\n" if '"part":1' in t else t)
    assert ("unreadable-part", None, None) in issues(spark, root)


def test_a_damaged_manifest_is_found(spark, root):
    rewrite(root / "manifest", lambda t: t.replace('"sha256"', '"md5"').replace('"activationCount":1', '"activationCount":2'))
    assert issues(spark, root) == [("count", "activations", None), ("manifest-invalid", None, None)]
    rewrite(root / "manifest", lambda t: "")
    assert issues(spark, root) == [("manifest-invalid", None, None)]


def test_another_format_is_found(spark, root):
    rewrite(root / "parts", lambda t: t.replace('"formatVersion":1', '"formatVersion":2'))
    assert ("unsupported-format", None, "0") in issues(spark, root)


def test_unknown_schemas_are_found(spark, root):
    known = spark.createDataFrame([("recipe-1", 1)], "document_key string, schema_version int")
    assert issues(spark, root, known) == [("unknown-schema", "versions", "10")]


def test_an_empty_export_verifies(spark, tables, tmp_path):
    settings.write_export(*[t.limit(0) for t in tables], str(tmp_path / "none"), "2026-02-03T00:00:00Z")
    assert issues(spark, tmp_path / "none") == []


def test_a_packed_export_verifies_and_leaves_no_lines_behind(spark, tables, tmp_path):
    from boardlake.sources.storage import shared_folder

    before = {p.name for p in pathlib.Path(shared_folder(spark)).glob("settings-lines-*")}
    settings.write_export(*tables, str(tmp_path / "packed"), "2026-02-03T00:00:00Z", part_items=2, compression="gzip")
    assert all(p.name.endswith(".gz") for p in part_files(tmp_path / "packed"))
    assert issues(spark, tmp_path / "packed") == []
    assert {p.name for p in pathlib.Path(shared_folder(spark)).glob("settings-lines-*")} == before


def test_items_are_numbered_within_their_documents(spark, tables):
    """Documents that come twice, under another key, hold their versions twice; a version of no document is left out."""
    documents, versions, activations = tables
    twice = documents.unionByName(documents.where("id = 2").withColumn("document_key", F.lit("recipe-0")))
    items = settings.numbered_items(twice, versions, activations).collect()
    got = sorted((r["collection"], r["at"], json.loads(r["item"])["id"]) for r in items)
    assert [g for g in got if g[0] == "versions"] == [("versions", 1, 10), ("versions", 2, 20), ("versions", 3, 21), ("versions", 4, 20), ("versions", 5, 21)]
    assert [g[2] for g in got if g[0] == "documents"] == [1, 2, 3, 2] and [g[1] for g in got if g[0] == "activations"] == [1, 2]


def test_stored_lines_come_in_small_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    lines = spark.range(0, 240, numPartitions=1).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 10_000).alias("line"))
    lines.write.options(**settings.LINE_FILES).parquet(str(tmp_path / "lines"))
    (path,) = (tmp_path / "lines").glob("part-*")
    meta = pq.ParquetFile(path).metadata
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 64 << 20


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {p for p in (blocks.apply(i).getName() for i in range(blocks.size())) if p.startswith("shuffle_")}


def test_an_export_moves_a_slice_at_a_time_and_keeps_no_shuffles(spark, tables, tmp_path, monkeypatch):
    documents, versions, activations = tables
    more = spark.range(100, 160).select(F.col("id"), F.lit(1).alias("document_id"), F.col("id").cast("int").alias("revision"), F.lit(1).alias("schema_version"),
        F.lit("{}").alias("payload"), F.lit(None).cast("long").alias("created_by"), F.lit("x").alias("reason"), F.lit(None).cast("long").alias("source_version_id"), F.lit(DAY).cast("timestamp_ntz").alias("created_at"))
    tables = documents, versions.unionByName(more.withColumn("checksum", settings.payload_checksum(F.col("payload")))), activations
    settings.write_export(*tables, str(tmp_path / "one"), "2026-02-03T00:00:00Z", part_items=2)
    asked, part_lines = [], settings.part_lines

    def counted(items, *rest):
        asked.append(items.count())
        return part_lines(items, *rest)

    monkeypatch.setattr(settings, "part_lines", counted)
    monkeypatch.setattr(settings, "SLICE_PARTS", 4)
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    settings.write_export(*tables, str(tmp_path / "many"), "2026-02-03T00:00:00Z", part_items=2)
    assert len(asked) == settings.MAX_SLICES and max(asked) <= 14 and sum(asked) == 67
    assert not shuffle_files(spark) - before and spark.conf.get(setting) == was
    one, many = (sorted(line for p in part_files(tmp_path / name) for line in p.read_text(encoding="utf-8").splitlines()) for name in ("one", "many"))
    assert one == many and len(one) == 32
    manifests = [settings.read_export(spark, str(tmp_path / name)).manifest.collect() for name in ("one", "many")]
    assert manifests[0] == manifests[1] and issues(spark, tmp_path / "many") == []
