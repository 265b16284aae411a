"""A table may be one file or a folder of parts."""
import hashlib

from arealytics.plans import source_queries
from arealytics.sources import files


def test_folders_of_parts_have_a_checksum(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"one\ntwo")
    (tmp_path / "b.parquet").mkdir()
    for n in (2, 1):
        (tmp_path / "b.parquet" / f"part-{n}.parquet").write_bytes(b"x" * n)
    found = {r["path"]: r["sha256"] for r in files.folder_digests(spark, str(tmp_path), "*.parquet").collect()}
    parts = [f"b.parquet/part-{n}.parquet:{hashlib.sha256(b'x' * n).hexdigest()}" for n in (1, 2)]
    assert found["a.parquet"] == hashlib.sha256(b"one\ntwo").hexdigest()
    assert found["b.parquet"] == hashlib.sha256("\n".join(parts).encode()).hexdigest()


def test_manifest_check_finds_tables_written_as_folders(spark, tmp_path):
    spark.range(50).repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(50).repartition(2).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "other.parquet"))
    found = {r["source_id"]: r["status"] for r in source_queries.manifest_check(spark, str(tmp_path)).collect()}
    assert found == {"lineitem": "ok", "orders": "changed", "absent": "missing"}
