"""The package lies in the folder that the driver and the executors share."""

import os

from loomframe.queries import sources


def test_package_export_writes_to_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "_scratch", lambda spark: f"file://{tmp_path}")
    rows = sources.package_export(spark, "/root/testdata/sf0.001").collect()
    assert rows[0]["n_rows"] == spark.read.parquet(str(tmp_path / "package/data/final.parquet")).count() > 0
    for name in ("metadata/manifest.json", "provenance/lineage.jsonl", "reports/quality_report.html", "scripts/reproduce.py"):
        assert os.path.getsize(tmp_path / "package" / name) > 0
