"""Recorded builds, digests, rebuilds and conflicts of meaning."""

import math
import json
import subprocess
import sys

import pytest

from loomframe.errors import EngineError
from loomframe.functions.units import Meaning
from loomframe.plans import build, record, semantics


def test_digest_is_of_a_set_with_repeats(spark):
    rows = [(1, 0.1 + 0.2, "a", [1]), (1, 0.1 + 0.2, "a", [1]), (2, None, None, None)]
    df = spark.createDataFrame(rows, "k int, v double, t string, l array<int>")
    same = spark.createDataFrame([(r[2], r[3], r[0], r[1] and 0.3) for r in reversed(rows)], "t string, l array<int>, k int, v double")
    assert record.digest(df) == record.digest(same.repartition(3))
    others = [rows[:2], [*rows, rows[2]], [(1, 0.3, "a", [1]), (1, 0.3, "b", [1]), rows[2]], [rows[0], rows[0], (2, None, "null", None)]]
    assert all(record.digest(spark.createDataFrame(o, df.schema)) != record.digest(df) for o in others)


def raw_build(spark, tmp_path):
    (tmp_path / "gdp.csv").write_text("country,2019,2020\nChina,1,2\nGermany,3,\nWorld,9,9\n")
    (tmp_path / "trade.csv").write_text("iso3,time,export_value\n" + "".join(f"{c},2019-{m:02d},{m}\n" for c in ("CHN", "DEU") for m in range(1, 13)))
    raws = [record.raw(spark, n, str(tmp_path / f"{n}.csv"), license="cc-by") for n in ("gdp", "trade")]
    config = build.Config(("gdp", "trade"), "country", ("country", "year"), methods={"export_value": "sum"}, derived=(("share", "export_value / value_i1"),))
    return config, raws


def test_a_package_is_rebuilt_from_its_raw_files(spark, tmp_path):
    config, raws = raw_build(spark, tmp_path)
    log = {r["step"]: r for r in record.export(config, raws, spark, str(tmp_path / "p"), {"gdp": {"country": "China"}}).collect()}
    assert [(s, log[s]["rows_before"], log[s]["rows_after"]) for s in ("load_gdp", "filter_gdp", "canonical_gdp", "annual_trade", "join_trade")] == [("load_gdp", None, 3), ("filter_gdp", 3, 1), ("canonical_gdp", 3, 2), ("annual_trade", 24, 2), ("join_trade", 2, 1)]
    assert log["load_trade"]["sha256"] == raws[1].sha256
    assert [tuple(r) for r in record.rebuild(spark, str(tmp_path / "p")).select("iso3", "year", "value_i1", "export_value", "share").collect()] == [("CHN", 2019, 1.0, 78.0, 78.0)]
    assert "rows_after" in json.loads((tmp_path / "p" / "provenance" / "operations.jsonl").read_text().splitlines()[0])

    stored = tmp_path / "p" / "metadata" / "build.json"
    kept = stored.read_text()
    (stored.parent / ".build.json.crc").unlink(missing_ok=True)
    stored.write_text(kept.replace('"export_value": "sum"', '"export_value": "max"'))  # a changed step changes a row
    with pytest.raises(EngineError, match="rebuilt"):
        record.rebuild(spark, str(tmp_path / "p"))
    stored.write_text(kept)
    (tmp_path / "gdp.csv").write_text("country,2019\nChina,7\n")
    with pytest.raises(EngineError, match="has changed"):
        record.rebuild(spark, str(tmp_path / "p"))


def test_the_script_of_a_package_rebuilds(spark, tmp_path):
    config, raws = raw_build(spark, tmp_path)
    record.export(config, raws, spark, str(tmp_path / "p"))
    done = subprocess.run([sys.executable, str(tmp_path / "p" / "scripts" / "reproduce.py")], capture_output=True, text=True, check=False, timeout=300, cwd="/root/repo", env={**__import__("os").environ, "PYTHONPATH": "/root/repo"})
    assert "repeated" in done.stdout, done.stderr[-2000:]
    assert spark.read.parquet(str(tmp_path / "p" / "data" / "repeated.parquet")).count() == 2


def test_conflicts_follow_from_sets(spark):
    inputs = {
        "a": [Meaning("gdp", unit="usd", price_basis="nominal", currency="CNY"), Meaning("rate", unit="percent"), Meaning("sex", unit="code", coding={"0": "male", "1": "female"}), Meaning("n", unit="count", frequency="annual")],
        "b": [Meaning("gdp", unit="usd", price_basis="real", base_year=2015, currency="USD"), Meaning("rate", unit="fraction"), Meaning("sex", unit="code", coding={"M": "male", "F": "female"}), Meaning("n", unit="count", frequency="monthly")],
        "c": [Meaning("gdp", unit="usd", price_basis="real"), Meaning("alone"), Meaning("sex", unit="code", coding={"9": "other"})],
    }
    found = {(s, v, f) for s, v, f, _ in semantics.scan(semantics.declared(spark, inputs))}
    assert found == {("blocking", "gdp", "price_basis"), ("blocking", "gdp", "currency"), ("conversion", "rate", "unit"), ("blocking", "sex", "coding"), ("warning", "n", "frequency")}
    frame = spark.createDataFrame([("CHN", 2019, 1.0)], "iso3 string, year int, gdp double")
    with pytest.raises(EngineError, match="price_basis"):
        build.run(build.Config(("a",), "country", ("country", "year")), {"a": frame}, meanings=semantics.declared(spark, inputs))


def test_digest_of_a_half_does_not_hang_on_its_last_bit(spark):
    halves = [134217728.15, 223456789.45, 312345678.05]
    df, up, down = (spark.createDataFrame([(math.nextafter(x, to) if to else x,) for x in halves], "v double") for to in (None, math.inf, -math.inf))
    assert record.digest(df) == record.digest(up) == record.digest(down)
