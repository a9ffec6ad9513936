"""Readers by content, archives, sinks and packages on small files."""

import gzip
import json
import os
import sqlite3
import subprocess
import sys
import zipfile

import pandas as pd
import pytest

from loomframe.errors import EngineError
from loomframe.operators import validate
from loomframe.sources import readers, sinks
from loomframe.sources.archive import guard_raw, ingest, safe_extract
from loomframe.sources.sniff import sniff, sniff_files


def rows(source):
    return sorted(tuple(r) for r in source.df.collect())


@pytest.fixture
def put(tmp_path):
    def write(name, data):
        path = tmp_path / name
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)

    return write


def test_delimited(spark, put):
    assert rows(readers.read(spark, put("a.csv", "iso3,year,gdp\nUSA,2015,1.5\nCHN,2016,\n"))) == [("CHN", 2016, None), ("USA", 2015, 1.5)]
    tsv = readers.read(spark, put("a.dat", "name\tvalue\nx\t1.0\ny\t2.5\n"))
    assert tsv.fmt == "tsv" and rows(tsv) == [("x", 1.0), ("y", 2.5)]
    noted = readers.read(spark, put("b.csv", "A note\nAnother\na,b,c,d\n1,2,3,4\n5,6,7,8\n"))
    assert noted.meta["skipped_lines"] == 2 and noted.df.columns == ["a", "b", "c", "d"] and noted.df.count() == 2


def test_json_kinds(spark, put):
    assert rows(readers.read(spark, put("a.json", json.dumps([{"id": 1, "v": "a"}, {"id": 2, "v": "b"}])))) == [(1, "a"), (2, "b")]
    lines = readers.read(spark, put("a.jsonl", '{"i": 1, "o": {"val": 0.5}}\n{"i": 2, "o": {"val": 1.5}}\n'))
    assert lines.fmt == "jsonl" and lines.df.columns == ["i", "o.val"]
    wrapped = readers.read(spark, put("w.json", json.dumps({"page": 1, "data": [{"a": 1}, {"a": 2}]})))
    assert rows(wrapped) == [(1,), (2,)]
    paged = readers.read(spark, put("p.json", json.dumps([{"page": 1}, [{"a": 1}, {"a": 3}]])))
    assert sorted(r["a"] for r in paged.df.collect()) == [1, 3]


def test_content_wins_over_the_name(spark, put):
    page = put("data.csv", "<!DOCTYPE html><html><table><tr><th>country</th><th>rate</th></tr><tr><td>US</td><td>1</td></tr></table></html>")
    assert sniff(page) == "html" and rows(readers.read(spark, page)) == [("US", "1")]
    formats = {r["file"]: r["format"] for r in sniff_files(spark, os.path.dirname(page)).collect()}
    assert formats["data.csv"] == "html"


def test_binary_kinds(spark, put, tmp_path):
    db = str(tmp_path / "x.bin")
    with sqlite3.connect(db) as con:
        con.execute("create table observations(country text, year int, value real)")
        con.executemany("insert into observations values (?, ?, ?)", [("US", 2015, 1.0), ("CN", 2016, None)])
    got = readers.read(spark, db)
    assert got.fmt == "sqlite" and rows(got) == [("CN", 2016, None), ("US", 2015, 1.0)]
    stata = str(tmp_path / "x.dta")
    pd.DataFrame({"gender": [1, 2], "income": [1.5, 2.5]}).to_stata(stata, write_index=False, variable_labels={"income": "Income"})
    got = readers.read(spark, stata)
    assert got.meta["variable_labels"]["income"] == "Income" and got.df.count() == 2
    packed = put("x.csv.gz", gzip.compress(b"a,b\n1,2\n"))
    assert rows(readers.read(spark, packed)) == [(1, 2)]
    geo = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"city": "X", "code": 1}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}
    got = readers.read(spark, put("p.geojson", json.dumps(geo))).df.first()
    assert got["city"] == "X" and got["_geometry_type"] == "Point"


def test_unsupported_formats_have_a_code(spark, put):
    with pytest.raises(EngineError) as e:
        readers.read(spark, put("a.sav", b"$FL2" + b"\0" * 100))
    assert e.value.code == "PARSE_UNSUPPORTED_FORMAT"


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return str(path)


def test_archives(spark, tmp_path):
    path = zipped(tmp_path / "a.zip", {"metadata.csv": "k,v\n" + "x,1\n" * 100, "data.csv": "a,b\n1,2\n3,4\n"})
    assert rows(readers.read(spark, path)) == [(1, 2), (3, 4)]
    for members, most in (({"../evil.txt": "x"}, 10), ({}, 10), ({f"{i}.txt": "x" for i in range(5)}, 4)):
        with pytest.raises(EngineError) as e:
            safe_extract(zipped(tmp_path / "bad.zip", members), str(tmp_path / "out"), most)
        assert e.value.code == "ARCHIVE_UNSAFE"


def test_raw_files_are_kept(tmp_path, put):
    raw = str(tmp_path / "raw")
    place = ingest(put("a.csv", "a,b\n1,2\n"), raw)
    assert ingest(put("a.csv", "a,b\n1,2\n"), raw) == place and not os.stat(place).st_mode & 0o222
    with pytest.raises(EngineError):
        guard_raw(place, raw)
    with pytest.raises(EngineError):
        ingest(put("b.csv", "<html><body>log in</body></html>"), raw)


def test_worksheet_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    df = spark.createDataFrame([("a & <b>", 1.5, None), ("c", None, "2")], "name string, x double, y string")
    sinks.write_xlsx(df, path)
    got = readers.read(spark, path)
    assert got.fmt == "xlsx" and got.meta["sheets"] == ["data"]
    assert sorted(r["name"] for r in got.df.collect()) == ["a & <b>", "c"] and got.df.columns == ["name", "x", "y"]


def test_package(spark, tmp_path):
    df = spark.createDataFrame([("USA", 2015, 1.0), ("CHN", 2015, 2.0)], "iso3 string, year int, gdp double")
    log = sinks.OperationLog()
    log.record("load", {"path": "a.csv"}, None, 2)
    log.derived("gdp", "a.csv", ["gdp"], "load")
    made = sinks.export_package(df, str(tmp_path / "p"), log, validate.check_keys(df, ["iso3", "year"]))
    assert all((tmp_path / "p" / m).exists() for m in made)
    assert "KEY_UNIQUE" in (tmp_path / "p/reports/quality_report.html").read_text()
    assert json.loads((tmp_path / "p/metadata/manifest.json").read_text())["sha256"]
    compile((tmp_path / "p/scripts/reproduce.py").read_text(), "reproduce.py", "exec")


def test_exports_have_codes(spark, tmp_path):
    with pytest.raises(EngineError) as e:
        sinks.export(spark.range(1), "docx", str(tmp_path / "x"))
    assert e.value.code == "EXPORT_UNSUPPORTED_FORMAT"
    assert subprocess.run([sys.executable, "-c", "import loomframe.sources.sinks"], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_short_rows_and_rows_like_the_header_are_kept(spark, tmp_path):
    plain = tmp_path / "plain.csv"
    plain.write_text("a,b\n1,2\n3\n4,5\n")
    assert sorted(tuple(r) for r in readers.read_delimited(spark, str(plain)).df.collect()) == [(1, 2), (3, None), (4, 5)]
    preamble = tmp_path / "preamble.csv"
    preamble.write_text("About these data\nSource: none\na,b,c,d\n1,2,3,4\na,b,c,d\nSource: none\n5,6,7,8\n")
    rows = [tuple(r) for r in readers.read_delimited(spark, str(preamble)).df.collect()]
    assert ("a", "b", "c", "d") in rows and len(rows) == 4


def test_long_nested_values_are_compared_whole(spark):
    from loomframe.operators import validate

    rows = spark.createDataFrame([([1] * 600 + [2],), ([1] * 600 + [3],)], "v array<int>")
    assert validate.check_duplicates(rows).count() == 0 and validate.check_constant(rows).count() == 0
