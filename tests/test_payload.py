"""Records of JSON payloads of every shape, and delimited text in encodings, splits and quotes."""

import io
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe.sources import delimited, payload, readers

R = [{"a": 1}, {"a": 2}]
SHAPES = [
    (R, R), ({"page": 1, "data": R}, R), ([{"page": 1}, R], R), ([{"page": 1, "rows": R}, {"page": 2, "rows": [{"a": 3}]}], R), ({"data": {"records": R}}, R), ({"total": 2, "value": {"items": R}}, R),
    ({"meta": {"page": 1}, "value": {"items": R}}, [{"page": 1}]), ([{"page": 1}, {"x": 2}, R], R), ({"z": {"list": R}, "b": {"list": [{"a": 9}]}}, R), ({"a": 1}, [{"a": 1}]), ({"observations": [], "obs": R}, R),
    ([1, 2], [{"value": [1, 2]}]), (3, [{"value": 3}]), ("x", [{"value": "x"}]), ([], [{"value": []}]), ([[1], [2]], [{"value": [[1], [2]]}]), ({"data": [1, 2], "n": 5}, [{"data": [1, 2], "n": 5}]),
    ({"a": {"b": {"c": {"d": R}}}}, R), ({"a": {"b": {"c": {"d": {"e": {"f": R}}}}}}, [{"e": {"f": R}}]), ({"x": {"data": [{"value": 1}]}}, [{"x": {"data": [{"value": 1}]}}]), ({"results": R, "data": [{"a": 7}]}, [{"a": 7}]),
    ([{"k": 1}, {"k": 2, "tags": [{"t": 1}]}], [{"t": 1}]), ([{"k": 1, "z": [{"first": 1}], "b": [{"second": 1}]}], [{"first": 1}]), ([None, R], R), ([{"a": 1}, None], [{"value": [{"a": 1}, None]}]), ({"it's": {"q": R}}, R),
]


def test_every_shape(spark):
    docs = spark.createDataFrame([(i, json.dumps(data)) for i, (data, _) in enumerate(SHAPES)], "i int, body string")
    got: dict[int, list] = {}
    for r in payload.explode_records(docs, "body").select("i", F.to_json("record").alias("j")).collect():
        got.setdefault(r["i"], []).append(json.loads(r["j"]))
    assert {i: got[i] for i in sorted(got)} == {i: want for i, (_, want) in enumerate(SHAPES)}


def test_schema_of_all_records(spark):
    docs = spark.createDataFrame([('{"data": [{"a": 1, "n": null, "o": {}, "m": 1}, {"a": 2.5, "l": [1, 2.5], "m": "x", "a b": {"c": true}}]}',), (None,), ("{broken",)], "body string")
    df = payload.typed(payload.explode_records(docs, "body"))
    rows = [r.asDict(True) for r in df.collect()]
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {"a": "double", "a b": "struct<c:boolean>", "l": "array<double>", "m": "string", "n": "string", "o": "string"}
    assert rows[0] == {"a": 1.0, "a b": None, "l": None, "m": "1", "n": None, "o": "{}"}
    assert rows[1] == {"a": 2.5, "a b": {"c": True}, "l": [1.0, 2.5], "m": "x", "n": None, "o": None}


TABLE = "city,code,note,rate\r\n北京,110000,首都,1.5\r\n上海,310000,,\r\n"


@pytest.mark.parametrize(("encoding", "named"), [("gbk", "gbk"), ("gb18030", "gbk"), ("utf-8", "utf-8"), ("utf-8-sig", "utf-8")])
@pytest.mark.parametrize("preamble", ["", 'A "note\r\n说明\r\n'])
def test_chinese_text(spark, tmp_path, encoding, named, preamble):
    (tmp_path / "c.csv").write_bytes((preamble + TABLE).encode(encoding))
    found = readers.read(spark, str(tmp_path / "c.csv"))
    assert found.meta == {"encoding": named, "separator": ",", "skipped_lines": 2 if preamble else 0, "surplus_rows": 0}
    assert [f.dataType.simpleString() for f in found.df.schema] == ["string", "bigint", "string", "double"]
    assert sorted(map(tuple, found.df.collect())) == sorted([("北京", 110000, "首都", 1.5), ("上海", 310000, None, None)])


def test_rare_characters_and_latin(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("a,b\n㐂𠀀,1\n".encode("gb18030"))
    found = readers.read(spark, str(tmp_path / "g.csv"))
    assert (found.meta["encoding"], [tuple(r) for r in found.df.collect()]) == ("gb18030", [("㐂𠀀", 1)])
    for text in ("name,x\nCafé,1\n", "x,name\n1,é", "x,name\n1," + "z" * 70_000 + "é,\n"):
        (tmp_path / "l.csv").write_bytes(text.encode("latin-1"))
        found = readers.read(spark, str(tmp_path / "l.csv"))
        assert found.meta["encoding"] == "latin-1"
        assert "é" in "".join(str(v) for r in found.df.collect() for v in r) or found.meta["surplus_rows"] == 1


def test_quotes_surplus_and_blanks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('k,v\n1,"x\ny"\n2,z\n\n3,a,b\n4\n5,"say ""hi"""\n')
    found = readers.read(spark, str(tmp_path / "q.csv"))
    assert sorted(map(tuple, found.df.collect())) == [(1, "x\ny"), (2, "z"), (4, None), (5, 'say "hi"')]
    assert found.meta["surplus_rows"] == 1


@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_splits_agree_with_pandas(spark, tmp_path, encoding):
    rng = random.Random(8)
    rows = [[str(i), str(rng.random()), "".join(rng.choices(["a", "，", "\n", '"', ",", "\r\n", " ", "字"], k=rng.choice([0, 3, 9, 400]))), rng.choice(["True", "False", ""]), rng.choice(["x", "NA"])] for i in range(1500)]
    frame = pd.DataFrame(rows, columns=["i", "f", "text", "flag", "mixed"])
    body = frame.to_csv(index=False).encode(encoding)
    (tmp_path / "s.csv").write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = readers.read(spark, str(tmp_path / "s.csv"))
        assert delimited.lines(spark, str(tmp_path / "s.csv")).select("start").distinct().count() > 50
        got = sorted(found.df.collect(), key=lambda r: r["i"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = pd.read_csv(io.BytesIO(body), encoding=encoding, float_precision="round_trip")
    assert [f.dataType.simpleString() for f in found.df.schema] == ["bigint", "double", "string", "boolean", "string"]
    clean = lambda v: None if pd.isna(v) else v
    assert [tuple(r) for r in got] == [tuple(map(clean, r)) for r in want.itertuples(index=False)]


def test_parts_of_a_folder_share_a_schema(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\n1,2\n3,4\n")
    (folder / "b.csv").write_text("k,v\n5,x\n")
    (folder / "c.csv").write_text("v,k,w\ny,6,0.5\n")
    found = readers.read(spark, str(folder))
    assert found.df.columns == ["k", "v", "w"]
    assert sorted(map(tuple, found.df.collect())) == [(1, "2", None), (3, "4", None), (5, "x", None), (6, "y", 0.5)]
    (folder / "a.csv").write_text("k,k,\n")
    assert readers.read(spark, str(folder / "a.csv")).df.columns == ["k", "k.1", "Unnamed: 2"]
