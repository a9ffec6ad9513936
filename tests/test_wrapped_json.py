"""Wrapped JSON payloads of any size keep every record and column."""

import json

import pytest

from loomframe.errors import EngineError
from loomframe.sources import readers


def put(tmp_path, data):
    path = tmp_path / "w.json"
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


@pytest.mark.parametrize("n", [3, 60_000])
def test_columns_of_later_records_and_large_payloads_are_kept(spark, tmp_path, n):
    records = [{"a": i, "name": "x" * 20} for i in range(n - 1)] + [{"a": n, "late": 1.5}]
    df = readers.read_json(spark, put(tmp_path, [{"page": 1}, records])).df
    assert sorted(df.columns) == ["a", "late", "name"] and df.count() == n
    assert [tuple(r) for r in df.filter("late is not null").select("a", "late", "name").collect()] == [(n, 1.5, None)]


def test_a_payload_without_records_is_one_value(spark, tmp_path):
    df = readers.read_json(spark, put(tmp_path, [{"page": 1}, []])).df
    assert df.columns == ["value"] and df.count() == 1


def test_what_is_no_json_is_refused(spark, tmp_path):
    with pytest.raises(EngineError):
        readers.read_json(spark, put(tmp_path, '[{"page": 1}, [{"a": 1}'))
