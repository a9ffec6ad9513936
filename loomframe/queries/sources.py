"""Round trips through file formats, format detection, lineage and packages."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..operators import validate
from ..registry import query, table
from ..sources import payload, readers, sinks

NATION_SQL = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _scratch(spark) -> str:
    """A new folder in the shared one where the session names it, else a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        return tempfile.mkdtemp(prefix="loomframe-")
    import uuid

    return f"{shared.rstrip('/')}/loomframe-{uuid.uuid4().hex}"


def _nation(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1)  # 25 rows


def _typed(df):
    return df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query(NATION_SQL)
def scan_json_wrapped(spark, sf):
    """A payload [meta, [records]] in one file, as providers send it, unwrapped by the reader."""
    path = f"{_scratch(spark)}/nation"
    record = F.struct("n_nationkey", "n_name", "n_regionkey")
    body = F.concat(F.lit('[{"page": 1}, '), F.to_json(F.collect_list(record)), F.lit("]"))
    _nation(spark, sf).agg(body.alias("value")).coalesce(1).write.text(path)
    return _typed(readers.read(spark, path).df)


@query(NATION_SQL)
def scan_html_table(spark, sf):
    """An HTML page's table, decoded by the task that reads the page."""
    path = f"{_scratch(spark)}/nation"
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>")) for c in ("n_nationkey", "n_name", "n_regionkey")], F.lit("</tr>"))
    body = F.concat(F.lit("<html><table><tr><th>n_nationkey</th><th>n_name</th><th>n_regionkey</th></tr>"), F.array_join(F.collect_list(cells), ""), F.lit("</table></html>"))
    _nation(spark, sf).agg(body.alias("value")).coalesce(1).write.text(path)
    return _typed(readers.read(spark, path).df)


@query(NATION_SQL)
def scan_gzip(spark, sf):
    path = f"{_scratch(spark)}/nation"
    _nation(spark, sf).write.option("header", True).option("compression", "gzip").csv(path)
    return _typed(readers.read(spark, path).df)


@query(NATION_SQL)
def scan_csv_roundtrip(spark, sf):
    path = f"{_scratch(spark)}/nation"
    sinks.export(_nation(spark, sf), "csv", path)
    return _typed(readers.read(spark, path).df)


@query(NATION_SQL)
def scan_tsv_roundtrip(spark, sf):
    path = f"{_scratch(spark)}/nation"
    _nation(spark, sf).write.option("sep", "\t").option("header", True).csv(path)
    return _typed(readers.read(spark, path).df)


@query(NATION_SQL)
def scan_jsonl_roundtrip(spark, sf):
    path = f"{_scratch(spark)}/nation"
    sinks.export(_nation(spark, sf), "json", path)
    return _typed(readers.read(spark, path).df)


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_flatten(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, user_id FROM events")
def scan_json_records(spark, sf):
    """Wrapped payloads, one for each user, unwrapped to records."""
    record = F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    wrapped = table(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(record).alias("data"))).alias("body"))
    parsed = wrapped.select("user_id", F.from_json("body", "data array<struct<event_id: long, k: long>>").alias("p"))
    return parsed.select("user_id", F.inline("p.data"))


@query("SELECT event_id, user_id, event_type, (props->>'$.k')::BIGINT AS k FROM events")
def scan_payload_shapes(spark, sf):
    """A provider's answer for each user's events, in five shapes; the records are found by their shape and typed together."""
    record = F.struct("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    users = table(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.collect_list(record)).alias("list"))
    shapes = ['{"page": 1, "data": %s}', '[{"page": 1}, %s]', '{"total": 9, "value": {"items": %s}}', '{"data": {"records": %s}}', "%s"]
    body = F.element_at(F.array(*[F.format_string(s, "list") for s in shapes]), (F.pmod("user_id", F.lit(len(shapes))) + 1).cast("int"))
    return payload.typed(payload.explode_records(users.select("user_id", body.alias("body")), "body"))


@query("SELECT o_orderkey::BIGINT AS o_orderkey, '订单，' || o_orderpriority || chr(10) || '\"' || (o_custkey % 7) || '\"' AS note, o_totalprice::DOUBLE AS o_totalprice FROM orders")
def scan_gbk_orders(spark, sf):
    """All orders as GBK text with line breaks and quotes inside cells, read back by splits: encoding, quotes and types are found by the reader."""
    path = f"{_scratch(spark)}/orders"
    note = F.concat(F.lit("订单，"), "o_orderpriority", F.lit('\n"'), (F.col("o_custkey") % 7).cast("string"), F.lit('"'))
    rows = table(spark, sf, "orders").select("o_orderkey", note.alias("note"), "o_totalprice")
    sinks.write_encoded_csv(rows, path, "gbk")
    return readers.read(spark, path).df


@query("SELECT n_nationkey::BIGINT AS cell, n_regionkey::DOUBLE AS value, (n_nationkey // 5)::BIGINT AS a, (n_nationkey % 5)::BIGINT AS b FROM nation")
def json_stat_cells(spark, sf):
    rows = table(spark, sf, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("double")))).alias("value"))
    cube = rows.select("value", F.array(F.lit("a"), F.lit("b")).alias("id"), F.array(F.lit(5), F.lit(5)).alias("size"))
    cells = readers.json_stat(cube)
    at = lambda d: F.col("coordinates")[d].cast("long")
    return cells.select((at("a") * 5 + at("b")).alias("cell"), "value", at("a").alias("a"), at("b").alias("b"))


@query("SELECT format, count(*) AS n FROM (SELECT (['json', 'html', 'csv', 'tsv', 'xml'])[(event_id % 5 + 1)::INT] AS format FROM events) GROUP BY 1")
def sniff_formats(spark, sf):
    from ..sources.sniff import sniffed

    heads = [F.concat(F.lit("[1, "), F.col("event_id").cast("string"), F.lit("]")), F.lit("<!DOCTYPE html><p>"), F.lit("a,b\n1,2"), F.lit("a\tb\n1\t2"), F.lit("<?xml version='1.0'?><r/>")]
    head = F.element_at(F.array(*heads), (F.col("event_id") % 5 + 1).cast("int")).cast("binary")
    return table(spark, sf, "events").select(sniffed(head).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('spent', 'orders', 'o_totalprice', 'aggregate'), ('year', 'orders', 'o_orderdate', 'time'), ('o_custkey', 'orders', 'o_custkey', 'key')) t(column_name, source, source_column, operation)")
def lineage_columns(spark, sf):
    log = sinks.OperationLog()
    log.derived("spent", "orders", ["o_totalprice"], "aggregate")
    log.derived("year", "orders", ["o_orderdate"], "time")
    log.derived("o_custkey", "orders", ["o_custkey"], "key")
    return log.lineage_table(spark)


@query("SELECT 'final' AS part, count(DISTINCT (o_custkey, year(o_orderdate))) AS n_rows FROM orders")
def package_export(spark, sf):
    """A yearly panel with its package; returns the rows of the exported table, read back."""
    folder = f"{_scratch(spark)}/package"
    panel = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    log = sinks.OperationLog()
    log.record("aggregate", {"by": ["o_custkey", "year"], "spent": "sum"})
    log.derived("spent", "orders", ["o_totalprice"], "aggregate")
    sinks.export_package(panel, folder, log, validate.check_keys(panel, ["o_custkey", "year"]))
    return spark.read.parquet(f"{folder}/data/final.parquet").agg(F.lit("final").alias("part"), F.count("*").alias("n_rows"))
