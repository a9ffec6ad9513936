"""Records of JSON payloads, found in variants: wrapped lists and objects of any shape, many documents at once.

A document is parsed once into a variant.  Column functions look for the list of records: the
first list of objects within a list or one level below it, else the list itself; in an object
under one of RECORD_KEYS, else under the first key, in the document's order, that leads to
records; a lone object is a record; anything else is one record with the column ``value``.
Records are exploded as variants, and their schema is the merged schema of all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_KEYS = ("data", "records", "results", "rows", "observations")
#: Levels below which a payload counts as one value.
DEPTH = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _records(v: Column) -> Column:
    """The elements of a list of objects, null for anything else."""
    return _let(_list(v), lambda a: F.when((F.size(a) > 0) & F.forall(a, _is_object), a))


def _first(found: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda r: r.isNotNull()), F.lit(1))


def _values(v: Column, text: Column) -> Column:
    """(at, key, v) of an object's keys, in the order of its text where that is known."""
    both = F.struct(_object(v).alias("m"), F.json_object_keys(text).alias("keys"))
    return _let(both, lambda s: F.array_sort(F.transform(F.map_entries(s["m"]), lambda e: F.struct(F.array_position(F.coalesce(s["keys"], F.map_keys(s["m"])), e["key"]).alias("at"), e["key"].alias("key"), e["value"].alias("v"))), lambda a, b: F.signum(a["at"] - b["at"]).cast("int")))


def _value(v: Column) -> Column:
    return F.array(F.call_function("to_variant_object", F.struct(v.alias("value"))))


def _in_list(v: Column, text: Column) -> Column:
    def found(a: Column) -> Column:
        holds = lambda x: F.when(_is_object(x), F.exists(F.map_values(_object(x)), lambda y: _records(y).isNotNull())).otherwise(_records(x).isNotNull())
        return _let(F.array_position(F.transform(a, lambda x: F.coalesce(holds(x), F.lit(False))), True), lambda at: F.when(at > 0, here(a, at)))

    def here(a: Column, at: Column) -> Column:
        item = F.call_function("get_json_object", text, F.concat(F.lit("$["), (at - 1).cast("string"), F.lit("]")))
        return _let(F.try_element_at(a, at.cast("int")), lambda x: F.coalesce(_records(x), _first(F.transform(_values(x, item), lambda e: _records(e["v"])))))

    return _let(_list(v), lambda a: F.coalesce(found(a), _records(v), _value(v)))


def _in_object(v: Column, text: Column, depth: int) -> Column:
    direct = _first(F.array(*[_records(F.try_variant_get(v, f"$.{k}", "variant")) for k in RECORD_KEYS]))
    child = lambda k: F.call_function("get_json_object", text, F.concat(F.lit("$['"), k, F.lit("']")))
    lone = lambda r: (F.size(r) == 1) & F.array_contains(F.map_keys(_object(r[0])), "value")
    below = F.filter(F.transform(_values(v, text), lambda e: records_of(e["v"], child(e["key"]), depth + 1)), lambda r: ~lone(r))
    return F.coalesce(direct, F.try_element_at(below, F.lit(1)), F.array(v))


def records_of(v: Column, text: Column, depth: int = 0) -> Column:
    """The records of a payload, as an array of variants; ``text`` is what ``v`` was parsed from."""
    if depth > DEPTH:
        return _value(v)
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("ARRAY"), _in_list(v, text)).when(kind.startswith("OBJECT"), _in_object(v, text, depth)).otherwise(_value(v))


def explode_records(docs: DataFrame, body: str, record: str = "record") -> DataFrame:
    """A row for each record of each document's payload, beside the other columns; null and broken documents have none."""
    parsed = docs.withColumn(record, F.try_parse_json(body)).filter(F.col(record).isNotNull())
    return parsed.withColumn(record, F.explode(records_of(F.col(record), F.col(body)))).drop(body)


def _plain(kind: T.DataType) -> T.DataType:
    """Fractions as doubles; values of several kinds as their text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in kind]) if len(kind) else T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(kind, (T.VariantType, T.NullType)) else kind


def schema_of(records: DataFrame, record: str = "record") -> T.StructType:
    """The schema that all records share."""
    found = records.agg(F.schema_of_variant_agg(record)).first()[0] or "VOID"
    ddl = "`".join(part if k % 2 else part.replace("OBJECT<>", "VARIANT").replace("OBJECT<", "STRUCT<") for k, part in enumerate(found.split("`")))
    kind = T.DataType.fromDDL(ddl) if ddl.startswith("STRUCT<") else None
    return _plain(kind) if kind else T.StructType([])


def typed(records: DataFrame, record: str = "record", schema: T.StructType | None = None) -> DataFrame:
    """The records' fields as columns beside the other columns."""
    schema = schema_of(records, record) if schema is None else schema
    rest = [F.col(f"`{c}`") for c in records.columns if c != record]
    return records.select(*rest, F.col(record).cast(schema).alias(record)).select(*rest, f"{record}.*") if len(schema) else records.select(*rest)
