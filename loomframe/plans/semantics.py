"""Conflicts between variables of one name over any number of inputs, from sets and not from pairs.

Each input states facets of its variables (unit, currency, price basis, base year, coding, frequency,
population), declared by a person or taken from a profile.  One aggregate by variable and facet
collects the distinct values; more than one is a conflict, a conversion or a warning.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units

FACETS = ("unit", "price_basis", "base_year", "currency", "frequency", "population", "coding")
#: Facets whose differences need a decision but don't forbid a common column.
MILD = ("frequency", "population")
STATED = "input string, variable string, facet string, value string"


def declared(spark: SparkSession, inputs: Mapping[str, Sequence[units.Meaning]]) -> DataFrame:
    """(input, variable, facet, value) of what is stated; what is unknown is left out but for units, which must be known."""
    rows = []
    for name, meanings in inputs.items():
        for m in meanings:
            for facet in FACETS:
                value = getattr(m, facet)
                value = units.unit_name(value) if facet == "unit" else json.dumps(dict(value), sort_keys=True, ensure_ascii=False) if facet == "coding" and value else value
                if facet == "unit" or value not in ("UNKNOWN", None, "", {}):
                    rows.append((name, m.name, facet, str(value)))
    return spark.createDataFrame(rows, STATED)


def profiled(name: str, profile: DataFrame) -> DataFrame:
    """The same from a profile's hints, which tell units alone."""
    return profile.filter("unit_hint is not null").select(F.lit(name).alias("input"), F.col("column_name").alias("variable"), F.lit("unit").alias("facet"), F.col("unit_hint").alias("value"))


def differences(stated: DataFrame) -> DataFrame:
    """(variable, facet, found, inputs, severity): facets with more than one value; shares of 1 and of 100 convert."""
    sets = stated.groupBy("variable", "facet").agg(F.sort_array(F.collect_set("value")).alias("found"), F.sort_array(F.collect_set("input")).alias("inputs")).filter(F.size("found") > 1)
    convert = (F.col("facet") == "unit") & (F.col("found") == F.array(F.lit("fraction"), F.lit("percent")))
    severity = F.when(convert, "conversion").when(F.col("facet").isin(*MILD), "warning").when(F.col("facet") == "coding", "recode").otherwise("blocking")
    return sets.withColumn("severity", severity)


def scan(stated: DataFrame) -> list[tuple[str, str, str, str]]:
    """(severity, variable, facet, message) of every difference, a few for each variable; codings that can't be mapped are blocking."""
    out = []
    for r in differences(stated).orderBy("variable", "facet").collect():
        severity = r["severity"]
        if severity == "recode":
            first, *rest = map(json.loads, r["found"])
            severity = "conversion" if all(len(units.align_codings(c, first)) == len(c) for c in rest) else "blocking"
        out.append((severity, r["variable"], r["facet"], f"{', '.join(r['inputs'])}: {'; '.join(r['found'])}"))
    return out
