"""When each request may go: at its arrival, but at least a gap after the one before it of the same domain.

start(i) = max(arrival(i), start(i - 1) + gap) unrolls to i * gap + max over j <= i of
(arrival(j) - j * gap): a sum and a running maximum, which combine over any cut of a domain's
requests.  Each step of a domain (an hour, say) sums up to its number of requests and its maximum;
these run over the domain's steps, and the rest within each step, so a busy domain is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paced(rows: DataFrame, domain: str, arrival: str, gap: Column, step: Column, order: Sequence[str] = (), out: str = "start") -> DataFrame:
    """``rows`` with the time at which each may go; ``arrival`` and ``gap`` are numbers of one unit, ``step`` a coarser form of ``arrival``."""
    own = Window.partitionBy("_domain", "_step").orderBy(arrival, *order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.withColumn("_domain", F.coalesce(F.col(domain).cast("string"), F.lit(""))).withColumn("_step", step).withColumn("_gap", gap.cast("double"))
    at = at.withColumn("_k", F.row_number().over(own)).withColumn("_lead", F.col(arrival).cast("double") - F.col("_k") * F.col("_gap"))
    steps = at.groupBy("_domain", "_step").agg(F.count("*").alias("_n"), F.max("_lead").alias("_m"), F.max("_gap").alias("_g"))
    ahead = Window.partitionBy("_domain").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)  # a row for each step
    steps = steps.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    steps = steps.withColumn("_top", F.max(F.col("_m") - F.col("_before") * F.col("_g")).over(ahead)).select(F.col("_domain").alias("_d"), F.col("_step").alias("_s"), "_before", "_top")
    met = at.join(steps, (F.col("_domain") == F.col("_d")) & (F.col("_step") == F.col("_s")))
    top = F.greatest(F.col("_top"), F.max("_lead").over(upto) - F.col("_before") * F.col("_gap"))
    return met.withColumn(out, top + (F.col("_before") + F.col("_k")) * F.col("_gap")).select(*rows.columns, out)
