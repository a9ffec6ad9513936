"""Units of measure: their names, conversions, and comparison of two variables' meanings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

# Names of units.
SYNONYMS = {
    "percent": {"percent", "percentage", "%", "pct", "rate_pct", "百分比"},
    "fraction": {"fraction", "ratio", "share", "proportion", "比例"},
    "usd": {"usd", "us_dollar", "constant_usd", "current_usd", "dollar"},
    "local_currency": {"lcu", "local_currency", "national_currency"},
}
FACTORS = {("percent", "fraction"): 0.01, ("fraction", "percent"): 100.0, ("percent", "percentage_point"): 1.0}


def unit_name(raw: str | None) -> str:
    text = (raw or "").strip().lower()
    return next((name for name, known in SYNONYMS.items() if text in known), text or "UNKNOWN")


def convert(value: Column, source: str, target: str) -> Column:
    a, b = unit_name(source), unit_name(target)
    if a == b:
        return value
    if (a, b) not in FACTORS:
        raise EngineError("SEMANTIC_CONFLICT", f"no conversion from {source!r} to {target!r}")
    return value / F.lit(100.0) if FACTORS[a, b] == 0.01 else value * F.lit(FACTORS[a, b])


@dataclass(frozen=True)
class Meaning:
    """What a variable measures."""

    name: str
    unit: str = "UNKNOWN"
    frequency: str = "UNKNOWN"
    population: str = "UNKNOWN"
    price_basis: str = "UNKNOWN"
    currency: str = "UNKNOWN"
    base_year: int | None = None
    coding: Mapping[str, str] = field(default_factory=dict)


@dataclass
class Comparison:
    compatible: bool = True
    issues: list[str] = field(default_factory=list)
    conversions: list[str] = field(default_factory=list)


def align_codings(a: Mapping[str, str], b: Mapping[str, str]) -> dict[str, str]:
    """Codes of ``a`` to the codes of ``b`` that share a label, by its first letters where one abbreviates the other."""
    out = {}
    for code, label in a.items():
        for other, meant in b.items():
            x, y = str(label).strip().lower(), str(meant).strip().lower()
            names = {y, str(other).strip().lower()}
            if x in names or any(n and (x.startswith(n) or n.startswith(x)) for n in names):
                out[code] = other
                break
    return out


def compare(a: Meaning, b: Meaning) -> Comparison:
    """Whether two variables can stand in one column, and how to convert the first."""
    out = Comparison()
    ua, ub = unit_name(a.unit), unit_name(b.unit)
    if ua != ub:
        if {ua, ub} == {"percent", "fraction"}:
            out.conversions.append("x * 100" if ua == "fraction" else "x / 100")
        else:
            out.compatible = False
            out.issues.append(f"unit: {a.unit} and {b.unit}")
    for what in ("price_basis", "base_year", "currency", "frequency", "population"):
        x, y = getattr(a, what), getattr(b, what)
        if x != y and not {x, y} & {"UNKNOWN", None, ""}:
            out.issues.append(f"{what}: {x} and {y}")
            out.compatible &= what in ("frequency", "population")
    if a.coding and b.coding and dict(a.coding) != dict(b.coding):
        found = align_codings(a.coding, b.coding)
        if len(found) == len(a.coding):
            out.conversions.append(f"recode {found}")
        else:
            out.compatible = False
            out.issues.append("coding: no full mapping")
    return out
