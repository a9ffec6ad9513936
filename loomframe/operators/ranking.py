"""Scores of candidates, providers and papers, and top-k by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the score's dimensions, trust by kind of source, values of access modes.
WEIGHTS = {"topic": 0.5, "variables": 3.0, "unit": 1.5, "time": 1.5, "geography": 1.0, "source_trust": 1.6, "doi_publication": 0.6, "license": 0.8, "access": 1.2, "documentation": 0.4}
TRUST = {"international": 1.0, "official": 0.9, "academic": 0.7, "nonprofit": 0.6, "community": 0.4, "commercial": 0.3}
RANKS = {"international": 5, "official": 4, "academic": 3, "nonprofit": 3, "community": 2, "commercial": 1}
ACCESS = {"PUBLIC_ANONYMOUS_API": 1.0, "PUBLIC_ANONYMOUS_HTTP": 0.9}
OPEN_LICENSE = r"(?i)cc0|cc-?by(?!-nc|-nd)|pddl|odc-by|public domain|usgov|ogl|etalab|open"


def _map(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def variable_tokens(variable: str) -> tuple[list[str], list[str]]:
    """Tokens that count in hints (the name and its parts of 4 letters) and in descriptions (parts of 5)."""
    parts = variable.lower().split("_")
    return [variable.lower(), *[p for p in parts if len(p) >= 4]], [p for p in parts if len(p) >= 5]


def _covers(variable: str, hints: Column, description: Column) -> Column:
    strong, weak = variable_tokens(variable)
    found = [hints.contains(t) for t in strong] + [description.contains(t) for t in weak]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def score_candidates(df: DataFrame, variables: Sequence[str], unit: str, years: tuple[int, int] | None, geography: Sequence[str]) -> DataFrame:
    """``df`` with the ten dimensions as a struct ``dims``, their weighted mean ``score`` and reasons.

    Expects title, description, hints, unit, year_start, year_end, geography (array), trust,
    doi, license, access and requires_login.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    title, description, hints = low("title"), low("description"), low("hints")
    count = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    in_title = count([F.lit(False) if not (ts := [t for t in v.lower().split("_") if len(t) >= 4]) else F.greatest(*[title.contains(t) for t in ts], F.lit(False)) for v in variables])
    matched = count([_covers(v, hints, description) for v in variables])
    if years:
        s, e = years
        known = F.col("year_start").isNotNull() & F.col("year_end").isNotNull()
        time = F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0), F.least(F.col("year_end"), F.lit(e)) - F.greatest(F.col("year_start"), F.lit(s))) / max(e - s, 1))).otherwise(0.3)
    else:
        time = F.lit(0.3)
    here = F.arrays_overlap("geography", F.array(*[F.lit(g) for g in (*geography, "global", "world")]))
    licence = F.coalesce(F.col("license"), F.lit("UNKNOWN"))
    dims = {
        "topic": F.least(F.lit(1.0), 0.3 * in_title),
        "variables": matched / len(variables) if variables else F.lit(0.5),
        "unit": F.when((F.col("unit") == unit) & (F.col("unit") != ""), 1.0).when(F.col("unit").isin("country", unit), 0.4).otherwise(0.2),
        "time": time,
        "geography": F.when(F.coalesce(here, F.lit(False)), 1.0).otherwise(0.3),
        "source_trust": _map(TRUST, F.col("trust"), 0.4),
        "doi_publication": F.when(F.coalesce(F.col("doi"), F.lit("")) != "", 1.0).otherwise(0.0),
        "license": F.when(licence == "UNKNOWN", 0.0).when(licence.rlike(OPEN_LICENSE), 1.0).otherwise(0.4),
        "access": F.when(F.col("requires_login"), 0.4).otherwise(_map(ACCESS, F.col("access"), 0.4)),
        "documentation": F.least(F.lit(1.0), F.length(description) / 400),
    }
    rounded = {k: F.round(v.cast("double"), 3) for k, v in dims.items()}
    score = sum((WEIGHTS[k] * v for k, v in rounded.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    reasons = F.array_compact(
        F.array(
            F.when(matched > 0, F.concat(F.lit("covers "), matched.cast("string"), F.lit(f" of {len(variables)} variables"))),
            F.when(rounded["time"] >= 0.8, "covers the years asked for"),
            F.when(rounded["source_trust"] >= 0.9, "trusted source"),
            F.when(rounded["license"] == 1.0, "open license"),
        )
    )
    limits = F.array_compact(F.array(F.when(matched < len(variables), "variables missing"), F.when(F.col("requires_login"), "needs an account"), F.when(rounded["license"] == 0.0, "license unknown")))
    return df.withColumns({"dims": F.struct(*[v.alias(k) for k, v in rounded.items()]), "score": F.round(score, 4), "reasons": reasons, "limitations": limits})


def best(df: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def relevance(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.35, "medium").otherwise("low")


def select_providers(df: DataFrame, macro: bool, china: bool, public_only: bool, preferences: Sequence[str] = (), excluded: Sequence[str] = (), topics: Sequence[str] = (), k: int = 6) -> DataFrame:
    """The ``k`` best active providers; expects id, name, category, trust, region, anonymous, searchable, active, position."""
    cat, name = F.col("category"), F.lower("name")
    plus = lambda on, n: F.when(on, n).otherwise(0.0)
    score = 2.0 * _map(RANKS, F.col("trust"), 2)
    if macro:
        score = score + plus(cat == "international_org", 6.0) + plus(cat == "gov", 3.0) - plus(F.col("trust") == "commercial", 1.5)
    if china:
        score = score + plus((cat == "cn") | F.col("region").contains("CN"), 5.0)
    if "unemployment" in topics:
        score = score + plus(name.contains("labour"), 4.0)
    if "education" in topics:
        score = score + plus(F.col("id") == "unesco", 4.0) + plus(name.contains("education"), 3.0)
    for p in preferences:
        score = score + plus((F.col("id") == p) | (cat == p) | (F.col("trust") == p), 8.0)
    if public_only:
        score = score - plus(~F.col("anonymous"), 3.0)
    score = score - plus(~F.col("searchable"), 100.0)
    kept = df.filter(F.col("active") & ~F.col("id").isin(*excluded, "")).withColumn("score", F.round(score, 4))
    return kept.filter("score > -50").orderBy(F.desc("score"), "position").limit(k)


def keyword_score(text_head: Column, text: Column, query: str) -> Column:
    """2 for each term in the head, 1 for one elsewhere; terms of three letters and more."""
    terms = [t for t in query.lower().split() if len(t) >= 3]
    head, body = F.lower(text_head), F.lower(text)
    return sum((F.when(head.contains(t), 2.0).when(body.contains(t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))


def rank_papers(df: DataFrame, keywords: Sequence[str], negative: Sequence[str] = ()) -> DataFrame:
    """``df`` (title, abstract, doi) with ``score`` and ``tier``."""
    title, abstract = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("abstract", F.lit("")))
    score = sum((F.when(title.contains(k.lower()), 2).when(abstract.contains(k.lower()), 1).otherwise(0) for k in keywords), F.lit(0))
    score = score - sum((F.when((F.concat_ws(" ", title, abstract)).contains(k.lower()), 2).otherwise(0) for k in negative), F.lit(0))
    score = score + F.when(F.coalesce(F.col("doi"), F.lit("")) != "", 1).otherwise(0)
    return df.withColumn("score", score.cast("int")).withColumn("tier", F.when(F.col("score") >= 3, "must_read").when(F.col("score") >= 1, "skim").otherwise("scan"))
