"""From a requirement to measures, providers and queries, and what is wrong with each, by rules alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .build import Point

# Names of variables in the languages of catalogues.
TRANSLATIONS = {
    "youth_unemployment_rate": ["youth unemployment rate", "青年失业率", "taux de chômage des jeunes"],
    "unemployment_rate": ["unemployment rate", "失业率"],
    "gdp_per_capita": ["GDP per capita", "人均GDP", "人均国内生产总值"],
    "gdp": ["GDP", "国内生产总值"],
    "education_level": ["education level", "教育水平", "educational attainment"],
    "population": ["population", "人口"],
}
# Codes under which an indicator provider has variables.
INDICATORS = {
    "youth_unemployment_rate": ["SL.UEM.1524.ZS"],
    "unemployment_rate": ["SL.UEM.TOTL.ZS"],
    "gdp_per_capita": ["NY.GDP.PCAP.CD", "NY.GDP.PCAP.KD"],
    "gdp": ["NY.GDP.MKTP.CD", "NY.GDP.MKTP.KD.ZG"],
    "education_level": ["SE.TER.ENRR", "SE.PRM.ENRR"],
    "aging": ["SP.POP.65UP.TO.ZS"],
    "population": ["SP.POP.TOTL"],
}
# Measures of abstract concepts: the preferred one, others, unit, aggregate and confidence.
MEASURES = {
    "digital_economy": ("数字经济核心产业增加值占GDP比重", ("信息传输、软件和信息技术服务业增加值", "电信业务总量"), "percent / CNY", "last", 0.55),
    "innovation": ("专利授权量（每万人）", ("R&D经费投入强度（R&D/GDP）", "高新技术企业数量"), "count per 10k / percent", "sum", 0.55),
    "aging": ("60岁及以上人口占比", ("65岁及以上人口占比",), "percent", "mean", 0.6),
    "environmental_regulation": ("节能环保支出占一般公共预算支出比重", ("工业二氧化硫排放强度（排放/工业增加值）", "PITI 环境监管指数"), "percent", "mean", 0.5),
    "fiscal_pressure": ("土地出让收入/一般公共预算收入（土地财政依赖度）", ("财政自给率（一般公共预算收入/支出）", "人均财政缺口"), "ratio", "last", 0.55),
    "industrial_upgrading": ("产业结构高级化（第三产业增加值/GDP）", ("第二产业占比下降幅度", "产业结构合理化（泰尔指数）"), "ratio", "last", 0.55),
}
COMMERCIAL = ("kaggle", "heywhale", "tianchi", "baidu_aistudio", "datafountain", "opendatalab", "data_world", "modelscope_datasets")
WANTS_OFFICIAL = ("官方", "official", "国际组织", "international", "政府", "统计")
CHINESE_CATEGORIES = ("cn_gov", "cn_science")
MOST_QUERIES = 4


def _table(values: Mapping[str, Sequence[str]]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*[F.lit(q) for q in v]))])


def measures(concepts: DataFrame, concept: str = "concept") -> DataFrame:
    """``concepts`` with struct ``measure``: the concept's preferred measure, alternatives, unit, aggregate and confidence.

    A concept is found under its name, or under one that holds it or that it holds, in the table's order.
    """
    name = F.trim(F.col(concept))
    key = F.regexp_replace(F.lower(name), "[ -]", "_")
    made = {k: F.struct(F.lit(p).alias("preferred"), F.array(*[F.lit(a) for a in alt]).alias("alternatives"), F.lit(u).alias("unit"), F.lit(agg).alias("aggregate"), F.lit(sure).alias("confidence")) for k, (p, alt, u, agg, sure) in MEASURES.items()}
    exact = [F.when(key == k, v) for k, v in made.items()]
    near = [F.when((name != "") & (name.contains(k) | F.contains(F.lit(k), name)), v) for k, v in made.items()]
    none = F.struct(F.concat(F.lit("[unresolved] "), name).alias("preferred"), F.array().cast("array<string>").alias("alternatives"), F.lit("UNKNOWN").alias("unit"), F.lit("unknown").alias("aggregate"), F.lit(0.05).alias("confidence"))
    return concepts.withColumn("measure", F.coalesce(*exact, *near, none))


def queries(providers: DataFrame, variables: Column, request: Column) -> DataFrame:
    """``providers`` (provider_id, category) with the array ``queries`` to ask them: at most four, in order, once each.

    Variables are asked for in all languages known; Chinese providers' Chinese names come again, which
    only keeps their order.  Without variables the request's first longer words are asked for.
    """
    names = lambda v: F.coalesce(F.try_element_at(_table(TRANSLATIONS), v), F.array(v))
    asked = F.flatten(F.transform(variables, names))
    words = F.slice(F.filter(F.split(request, r"\s+"), lambda w: F.length(w) >= 3), 1, 4)
    base = F.when(F.size(asked) > 0, asked).otherwise(F.array(F.array_join(words, " ")))
    chinese = F.filter(asked, lambda q: q.rlike(r"[\x{4e00}-\x{9fff}]"))
    every = F.when(F.col("category").isin(*CHINESE_CATEGORIES), F.concat(base, chinese)).otherwise(base)
    return providers.withColumn("queries", F.slice(F.array_distinct(every), 1, MOST_QUERIES))


def indicator_codes(variables: Column) -> Column:
    """Codes of the variables that an indicator provider has, at most six."""
    return F.slice(F.flatten(F.transform(variables, lambda v: F.coalesce(F.try_element_at(_table(INDICATORS), v), F.array().cast("array<string>")))), 1, 6)


def official_first(providers: DataFrame, request: Column, position: str = "position", lead: int = 3) -> DataFrame:
    """``providers`` with their ``place``: where a request wants official sources and a commercial one is among the leading, those come last.

    The order among equals stays; one row of ``request`` for all, so the rule is a window of the few providers.
    """
    commercial = F.lower("provider_id").isin(*COMMERCIAL)
    text = F.lower(request)
    wants = F.lit(False)
    for w in WANTS_OFFICIAL:
        wants = wants | text.contains(w)
    led = F.max(F.when(commercial & (F.col("_rank") <= lead), True).otherwise(False)).over(Window.partitionBy(F.lit(0)))
    ranked = providers.withColumn("_rank", F.row_number().over(Window.orderBy(position)))
    moved = ranked.withColumn("_moved", wants & led & commercial)
    return moved.withColumn("place", F.row_number().over(Window.orderBy("_moved", "_rank"))).drop("_rank", "_moved")


def by_provider(candidates: DataFrame, provider: str, order: Sequence[str], doi: str = "doi", url: str = "url", title: str = "title", most: int = 12) -> DataFrame:
    """Each provider's first ``most`` records, once for each DOI, else URL, else title."""
    key = F.coalesce(F.nullif(F.col(doi), F.lit("")), F.nullif(F.col(url), F.lit("")), F.col(title))
    first = candidates.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy(provider, "_key").orderBy(*order))).filter("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(provider).orderBy(*order))).filter(F.col("_n") <= most).drop("_n", "_key")


def requirement_points(requirement: str = "requirement", providers: Column | None = None) -> Column:
    """Review points of a parsed requirement as an array of (severity, topic, message); ``providers`` counts those chosen."""
    r = F.col(requirement)
    point = lambda on, severity, topic, message: F.when(on, F.struct(F.lit(severity).alias("severity"), F.lit(topic).alias("topic"), F.lit(message).alias("message")))
    bad = ~r["year_start"].between(1900, 2099) | ~r["year_end"].between(1900, 2099)
    none = F.size(r["outcome"]) + F.size(r["exposure"]) + F.size(r["control"]) == 0
    large = (r["frequency"] == "daily") & r["unit"].isin("country", "province") & (r["year_end"] - r["year_start"] >= 3)
    found = [
        point(bad, "blocking", "requirement", "time range invalid"), point(~F.coalesce(bad, F.lit(False)) & (r["year_start"] > r["year_end"]), "blocking", "requirement", "time range inverted"),
        point(none, "blocking", "requirement", "no variables"), point(r["unit"] == "unknown", "warning", "requirement", "unit unknown"), point(large, "warning", "time", "daily panel of many years"),
    ]
    if providers is not None:
        found += [point(providers == 0, "blocking", "source", "no provider"), point(providers < 2, "warning", "source", "one provider or none")]
    return F.array_compact(F.array(*found))


def is_runnable(points: Sequence[Point]) -> bool:
    return not any(p.severity == "blocking" for p in points)
