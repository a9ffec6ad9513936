"""Entity names to codes: countries, Chinese provinces and prefectures, and plain names.

A resolver is a table of (alias, code, ...); distinct raw values are joined to it once and the
answers joined back.  Only what no alias explains goes to a fuzzy match in a pandas function.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators.joins import lookup

# Country names in use besides the ISO short names.
COUNTRY_ALIASES = {
    "usa": "US", "us": "US", "united states of america": "US", "america": "US", "u.s.": "US",
    "uk": "GB", "great britain": "GB", "britain": "GB", "england": "GB",
    "united kingdom of great britain and northern ireland": "GB",
    "china": "CN", "people's republic of china": "CN", "prc": "CN", "中华人民共和国": "CN", "中国": "CN",
    "korea, rep.": "KR", "south korea": "KR", "korea, south": "KR", "republic of korea": "KR", "韩国": "KR",
    "korea, dem. people's rep.": "KP", "north korea": "KP",
    "russian federation": "RU", "russia": "RU", "俄罗斯": "RU",
    "viet nam": "VN", "vietnam": "VN", "越南": "VN",
    "hong kong sar, china": "HK", "hong kong": "HK", "香港": "HK",
    "taiwan, china": "TW", "taiwan": "TW", "台湾": "TW",
    "macao sar, china": "MO", "macau": "MO", "澳门": "MO",
    "egypt, arab rep.": "EG", "iran, islamic rep.": "IR", "venezuela, rb": "VE",
    "slovak republic": "SK", "土耳其": "TR", "turkiye": "TR", "turkey": "TR",
    "deutschland": "DE", "德国": "DE", "germany": "DE",
    "日本": "JP", "japan": "JP", "法国": "FR", "france": "FR",
    "india": "IN", "印度": "IN", "brazil": "BR", "巴西": "BR",
    "czech republic": "CZ", "czechia": "CZ",
    "hong kong sar": "HK", "macao sar": "MO",
}

# Numeric ISO codes of large economies; pass a longer table where others occur.
NUMERIC_CODES = {
    "840": "US", "156": "CN", "276": "DE", "076": "BR", "356": "IN", "392": "JP", "826": "GB", "250": "FR", "380": "IT", "124": "CA",
    "643": "RU", "410": "KR", "036": "AU", "724": "ES", "484": "MX", "360": "ID", "528": "NL", "792": "TR", "682": "SA", "756": "CH",
}

# The province-level units (code, name, valid from) and their short names.
PROVINCES = [
    ("110000", "北京市", 1955), ("120000", "天津市", 1955), ("130000", "河北省", 1955), ("140000", "山西省", 1955),
    ("150000", "内蒙古自治区", 1955), ("210000", "辽宁省", 1955), ("220000", "吉林省", 1955), ("230000", "黑龙江省", 1955),
    ("310000", "上海市", 1955), ("320000", "江苏省", 1955), ("330000", "浙江省", 1955), ("340000", "安徽省", 1955),
    ("350000", "福建省", 1955), ("360000", "江西省", 1955), ("370000", "山东省", 1955), ("410000", "河南省", 1955),
    ("420000", "湖北省", 1955), ("430000", "湖南省", 1955), ("440000", "广东省", 1955), ("450000", "广西壮族自治区", 1958),
    ("460000", "海南省", 1988), ("500000", "重庆市", 1997), ("510000", "四川省", 1955), ("520000", "贵州省", 1955),
    ("530000", "云南省", 1955), ("540000", "西藏自治区", 1965), ("610000", "陕西省", 1955), ("620000", "甘肃省", 1955),
    ("630000", "青海省", 1955), ("640000", "宁夏回族自治区", 1958), ("650000", "新疆维吾尔自治区", 1955),
    ("710000", "台湾省", 1955), ("810000", "香港特别行政区", 1997), ("820000", "澳门特别行政区", 1999),
]
PROVINCE_ALIASES = {
    "北京": "110000", "内蒙古": "150000", "广西": "450000", "西藏": "540000", "宁夏": "640000", "新疆": "650000",
    "上海": "310000", "天津": "120000", "重庆": "500000", "香港": "810000", "澳门": "820000", "台湾": "710000",
}

# Prefectures of common panels (code, name, valid from, valid to); pass a full table for others.
PREFECTURES = [
    ("130100", "石家庄市", 1968, None), ("140100", "太原市", 1955, None), ("210100", "沈阳市", 1955, None), ("210200", "大连市", 1955, None),
    ("220100", "长春市", 1955, None), ("230100", "哈尔滨市", 1955, None), ("320100", "南京市", 1955, None), ("320500", "苏州市", 1955, None),
    ("330100", "杭州市", 1955, None), ("330200", "宁波市", 1955, None), ("340100", "合肥市", 1955, None), ("350100", "福州市", 1955, None),
    ("350200", "厦门市", 1955, None), ("360100", "南昌市", 1955, None), ("370100", "济南市", 1955, None), ("370200", "青岛市", 1955, None),
    ("410100", "郑州市", 1955, None), ("420100", "武汉市", 1955, None), ("420600", "襄阳市", 1955, None), ("430100", "长沙市", 1955, None),
    ("440100", "广州市", 1955, None), ("440300", "深圳市", 1979, None), ("450100", "南宁市", 1955, None), ("510100", "成都市", 1955, None),
    ("520100", "贵阳市", 1955, None), ("530100", "昆明市", 1955, None), ("610100", "西安市", 1955, None), ("620100", "兰州市", 1955, None),
]

FUZZY = 0.92
# What the names of groups of countries hold.
AGGREGATES = (
    "&", "(", ")", "excluding", "income", "area", "region", "total", "world", "globe", "ida", "ibrd", "oecd", "euro ", "small states", "dividend", "fragile", "heavily",
    "least developed", "arab league", "asean", "central europe", "north america", "south asia", "east asia", "pacific island", "sub-saharan", "middle east",
)
# Earlier names of prefectures (code, name, from, to).
HISTORICAL = [("420600", "襄樊市", 1983, 2010), ("320800", "淮阴市", 1955, 2000), ("460200", "三亚市", 1987, None), ("441300", "惠阳市", 1955, 1988)]
# Names of columns that hold an entity, by kind.
COLUMN_NAMES = {
    "country": ("country", "country_name", "nation", "country_code", "iso3", "iso2", "geo", "ref_area", "reporter", "partner"),
    "province": ("province", "province_name", "province_code", "prov", "geo", "region", "省份"),
    "prefecture": ("city", "city_name", "city_code", "prefecture", "prefecture_name", "prefecture_code", "geo", "region", "城市", "地级市"),
}
#: Distinct values of a column that are looked at to tell what it holds, and the share that must be known.
SAMPLE, KNOWN = 20, 0.6


def country_table(spark: SparkSession, numeric: dict[str, str] = NUMERIC_CODES) -> DataFrame:
    """(alias, code, iso3, confidence) of every country the JVM's locale data knows, and the names above."""
    jvm = spark._jvm.java.util
    iso3, rows = {}, []
    for code in jvm.Locale.getISOCountries():
        place = jvm.Locale.Builder().setRegion(code).build()
        iso3[code] = place.getISO3Country()
        rows += [(code.lower(), code, 1.0), (iso3[code].lower(), code, 1.0), (place.getDisplayCountry(jvm.Locale.ENGLISH).lower(), code, 0.98)]
    rows += [(name, code, 0.98) for name, code in COUNTRY_ALIASES.items()]
    rows += [(number, code, 1.0) for number, code in numeric.items()]
    best: dict[str, tuple[str, float]] = {}
    for alias, code, sure in rows:
        best.setdefault(alias, (code, sure))
    return spark.createDataFrame([(a, c, iso3[c], s) for a, (c, s) in best.items()], "alias string, code string, iso3 string, confidence double")


def region_table(spark: SparkSession, level: str, prefectures: Sequence[tuple] = PREFECTURES) -> DataFrame:
    """(alias, code, valid_from, valid_to) of provinces or prefectures."""
    rows: dict[str, tuple] = {}
    if level == "province":
        named = {code: since for code, _, since in PROVINCES}
        for code, name, since in PROVINCES:
            rows |= {code: (code, since, None), name: (code, since, None)}
            if name.endswith("市"):
                rows.setdefault(name[:-1], (code, since, None))
        rows |= {a: (c, named[c], None) for a, c in PROVINCE_ALIASES.items()}
    elif level == "prefecture":
        for code, name, since, until in prefectures:
            rows |= {code: (code, since, until), name: (code, since, until)}
            if name.endswith("市"):
                rows.setdefault(name[:-1], (code, since, until))
        for code, name, since, until in HISTORICAL:
            rows.setdefault(name, (code, since, until))
    else:
        raise EngineError("BUILD_FAILED", f"unknown level {level!r}")
    return spark.createDataFrame([(a, *r) for a, r in rows.items()], "alias string, code string, valid_from int, valid_to int")


def generic_key(raw: Column) -> Column:
    """A name without surrounding space and case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), F.lit(""))


def resolve_countries(df: DataFrame, column: str, fuzzy: bool = True, out: str = "iso3") -> DataFrame:
    """``df`` with ``out`` and ``<column>_original``; aggregates such as World stay null."""
    spark = df.sparkSession
    known = country_table(spark)
    values = df.select(F.col(column).alias("_raw")).filter(F.col(column).isNotNull()).distinct().withColumn("alias", F.lower(F.trim("_raw")))
    met = lookup(values, known, "alias")
    if fuzzy:
        aliases = [r for r in known.select("alias", "iso3").toLocalIterator() if 4 <= len(r[0]) < 35 and r[0].isalpha()]  # of the fixed table

        @F.pandas_udf("string")
        def nearest(raw: pd.Series) -> pd.Series:
            def one(text: str | None) -> str | None:
                if not text or len(text) >= 35 or any(m in text for m in AGGREGATES):
                    return None
                best, found = 0.0, None
                for alias, iso3 in aliases:
                    ratio = SequenceMatcher(None, text, alias).ratio()
                    if ratio > best:
                        best, found = ratio, iso3
                return found if best >= FUZZY else None

            return raw.map(one)

        met = met.withColumn("iso3", F.coalesce("iso3", nearest(F.when(F.col("iso3").isNull(), F.col("alias")))))
    answers = met.select("_raw", F.col("iso3").alias(out))
    return df.withColumn(f"{column}_original", F.col(column)).join(answers, F.col(column) == F.col("_raw"), "left").drop("_raw")


def resolve_regions(df: DataFrame, column: str, level: str, year: Column | None = None, out: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """``df`` with the region's code, null where the unit isn't valid in ``year``."""
    known = table if table is not None else region_table(df.sparkSession, level)
    name = out or f"{level}_code"
    at = df.withColumn("alias", F.trim(F.col(column).cast("string"))).withColumn("_year", year if year is not None else F.lit(None).cast("int"))
    met = lookup(at, known, "alias")
    valid = F.col("_year").isNull() | ((F.col("_year") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_year") <= F.col("valid_to"))))
    return met.withColumn(name, F.when(valid, F.col("code"))).select(*df.columns, name)


def hit_ratio(df: DataFrame, column: str, kind: str) -> float:
    """The share of SAMPLE of a column's distinct values, drawn by hash, that are known names or codes of ``kind``."""
    spark = df.sparkSession
    text = F.trim(F.col(column).cast("string"))
    sample = df.select(text.alias("v")).filter("v != ''").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).withColumn("alias", F.lower("v") if kind == "country" else F.col("v"))
    known = (country_table(spark) if kind == "country" else region_table(spark, kind)).select("alias", F.lit(1).alias("hit"))
    return sample.join(F.broadcast(known), "alias", "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0))).first()[0]  # a fixed table


def holds(df: DataFrame, column: str, kind: str) -> bool:
    """Whether a column holds entities of ``kind``: by its name, or by most of its values."""
    return column.strip().lower().replace(" ", "_") in COLUMN_NAMES[kind] or hit_ratio(df, column, kind) >= KNOWN


def resolver(unit: str):
    """What resolves entities of a unit of analysis: a function of (df, column); generic units have keys of their names."""
    if unit == "country":
        return resolve_countries
    if unit in ("province", "city", "prefecture"):
        return lambda df, column, **more: resolve_regions(df, column, "province" if unit == "province" else "prefecture", **more)
    return lambda df, column: df.withColumn("entity_key", generic_key(F.col(column)))


def unresolved(df: DataFrame, column: str, code: str, n: int = 20) -> DataFrame:
    """The most frequent values without a code, as a report."""
    return df.filter(F.col(code).isNull() & F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)
