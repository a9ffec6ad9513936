"""Deduplication of catalogue records, posts and papers, and fuzzy review of titles."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dedup_url, doi_key, title_key

AUTO, REVIEW = 0.92, 0.80
#: Titles of a run that one task compares with all others of the run.
BLOCK = 500


def candidate_key(doi: Column, url: Column, ident: Column) -> Column:
    """DOI, else canonical URL, else the record itself."""
    at = F.nullif(dedup_url(url), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:"), doi_key(doi)), F.concat(F.lit("url:"), at), F.concat(F.lit("id:"), ident.cast("string")))


def deduplicate(df: DataFrame, ident: str = "id", doi: str = "doi", url: str = "url", score: str = "score") -> DataFrame:
    """``df`` with group_id, is_primary (the highest score, ties by id) and the group's mirrors.

    Sizes and mirrors are aggregated before the join, so a large group is no single task.
    """
    keyed = df.withColumn("group_id", candidate_key(F.col(doi), F.col(url), F.col(ident)))
    best = F.min_by(F.col(ident), F.struct(-F.coalesce(F.col(score), F.lit(0.0)), F.col(ident)))
    groups = keyed.groupBy("group_id").agg(best.alias("_first"), F.count("*").alias("group_size"), F.count_distinct(dedup_url(F.col(url))).alias("n_mirrors"))
    return keyed.join(groups, "group_id").withColumn("is_primary", F.col(ident) == F.col("_first")).drop("_first")


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching runs of characters; the order of the two counts."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def fuzzy_pairs(df: DataFrame, ident: str, title: str, least: float = REVIEW) -> DataFrame:
    """(left_id, right_id, similarity) of all titles that are near but not equal; ``least`` is above 0 and no pair from it on is missed.

    A similarity of s matches m >= s * (la + lb) / 2 characters in order.  The la + lb - 2 * m others
    part them, and each parting breaks q - 1 of the m - q + 1 runs of q characters, so the titles
    have (la + lb) * slope - (q - 1) runs in common, counted with multiplicity.  One of these is
    then among the first of each title's runs by rarity; titles meet at the rarest common one.
    Titles so short that no run need be common share a run of their own.

    Before runs are compared, two words of bits rule out most pairs: a character or run that only one
    title has turns one bit of the parities, and so many of them are allowed at most.  What is left
    must be within as many edits.  The titles of a run that more than BLOCK of them have are dealt over tasks.
    """
    q = 2 if 1.5 * least > 1.1 else 1
    slope = least / 2 - (q - 1) * (1 - least)
    needed = lambda both: F.ceil(both * F.lit(slope) - F.lit(q - 1 + 1e-6))
    keyed = df.select(F.col(ident).alias("i"), title_key(F.col(title)).alias("k")).filter("k != ''").groupBy("k").agg(F.min("i").alias("i"))
    keyed = keyed.withColumn("n", F.length("k"))
    starts = F.filter(F.sequence(F.lit(1), F.col("n")), lambda p: p <= F.col("n") - (q - 1))
    runs = keyed.select("i", F.explode(F.transform(starts, lambda p: F.substring(F.col("k"), p, F.lit(q)))).alias("g")).groupBy("i", "g").agg(F.count("*").cast("int").alias("c"))
    runs = runs.select("i", "g", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("c"))
    ranks = runs.groupBy("g", "c").agg(F.count("*").alias("f")).select("g", "c", "f", F.row_number().over(Window.orderBy("f", "g", "c")).alias("rank"))  # keys have 37 different characters, so at most 37 ** q by the times one comes up in a title
    own = runs.join(ranks.drop("f"), ["g", "c"]).groupBy("i").agg(F.array_sort(F.collect_list("rank")).alias("runs"))
    short = F.col("n") * slope <= q - 1
    first = F.size("runs") - F.greatest(needed(F.col("n") * 2 / (2 - least)), F.lit(1)) + 1  # the least its longest and shortest partners need
    ready = keyed.join(own, "i", "left").withColumn("runs", F.concat(F.when(short, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.coalesce("runs", F.array().cast("array<int>"))))
    chars = F.aggregate(F.split("k", ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))
    grams = F.aggregate("runs", F.lit(0).cast("long"), lambda bits, r: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), r % 64)))
    ready = ready.withColumn("chars", chars).withColumn("grams", grams)
    blocks = ready.select("i", "k", "n", "chars", "grams", "runs", F.explode(F.when(short, F.col("runs")).otherwise(F.slice("runs", F.lit(1), F.greatest(first, F.lit(0)).cast("int")))).alias("run"))
    heavy = ranks.filter(F.col("f") > BLOCK).select(F.col("rank").alias("run"), F.ceil(F.col("f") / BLOCK).cast("int").alias("cuts"))
    blocks = blocks.join(F.broadcast(heavy), "run", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))  # as many as ranks at most
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)
    side = lambda x, cut: blocks.select("run", cut.alias("cut"), *[F.col(c).alias(c + x) for c in ("i", "k", "n", "chars", "grams", "runs")]).repartition(parts, "run", "cut")
    both = F.col("na") + F.col("nb")
    apart = F.floor(both * F.lit(1 - least) + F.lit(1e-6))  # characters that one title has and the other hasn't, at most
    sizes = F.size("runsa") + F.size("runsb")
    other = F.bit_count(F.col("charsa").bitwiseXOR(F.col("charsb"))) <= apart
    other &= F.bit_count(F.col("gramsa").bitwiseXOR(F.col("gramsb"))) <= sizes - 2 * needed(both)
    common = F.array_intersect("runsa", "runsb")
    near = (F.col("ia") < F.col("ib")) & (2 * F.least("na", "nb") / both >= least) & other & (F.get(common, F.lit(0)) == F.col("run")) & (F.size(common) >= needed(both)) & (F.levenshtein("ka", "kb") <= apart)
    pairs = side("a", F.pmod(F.xxhash64("k"), F.col("cuts")).cast("int")).join(side("b", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))), ["run", "cut"]).filter(near).select(F.col("ia").alias("left_id"), F.col("ib").alias("right_id"), "ka", "kb")
    return pairs.withColumn("similarity", title_similarity("ka", "kb")).filter(F.col("similarity").between(least, 0.9999999)).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


def merge_review(df: DataFrame, ident: str = "id", title: str = "title", version: str = "version", year: str = "year", provider: str = "provider_id") -> DataFrame:
    """(left_id, right_id, similarity, auto): near titles; only records of one version and year from two providers merge by themselves.

    Records of equal titles are groups of their own (``deduplicate``); the least id stands for each.
    """
    pairs = fuzzy_pairs(df, ident, title)
    facts = lambda x: df.select(F.col(ident).alias(f"{x}_id"), *[F.col(c).alias(f"_{x}{k}") for k, c in enumerate((version, year, provider))])
    met = pairs.join(facts("left"), "left_id").join(facts("right"), "right_id")
    same_version = F.coalesce("_left0", F.lit("")) == F.coalesce("_right0", F.lit(""))
    auto = (F.col("similarity") >= AUTO) & same_version & F.col("_left1").eqNullSafe(F.col("_right1")) & ~F.col("_left2").eqNullSafe(F.col("_right2"))
    return met.select("left_id", "right_id", F.round("similarity", 3).alias("similarity"), auto.alias("auto"))


def paper_key(doi: Column, arxiv: Column, title: Column) -> Column:
    return F.coalesce(doi_key(doi), F.nullif(F.lower(F.trim(arxiv)), F.lit("")), F.lower(F.trim(title)))


def dedupe_posts(df: DataFrame, platform: str, post: str, order: str) -> DataFrame:
    """The first row of each (platform, post), by ``order``."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(platform).alias("_p"), F.col(post).alias("_q")).agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")


def cross_platform(df: DataFrame, platform: str, text: str) -> DataFrame:
    """(text_hash, n_posts, n_platforms) of texts that more than one platform has; no pairs are made."""
    return (
        df.filter(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("text_hash")).agg(F.count("*").alias("n_posts"), F.count_distinct(platform).alias("n_platforms")).filter("n_platforms > 1")
    )
