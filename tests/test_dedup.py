"""Near titles against a comparison of every pair."""

from difflib import SequenceMatcher

import pytest

from loomframe.operators import dedup


@pytest.mark.parametrize("least", [0.6, 0.8, 0.9])
def test_fuzzy_pairs_are_those_of_all_pairs(spark, least):
    rows = [(r["p_partkey"], f"{r['p_type']} {r['p_brand']} {r['p_name']}") for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(70).collect()]
    rows += [(1000, "a"), (1001, "ab"), (1002, "abc"), (1003, "ba"), (1004, "abcd"), (1005, "abcde"), (1006, "aaaa"), (1007, "aaaaa"), (1008, ""), (1009, None), (1010, "GDP of 2015"), (1011, "gdp of 2016"), (1012, "gdp, of 2016")]
    keys = {}
    for i, raw in sorted(rows):
        keys.setdefault(" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (raw or "").lower()).split()), i)
    keys.pop("", None)
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    want = {(i, j, round(s, 6)) for x, i in keys.items() for y, j in keys.items() if i < j and least <= (s := ratio(x, y)) < 1}
    got = [tuple(r) for r in dedup.fuzzy_pairs(spark.createDataFrame(rows, "i long, t string"), "i", "t", least).collect()]
    assert len(got) == len(want) > 4 and set(got) == want


def test_fuzzy_title_pairs_query_finds_all_pairs(spark):
    from loomframe.queries import search

    assert search.fuzzy_title_pairs(spark, "/root/testdata/sf0.001").count() == 81  # of all 19,701 pairs of its 199 titles, compared one by one


def test_merge_review_against_every_pair(spark):
    rows = [(1, "gdp of the world 2015", "v1", 2015, "a"), (2, "gdp of the world 2016", "v1", 2015, "b"), (3, "gdp of the world 2016x", "v2", 2015, "c"), (4, "gdp of the world, 2016", "v1", 2015, "a"), (5, "prices", None, None, "a"), (6, "prices of", None, None, "b"), (7, "prices off", None, None, None)]
    got = {tuple(r) for r in dedup.merge_review(spark.createDataFrame(rows, "id long, title string, version string, year int, provider_id string")).collect()}
    titles = {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 5: "prices", 6: "prices of", 7: "prices off"}
    by_id = {r[0]: r for r in rows}
    want = set()
    for i in titles:
        for j in titles:
            s = SequenceMatcher(None, titles[i], titles[j]).ratio()
            if i < j and 0.8 <= s < 1:
                a, b = by_id[i], by_id[j]
                want.add((i, j, round(s, 3), s >= 0.92 and (a[2] or "") == (b[2] or "") and a[3] == b[3] and a[4] != b[4]))
    assert got == want and {True, False} <= {r[3] for r in got}
