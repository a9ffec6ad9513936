"""Long index lists of the n-gram join: sets are compared by families, each pair once."""

import random

import pytest
from test_similarity import joined_by_force

from loomframe.llm import ngram_join


def variants(seed, words, copies, changes, first=0):
    """Copies of one text, each with other words changed; few, if any, are similar enough to link."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(copies):
        text = list(base)
        for k in rng.sample(range(words), changes(i)):
            text[k] = f"c{rng.randrange(10**9)}"
        rows.append((first + i, " ".join(text)))
    return rows


def asked(monkeypatch, docs):
    """Pairs of different groups that are left to the sets' whole bitmaps."""
    counts, plausible = [], ngram_join.plausible

    def counted(pairs, index, percent):
        counts.append(pairs.count())
        return plausible(pairs, index, percent)

    monkeypatch.setattr(ngram_join, "plausible", counted)
    ngram_join.classes_and_links(docs, 4, 85)
    return counts[1]


def test_pairs_left_open_do_not_grow_with_the_square_of_a_family(spark, monkeypatch):
    rows = variants(1, 800, 48, lambda i: 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert asked(monkeypatch, docs) <= len(rows)


@pytest.mark.parametrize(("long", "tile"), [(2, 3), (5, 256), (16, 2)])
def test_families_and_short_lists_lose_no_link(spark, monkeypatch, long, tile):
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "NEIGHBOURS", 1)
    rows = variants(2, 120, 40, lambda i: i % 4) + variants(3, 60, 30, lambda i: i % 3, 100) + variants(4, 300, 30, lambda i: 3 + i % 6, 200)
    rows += [(300 + i, f"{t} " + " ".join(f"t{i}x{k}" for k in range(i % 5 * 4))) for i, (_, t) in enumerate(variants(2, 120, 25, lambda i: i % 2))]
    rows += [(200, rows[0][1]), (None, rows[1][1])]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(joined_by_force(rows, 4, 85).elements(), key=str)
