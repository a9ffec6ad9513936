"""op7_iblt_fingerprints shuffles again only the texts of pairs whose sketches didn't peel."""

import pytest

from loomframe.llm import fingerprint


def test_only_what_is_tried_again_is_read_again(spark, monkeypatch):
    long = lambda k: " ".join(f"part {k} {i}." for i in range(80))
    rows = [(i, "the same. text here.") for i in range(40)] + [(40, long(1)), (41, long(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    attempt = fingerprint._attempt
    monkeypatch.setattr(fingerprint, "_attempt", lambda texts, beside, k: seen.append((texts.count(), beside.count())) or attempt(texts, beside, k))
    monkeypatch.setattr(fingerprint, "CELLS", {"edited": 0.75, "next": 0.3})  # too few cells for texts that have nothing in common
    got = {r["doc_id"]: r for r in fingerprint.compared(docs).collect()}
    assert len(got) == 42 and got[40]["near_next"] == 0.0 and got[0]["near_next"] == 1.0
    assert got[41]["near_next"] == pytest.approx(0.0) and got[40]["n_chars"] == len(long(1))
    assert seen[0] == (42, 42) and len(seen) > 1
    assert all(texts <= 2 * asked < 42 for texts, asked in seen[1:])
