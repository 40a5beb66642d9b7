"""No similar pair of a bucket is lost, whatever its head is like."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronoloom.llm import minhash


def test_pairs_that_the_head_rejects(spark, monkeypatch):
    monkeypatch.setattr(minhash, "band_keys", lambda *_: F.array(F.lit(1)))
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, list(range(10, 20))), (3, list(range(10, 21)))], "id long, s array<long>")
    assert rows(minhash.similar_pairs(df, "id", "s")) == [(2, 3)]


@pytest.mark.parametrize("small", [1, 64])
def test_components_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "band_keys", lambda *_: F.array(F.lit(1)))
    monkeypatch.setattr(minhash, "SMALL", small, raising=False)
    rnd = random.Random(6)
    sets = {frozenset(x for x in range(100 * k, 100 * k + 14) if rnd.random() > 0.12) for k in range(3) for _ in range(12)}
    data = dict(enumerate(sorted(sets, key=sorted), 1))
    true = {(a, b) for a in data for b in data if a < b and len(data[a] & data[b]) >= 0.8 * len(data[a] | data[b])}
    got = set(rows(minhash.similar_pairs(spark.createDataFrame([(k, sorted(v)) for k, v in data.items()], "id long, s array<long>"), "id", "s")))

    def parts(links):
        top = {k: k for k in data}
        for _ in data:
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert got <= true and parts(got) == parts(true)
