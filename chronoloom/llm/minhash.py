"""MinHash over word shingles with banded candidates, each verified by exact Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import stage

SHINGLE, SIMILARITY = 5, 0.8
SMALL = 64  #: members of a bucket that are compared with each other at most


def word_shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of the runs of ``n`` words; of all words where there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def band_keys(shingles: Column, bands: int = 8, rows: int = 3) -> Column:
    """One key per band; each of a band's rows is the least of the shingles hashed with its own seed."""
    def least(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(seed))))

    def one(b: int) -> Column:
        return F.xxhash64(F.lit(b), *[least(b * rows + r) for r in range(rows)])

    return F.array(*[one(b) for b in range(bands)])


def similar_pairs(docs: DataFrame, ident: str, shingles: str, similarity: float = SIMILARITY, bands: int = 8, rows: int = 3) -> DataFrame:
    """Links ``u, v`` between distinct shingle sets with Jaccard similarity of at least ``similarity``.

    Small buckets of a band are compared in full. In a large one every member is compared with the least, the head. Members
    that are similar to it need no links among themselves; by the triangle inequality of the Jaccard distance they can only
    be similar to rejected members that are less than twice the distance away, and are compared with these. The rejected
    ones are a bucket again, until none are left. So whatever is similar and shares a bucket is connected by the links.
    ``docs`` must hold each shingle set once. 
    """
    def share(a: str, b: str) -> Column:
        same = F.size(F.array_intersect(a, b))
        return same / (F.size(a) + F.size(b) - same)

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where(share("su", "sv") >= similarity).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    def other(df: DataFrame) -> DataFrame:
        return df.select("band", "key", F.col("v").alias("u"), F.col("sv").alias("su"))

    left = docs.where(F.size(shingles) > 0).select(F.col(ident).alias("v"), F.col(shingles).alias("sv"), F.posexplode(band_keys(F.col(shingles), bands, rows)).alias("band", "key"))
    out = None
    while True:
        heads = left.groupBy("band", "key").agg(F.min("v").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        left = stage(left.join(heads, ["band", "key"]))
        small, large = left.where(F.col("n") <= SMALL), left.where(F.col("n") > SMALL)
        links = linked(small.join(other(small), ["band", "key"]).where("u < v"))
        out = stage(links if out is None else out.unionByName(links))
        if not large.limit(1).count():
            return out.distinct()
        first = large.where("v = head").select("band", "key", F.col("v").alias("u"), F.col("sv").alias("su"))
        seen = stage(large.where("v <> head").join(first, ["band", "key"]).withColumn("share", share("su", "sv")).select("band", "key", "u", "v", "sv", "share"))
        near = seen.where((F.col("share") < similarity) & (F.col("share") >= 2 * similarity - 1 - 1e-9)).select("band", "key", "v", "sv")
        good = seen.where(F.col("share") >= similarity)
        out = out.unionByName(good.select("u", "v")).unionByName(linked(near.join(other(good), ["band", "key"])))
        left = seen.where(F.col("share") < similarity).select("v", "sv", "band", "key")
