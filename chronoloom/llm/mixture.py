"""Mixing sources to target shares of tokens.

Every source gets a budget of tokens. As many complete epochs of it as fit come first; the rest is a weighted sample
without replacement by Efraimidis-Spirakis: an exponential key scaled by the record's quality weight, sorted within the
source, summed up to the budget. The running sum has two levels (bins of keys, then rows within a bin), so no source is
ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.encoding import token_counts
from chronoloom.session import stage

BIN_ROWS = 20_000  #: rows of a bin of keys, about


def quality(text: Column) -> Column:
    """Weight of a record from 0.1 to 1: the share of letters, digits and plain marks, damped for very short texts."""
    n = F.greatest(F.length(text), F.lit(1))
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N} .,;:!?'()-]", "")) / n
    return F.round(F.lit(0.1) + F.lit(0.9) * plain * F.least(F.lit(1.0), n / F.lit(200.0)), 6)


def sized(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, source, n_tokens, weight`` of the records that can be in a mix: with an id, a source and tokens."""
    d = docs.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0))
    d = d.select("doc_id", "source", quality(F.col("text")).alias("weight"), "text")
    return stage(token_counts(d, ["doc_id", "source", "weight"], **kw).where("n_tokens > 0"))


def budgets(records: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source (a row per row of the fixed ``targets``): ``source, weight, max_repeats, tokens, n, budget, epochs, rest``.

    Weights are scaled to sum to one over the sources that have tokens. ``total`` is the size of the mix in tokens;
    by default the largest at which every source can have its share. No source is given more than ``max_repeats`` times
    its tokens (null or less than 1 means once).
    """
    have = records.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    t = targets.where(F.col("source").isNotNull() & (F.col("weight") > 0)).groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source").withColumn("max_repeats", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)))
    one = t.agg(F.sum("weight").alias("_w"))
    t = t.crossJoin(F.broadcast(one)).withColumn("weight", F.col("weight") / F.col("_w")).drop("_w")  # one row
    most = t.agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("weight")).alias("_t"))
    t = t.crossJoin(F.broadcast(most if total is None else most.select(F.lit(float(total)).alias("_t"))))  # one row
    t = t.withColumn("budget", F.least(F.floor(F.col("weight") * F.col("_t") + F.lit(1e-6)), F.col("max_repeats") * F.col("tokens")).cast("long")).drop("_t")
    epochs = F.floor(F.col("budget") / F.col("tokens")).cast("long")
    return t.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def mix(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """``doc_id, source, n_tokens, copies``: how often each record is in the mix; records that aren't are left out.

    Ties of keys are broken by doc_id; the same seed gives the same mix. Records of sources without target are left
    out; empty tables give no rows.
    """
    fine = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(BIN_ROWS)))).cast("int")
    b = stage(budgets(records, targets, total).select("source", "epochs", "rest", fine.alias("fine")))
    r = records.join(F.broadcast(b), "source")  # as many rows as the fixed table of targets
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit((1 << 53) - 1)) + F.lit(1)) / F.lit(float(1 << 53))
    r = r.withColumn("key", -F.log(u) / F.col("weight"))
    # bins follow the key: its octave, cut into 2**fine pieces. Keys of any weight lie in a few octaves, so no bin has more than
    # a few times BIN_ROWS rows, and all of a bin comes before the next
    octave, pieces = F.floor(F.log2("key")), F.pow(F.lit(2.0), F.col("fine"))
    piece = F.least(F.floor((F.col("key") / F.pow(F.lit(2.0), octave) - 1) * pieces), pieces - 1)
    r = r.withColumn("bin", F.when(F.col("key") > 0, octave * pieces + piece).otherwise(F.lit(-1e15)).cast("long"))
    sums = r.groupBy("source", "bin").agg(F.sum("n_tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "bin", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.join(base, ["source", "bin"]).withColumn("upto", F.col("base") + F.sum("n_tokens").over(inside))
    copies = F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return r.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, records: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``source, target, budget, tokens, share, n_records, most_copies``: what the mix really holds."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_records"), F.max("copies").alias("most_copies"))
    b = budgets(records, targets, total).select("source", F.col("weight").alias("target"), "budget")
    return b.join(got, "source", "left").na.fill(0, ["tokens", "n_records", "most_copies"]).withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0))))
