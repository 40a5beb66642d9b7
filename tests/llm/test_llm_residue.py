"""Residue: scores don't depend on the size of the corpus, and the model decides."""

import random

from pyspark.sql import functions as F

from chronoloom.llm import residue


def test_scores_do_not_depend_on_the_size_of_the_corpus(spark):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in "bakelimo" for b in ("ra", "ten", "vik", "sol")]
    docs = [(i, ". ".join(" ".join(rnd.choices(words, k=9)) for _ in range(12)) + ".") for i in range(180)] + [(1000 + i, "404 Not Found") for i in range(25)] + [(2000 + i, "Please enable JavaScript to view this recording.") for i in range(25)]
    small = spark.createDataFrame(docs, "doc_id long, text string")
    large = small.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(7)))).select((F.col("doc_id") + 10_000 * F.col("copy")).alias("doc_id"), "text")

    def medians(df):
        s = residue.scored_passages(df, fit_trusted=2500, fit_other=2500)
        return {r[0]: r[1] for r in s.groupBy("trusted").agg(F.median("score")).collect()}

    a, b = medians(small), medians(large)
    # smoothing leaves a rest, as the large fit has a fifth more passages; without weights the medians moved by 9.4 and 10.9
    assert set(a) == {True, False} and all(abs(a[t] - b[t]) < 5 for t in a), (a, b)


def test_the_model_finds_what_no_trusted_form_shows(spark):
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in "bakelimo" for b in ("ra", "ten", "vik", "sol")]
    tails = ["Return to the start page.", "Contact the administrator and quote code 7.", "Upstream gave no answer in time."]
    docs = [(i, ". ".join(" ".join(rnd.choices(words, k=9)) for _ in range(12)) + ".") for i in range(300)]
    docs += [(1000 + i, "404 Not Found. " + " ".join(rnd.sample(tails, 2))) for i in range(40)]
    docs += [(2000 + i, " ".join(rnd.sample(tails, 1 + i % 2))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {r.doc_id for r in residue.documents_with_residue(df).collect()}
    trusted = {r.doc_id for r in residue.documents_with_residue(df, rounds=0).collect()}
    assert whole == {i for i, _ in docs if i >= 1000} and trusted == set(range(1000, 1040))
