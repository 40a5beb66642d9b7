"""Queries of the problems 3, 4, 7, 8, 9 and 10, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.llm import encoding, grouping, mixture, overlap, pairs, residue
from chronoloom.plans.registry import Registry
from chronoloom.session import stage, table

llm = Registry()


_SPLIT = """CASE WHEN lower(trim(split)) IN ('val', 'valid') THEN 'validation' ELSE lower(trim(split)) END"""

_GROUPS = """
e AS (SELECT DISTINCT ecg_id e, patient_id p FROM ptbxl_recordings WHERE ecg_id IS NOT NULL AND patient_id > 0),
l AS (SELECT DISTINCT a.e x, b.e y FROM e a JOIN e b ON a.p = b.p),
reach AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
g AS (SELECT x, min(y) group_id FROM reach GROUP BY x),
c AS (SELECT DISTINCT ecg_id FROM cot_rows WHERE ecg_id IS NOT NULL),
m AS (SELECT c.ecg_id, coalesce(g.group_id, c.ecg_id) group_id FROM c LEFT JOIN g ON g.x = c.ecg_id)
"""


@llm.add(
    "p3_found",
    f"""WITH RECURSIVE {_GROUPS},
    b AS (SELECT group_id FROM m JOIN cot_rows r USING (ecg_id) WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1)
    SELECT ecg_id FROM m WHERE group_id IN (SELECT group_id FROM b)""",
)
def p3_found(spark, d):
    rows = table(spark, d, "cot_rows")
    return grouping.straddling(grouping.groups(table(spark, d, "ptbxl_recordings"), rows), rows)


@llm.add("p3_groups", f"WITH RECURSIVE {_GROUPS} SELECT ecg_id, group_id FROM m")
def p3_groups(spark, d):
    return grouping.groups(table(spark, d, "ptbxl_recordings"), table(spark, d, "cot_rows"))


@llm.add("p3_assigned")
def p3_assigned(spark, d):
    rows = table(spark, d, "cot_rows")
    return grouping.assign(grouping.groups(table(spark, d, "ptbxl_recordings"), rows), rows, table(spark, d, "split_targets"))


@llm.add("p3_shares")
def p3_shares(spark, d):
    rows = table(spark, d, "cot_rows")
    targets = table(spark, d, "split_targets")
    return grouping.shares(grouping.assign(grouping.groups(table(spark, d, "ptbxl_recordings"), rows), rows, targets), rows, targets)


@llm.add("p3_kept_together", "SELECT count(DISTINCT ecg_id) AS n_recordings, 0::BIGINT AS torn_groups, 3::BIGINT AS n_splits, true AS near_targets FROM cot_rows WHERE ecg_id IS NOT NULL")
def p3_kept_together(spark, d):
    """What an assignment must hold: every recording once, no group in two splits, shares within five hundredths (a hash of few groups can be off by that)."""
    rows, targets = table(spark, d, "cot_rows"), table(spark, d, "split_targets")
    a = stage(grouping.assign(grouping.groups(table(spark, d, "ptbxl_recordings"), rows), rows, targets))
    torn = a.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("z")).agg(F.count_if(F.col("a") != F.col("z")).alias("torn_groups"))
    near = grouping.shares(a, rows, targets).agg(F.count(F.lit(1)).alias("n_splits"), F.bool_and(F.abs(F.col("share") - F.col("target")) <= 0.05).alias("near_targets"))
    return a.agg(F.count(F.lit(1)).alias("n_recordings")).crossJoin(torn).crossJoin(near)  # one row each


@llm.add("p4_found")
def p4_found(spark, d):
    return pairs.defects(table(spark, d, "cot_rows"))


@llm.add("p4_report")
def p4_report(spark, d):
    rows = table(spark, d, "cot_rows")
    found = pairs.defects(rows).join(rows.select("row_id", "source").dropDuplicates(["row_id"]), "row_id")
    return found.groupBy("source", "defect").agg(F.count(F.lit(1)).alias("n_rows"))


@llm.add("p7_found")
def p7_found(spark, d):
    return overlap.found(overlap.overlaps(table(spark, d, "cot_rows")))


_ALIKE = f"""t AS (SELECT DISTINCT row_id, ecg_id, question, {_SPLIT} sp FROM cot_rows WHERE row_id IS NOT NULL AND ecg_id IS NOT NULL AND regexp_matches(question, '[A-Za-z]'))"""


@llm.add(
    "p7_equal_pairs",
    f"""WITH {_ALIKE} SELECT least(a.row_id, b.row_id) AS row_id_a, greatest(a.row_id, b.row_id) AS row_id_b FROM t a JOIN t b ON a.ecg_id = b.ecg_id AND a.question = b.question AND a.sp = 'train' AND b.sp IN ('validation', 'test')""",
)
def p7_equal_pairs(spark, d):
    """The pairs that the operator finds with questions equal to the letter: it must find all of these."""
    rows = table(spark, d, "cot_rows")
    q = rows.select("row_id", "question").dropDuplicates(["row_id"])
    pairs = overlap.overlaps(rows).select("train_row", "eval_row")
    same = pairs.join(q.select(F.col("row_id").alias("train_row"), F.col("question").alias("a")), "train_row").join(q.select(F.col("row_id").alias("eval_row"), F.col("question").alias("b")), "eval_row").where("a = b")
    return overlap.found(same)


@llm.add("p7_report")
def p7_report(spark, d):
    rows = table(spark, d, "cot_rows")
    return overlap.report(rows)


@llm.add("p8_ids")
def p8_ids(spark, d):
    return encoding.encode(table(spark, d, "documents"))


@llm.add("p8_corpus_tokens")
def p8_corpus_tokens(spark, d):
    return encoding.corpus_tokens(table(spark, d, "documents"))


@llm.add("p9_mix")
def p9_mix(spark, d):
    return mixture.mix(mixture.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@llm.add("p9_shares")
def p9_shares(spark, d):
    records, targets = mixture.sized(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixture.shares(mixture.mix(records, targets), records, targets)


@llm.add("p9_limits", "SELECT source, true AS within_budget, true AS within_repeats, true AS near_target FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE length(text) > 0)")
def p9_limits(spark, d):
    """What a mix must hold per source: no more tokens than the budget, no record more often than allowed, the share wanted."""
    records, targets = mixture.sized(table(spark, d, "documents")), table(spark, d, "mix_targets")
    s = mixture.shares(mixture.mix(records, targets), records, targets).join(F.broadcast(targets.groupBy("source").agg(F.max("max_repeats").alias("most"))), "source")  # the fixed table of targets
    return s.select("source", (F.col("tokens") <= F.col("budget")).alias("within_budget"), (F.col("most_copies") <= F.greatest(F.coalesce("most", F.lit(1)), F.lit(1))).alias("within_repeats"), (F.abs(F.col("share") - F.col("target")) <= 0.02).alias("near_target"))


@llm.add("p10_found")
def p10_found(spark, d):
    return residue.documents_with_residue(table(spark, d, "documents")).select("doc_id")


@llm.add("p10_clean_counts")
def p10_clean_counts(spark, d):
    kept = residue.without_residue(table(spark, d, "documents"))
    return kept.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"))
