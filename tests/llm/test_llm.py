"""The operators of the llm subpackage on small tables with known answers, with the dirt that tables can hold."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import rows  # noqa: E402

from chronoloom.llm import encoding, grouping, minhash, mixture, overlap, pairs, residue, text  # noqa: E402

COT = "row_id long, ecg_id long, template_id int, question_type string, question string, answer string, rationale string, split string, source string, q string"
REC = "ecg_id long, patient_id long, split string"
TOKENIZERS = Path(encoding.FOLDER)
needs_vocabulary = pytest.mark.skipif(not (TOKENIZERS / encoding.VOCABULARY).exists(), reason="no vocabulary files here")


def cot(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], COT)


# problem 3


def test_groups_against_brute_force(spark):
    rnd = random.Random(1)
    recs = [(rnd.randint(1, 150), rnd.choice([None, 0, -1, 7, *range(100, 160)]), "x") for _ in range(220)] + [(None, 100, "x"), (3, None, None)]
    recs += recs[:20]
    data = [(i, rnd.choice([None, *range(1, 200)]), 1, "verify", "q", "a", "r", rnd.choice([None, "train", " TEST", "val", "Validation"]), "s") for i in range(400)]
    up = {}
    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for e, p, _ in recs:
        if e is not None and p is not None and p > 0:
            a, b = find(("e", e)), find(("p", p))
            up[max(a, b)] = min(a, b)
    group = {e: find(("e", e))[1] for _, e, *_ in data if e is not None}
    even = {None: None, "train": "train", " TEST": "test", "val": "validation", "Validation": "validation"}
    splits = {}
    for r in data:
        if r[1] is not None and r[7] is not None:
            splits.setdefault(group[r[1]], set()).add(even[r[7]])
    r, c = spark.createDataFrame(recs, REC), cot(spark, data)
    g = grouping.groups(r, c)
    assert dict(map(tuple, g.collect())) == group
    assert {x[0] for x in grouping.straddling(g, c).collect()} == {e for e in group if len(splits.get(group[e], ())) > 1}


def test_split_shares_and_whole_groups(spark):
    recs = spark.createDataFrame([(i, 1 + i // 3, "") for i in range(1, 9001)], REC)
    c = spark.range(1, 9001).selectExpr("id as row_id", "id as ecg_id", "'train' as split")
    t = spark.createDataFrame([("train", 7.0), ("validation", 1.5), ("test", 1.5), ("none", 0.0), (None, 3.0)], "split string, share double")
    a = grouping.assign(grouping.groups(recs, c), c, t)
    assert a.groupBy("group_id").agg({"split": "min"}).count() == a.select("group_id", "split").distinct().count()
    got = {r["split"]: r["share"] for r in grouping.shares(a, c, t).collect()}
    assert set(got) == {"train", "validation", "test"} and abs(got["train"] - 0.7) < 0.03 and abs(got["test"] - 0.15) < 0.03
    assert rows(a) == rows(grouping.assign(grouping.groups(recs, c), c, t))


def test_large_groups_do_not_upset_the_shares(spark):
    recs = spark.createDataFrame([(i, 1 if i <= 3000 else 2 if i <= 3900 else i, "") for i in range(1, 9001)], REC)
    c = spark.range(1, 9001).selectExpr("id as row_id", "id as ecg_id", "'train' as split")
    t = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split string, share double")
    a = grouping.assign(grouping.groups(recs, c), c, t)
    assert a.where("ecg_id <= 3000").select("split").distinct().count() == 1
    assert all(abs(r["share"] - r["target"]) < 0.02 for r in grouping.shares(a, c, t).collect())
    empty = c.limit(0)
    assert grouping.assign(grouping.groups(recs, empty), empty, t).count() == 0


# problem 4

RATIONALES = [
    "Looking at lead {l}, the complexes come clean across the strip. The axis points towards {l}, so a broad cause is likely. The rest of the strip agrees",
    "I cannot see any clear P wave in {l}, which matters here. The interval was taken over {n} beats and is normal for this age.",
    "Each beat in {l} has a narrow complex, and P waves are regular. That settles the question in this recording. The answer is {a}",
]
GERMAN = "Die Frequenz liegt bei etwa {n} pro Minute und die Abstände sind regelmäßig. Damit ist die Frage für diese Aufzeichnung geklärt. Die Antwort lautet {a}."


def answers(n=240):
    rnd = random.Random(4)
    out = []
    for i in range(1, n + 1):
        lead = rnd.choice("V1 V2 aVL II III".split())
        if i % 6 == 0:
            a = rnd.choice(["ja", "nein", "unklar", "Vorhofflimmern"])
            out.append([i, i, 1, "verify", f"Ist in Ableitung {lead} Vorhofflimmern zu sehen?", a, GERMAN.format(n=i, a=a), "train", "s"])
        else:
            a = rnd.choice(["yes", "No.", "none", "not sure", "sinus rhythm", f"leads I and {lead}"])
            out.append([i, i, 1, "verify", f"Does lead {lead} of this tracing show sinus rhythm?", a, RATIONALES[i % 3].format(l=lead, n=i, a=a), "train", "s"])
    return out


def test_defects(spark):
    data = answers()
    put = {
        1: ("answer", "​", "empty"), 2: ("answer", None, "empty"), 3: ("rationale", "N/A", "empty"), 4: ("rationale", "...", "empty"), 5: ("answer", "leads II, aVF and", "truncated"),
        7: ("rationale", "Looking at lead V2, the complexes come clean across the", "truncated"), 8: ("rationale", "Each beat in V2 has a narrow comp", "truncated"), 9: ("rationale", "Each beat in II has a narrow complex, and P wa…", "truncated"),
        10: ("answer", "I'm sorry, but I can't help with reading medical recordings.", "refusal"), 11: ("rationale", "I'm sorry, but I can't help with reading medical recordings. Please ask a clinician.", "refusal"),
        13: ("answer", "You asked: Does lead V9 of this tracing show sinus rhythm", "copies_question"), 14: ("rationale", "DOES  LEAD V9 OF THIS TRACING SHOW SINUS RHYTHM?", "copies_question"),
        15: ("answer", "Vorhofflimmern", "other_language"), 16: ("rationale", GERMAN.format(n=3, a="nein"), "other_language"), 18: ("answer", "Leider darf ich diese Anfrage nicht beantworten.", "refusal"),
    }
    want = set()
    for i, (field, value, defect) in put.items():
        r = data[i - 1]
        if defect == "copies_question":
            r[4] = "Does lead V9 of this tracing show sinus rhythm?"
        r[5 if field == "answer" else 6] = value
        if defect == "other_language" and field == "rationale":
            r[5] = "yes"
        want.add((i, defect))
    data[19][5], data[19][6] = "", None  # two kinds of one defect are one row
    want.add((20, "empty"))
    # a refusal shows by recurring under another kind of question
    for i, (q, a) in enumerate([("What is the QT interval in lead V2?", put[10][1]), ("Wie lang ist das Intervall in Ableitung V2?", put[18][1])], 9001):
        data.append([i, i, 1, "measure", q, a, (GERMAN if q.startswith("Wie") else RATIONALES[2]).format(l="V2", n=i, a="300 ms"), "train", "s"])
        want.add((i, "refusal"))
    data[20][4] = None
    data[21][4] = "x " * 20_000
    df = cot(spark, [tuple(r) for r in data] + [tuple(data[0]), (None, 1, 1, "q", "q", "a", "r", "train", "s")])
    got = {tuple(r) for r in pairs.defects(df).collect()}
    assert got == want, (got - want, want - got)


def test_refusals_show_by_recurring_under_unrelated_questions(spark):
    """The clusters decide: no phrase is known beforehand."""
    made_up = "The brown lamp is kept behind that door today"
    data = answers(60)
    for i, kind in ((3, "verify"), (9, "choose"), (15, "measure")):
        data[i][3], data[i][5] = kind, made_up
    data[21][6] = f"{made_up}, said someone else."  # the same template as a rationale
    for i in (27, 33):
        data[i][5] = "A wet road leads to the north side"  # under one kind of question only
    got = {tuple(r) for r in pairs.defects(cot(spark, [tuple(r) for r in data])).collect()}
    assert got == {(i + 1, "refusal") for i in (3, 9, 15, 21)}


def test_defects_of_empty_table(spark):
    assert pairs.defects(cot(spark, [])).count() == 0


def test_language(spark):
    df = spark.createDataFrame([("Is there any sign of a rhythm on this ECG?",), ("Welcher Befund liegt vor?",), ("Quelles dérivations montrent le rythme ?",), ("¿Está presente en la derivación II?",), ("",), (None,)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(text.language(text.words(text.squeeze(F.col("t"))), 1)).collect()] == ["en", "de", "fr", "es", None, None]


def test_minhash_finds_similar_sets(spark):
    from pyspark.sql import functions as F

    base = [f"w{i}" for i in range(60)]
    data = [(1, base), (2, base[:58] + ["x", "y"]), (3, [f"v{i}" for i in range(60)]), (4, base[:20]), (5, []), (6, ["a", "b"])]
    df = spark.createDataFrame(data, "id long, w array<string>").withColumn("s", minhash.word_shingles(F.col("w")))
    assert rows(minhash.similar_pairs(df, "id", "s")) == [(1, 2)]
    assert {r["id"]: len(r["s"]) for r in df.collect()} == {1: 56, 2: 56, 3: 56, 4: 16, 5: 0, 6: 1}


# problem 7


def test_overlaps_against_brute_force(spark):
    rnd = random.Random(7)
    finding = ["ST elevation", "ST depression", "sinus rhythm", "left axis deviation", "right axis deviation", "burst noise"]
    def ask():
        q = rnd.choice(["Does lead {l} of this tracing show {f}?", "Is the {i} interval longer than {n} ms?", "Which leads show {f}?"]).format(l=rnd.choice(["I", "II", "V1", "V2"]), f=rnd.choice(finding), i=rnd.choice(["QT", "PR"]), n=rnd.choice([100, 120]))
        k = rnd.random()
        if k < 0.2:
            at = rnd.randrange(1, len(q) - 1)
            q = q[:at] + q[at + 1 :] if q[at].isalpha() and q[at - 1].islower() else q
        return rnd.choice(["{}", "{}", "<p>{}</p>", "Q: {}", "* {} Thanks."]).format(rnd.choice([q, q.upper(), q.replace(" ", " "), "​" + q]))

    data = [(i, rnd.choice([None, 1, 1, 1, 2, 3]), 1, "verify", rnd.choice([ask(), ask(), None, ""]), "a", "r", rnd.choice(["train", "Train ", "val", "test", None]), "s") for i in range(1, 260)]
    df = cot(spark, data + data[:20])
    even = lambda s: {"val": "validation"}.get((s or "").strip().lower(), (s or "").strip().lower())
    want = set()
    for a in data:
        for b in data:
            if a[1] is not None and a[1] == b[1] and a[4] and b[4] and even(a[7]) == "train" and even(b[7]) in ("validation", "test"):
                x, y = overlap.clean(a[4]), overlap.clean(b[4])
                if x and y and overlap.signature(x) == overlap.signature(y) and overlap._align(list(x), list(y)) >= 0:
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    found = overlap.overlaps(df)
    assert {tuple(r) for r in overlap.found(found).collect()} == want and len(want) > 30
    rep = overlap.report(df)
    assert sum(r["n_pairs"] for r in rep.collect()) == len(want)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Does this ECG show ST elevation?", "does this ecg shwo st elevation", True), ("Does this ECG show ST elevation?", "Does this ECG show ST depression?", False), ("Is the QT interval longer than 120 ms?", "Is the QT interval longer than 100 ms?", False),
        ("Is it seen in lead I?", "Is it seen in lead II?", False), ("Which leads show burst noise?", "What leads show burst noise? Give a reason.", True), ("Does this E.C.G. show noise?", "Does this ECG show noise?", True), ("left axis deviation seen?", "right axis deviation seen?", False),
    ],
)
def test_same_question(a, b, same):
    x, y = overlap.clean(a), overlap.clean(b)
    got = overlap.signature(x) == overlap.signature(y) and overlap.same_question(" ".join(x), " ".join(y))[0]
    assert got == same


def test_winnow_keeps_what_long_matches_share():
    rnd = random.Random(2)
    common = "".join(rnd.choice("abcdef ") for _ in range(60))
    a, b = (overlap.winnow("".join(rnd.choice("xyz") for _ in range(30)) + common)[0] for _ in range(2))
    assert set(a.tolist()) & set(b.tolist())
    assert overlap.chain(*map(__import__("numpy").array, ([0, 5, 9, 12], [0, 9, 5, 12]))) in ([(0, 0), (5, 9), (12, 12)], [(0, 0), (9, 5), (12, 12)])


def test_overlaps_of_empty_table(spark):
    assert overlap.overlaps(cot(spark, [])).count() == 0


# problem 8


@needs_vocabulary
def test_encoding_equals_the_library_and_round_trips(spark):
    import tiktoken

    e = encoding.Encoder(str(TOKENIZERS / encoding.VOCABULARY))
    lib = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rnd = random.Random(3)
    texts = ["Hello  world's\r\n \t x", "a" * 30_000, "漢字한" * 700, "<|endoftext|>", "\U0001f600‍⚕️́", " " * 999 + "x", "12,345.67 µV ١٢", "_" * 5000 + "!?" * 999]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2000), rnd.randrange(0x1F300, 0x1F600)])) for _ in range(rnd.randint(1, 200))) for _ in range(200)]
    back = {i: t for t, i in e.ranks.items()}
    df = spark.createDataFrame([*enumerate(texts), (-1, ""), (-2, None), (-2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(df).collect()}
    assert got[-1] == got[-2] == [] and encoding.encode(df).count() == len(texts) + 3
    for i, t in enumerate(texts):
        assert got[i] == lib.encode_ordinary(t)
        assert b"".join(back[x] for x in got[i]).decode() == t
    n = {r["doc_id"]: r["n_tokens"] for r in encoding.token_counts(df, ["doc_id"]).collect()}
    assert all(n[i] == len(got[i]) for i in got)


@needs_vocabulary
def test_forced_boundaries_never_cut_a_token():
    e = encoding.Encoder(str(TOKENIZERS / encoding.VOCABULARY))
    assert all(e.fragments(t) == [t] for t in e.ranks)
    piece = "xq١zzq\U0001f600qx".encode()
    assert b"".join(e.fragments(piece)) == piece and len(e.fragments(piece)) > 1


# problem 9


def records(spark, n):
    data = [(i, "ab"[i % 3 == 0], 10 + i % 7, 0.1 + (i % 10) / 11) for i in range(1, n + 1)] + [(9000 + i, "c", 100, 1.0) for i in range(3)]
    return spark.createDataFrame(data, "doc_id long, source string, n_tokens long, weight double")


def test_mix_meets_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BIN_ROWS", 50)  # many bins
    r = records(spark, 3000)
    t = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 3), ("zzz", 0.1, 1), (None, 0.5, 1), ("c", 0.0, 9)], "source string, weight double, max_repeats int")
    m = mixture.mix(r, t)
    got = {x["source"]: x for x in mixture.shares(m, r, t).collect()}
    assert set(got) == {"a", "b"} and abs(got["a"]["share"] - 2 / 3) < 0.002
    assert got["a"]["most_copies"] <= 2 and got["b"]["most_copies"] <= 3
    assert all(0 <= x["budget"] - x["tokens"] <= 17 for x in got.values())
    # complete epochs come before the fraction, and the fraction is a prefix of the keys
    for x in got.values():
        c = [y["copies"] for y in m.where(f"source = '{x['source']}'").collect()]
        assert max(c) - min(c) <= 1
    assert rows(mixture.mix(r, t)) == rows(m) and rows(mixture.mix(r, t, seed=1)) != rows(m)


def test_mix_prefers_quality(spark):
    data = [(i, "a", 10, 1.0 if i % 2 else 0.1) for i in range(1, 2001)]
    r = spark.createDataFrame(data, "doc_id long, source string, n_tokens long, weight double")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    m = mixture.mix(r, t, total=5000)
    assert m.count() == 500 and m.where("doc_id % 2 = 1").count() > 400


@needs_vocabulary
def test_mix_of_dirty_and_empty_documents(spark):
    d = spark.createDataFrame([(1, "some text here", "a", "x"), (2, None, "a", "x"), (3, "", "a", "x"), (None, "text", "a", "x"), (5, "more text", None, "x")], "doc_id long, text string, source string, weight string")
    t = spark.createDataFrame([("a", 1.0, None)], "source string, weight double, max_repeats int")
    s = mixture.sized(d)
    assert [r[0] for r in mixture.mix(s, t).select("doc_id").collect()] == [1]
    assert mixture.mix(mixture.sized(d.limit(0)), t).count() == 0


# problem 10

GOOD = [
    "The label set follows the 128 Hz cadence for {n} minutes. Splits follow the subject, so no person appears on two sides.", "When the registry answers 408 request timeout, the reader waits {n} s and asks again; marks are kept meanwhile.",
    "The guide shows `<sampling_rate>` in paths, which the tool replaces at build time. Paths follow `{{site}}/{{signal}}.parquet`, braces included.", "Since 1.{n} the chart page also works when scripts are switched off in the browser.",
    'In the log, "503 service unavailable" appears {n} times, always for the old mirror.', "Array indices such as x[{n}] and sets like {{1, 2, {n}}} are written in the usual way. Citations use brackets [{n}].", "We counted {n} pages that only said JavaScript was required and left them out of the set.",
    "In $x_{{i}} = \\sum_{{k}} a_{{k}}$ the index k runs over the {n} leads. The TODO list of the team is closed, all {n} points are done.",
]
BAD = [
    "404 Not Found", "Please enable JavaScript to view this recording.", "Lorem ipsum dolor sit amet consectetur elit.", "The collection {{ site }} holds 12 recordings.", "The trace was aligned to [insert channel here] at 10 Hz.", "Veuillez activer JavaScript pour afficher ce tracé.",
    "The label set follows the 128 Hz cadence. Internal Server Error", "Seite nicht gefunden (404)", "The %DATE% import was checked.", '{"error": {"code": 504, "message": "Gateway Timeout"}}', "Placeholder paragraph for the summary.", "<html><body><h1>Access denied.</h1></body></html>",
]


def test_residue(spark):
    good = [(i, GOOD[i % len(GOOD)].format(n=i)) for i in range(1, 400)] + [(5000, "The label set follows the 64 Hz cadence. " * 5000)]
    bad = [(1000 + i, BAD[i % len(BAD)]) for i in range(60)] + [(2000, "The label set follows the grid. " * 3000 + "{{ version }}")]
    docs = spark.createDataFrame([(*x, "c") for x in good + bad + bad[:5] + [(3000, None), (3001, ""), (3002, " \n "), (None, "404 Not Found")]], "doc_id long, text string, kind string")
    got = {r[0] for r in residue.documents_with_residue(docs).select("doc_id").collect()}
    want = {i for i, _ in bad}
    assert got == want, (got - want, want - got)
    assert residue.without_residue(docs.where("doc_id is not null")).count() == len(good) + 3


def test_residue_of_empty_table(spark):
    assert residue.documents_with_residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_coverage_counts_what_seeds_and_extensions_cover(spark):
    data = [(1, 1, 1, "verify", "Does this recording show a clear T wave inversion in lead V2?", "a", "r", "train", "s"), (2, 1, 1, "verify", "Does this recording show a claer T wave inversion in lead V2?", "a", "r", "test", "s"), (3, 1, 1, "verify", "Does this recording show a clear T wave inversion in lead V2? Thanks", "a", "r", "val", "s")]
    got = {r["eval_row"]: r["coverage"] for r in overlap.overlaps(cot(spark, data)).collect()}
    assert 0.8 < got[2] < 1 and 0.8 < got[3] < 1
    best = {r["split"]: r["mean_coverage"] for r in overlap.report(cot(spark, data)).collect()}
    assert best == {"test": got[2], "validation": got[3]}


def test_bins_of_a_mix_are_even_for_any_weight(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixture, "BIN_ROWS", 50)
    r = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("n_tokens"), F.lit(0.1).alias("weight"))
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    assert mixture.mix(r, t, total=20_000).agg({"n_tokens": "sum"}).head()[0] == 20_000
