"""Same or near-same questions across splits, within one recording.

Questions are cleaned and reduced to distinct ones per recording; winnowing keeps the least rolling hash of every
window. A pair must share ``COVER`` of the fingerprints of both; so it shares one of the rarest n - ceil(COVER n) + 1 of each,
and only these are looked up: no such pair is lost, and wording that all questions share yields no candidates. Shared seeds
of a candidate are chained in order, and the stretches between them are aligned word by word; names, leads and numbers must
agree exactly. The coverage of a pair is the share of its questions' characters that seeds and extensions cover.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import stage

GRAM, WINDOW = 5, 4
COVER = 0.4  #: share of the fingerprints of either question that a pair has in common at least; part of what a pair is

# fixed values: what may stand before or after a question without changing it
BEFORE = ["q", "question", "repeat", "repeated", "again", "please answer", "please", "answer", "asked", "you asked", "frage", "bitte", "pregunta", "por favor", "nochmal", "hello", "hi", "encore", "once more"]
AFTER = ["thanks", "thank you", "give a reason", "give reasons", "answer briefly", "please", "please explain", "explain", "explain why", "be brief", "briefly", "danke", "bitte", "merci", "gracias", "por favor", "why", "again", "repeat", "in short", "keep it short", "answer in one word", "s'il vous plaît"]
# fixed values: words that stand for each other without asking something else
ALIKE = [
    "this that the a an", "which what", "in on of", "recording tracing trace strip ecg ekg electrocardiogram", "seen visible found", "longer greater above over", "exceed surpass", "show shows display displays", "signs sign evidence indication",
    "dieser diese dieses diesem der die das dem ein eine einem", "welche welcher welches", "aufzeichnung ekg kurve", "sehen erkennen", "ce cet cette le la l un une", "quel quelle quels quelles", "este esta el la un una", "qué cuál cuáles", "registro trazado ecg", "ecg tracé enregistrement",
]
KIND = {w: i for i, ws in reversed(list(enumerate(ALIKE))) for w in ws.split()}
# fixed values: words that a typing error may not turn into each other
EXACT = set("i ii iii avr avl avf qt pr rr qrs st av t q p r u no not".split())
_PREFIX = sorted((tuple(x.split()) for x in BEFORE), key=len, reverse=True)
_SUFFIX = sorted((tuple(x.split()) for x in AFTER), key=len, reverse=True)


def even_split(split: Column) -> Column:
    """train, validation or test, however it is spelled; other values as they are in lower case; null stays null."""
    s = F.lower(F.regexp_replace(split, r"[\s\u00a0\u200b\ufeff]+", ""))
    return F.when(s.isin("val", "valid", "validation", "dev", "validate"), "validation").when(s.isin("train", "training"), "train").when(s.isin("test", "testing", "tests"), "test").when(s != "", s)


def clean(question: str) -> tuple[str, ...]:
    """The words of a question without markup, case, invisible characters, and words that don't change it."""
    s = unicodedata.normalize("NFKC", re.sub("[\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff]", "", question))
    s = re.sub(r"(?<![^\W_]{2})(?<=[^\W_])\.(?=[^\W_]\b)", "", s)  # letters with dots between them
    s = re.sub(r"&[a-z]+;|</?[a-zA-Z][^<>]*>", " ", s).casefold().replace("’", "'")
    t = re.findall(r"[^\W_]+(?:'[^\W_]+)*", s)
    changed = True
    while changed and len(t) > 1:
        changed = False
        for x in _PREFIX:
            if len(t) > len(x) + 1 and tuple(t[: len(x)]) == x:
                t, changed = t[len(x) :], True
                break
        for x in _SUFFIX:  # the longest first, from the start again after each
            if len(t) > len(x) + 1 and tuple(t[-len(x) :]) == x:
                t, changed = t[: -len(x)], True
                break
    return tuple(t)


def signature(tokens: tuple[str, ...]) -> str:
    """What must agree exactly: numbers, leads and intervals, in order."""
    return " ".join(x for x in tokens if x in EXACT or any(c.isdigit() for c in x))


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their places: the least hash of each window of rolling gram hashes (the rightmost of equals)."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) <= gram:
        return np.array([np.uint64(hash_words(codes))]), np.zeros(1, int)
    with np.errstate(over="ignore"):
        base = np.uint64(0x100000001B3)
        h = np.zeros(len(codes) - gram + 1, np.uint64)
        for i in range(gram):
            h = h * base + codes[i : i + len(h)]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    w = min(window, len(h))
    rows = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    at = np.unique(np.arange(len(rows)) + w - 1 - rows.argmin(1))
    return h[at], at


def hash_words(codes: np.ndarray) -> int:
    h = 0xCBF29CE484222325
    for c in codes.tolist():
        h = ((h ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def chain(pa_: np.ndarray, pb: np.ndarray) -> list[tuple[int, int]]:
    """The longest run of seeds that is in order in both texts (patience, n log n)."""
    order = np.lexsort((-pb, pa_))
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    seeds = [(int(pa_[i]), int(pb[i])) for i in order]
    for i, (_, b) in enumerate(seeds):
        k = bisect.bisect_left(tops, b)
        if k == len(tops):
            tops.append(b), ends.append(i)
        else:
            tops[k], ends[k] = b, i
        back.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def slip(a: str, b: str) -> bool:
    """Whether one word is the other with a typing error: one letter added, lost, changed or two swapped (two errors in
    words of eight letters or more)."""
    if a == b or (a in KIND and any(a in ws.split() and b in ws.split() for ws in ALIKE)):
        return True
    if a in EXACT or b in EXACT or min(len(a), len(b)) < 2 or max(len(a), len(b)) < 3 or any(c.isdigit() for c in a + b):
        return False
    most = 2 if min(len(a), len(b)) >= 8 else 1
    if abs(len(a) - len(b)) > most:
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            d = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[i - 2][j - 2] + 1)
            rows[i].append(d)
    return rows[-1][-1] <= most


def _align(a: list[str], b: list[str]) -> int:
    """How many characters of two short runs of words are the same word for word (with the space after each), or -1 where the
    runs differ by more than typing errors and lost or added spaces."""
    i = j = same = 0
    while i < len(a) and j < len(b):
        if slip(a[i], b[j]):
            same += len(a[i]) + 1 if a[i] == b[j] else 0
            i, j = i + 1, j + 1
        elif j + 1 < len(b) and slip(a[i], b[j] + b[j + 1]):
            i, j = i + 1, j + 2
        elif i + 1 < len(a) and slip(a[i] + a[i + 1], b[j]):
            i, j = i + 2, j + 1
        else:
            return -1
    return same if i == len(a) and j == len(b) else -1


def same_question(a: str, b: str) -> tuple[bool, float]:
    """Whether the cleaned questions are the same, and the share of the longer one that seeds and their extensions cover
    (words with a typing error aren't covered)."""
    if a == b:
        return True, 1.0
    whole = max(len(a), len(b)) + 1
    fa, at_a = winnow(a)
    fb, at_b = winnow(b)
    _, ia, ib = np.intersect1d(fa, fb, return_indices=True)
    if len(ia) < COVER * max(len(np.unique(fa)), len(np.unique(fb))):
        return False, 0.0
    # words wholly inside a seed agree already; the stretches between seeds are aligned
    left_a = left_b = covered = 0
    for x, y in chain(at_a[ia], at_b[ib]):
        n = min(GRAM, len(a) - x, len(b) - y)
        # a seed counts from its first word start to its last word end
        sa, sb = a.find(" ", x, x + n), b.find(" ", y, y + n)
        if sa < 0 or sb < 0 or sa - x != sb - y or sa < left_a or sb < left_b:
            continue
        agreed = _align(a[left_a:sa].split(), b[left_b:sb].split())
        if agreed < 0:
            return False, covered / whole
        covered += agreed
        left_a, left_b = sa + 1, sb + 1
    agreed = _align(a[left_a:].split(), b[left_b:].split())
    return (False, covered / whole) if agreed < 0 else (True, (covered + agreed) / whole)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, sig, marks, kept = [], [], [], []
        for q in batch.column("question").to_pylist():
            t = clean(q)
            kept.append(min(1.0, sum(map(len, t)) / max(1, sum(map(len, re.findall(r"[^\W_]+(?:['’][^\W_]+)*", q))))))
            text.append(" ".join(t)), sig.append(signature(t))
            marks.append(winnow(text[-1])[0].view(np.int64) if text[-1] else np.zeros(0, np.int64))
        flat = np.concatenate(marks) if marks else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(text, pa.string()), pa.array(sig, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())), pa.array(kept, pa.float64())], names=["q", "plain", "sig", "marks", "kept"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same, cover = [], []
        for a, b in zip(batch.column("a_plain").to_pylist(), batch.column("b_plain").to_pylist()):
            ok, c = same_question(a, b)
            same.append(ok), cover.append(c)
        yield pa.RecordBatch.from_arrays([batch.column("ecg_id"), batch.column("a"), batch.column("b"), pa.array(cover, pa.float64())], names=["ecg_id", "a", "b", "coverage"]).filter(pa.array(same))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by class of equal cleaned questions, and the pairs of classes of one recording that ask the same.

    The members are ``row_id, ecg_id, split, train, kind, kept`` (``kept``: the share of the question that cleaning left);
    the pairs ``ecg_id, a, b, coverage`` with a train class and an evaluation class.
    """
    r = rows.select("row_id", "ecg_id", even_split(F.col("split")).alias("split"), "question").where(F.col("row_id").isNotNull() & F.col("ecg_id").isNotNull() & F.col("question").isNotNull() & F.col("split").isin("train", "validation", "test")).dropDuplicates(["row_id"])
    r = r.withColumn("train", F.col("split") == "train").withColumn("q", F.xxhash64("question"))
    # recordings that are in train and elsewhere; the rest has no pairs
    both = r.groupBy("ecg_id").agg(F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e")).where("t > 0 and e > 0").select("ecg_id")
    r = stage(r.join(both, "ecg_id", "left_semi"))
    texts = r.select("q", "question").dropDuplicates(["q"]).mapInArrow(_prepare, "q long, plain string, sig string, marks array<long>, kept double").where("plain != ''")
    texts = stage(texts.withColumn("kind", F.xxhash64("plain")))
    member = stage(r.join(texts.select("q", "kind", "kept"), "q").select("row_id", "ecg_id", "split", "train", "kind", "kept"))
    kinds = texts.dropDuplicates(["kind"]).select("kind", "plain", "sig", "marks")
    # rarest fingerprints first, as many as a pair that covers enough must have one of in common
    marks = kinds.select("kind", "sig", F.explode(F.array_distinct("marks")).alias("mark"), F.size(F.array_distinct("marks")).alias("n"))
    often = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("often", "mark"))
    keys = stage(marks.join(often, "mark").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * COVER) + 1).select("kind", "sig", "mark"))
    asked = member.select("ecg_id", "train", "kind").distinct()
    at = asked.join(keys, "kind")
    a = at.where("train").select("ecg_id", "sig", "mark", F.col("kind").alias("a"))
    b = at.where("not train").select("ecg_id", "sig", "mark", F.col("kind").alias("b"))
    candidates = a.join(b, ["ecg_id", "sig", "mark"]).where("a != b").select("ecg_id", "a", "b").distinct()
    plain = kinds.select("kind", "plain")
    candidates = candidates.join(plain.select(F.col("kind").alias("a"), F.col("plain").alias("a_plain")), "a").join(plain.select(F.col("kind").alias("b"), F.col("plain").alias("b_plain")), "b").select("ecg_id", "a", "b", "a_plain", "b_plain")
    near = candidates.mapInArrow(_verify, "ecg_id long, a long, b long, coverage double")
    own = asked.groupBy("ecg_id", "kind").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("ecg_id", F.col("kind").alias("a"), F.col("kind").alias("b"), F.lit(1.0).alias("coverage"))
    return member, near.unionByName(own)


def overlaps(rows: DataFrame) -> DataFrame:
    """``train_row, eval_row, eval_split, coverage``: every pair of rows of one recording, one in train and one in
    validation or test, that ask the same question.

    Rows without id, recording, split or question take no part, nor do questions without a word. Rows sent twice count
    once. Empty tables give no rows. Steps are staged when this is called.
    """
    member, pairs = classes(rows)
    left = member.where("train").select("ecg_id", F.col("kind").alias("a"), F.col("row_id").alias("train_row"), F.col("kept").alias("_a"))
    right = member.where("not train").select("ecg_id", F.col("kind").alias("b"), F.col("row_id").alias("eval_row"), F.col("split").alias("eval_split"), F.col("kept").alias("_b"))
    both = pairs.join(left, ["ecg_id", "a"]).join(right, ["ecg_id", "b"])
    return both.select("train_row", "eval_row", "eval_split", (F.col("coverage") * F.least("_a", "_b")).alias("coverage"))


def found(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b")).distinct()


def report(rows: DataFrame) -> DataFrame:
    """Per evaluation split and source: rows, rows with an overlap, pairs, and mean coverage of the best overlap. Pairs are
    counted by classes; none is made."""
    member, pairs = classes(rows)
    train = member.where("train").groupBy("ecg_id", F.col("kind").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("_a"))
    per = pairs.join(train, ["ecg_id", "a"]).select("ecg_id", F.col("b").alias("kind"), "n", "coverage", "_a")
    # the best pair of a row: the coverage of the classes times what cleaning left of the worse kept question
    hit = member.where("not train").select("row_id", "ecg_id", "kind", "kept").join(per, ["ecg_id", "kind"])
    best = hit.groupBy("row_id").agg(F.sum("n").alias("pairs"), F.max(F.col("coverage") * F.least("_a", "kept")).alias("coverage")).withColumnRenamed("row_id", "eval_row")
    r = rows.select("row_id", even_split(F.col("split")).alias("split"), "source").where(F.col("split").isin("validation", "test")).dropDuplicates(["row_id"])
    return r.join(best, r["row_id"] == best["eval_row"], "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("eval_row").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.avg("coverage").alias("mean_coverage")
    )
