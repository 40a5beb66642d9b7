"""Broken prompt and response pairs: empty, truncated, refusing, copying and other-language responses.

Every response is looked at once, in one Arrow pass that gives its words, its flags and the five-word runs of its opening.
Openings of answers are clustered by verified MinHash: a template that recurs as the answer to unrelated prompts answers
none of them, so it is a refusal, and so is every response whose opening holds a run that the template always has. No phrase
is listed. Copies, languages and terminations are checked per response: languages against words learned from the corpus,
terminations against how sentences of the corpus end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import text as T
from chronoloom.llm.minhash import SHINGLE, similar_pairs
from chronoloom.operators.components import connected_components
from chronoloom.session import stage

OPENING_WORDS = 14
CORE = 0.5  #: share of the kinds of a cluster that have a run of its template
COPY = 0.8  #: share of the question's words in the response, and of the response's words in the question
USUAL_END = 0.005  #: an unpunctuated ending is usual if this share of all responses has it
SHORT = 12  #: words below which a response is too short for function words to tell its language
FLUSH = 200_000  #: keys of a partial count that a task holds at a time

# fixed values: stand-ins for a missing value ("none" and "no" are answers)
STAND_INS = ["", "null", "nan", "n/a", "na", "n.a.", "#n/a", "[]", "{}", "()", "-", "--", "---", "...", "…", "?", "??", "???", ".", "_", "<empty>", "<null>", "<none>", "<na>", "(empty)", "(null)", "nil", "undefined", "empty", "missing", '""', "''", "answer:", "final answer:", "answer", "antwort:", "réponse :", "réponse:", "respuesta:", "the answer is", "tbd", "<na>", "<answer>"]
LABELS = r"^(?:q|question|you asked|the question (?:is|was)|asked|prompt|frage|sie fragten|pregunta|preguntó|usted preguntó|question posée|vous avez demandé)\s*[:\-–]\s*"
OPEN_WORDS = "and or the a an of to in with at by for from as is are was were be that which but than und oder der die das ein eine mit von zu im in bei als ist sind et ou le la les un une de du des dans avec à en est sont y o el los las del con en es son una que por para al".split()
ENDINGS = r"""[.!?。]['"”’)\]»*_]*$"""
CUT = r"(?:[,;:(\[{/–—&+]|\s-|…|\.\.\.|\[(?:output|token|length|max)[^\]]*\]|\((?:cut|truncated|continued|output)[^)]*\)|<(?:truncated|cut|eos|end)[^>]*>)$"
SAYS = r"(?:final answer|answer|the answer is|therefore the answer is|antwort|die antwort lautet|réponse|la réponse est|respuesta|la respuesta es)\s*:?\s+(\S[^.!?]*)$"

_ZERO, _BLANK, _LEADS = re.compile(T.ZERO_WIDTH), re.compile(T.BLANK), re.compile(T.LEADS)
_WORDS, _NUMBER = re.compile(r"[^\W_]+(?:['’][^\W_]+)*"), re.compile(r"[0-9]+(?:[.,][0-9]+)*")
_NO_WORD, _KEPT = re.compile(r"[^\w ]|_"), re.compile(r"[^\w#§'’.!? ]|_")
_LABELS, _ENDINGS, _CUT, _SAYS = re.compile(LABELS), re.compile(ENDINGS), re.compile(CUT), re.compile(SAYS)
_EMPTY, _OPEN = frozenset(STAND_INS), frozenset(OPEN_WORDS)
LANGUAGES = list(T.FUNCTION_WORDS)
_TALLY: dict[str, list[int]] = {}
for _i, _own in enumerate(T.FUNCTION_WORDS.values()):
    for _w in set(_own):
        _TALLY.setdefault(_w, []).append(_i)


def _squeeze(text: str | None) -> str:
    if text is None or text.isascii():
        return " ".join(text.split()) if text else ""
    return _BLANK.sub(" ", _ZERO.sub("", text or "")).strip(" ")


def _skeleton(low: str) -> str:
    return _LEADS.sub("§", _NUMBER.sub("#", low))


def _votes(tokens: list[str]) -> list[int]:
    out = [0] * len(LANGUAGES)
    for t in tokens:
        for i in _TALLY.get(t, ()):
            out[i] += 1
    return out


def _language(votes: list[int], least: int) -> str | None:
    """The language with the most function words; none with fewer than ``least`` or a tie."""
    top = max(votes)
    return LANGUAGES[votes.index(top)] if top >= least and votes.count(top) == 1 else None


def runs(words: list[str], n: int = SHINGLE) -> list[int]:
    """Distinct hashes of the runs of ``n`` words, in order; none where there are fewer words."""
    return list(dict.fromkeys(xxhash.xxh64_intdigest(" ".join(words[i : i + n])) - (1 << 63) for i in range(len(words) - n + 1)))


def is_copy(low: str, asked: frozenset[str] | set[str]) -> bool:
    """The words of the response are those of the question, whatever their case, spacing, marks, repetition or label."""
    own = set(_WORDS.findall(_LABELS.sub("", low)))
    both = len(own & asked)
    return len(asked) >= 3 and both >= COPY * len(asked) and both >= COPY * len(own)


def breaks_off(plain: str, low: str, rationale: bool, lowq: str, mine: list[str]) -> tuple[bool, bool]:
    """Whether a response surely breaks off, and whether only the corpus can tell.

    A response that ends a sentence is whole. Otherwise it is cut if it ends in an open mark or word or within a word of the
    question; if it states the answer, by whether that is all of the answer; a rationale that does neither must end as
    sentences of the corpus do. A missing full stop alone is no defect.
    """
    at_cut = bool(_CUT.search(plain))
    if not at_cut and _ENDINGS.search(plain):
        return False, False
    last = plain.rsplit(" ", 1)[-1]
    # case matters: "a" is an open word, the lead "I" isn't
    if at_cut or last in _OPEN or sum(map(plain.count, "([")) > sum(map(plain.count, ")]")):
        return True, False
    if not rationale:
        safe = _NO_WORD.sub("", low)
        at = lowq.find(safe)
        after = lowq[at + len(safe) : at + len(safe) + 1]
        return at >= 0 and len(safe) > 3 and after.isalpha() and (at == 0 or lowq[at - 1] == " "), False
    m = _SAYS.search(low)
    said = _WORDS.findall(m.group(1)) if m else []
    return bool(said) and len(said) <= len(mine) and said != mine and " ".join(mine).startswith(" ".join(said)), not said


LOOKED = "row_id long, field string, topic string, empty boolean, copy boolean, cut boolean, unsure boolean, foreign boolean, q_lang string, tokens array<string>, opening array<long>, q_runs array<long>, ending string, stat string, key string, a long, b long, c long"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
_COLUMNS = {k: _KINDS[t] for k, t in (x.split(" ") for x in LOOKED.split(", "))}


class _Counts:
    """Partial counts that leave with the responses: texts of a language that have a word (the empty word counts the texts),
    and pairs of words before an end mark (a), at the bare end of a text (b) and inside one (c)."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.marked, self.bare, self.inside = Counter(), Counter(), Counter()

    def text(self, lang: str | None, tokens: list[str]) -> None:
        if lang is not None and tokens:
            self.words.update([(lang, w) for w in set(tokens)])
            self.words[(lang, "")] += 1

    def ends(self, w: list[str]) -> None:
        if len(w) < 2:
            return
        self.words[("", "")] += 1
        inside = [f"{a} {b}" for a, b in zip(w, w[1:]) if b[-1] not in ".!?"]
        if w[-1][-1] not in ".!?":
            self.bare[inside.pop()] += 1
        self.inside.update(inside)
        # dots are no end of a sentence, nor does the text go on there
        self.marked.update([f"{a} {b.rstrip('.!?')}" for a, b in zip(w, w[1:]) if b[-1] in ".!?" and not b.endswith("..")])

    def full(self) -> bool:
        return len(self.words) + len(self.marked) + len(self.bare) + len(self.inside) > FLUSH

    def out(self) -> pa.RecordBatch:
        words, pairs = list(self.words), list({**self.marked, **self.bare, **self.inside})
        n = len(words) + len(pairs)
        of = lambda c: [c[k] for k in pairs]
        made = {
            "stat": [f"word {k[0]}" for k in words] + ["pair"] * len(pairs), "key": [k[1] for k in words] + pairs, "a": list(self.words.values()) + of(self.marked),
            "b": [0] * len(words) + of(self.bare), "c": [0] * len(words) + of(self.inside),
        }
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(made[k], t) if k in made else pa.nulls(n, t) for k, t in _COLUMNS.items()], names=list(_COLUMNS))


def _question(text: str | None) -> tuple[list[str], frozenset[str], str | None, str, list[int], str]:
    """Words, distinct words, language, bare text, runs, and first words of a question."""
    low = _squeeze(text).lower()
    asked = _WORDS.findall(low)
    q_words = _skeleton(" ".join(asked)).split()
    return asked, frozenset(asked), _language(_votes(asked), 1), _NO_WORD.sub("", low), runs(q_words), " ".join(q_words[:3])


def _response(text: str | None) -> tuple[str, str, list[str], list[int], list[int]]:
    """Plain and lower-case text, words, votes of languages, and runs of the opening."""
    plain = _squeeze(text)
    low = plain.lower()
    tokens = _WORDS.findall(low)
    return plain, low, tokens, _votes(tokens), runs(_skeleton(" ".join(tokens[:OPENING_WORDS])).split()[:OPENING_WORDS])


class _Known:
    """What ``make`` gives for short texts, which recur; long ones are looked at anew."""

    def __init__(self, make, most: int = 20_000, chars: int = 160) -> None:
        self.make, self.most, self.chars, self.held = make, most, chars, {}

    def __call__(self, text: str | None):
        if text is not None and len(text) > self.chars:
            return self.make(text)
        out = self.held.get(text)
        if out is None:
            if len(self.held) >= self.most:
                self.held.clear()
            out = self.held[text] = self.make(text)
        return out


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, of_question, of_response = _Counts(), _Known(_question), _Known(_response)
    for b in batches:
        out = {k: [] for k in _COLUMNS}
        for row_id, topic, question, *texts in zip(*[b.column(c).to_pylist() for c in ("row_id", "topic", "question", "answer", "rationale")]):
            asked, once, q_lang, lowq, q_runs, first = of_question(question)
            mine = of_response(texts[0])[2]
            counts.text(q_lang, asked)
            for field, text in zip(("answer", "rationale"), texts):
                plain, low, tokens, votes, opening = of_response(text)
                empty = low in _EMPTY or not tokens
                copy = not empty and is_copy(low, once)
                rationale = field == "rationale"
                cut, unsure = (False, False) if empty or copy else breaks_off(plain, low, rationale, lowq, mine)
                ending = None
                if rationale and not empty:
                    counts.text(_language(votes, 4), tokens)
                    if not copy:
                        w = [x for x in _KEPT.sub("", _skeleton(low)).split(" ") if x]
                        counts.ends(w)
                        ending = " ".join(w[-2:]) if unsure else None
                top = max(votes)
                foreign = len(tokens) >= SHORT and top >= 4 and q_lang is not None and votes[LANGUAGES.index(q_lang)] < 0.6 * top
                row = (
                    row_id, field, topic if topic is not None else first, empty, copy, cut, unsure, foreign, q_lang, tokens if len(tokens) < SHORT else [],
                    opening, [] if rationale else q_runs, ending, None, None, None, None, None,
                )
                for k, v in zip(_COLUMNS, row):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in _COLUMNS.items()], names=list(_COLUMNS))
        if counts.full():
            yield counts.out()
    yield counts.out()


def responses(rows: DataFrame) -> DataFrame:
    """One row per row id and field, answer or rationale, with all that the steps below need, and beside them (``stat`` not null)
    partial counts of the corpus; null row ids are left out."""
    topic = F.col("question_type").cast("string") if "question_type" in rows.columns else F.lit(None).cast("string")
    r = rows.where(F.col("row_id").isNotNull()).select("row_id", topic.alias("topic"), "question", "answer", "rationale").dropDuplicates(["row_id"])
    return r.mapInArrow(_look, LOOKED)


def templates(resp: DataFrame) -> DataFrame:
    """``run``: the five-word runs of templates that answer unrelated prompts alike.

    Openings of answers are clustered by MinHash with verified similarity. A cluster whose answers stand under several
    topics (kinds of question) is a template; its runs are those that half of its kinds have. Runs that occur in a
    question are left out.
    """
    a = resp.where((F.col("field") == "answer") & ~F.col("empty") & ~F.col("copy") & (F.size("opening") > 0))
    kinds = a.groupBy(F.xxhash64("opening").alias("kind")).agg(F.first("opening").alias("opening"), F.count(F.lit(1)).alias("n"), F.min("topic").alias("first"), F.max("topic").alias("last"))
    kinds = stage(kinds)
    links = similar_pairs(kinds, "kind", "opening")
    member = connected_components(links.unionByName(kinds.select(F.col("kind").alias("u"), F.col("kind").alias("v"))))
    member = stage(kinds.join(member.withColumnRenamed("node", "kind"), "kind"))
    spread = member.groupBy("component").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("kinds")).where("first != last").select("component", "kinds")
    held = member.join(spread, "component").select("component", "kinds", F.explode("opening").alias("run")).groupBy("component", "run").agg(F.count(F.lit(1)).alias("n"), F.first("kinds").alias("kinds"))
    asked = resp.where(F.size("q_runs") > 0).select(F.explode("q_runs").alias("run"))
    return held.where(F.col("n") >= CORE * F.col("kinds")).select("run").distinct().join(asked, "run", "left_anti")


def refusals(resp: DataFrame) -> DataFrame:
    """``row_id, field`` of responses whose opening holds a run of a template."""
    o = resp.where(~F.col("empty") & ~F.col("copy")).select("row_id", "field", F.explode("opening").alias("run"))
    return o.join(templates(resp), "run", "left_semi").select("row_id", "field").distinct()


def word_languages(looked: DataFrame, share: float = 0.9, least: int = 3) -> DataFrame:
    """``word, lang``: words that the corpus uses in one language only, learned from questions and whole rationales."""
    per = [F.sum(F.when(F.col("stat") == f"word {k}", F.col("a")).otherwise(0)).alias(k) for k in LANGUAGES]
    counts = stage(looked.where(F.col("stat").startswith("word ")).groupBy(F.col("key").alias("word")).agg(*per))
    totals = counts.where("word = ''").head()  # one row
    rate = {k: F.col(k) / F.lit(max(1, totals[k] if totals else 0)) for k in LANGUAGES}
    best = F.coalesce(*[F.when(r >= share * sum(rate.values(), F.lit(0.0)), F.lit(k)) for k, r in rate.items()])
    seen = sum((F.col(k) for k in LANGUAGES), F.lit(0))
    return counts.where((seen >= least) & (F.col("word") != "")).select("word", best.alias("lang")).where(F.col("lang").isNotNull() & ~F.col("word").rlike(r"^[0-9]"))


def other_language(resp: DataFrame, looked: DataFrame) -> DataFrame:
    """``row_id, field`` of responses mostly in another language than their question. Only short ones have tokens."""
    r = resp.where(F.col("q_lang").isNotNull())
    short = r.where(F.size("tokens") > 0).select("row_id", "field", "q_lang", "tokens", F.xxhash64("tokens").alias("kind"))
    kinds = short.groupBy("kind").agg(F.first("tokens").alias("tokens")).select("kind", F.explode("tokens").alias("word"))
    votes = kinds.join(stage(word_languages(looked)), "word").groupBy("kind").agg(*[F.count_if(F.col("lang") == k).alias(k) for k in LANGUAGES])
    own = F.coalesce(*[F.when(F.col("q_lang") == k, F.col(k)) for k in LANGUAGES])
    top = F.greatest(*LANGUAGES)
    return r.where("foreign").select("row_id", "field").unionByName(short.join(votes, "kind").where((top > 0) & (2 * own < top)).select("row_id", "field"))


def truncated(resp: DataFrame, looked: DataFrame) -> DataFrame:
    """``row_id, field`` of responses that break off: surely, or ending in two words in which the corpus ends no sentence."""
    stats = looked.where("stat = 'pair'").groupBy(F.col("key").alias("ending")).agg(F.sum("a").alias("marked"), F.sum("b").alias("bare"), F.sum("c").alias("inside"))
    usual = USUAL_END * (looked.where("stat = 'word ' and key = ''").agg(F.sum("a").alias("n")).head()["n"] or 0)
    ends = resp.where("unsure").select("row_id", "field", "ending").join(stats, "ending", "left")
    ok = ((F.col("marked") > 0) & (F.col("marked") >= F.col("inside"))) | ((F.col("bare") >= usual) & (F.col("bare") >= 0.2 * F.col("inside")))
    return resp.where("cut").select("row_id", "field").unionByName(ends.where(~F.coalesce(ok, F.lit(False))).select("row_id", "field"))


def defects(rows: DataFrame) -> DataFrame:
    """``row_id, defect``, distinct; a row has as many rows as it has kinds of defect, of its answer or rationale.

    Null texts are empty; a null question can only have empty, truncated or refusing responses. Empty responses have no
    further defect, and one that copies the question or refuses is not tested for its ending (nor a copy for its
    language). A refusal shows by recurring: one that occurs once, or under one kind of question only, isn't told from an
    answer. ``question_type`` is the kind of question where there is one, else its first words are. Rows sent twice count
    once; an empty table gives no rows; extra columns are ignored.
    """
    looked = stage(responses(rows))  # texts are looked at once; the steps below read columns of this table
    resp = looked.where("stat is null")
    content = resp.where(~F.col("empty") & ~F.col("copy"))
    refuse = stage(refusals(resp))
    cut = truncated(content, looked).join(refuse, ["row_id", "field"], "left_anti")
    parts = {"refusal": refuse, "truncated": cut, "other_language": other_language(content, looked)}
    out = resp.where(F.col("empty") | F.col("copy")).select("row_id", F.when(F.col("empty"), "empty").otherwise("copies_question").alias("defect"))
    for defect, part in parts.items():
        out = out.unionByName(part.select("row_id", F.lit(defect).alias("defect")))
    return out.distinct()
