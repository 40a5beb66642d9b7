"""Template residue, filler, error pages and script notices in place of content.

Every text is cut into passages: sentences, and separately each place that has the form of a template field. A few
unmistakable forms (double braces, "lorem ipsum", a status code with its reason phrase, a call to enable scripts) are the
trusted positives; everything else is unlabelled. A naive Bayes model of each kind of passage is fitted by
expectation-maximisation: the features are words and pairs of words (of a field: what stands around it), and the prior of a
passage is how much of the rest of its document is residue. The model scores all passages, and a document with a passage
that is more likely residue than content is a case. There is no list of phrases beside the model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18  #: hashed features
FIT_TRUSTED, FIT_OTHER = 60_000, 600_000  #: bound of the sample the model is fitted on: passages of documents with and without a trusted one
ROUNDS = 10
START = 0.1  #: what a field that is not trusted and not set as code, quotation or formula starts with
SMOOTH = 3.0  #: passages of either class that are added with the features of the whole sample
PULL = 4.0  #: passages at the corpus' share of residue that are added to the rest of a document
FLOOR, CAP = 1e-4, 8.0  #: least prior of a passage; most that a feature can weigh

# fixed values: tags that are markup, not fields
MARKUP = set("a abbr b big blockquote body br center cite code col dd del details div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd li link main mark meta nav noscript ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video".split())
# fixed values: the beginnings of passages that are trusted to be residue
ANCHORS = re.compile(
    r"^\W*(?:(?:please |bitte |veuillez |por favor,? )?(?:enable|activate|allow|turn on|switch on|aktivieren sie|activer|activez|active|habilite) (?:java\s?script|js|scripts)\b"
    r"|(?:http(?:/[\d.]+)? |error )?[45]\d\d\W+(?:bad request|unauthori[sz]ed|forbidden|not found|request timeout|gone|too many requests|(?:internal )?server error|bad gateway|service unavailable|gateway timeout)"
    r"|(?:page not found|seite nicht gefunden|page introuvable|p[aá]gina no encontrada|access denied|internal server error|bad gateway|gateway timeout)\W*(?:[45]\d\d)?\W*$|(?:your )?session (?:has )?expired\b|(?:an|une) (?:\w+ )?(?:error|erreur) (?:has )?(?:occurred|est survenue)|se (?:ha producido|produjo) un error|es ist ein fehler"
    r"|(?:sorry, )?we are down for maintenance|the \w+ you (?:asked for|requested) (?:does not exist|was not found)|\{\s*\"(?:error|status)\"\W+(?:\{\s*\"code\"\W+)?[45]\d\d|(?:your )?text (?:goes )?here\W*$|(?:coming soon|to be added)\W*$|placeholder (?:text|paragraph)\b)",
    re.I,
)
#: every anchor has one of these, which is cheaper to look for
_MAYBE = ("script", "js", "40", "41", "42", "50", "lorem", "not found", "nicht gefunden", "introuvable", "no encontrada", "denied", "expired", "err", "fehler", "maintenance", "asked", "requested", "status", "text", "soon", "be added", "placeholder", "server", "gateway")
_NAME = r"[^\W\d][\w.:/-]*(?:[ _-][\w.]+){0,4}"
SLOT = re.compile(
    r"(?=[{<%$\[@#_TFX])(?:(?P<dbl>\{\{[^{}\n]*\}\})|(?P<erb><%=?[^<>\n]+%>)|(?P<tag>\{%[^{}\n]+%\})|(?P<pct>%\([^()\n]+\)[sdfr])|(?P<dollar>\$[\[{(]\s*" + _NAME + r"\s*[\]})])|(?P<wiki>\[\[[^\[\]\n]+\]\])|(?P<dbla><<[^<>\n]+>>)"
    r"|(?P<at>@@[^@\n]+@@)|(?P<hash>#" + _NAME + r"#)|(?P<perc>%" + _NAME + r"%)|(?P<under>__[^\W\d_][\w. ]*?__|_{4,})|(?P<dots>\[\.\.\.[^\[\]\n]+\.\.\.\])"
    r"|(?P<brace>\{\s*" + _NAME + r"\s*\})|(?P<square>\[\s*" + _NAME + r"\s*\])|(?P<angle><\s*" + _NAME + r"\s*>)|(?P<mark>\b(?:TBD|TBA|FIXME|X{3,})\b|\bTODO\s*:\s*\w[\w.]*))"
)
_SLOT_SIGNS = ("{", "<", "%", "$", "[", "@@", "#", "__", "TB", "FIXME", "XXX", "TODO")  #: every field has one of these
TRUSTED_SLOTS = {"dbl", "erb", "tag", "at", "dbla", "dots"}
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>")
_END = r"[.!?…]+(?=\s)|[\r\n]+"
_CUT = re.compile(_END)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[\"“”«»„`|{}]|" + _END)
_WORD = re.compile(r"[^\W\d_]+|\d+|[\"“”«»„`|{}]")
_NUMBERS: dict[str, int] = {}  # words seen by this process and their buckets; a boundary is -1
_KNOWN = 200_000  #: words a process keeps before it starts anew


def _hash(x: str) -> int:
    return zlib.crc32(x.encode()) & (BUCKETS - 1)


def _number(token: str) -> int:
    n = _NUMBERS.get(token)
    if n is None:
        if len(_NUMBERS) >= _KNOWN:
            _NUMBERS.clear()
        n = _NUMBERS[token] = -1 if token[0] in ".!?…\r\n" else _hash("w #" if token[0].isdigit() else "w " + token)
    return n


def slots(text: str) -> Iterator[tuple[bool, bool, list[int]]]:
    """Of each place with the form of a template field: whether it is trusted, whether it is set as code, quotation or formula,
    and features of what stands around it.

    The form itself is no feature: it made the trusted ones."""
    for m in SLOT.finditer(text) if any(x in text for x in _SLOT_SIGNS) else ():
        a, z = m.span()
        inner = re.sub(r"^\W+|\W+$", "", m.group(0))
        if m.lastgroup == "angle" and inner.split()[0].lower() in MARKUP:
            continue
        before, after, line = text[max(0, a - 60) : a], text[z : z + 60], text.rfind("\n", 0, a) + 1
        code = text.count("`", line, a) % 2 == 1
        quoted = bool(re.search(r"[\"'“«„]$", before) and re.match(r"[\"'”»“]", after))
        formula = text.count("$", line, a) % 2 == 1 and "$" in after
        left, right = _WORD.findall(before.lower())[-4:], _WORD.findall(after.lower())[:4]
        form = "none" if not inner else "letters" if any(c.isalpha() for c in inner) else "digits"
        feats = [f"code {code}", f"quoted {quoted}", f"formula {formula}", f"form {form} {len(inner) == 1}", f"prev {before[-1:]}", f"next {after[:1]}"]
        feats += [f"L {w}" for w in left] + [f"R {w}" for w in right] + [f"L1 {left[-1:]}", f"R1 {right[:1]}"]
        yield m.lastgroup in TRUSTED_SLOTS and not code and not quoted, code or quoted or formula, [_hash(f) for f in dict.fromkeys(feats)]


def _plain(text: str) -> str:
    """Without markup; its tags part passages."""
    return _TAG.sub(lambda m: "\n" if m.group(1).lower() in MARKUP else m.group(0), text) if "<" in text else text


def _anchored(bare: str, low: str) -> list[bool]:
    """Which sentences have a trusted form, in order; empty if none has. ``low`` is ``bare`` in lower case."""
    if not any(x in low for x in _MAYBE):
        return []
    out = []
    for p in _CUT.split(bare):
        if _WORD.search(p):
            own = p.lower()
            out.append(("lorem" in own and "ipsum" in own) or bool(ANCHORS.match(p)))
    return out if any(out) else []


def has_trusted(text: str) -> bool:
    bare = _plain(text)
    return any(_anchored(bare, bare.lower())) or any(t for t, _, _ in slots(text))


class Passages:
    """The passages of a batch of texts: of each its document's place, kind, trust; and of each feature its passage."""

    def __init__(self, texts: list[str]) -> None:
        numbers: list[int] = []
        marks: list[tuple[int, list[bool]]] = []
        slot_doc, slot_trusted, slot_set, slot_feats = [], [], [], []
        ends = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            bare = _plain(text)
            low = bare.lower()
            numbers.extend(map(_number, _TOKEN.findall(low)))
            numbers.append(-1)
            ends[i] = len(numbers)
            sure = _anchored(bare, low)
            if sure:
                marks.append((i, sure))
            for t, c, f in slots(text):
                slot_doc.append(i), slot_trusted.append(t), slot_set.append(c), slot_feats.append(f)
        ids = np.array(numbers, np.int64)
        word = ids >= 0
        first = word & ~np.r_[False, word[:-1]]
        row_of = np.cumsum(first) - 1
        doc = np.searchsorted(ends, np.flatnonzero(first), side="right")
        trusted = np.zeros(len(doc), bool)
        starts = np.searchsorted(doc, np.arange(len(texts)))
        for i, sure in marks:
            trusted[starts[i] : starts[i] + len(sure)] = sure
        row = row_of[word]
        pair = word[:-1] & word[1:]
        size = np.bincount(row, minlength=len(doc))
        opens = np.flatnonzero(first)[size > 2]
        flat = [ids[word], (ids[:-1][pair] * 31 + ids[1:][pair] * 131 + 7) & (BUCKETS - 1), (ids[opens] * 17 + 3) & (BUCKETS - 1)]
        rows = [row, row_of[:-1][pair], row_of[opens]]
        n = len(doc)
        flat.append(np.array([x for f in slot_feats for x in f], np.int64))
        rows.append(n + np.repeat(np.arange(len(slot_feats)), [len(f) for f in slot_feats]).astype(np.int64))
        both = np.sort(np.concatenate(rows) * BUCKETS + np.concatenate(flat))
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both  # a feature counts once in a passage
        self.flat, self.row = both % BUCKETS, both // BUCKETS
        self.doc = np.r_[doc, np.array(slot_doc, np.int64)].astype(np.int64)
        self.trusted = np.r_[trusted, np.array(slot_trusted, bool)]
        self.slot = np.r_[np.zeros(n, bool), np.ones(len(slot_doc), bool)]
        self.set_off = np.r_[np.zeros(n, bool), np.array(slot_set, bool)]


def rest_of_document(p: np.ndarray, doc: np.ndarray, base: float) -> np.ndarray:
    """Log odds of a passage before it is looked at: the share of residue in the rest of its document, even odds at most."""
    n, total = np.bincount(doc), np.bincount(doc, weights=p)
    share = (total[doc] - p + PULL * base) / (n[doc] - 1 + PULL)
    share = np.clip(share, FLOOR, 0.5)
    return np.log(share / (1 - share))


def _logistic(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _sums(into: np.ndarray, of: np.ndarray, value: np.ndarray, size: int, block: int = 1 << 20) -> np.ndarray:
    """Sums of ``value[of]`` by ``into``, in blocks, so that no array as long as all features is made."""
    out = np.zeros(size)
    for a in range(0, len(into), block):
        out += np.bincount(into[a : a + block], weights=value[of[a : a + block]], minlength=size)
    return out


def fit(flat: np.ndarray, row: np.ndarray, slot: np.ndarray, trusted: np.ndarray, doc: np.ndarray, set_off: np.ndarray, rounds: int = ROUNDS, weight: np.ndarray | None = None) -> dict[bool, tuple[np.ndarray, float]]:
    """Weights of features and the share of residue, for slots (True) and for sentences (False), by EM from positive and
    unlabelled passages.

    Trusted passages stay residue. Other fields start at ``START``, or as content where they are set as code, quotation or formula;
    other sentences start at the share of trusted ones in their
    document; each round they get the probability that the model of the round before gives them. ``weight``: how many
    passages of the corpus each one stands for; only proportions count, so that neither sampling rates nor the size of the
    corpus move a score.
    """
    weight = np.ones(len(slot)) if weight is None or not len(slot) else weight / weight.mean()
    models = {}
    for kind in (True, False):
        own = np.flatnonzero(slot == kind)
        weights, base = np.zeros(BUCKETS), FLOOR
        if len(own):
            place = np.full(len(slot), -1, np.int32)
            place[own] = np.arange(len(own))
            mine = (slot == kind)[row]
            f, r = flat[mine].astype(np.int32), place[row[mine]]
            del mine
            t, w = trusted[own], weight[own]
            _, d = np.unique(doc[own], return_inverse=True)
            p = np.where(t, 1.0, np.where(set_off[own], 0.0, START) if kind else (np.bincount(d, weights=t) / np.bincount(d))[d])
            both = _sums(f, r, w, BUCKETS)
            seen, n = both > 0, w.sum()
            common = np.where(seen, both / n, 1.0)
            for turn in range(rounds):
                pos = _sums(f, r, p * w, BUCKETS)
                inside, outside = (p * w).sum(), ((1 - p) * w).sum()
                odds = np.log((pos + SMOOTH * common) / (inside + SMOOTH)) - np.log((np.maximum(both - pos, 0) + SMOOTH * common) / (outside + SMOOTH))
                if turn == 0:  # what stands beside a trusted passage once or twice tells nothing yet
                    odds = np.minimum(odds, np.log1p(pos))
                weights = np.where(seen, np.clip(odds, -CAP, CAP), 0.0)
                base = float(np.clip(inside / n, FLOOR, 1 - FLOOR))
                score = _sums(r, f, weights, len(own)) + rest_of_document(p, d, base)
                p = np.where(t, 1.0, _logistic(score))
        models[kind] = (weights, base)
    return models


def log_odds(models: dict[bool, tuple[np.ndarray, float]], p: Passages, rounds: int = 6) -> np.ndarray:
    """Score of each passage; those of one document settle on how much of it is residue. Trusted ones are residue."""
    out = np.zeros(len(p.doc))
    for kind, (weights, base) in models.items():
        own = np.flatnonzero(p.slot == kind)
        if not len(own):
            continue
        words = np.bincount(p.row, weights=weights[p.flat], minlength=len(p.doc))[own]
        _, d = np.unique(p.doc[own], return_inverse=True)
        t = p.trusted[own]
        score = words + np.log(base / (1 - base))
        for _ in range(rounds):
            score = words + rest_of_document(np.where(t, 1.0, _logistic(score)), d, base)
        out[own] = np.where(t, np.maximum(score, CAP), score)
    return out


def _strata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many passages stand in documents with and without a trusted one, counted by ends of sentences."""
    for b in batches:
        n = [0, 0]
        for text in b.column("text").to_pylist():
            n[has_trusted(text)] += 1 + len(_CUT.findall(text))
        yield pa.RecordBatch.from_arrays([pa.array([False, True]), pa.array(n, pa.int64())], names=["sure", "n"])


def _sampled(rate: dict[bool, float]):
    """Passages of the documents whose number ``u`` (even between 0 and 1) is below the rate of their stratum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, ids = b.column("u").to_numpy(), b.column("doc_id").to_numpy()
            texts = b.column("text").to_pylist()
            keep = [i for i in np.flatnonzero(u < max(rate.values())) if u[i] < rate[has_trusted(texts[i])]] if min(rate.values()) < 1 else list(range(len(texts)))
            p = Passages([texts[i] for i in keep])
            at = np.r_[0, np.cumsum(np.bincount(p.row, minlength=len(p.doc)))].astype(np.int32)
            sure = np.zeros(len(keep), bool)
            sure[p.doc[p.trusted]] = True
            feats = pa.ListArray.from_arrays(pa.array(at), pa.array(p.flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep][p.doc]), pa.array(p.slot), pa.array(p.trusted), pa.array(p.set_off), pa.array(sure[p.doc]), feats], names=["doc_id", "slot", "trusted", "set_off", "sure", "feats"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0))
    return rows.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def learn(docs: DataFrame, fit_trusted: int = FIT_TRUSTED, fit_other: int = FIT_OTHER, rounds: int = ROUNDS) -> dict[bool, tuple[np.ndarray, float]]:
    """The models of slots and sentences, fitted on the passages of a sample of documents.

    The sample holds at most ``fit_trusted`` passages of documents that have a trusted one and ``fit_other`` of others (the
    documents with the smallest hashes, whatever the size of the corpus), each weighted by the inverse of its sampling rate.
    """
    rows = _texts(docs)
    n = {r["sure"]: r["n"] for r in rows.select("text").mapInArrow(_strata, "sure boolean, n long").groupBy("sure").agg(F.sum("n").alias("n")).collect()}
    rate = {k: min(1.0, 0.9 * most / max(1, n.get(k) or 0)) for k, most in ((True, fit_trusted), (False, fit_other))}
    drawn = rows.mapInArrow(_sampled(rate), "doc_id long, slot boolean, trusted boolean, set_off boolean, sure boolean, feats array<int>")
    t = (drawn.limit(fit_trusted + fit_other) if min(rate.values()) < 1 else drawn).toArrow()  # the limit makes the bound exact
    if not t.num_rows:
        return fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, int), np.zeros(0, bool), 0)
    lists = t.column("feats").combine_chunks()
    row = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    slot, trusted, set_off, sure = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("slot", "trusted", "set_off", "sure"))
    weight = np.where(sure, 1 / rate[True], 1 / rate[False])
    return fit(lists.flatten().to_numpy(zero_copy_only=False), row, slot, trusted, t.column("doc_id").to_numpy(), set_off, rounds, weight)


def _score(models: dict[bool, tuple[np.ndarray, float]]):
    slim = {k: (w.astype(np.float32), b) for k, (w, b) in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Passages(b.column("text").to_pylist())
            kinds = pa.DictionaryArray.from_arrays(pa.array(p.slot.astype(np.int8)), ["sentence", "slot"]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(b.column("doc_id").to_numpy()[p.doc]), kinds, pa.array(p.trusted), pa.array(log_odds(slim, p))], names=["doc_id", "kind", "trusted", "score"])

    return run


def scored_passages(docs: DataFrame, fit_trusted: int = FIT_TRUSTED, fit_other: int = FIT_OTHER, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, kind, trusted, score`` of every passage of every document: the log odds of being residue."""
    models = learn(docs, fit_trusted, fit_other, rounds)
    return _texts(docs).select("doc_id", "text").mapInArrow(_score(models), "doc_id long, kind string, trusted boolean, score double")


def documents_with_residue(docs: DataFrame, least: float = 0.0, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_passages, score``: the documents that have residue, with the number of such passages and the best score.

    Null, empty and blank texts are no cases; null ids are left out; whole texts are read; a document sent twice counts once.
    An empty table gives no rows. The model is fitted when this is called. With ``rounds`` 0 nothing is learned, and only
    documents with a trusted passage are left.
    """
    bad = scored_passages(docs, rounds=rounds).where(F.col("score") > least)
    return bad.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_passages"), F.max("score").alias("score"))


def without_residue(docs: DataFrame) -> DataFrame:
    """The documents that aren't cases, as they are."""
    return docs.join(documents_with_residue(docs).select("doc_id"), "doc_id", "left_anti")
