"""Encoding of a corpus with a public byte-level BPE tokenizer.

A text is first cut into the tokenizer's own pieces; within a piece, a pair of neighbouring bytes that occurs inside no
token of the vocabulary can never be merged across, so it marks a certain cut. The fragments between certain cuts are
encoded independently and concatenated, which gives exactly the ids of the whole while no merge loop ever sees more
than a fragment.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# fixed value: how the public tokenizer cuts text into pieces
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 200_000  #: pieces whose ids a task remembers

class Encoder:
    """Byte-level BPE by ranks."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = regex.compile(pattern).findall
        inside = bytearray(65536)
        for token in self.ranks:
            for x, y in zip(token, token[1:]):
                inside[x * 256 + y] = 1
        self.inside = inside  #: whether a pair of bytes occurs inside a token
        self.known: dict[str, list[int]] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut wherever no token could reach across."""
        inside, cuts = self.inside, [0]
        for i in range(1, len(piece)):
            if not inside[piece[i - 1] * 256 + piece[i]]:
                cuts.append(i)
        cuts.append(len(piece))
        return [piece[a:z] for a, z in zip(cuts, cuts[1:])]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: the lowest rank merges first, the leftmost of equals; n log n."""
        ranks = self.ranks
        if fragment in ranks:
            return [ranks[fragment]]
        n = len(fragment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part: list[bytes | None] = [fragment[i : i + 1] for i in range(n)]
        queue = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != both:
                continue  # one of the two has merged meanwhile
            part[i], part[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(both + part[k])) is not None:
                    heapq.heappush(queue, (r, i, both + part[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(part[h] + both)) is not None:
                heapq.heappush(queue, (r, h, part[h] + both))
        return [ranks[p] for p in part if p is not None]

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for piece in self.pieces(text):
            got = known.get(piece)
            if got is None:
                # a lone surrogate can't be written as UTF-8; it becomes the replacement character
                raw = piece.encode("utf-8", "replace") if piece.isascii() else piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
                got = [x for f in self.fragments(raw) for x in self.merge(f)]
                if len(piece) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids

def _encode(path: str, counts: bool):
    """Replaces the last column, the text, by its ids or their number; the others pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            ids = [encoder.encode(t) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], "n_tokens" if counts else "ids"])

    return run

def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``<ident>, ids``: the ids of every text, without special tokens. Null and empty texts have no ids (an empty list).

    One row per row of ``docs``; whole texts of any length; strings of special tokens in a text are ordinary text. The
    vocabulary must be readable at ``folder`` on every executor. No exchange: texts are encoded where they are read.
    """
    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(_encode(f"{folder}/{vocabulary}", False), f"`{ident}` {kind}, ids array<int>")

def token_counts(docs: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``: the same, counted, without a join back."""
    rows = docs.select(*keep, text)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_encode(f"{folder}/{vocabulary}", True), schema)


def corpus_tokens(docs: DataFrame, **kw) -> DataFrame:
    """``source, lang, n_docs, n_tokens``: tokens of the whole corpus by source and language."""
    return token_counts(docs, ["source", "lang"], **kw).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
