"""Token counts by trie-shared dynamic programming.

The tokeniser is a unigram model over the byte pieces of a given vocabulary: piece number r has probability proportional
to 1 / (r + 2), and a pre-token's tokens are its most probable split (of equal ones, that with fewer tokens). Pre-tokens
are runs of non-blank bytes, with one space (U+0020) before them if there is one; every other blank byte stands alone.

The distinct pre-tokens of a batch of texts are put into a trie, as a sorted list whose neighbours share their common
prefix. A walk through it keeps the forward scores (best log probability and its token count) of every prefix on the
current path, so each shared prefix is scored once; the count and score at a pre-token's end are stored for it. The
counts of a text are then sums over its pre-tokens. Whole texts are read in one pass without a shuffle.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import slices, whole_text, with_fields


def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file with lines `base64 rank`; every single byte must be a piece."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return ranks


def log_probabilities(ranks: dict[bytes, int]) -> dict[bytes, float]:
    total = math.log(sum(1 / (r + 2) for r in ranks.values()))
    return {p: -math.log(r + 2) - total for p, r in ranks.items()}


def suffixes(pieces: dict[bytes, float]) -> dict[bytes, float]:
    """Every suffix of every piece; 1.0 for those that are no pieces themselves."""
    out: dict[bytes, float] = {}
    for p in pieces:
        for k in range(len(p)):
            out.setdefault(p[k:], 1.0)
    return out | pieces


def forward(pretokens: list[bytes], ends: dict[bytes, float]) -> tuple[list[int], list[float]]:
    """Token counts and log probabilities of sorted, distinct, non-empty pre-tokens; ends: as suffixes() gives."""
    counts, scores = [], []
    best, used = [0.0], [0]
    last = b""
    for word in pretokens:
        shared, most = 0, min(len(last), len(word))
        while shared < most and last[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], used[shared + 1 :]
        for j in range(shared + 1, len(word) + 1):
            top, n = -math.inf, 0
            for i in range(j - 1, -1, -1):
                p = ends.get(word[i:j])
                if p is None:
                    break
                if p <= 0.0:
                    s = best[i] + p
                    if s > top or s == top and used[i] + 1 < n:
                        top, n = s, used[i] + 1
            best.append(top)
            used.append(n)
        counts.append(used[-1])
        scores.append(best[-1])
        last = word
    return counts, scores


def count_batch(col: pa.Array, ends: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, log probability and pre-tokens of every text."""
    n = len(col)
    buf, off = tv.text_bytes(col)
    w = tv.words(col, fold=False, spans=True)
    start, end = w.spans
    spaced = np.zeros(len(start), bool)
    inside = start > off[w.doc]
    spaced[inside] = buf[start[inside] - 1] == 32
    start = start - spaced
    with np.errstate(over="ignore"):
        key = np.where(spaced, tv.mix(w.hash + np.uint64(1)), w.hash)
    _, at, back = np.unique(key, return_index=True, return_inverse=True)
    data = buf.tobytes()
    distinct = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
    order = sorted(range(len(distinct)), key=distinct.__getitem__)
    counts, scores = forward([distinct[k] for k in order], ends)
    count, score = np.zeros(len(order), np.int64), np.zeros(len(order))
    count[order], score[order] = counts, scores
    # blanks that no pre-token took
    alone = tv.SPACE[buf]
    alone[start[spaced]] = False
    at = np.flatnonzero(alone)
    doc = np.searchsorted(off, at, "right") - 1
    value = np.array([ends[bytes([b])] for b in range(256)])
    blank = np.bincount(doc, minlength=n)
    tokens = np.bincount(w.doc, count[back], n).astype(np.int64) + blank
    return tokens, np.bincount(w.doc, score[back], n) + np.bincount(doc, value[buf[at]], n), w.counts + blank


def _counter(shared, passed: list[str]):
    def count(batches):
        ends = suffixes(log_probabilities(shared.value))
        for batch in batches:
            for part in slices(batch, "_text", 8 << 20):
                tokens, score, pretokens = count_batch(part.column("_text"), ends)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), pa.array(tokens), pa.array(pretokens.astype(np.int64)), pa.array(score.astype(np.float64))], [*passed, "n_tokens", "n_pretokens", "log_probability"])

    return count


def token_counts(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_tokens, n_pretokens and log_probability (natural logarithm) for every row; all 0 for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, of fixed size
    rows = docs.select(*keep, whole_text(text).alias("_text"))
    return rows.mapInArrow(_counter(shared, list(keep)), with_fields(rows.schema[:-1], "n_tokens long, n_pretokens long, log_probability double"))
