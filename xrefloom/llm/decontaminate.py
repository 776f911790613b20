"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND.

The index holds the test items, which are few: it is broadcast in shards of at most `shard_items` items, and the texts are
read once for each shard, so its size in a worker is bounded however many items there are. Document frequencies, the mean
length and the longest item are those of all items, so results do not hang on the number of shards. Every text is cut into
overlapping passages, twice as long as the shard's longest item and half a passage apart, so that a copy of an item lies
whole in some passage. Each passage is a query. An item is retrieved when its BM25 score reaches `share` of the score that
it gives to its own text. Passages that lack the rarer terms of every item, so that even all of its common terms could not
lift it to its threshold, are dismissed in bulk; the others go through block-max WAND, which moves over the posting lists by pivots and skips blocks of
items whose largest impacts cannot reach the block's least threshold. All items above their thresholds are retrieved.

A retrieved item is then verified on words: its question (all but the last quarter of its words) and its answer (that
last quarter) must each have at least `overlap` of their distinct word n-grams (3 and 2 words) in the passage.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import saved, slices, whole_text, with_fields

K1, B = 1.2, 0.75
BLOCK = 8


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct word n-grams; all words as one where there are fewer."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    w = tv.Words(words, np.zeros(len(words), np.int64), np.array([0, len(words)]))
    return np.unique(tv.ngrams(w, n)[0])


class Index:
    """Posting lists of a shard of test items, with impacts, block maxima and thresholds."""

    def __init__(self, ids: list, texts: list[str], share: float, whole: dict | None = None):
        """whole: items, mean length, longest item, and terms with their document frequencies, of all shards together."""
        w = tv.words(pa.array(texts, pa.string()), ~tv.ALNUM)
        own = [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        self.ids = [i for i, x in zip(ids, own, strict=True) if len(x)]
        own = [x for x in own if len(x)]
        self.n = len(own)
        self.longest = whole["longest"] if whole else max((len(x) for x in own), default=1)
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        mean = whole["mean"] if whole else np.mean([len(x) for x in own]) if own else 1.0
        total = whole["items"] if whole else self.n
        post: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        counts = [np.unique(x, return_counts=True) for x in own]
        df = np.bincount(np.concatenate([np.zeros(0, int), *(np.searchsorted(self.terms, t) for t, _ in counts)]), minlength=len(self.terms))
        if whole:
            df = whole["df"][np.searchsorted(whole["terms"], self.terms)]
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        self.least = np.zeros(self.n)
        for k, (t, tf) in enumerate(counts):
            at = np.searchsorted(self.terms, t)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own[k]) / mean))
            self.least[k] = share * impact.sum()
            for j, x in zip(at.tolist(), impact.tolist(), strict=True):
                post[j].append((k, x))
        self.items = [np.array([k for k, _ in p], np.int64) for p in post]
        self.impacts = [np.array([x for _, x in p]) for p in post]
        self.top = np.array([x.max() for x in self.impacts])
        blocks = -(-self.n // BLOCK) if self.n else 0
        self.block_least = np.array([self.least[b * BLOCK : (b + 1) * BLOCK].min() for b in range(blocks)])
        self.block_top: list[dict[int, float]] = []  # of each term, the blocks that its list touches
        for k, x in zip(self.items, self.impacts, strict=True):
            own_blocks, first = np.unique(k // BLOCK, return_index=True)
            self.block_top.append(dict(zip(own_blocks.tolist(), (np.maximum.reduceat(x, first) * 1.000001).tolist(), strict=True)))
        # terms so common among items that most passages have them are taken as always present; `rest` is what an item
        # then needs of its other terms, and a tenth of its threshold at least is left for those
        self.common = df > max(8, 0.05 * total)
        self.rest = np.zeros(self.n)
        for k, (t, tf) in enumerate(counts):
            at = np.searchsorted(self.terms, t)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own[k]) / mean))
            for j in np.argsort(df[at]).tolist():
                if self.least[k] - impact[self.common[at]].sum() >= 0.1 * self.least[k]:
                    break
                self.common[at[j]] = False
        for k, (t, tf) in enumerate(counts):
            at = np.searchsorted(self.terms, t)
            at, tf = at[self.common[at]], tf[self.common[at]]
            self.rest[k] = self.least[k] - (idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own[k]) / mean))).sum()
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in self.items])]).astype(np.int64)
        self.flat_items = np.concatenate([np.zeros(0, np.int64), *self.items])
        self.flat_impacts = np.concatenate([np.zeros(0), *self.impacts])
        cut = [max(1, len(x) - max(1, len(x) // 4)) for x in own]
        self.parts = [(x[:c], x[c:] if len(x) > 1 else x) for x, c in zip(own, cut, strict=True)]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score with a query of distinct terms reaches their thresholds, with the scores."""
        lists = [[0, self.items[t], self.impacts[t], float(self.top[t]), t] for t in terms]
        found = []
        least = self.least.min() if self.n else 0.0
        while True:
            lists = [x for x in lists if x[0] < len(x[1])]
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = int(lists[pivot][1][lists[pivot][0]])
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_top[x[4]].get(block, 0.0) for x in lists[: pivot + 1]) < self.block_least[block]:
                # nothing in this block, up to the next list's item, can reach a threshold
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, int(lists[pivot + 1][1][lists[pivot + 1][0]]))
                to = max(to, item + 1)
                for x in lists[: pivot + 1]:
                    x[0] = int(np.searchsorted(x[1], to))
                continue
            if lists[0][1][lists[0][0]] == item:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += float(x[2][x[0]])
                    x[0] += 1
                if score >= self.least[item] - 1e-9:
                    found.append((item, score))
            else:
                for x in lists[:pivot]:
                    if x[1][x[0]] < item:
                        x[0] += int(np.searchsorted(x[1][x[0] :], item))


def _passages(bounds: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Each passage's first word and document: one every `half` words, twice as long; a text's last passage may be shorter."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(1, -(-n // half) - 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[doc] + first * half, doc


def _query(part: pa.RecordBatch, index: Index, overlap: float):
    w = tv.words(part.column("text"), ~tv.ALNUM)
    half = max(16, index.longest)
    at = np.minimum(np.searchsorted(index.terms, w.hash), len(index.terms) - 1)
    known = index.terms[at] == w.hash
    start, doc = _passages(w.bounds, half)
    if not len(start):
        return {}
    end = np.minimum(start + 2 * half, w.bounds[doc + 1])
    # rare terms of each passage: a token at half h of its document is in the passages that begin at h and at h - 1
    rare = np.flatnonzero(known & ~index.common[at])
    first = np.searchsorted(doc, np.arange(part.num_rows))
    last = np.searchsorted(doc, np.arange(part.num_rows), "right") - 1
    d = w.doc[rare]
    h = (rare - w.bounds[d]) // half
    here = np.concatenate([np.minimum(first[d] + h, last[d]), np.maximum(np.minimum(first[d] + h - 1, last[d]), first[d])])
    key = np.unique(here * len(index.terms) + np.concatenate([at[rare]] * 2))
    passage, term = key // len(index.terms), key % len(index.terms)
    # what the passages' rarer terms give to each item; where that is too little, no common terms can make up for it
    length = index.start[term + 1] - index.start[term]
    post = np.arange(length.sum()) + np.repeat(index.start[term] - (np.cumsum(length) - length), length)
    pair, back = np.unique(np.repeat(passage, length) * index.n + index.flat_items[post], return_inverse=True)
    enough = np.bincount(back, index.flat_impacts[post], len(pair)) >= index.rest[pair % index.n] - 1e-9
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in np.unique(pair[enough] // index.n).tolist():
        a, b = int(start[p]), int(end[p])
        terms = np.unique(at[a:b][known[a:b]]).tolist()
        for item, score in index.search(terms):
            text, (question, answer) = w.hash[a:b], index.parts[item]
            q = np.isin(_shingles(question, 3), _shingles(text, min(3, len(question)))).mean()
            r = np.isin(_shingles(answer, 2), _shingles(text, min(2, len(answer)))).mean()
            if q >= overlap and r >= overlap:
                at_ = (int(doc[p]), item)
                found[at_] = max(found.get(at_, (0.0, 0.0, 0.0)), (score, float(q), float(r)))
    return found


def _searcher(shared, overlap: float, names: list[str]):
    def search(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = _query(part, index, overlap) if index.n else {}
                row = pa.array([d for d, _ in found], pa.int64())
                best = list(found.values())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n).take(row) for n in names), pa.array([index.ids[k] for _, k in found], pa.int64()), *(pa.array([x[k] for x in best], pa.float64()) for k in range(3))],
                    [*names, "item_id", "bm25", "question_overlap", "answer_overlap"],
                )

    return search


def _lister(batches):
    """Each item's distinct terms, and one row without a term for its length."""
    for batch in batches:
        w = tv.words(batch.column("text"), ~tv.ALNUM)
        shard = batch.column("shard").to_numpy()
        doc, h = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, [np.full(len(np.unique(w.hash[a:b])), k) for k, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:], strict=True))]), (np.uint64, [np.unique(w.hash[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)])))
        yield pa.RecordBatch.from_arrays([pa.array(shard[doc]), pa.array(h.view(np.int64)), pa.array(np.zeros(len(h), np.int64))], ["shard", "h", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.nulls(len(shard), pa.int64()), pa.array(w.counts.astype(np.int64))], ["shard", "h", "n"])


def indexes(spark: SparkSession, items: DataFrame, item_id: str = "item_id", item_text: str = "text", share: float = 0.6, shard_items: int = 20_000) -> list:
    """Broadcast indexes of all test items, one for each shard of about shard_items items."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), whole_text(item_text)).filter("item_id is not null and text <> ''").dropDuplicates()
    shards = max(1, -(-items.count() // shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    listed = sizes = None
    if shards > 1:
        items = saved(items)
        listed = saved(items.select("shard", "text").mapInArrow(_lister, "shard long, h long, n long"))
        sizes = listed.filter("n > 0").agg(F.count("*").alias("items"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    made = []
    for k in range(shards):
        own = items.filter(F.col("shard") == k).orderBy("item_id", "text").toArrow()
        whole = None
        if listed is not None:
            terms = listed.filter((F.col("shard") == k) & F.col("h").isNotNull()).select("h").distinct()
            df = listed.filter("h is not null").groupBy("h").agg(F.count("*").alias("df")).join(terms, "h", "left_semi").toArrow()  # a shard's terms
            h = df["h"].to_numpy().view(np.uint64)
            order = np.argsort(h)
            whole = {"items": sizes["items"], "mean": sizes["mean"] or 1.0, "longest": sizes["longest"] or 1, "terms": h[order], "df": df["df"].to_numpy()[order]}
        made.append(spark.sparkContext.broadcast(Index(own["item_id"].to_pylist(), own["text"].to_pylist(), share, whole)))
    return made


def matches(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), share: float = 0.6, overlap: float = 0.5, **options) -> DataFrame:
    """One row for each row of docs and test item that it contains: the columns of keep, item_id, and the best passage's bm25, question_overlap and answer_overlap.

    Null or empty texts, and items without words or id, match nothing. Items that share an id but not their text are
    separate items of that id. Repeated rows of docs give repeated pairs. Without items there are no rows.
    """
    rows = docs.select(*keep, whole_text(text))
    schema = with_fields(rows.schema[:-1], "item_id long, bm25 double, question_overlap double, answer_overlap double")
    found = [rows.mapInArrow(_searcher(shared, overlap, list(keep)), schema) for shared in indexes(docs.sparkSession, items, share=share, **options)]
    return reduce(DataFrame.unionByName, found)


def _cleaner(shared, overlap: float):
    def keep(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                bad = {d for d, _ in _query(part.select(["_text"]).rename_columns(["text"]), index, overlap)} if index.n else set()
                yield part.drop_columns(["_text"]).filter(pa.array([k not in bad for k in range(part.num_rows)], pa.bool_()))

    return keep


def clean(docs: DataFrame, items: DataFrame, text: str = "text", share: float = 0.6, overlap: float = 0.5, **options) -> DataFrame:
    """The rows of docs that contain no test item, with all their columns, in one pass for each shard of items and without a shuffle."""
    for shared in indexes(docs.sparkSession, items, share=share, **options):
        rows = docs.select(*docs.columns, whole_text(text).alias("_text"))
        docs = rows.mapInArrow(_cleaner(shared, overlap), docs.schema)
    return docs
