"""Language-model scores from a log-frequency Bloom filter.

Words and word pairs of all training texts are counted: tasks count what they read and send packed blocks of (n-gram,
count) to the owner of a region of the hash space, and the owners add up. The counts are then quantised by logarithm: an
n-gram with quantised count q is put into its region's Bloom filter as q members, (n-gram, 1) to (n-gram, q). A count is
read back by probing (n-gram, 1), (n-gram, 2), ... until a probe fails. Word probabilities are smoothed: a pair's count is
mixed with the word's own probability (a Dirichlet prior of `prior` pseudo counts), and that with one more than its count.
Word probabilities sum to 1 over the known words and one unknown. What follows a word sums to 1 as far as the pairs'
quantised counts add up to the word's exact count (counts up to 3 are kept exactly): within a few percent.

The filter takes `member_bits` bits a member. A region stands for about `region_bytes` bytes of training text, so a larger corpus has
more regions, each of the same size, and no n-gram is left out. Where the whole filter, with the exact word counts that
the base score needs, takes at most `broadcast_bytes` bytes, it is broadcast to the workers, which score texts in one
pass. A larger one stays in its regions: texts are gathered in chunks of about CHUNK bytes, each chunk's distinct n-grams
are sent to their regions' tasks, and their counts come back to the chunk. Both ways run the same probes and give the
same scores.

Words are told apart by 64-bit hashes, pairs by their region and 40 more bits. Every text ends with one end token, which is
also the left neighbour of its first word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import pack, saved, slices, unpack, whole_text, with_fields

END = np.uint64(0xE14D0FE14D0F0001)
BASE = 1.5
PROBES = 4
KEY_BITS = 40
CHUNK = 4 << 20
LEAST_REGIONS = 4  # as a power of two
WORD, PAIR = 0, 1
#: Parts of a region's store, in the order in which its task reads them: word hashes, word counts, filter.
HASHES, COUNTS, CELLS = -3, -2, -1
_BLOCK = "region int, kind int, h binary, c binary"
_STORE = "region int, kind int, chunk long, b binary, tokens long, words long, typical double"
_ASK = "region int, kind int, chunk long, b binary"


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a batch (each text's words, then its end), their left neighbours, their documents, tokens by document."""
    w = tv.words(col)
    n = w.n
    counts = w.counts + 1
    doc = np.repeat(np.arange(n), counts)
    tok = np.full(len(w.hash) + n, END)
    tok[np.arange(len(w.hash)) + w.doc] = w.hash
    left = np.empty_like(tok)
    if len(tok):
        left[1:], left[0] = tok[:-1], END  # the token before a first word is another text's end
    return tok, left, doc, counts


def pair(left: np.ndarray, tok: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of pairs: the region (2**bits of them), then KEY_BITS bits of a hash."""
    with np.errstate(over="ignore"):
        h = tv.mix(left * np.uint64(0x9FB21C651E98DF25) + tok)
    return h >> np.uint64(64 - bits) << np.uint64(KEY_BITS) | _key(h)


def _key(h: np.ndarray) -> np.ndarray:
    """What stands for an n-gram inside its region's filter."""
    return h & np.uint64((1 << KEY_BITS) - 1)


def level(count: np.ndarray) -> np.ndarray:
    """Quantised logarithm of a count from 1: 1, 2, ..."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def typical(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of the counts with that level; 0 for level 0."""
    low, high = np.ceil(BASE ** (q - 1.0) - 1e-9), np.ceil(BASE ** (q * 1.0) - 1e-9) - 1
    return np.where(q > 0, np.maximum(1.0, (low + np.maximum(high, low)) / 2), 0.0)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers: their differences, packed."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def _by_region(x: np.ndarray, kind: int, bits: int) -> list[tuple[int, int, int]]:
    """Region, start and end of every region that has any of these ascending numbers."""
    shift = np.uint64(64 - bits if kind == WORD else KEY_BITS)
    edges = np.concatenate([[0], np.searchsorted(x, np.arange(1, 1 << bits, dtype=np.uint64) << shift), [len(x)]])
    return [(k, int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(np.diff(edges)).tolist()]


def _counter(bits: int, most: int = 1 << 21):
    """Blocks of distinct n-grams and their counts, after about `most` tokens each."""

    def flush(kept):
        rows = []
        for kind, parts in enumerate(kept):
            x, c = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            rows += [(k, kind, pack_sorted(x[a:b]), pack(c[a:b])) for k, a, b in _by_region(x, kind, bits)]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["region", "kind", "h", "c"])

    def count(batches):
        kept: tuple[list, list] = ([], [])
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                tok, left, _, _ = tokens(part.column("text"))
                kept[WORD].append(tok)
                kept[PAIR].append(pair(left, tok, bits))
                size += len(tok)
                if size > most:
                    yield flush(kept)
                    size = 0
        if size:
            yield flush(kept)

    return count


def _add(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of sorted blocks, and the sums of their counts."""
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, c = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.add.reduceat(c, at)


def _slots(key: np.ndarray, q: int, kind: int, size: int):
    """The places of (n-gram, q) in a filter of size bits, one array for each probe."""
    with np.errstate(over="ignore"):
        x = tv.mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64((2 * q + kind) * 0x165667B19E3779F9 & (1 << 64) - 1))
        a, b = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
        for i in range(PROBES):
            yield (((a + b * np.uint64(i)) & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def fill(grams: list[tuple[np.ndarray, np.ndarray]], member_bits: int) -> np.ndarray:
    """A filter's bytes, from each kind's n-grams and their counts."""
    levels = [level(c) for _, c in grams]
    size = max(64, -(-member_bits * int(sum(q.sum() for q in levels)) // 8) * 8)
    on = np.zeros(size, bool)
    for kind, ((h, _), q) in enumerate(zip(grams, levels, strict=True)):
        for k in range(1, int(q.max(initial=0)) + 1):
            for s in _slots(_key(h[q >= k]), k, kind, size):
                on[s] = True
    return np.packbits(on, bitorder="little")


class Region:
    """What one region holds: exact word counts, and the filter of its words and pairs."""

    def __init__(self):
        self.part = {HASHES: np.zeros(0, np.uint64), COUNTS: np.zeros(0, np.int64), CELLS: np.zeros(8, np.uint8)}

    def put(self, kind: int, b) -> None:
        self.part[kind] = unpack_sorted(b) if kind == HASHES else unpack(b).astype(np.int64) if kind == COUNTS else np.frombuffer(b, np.uint8)

    def counts(self, h: np.ndarray) -> np.ndarray:
        own, c = self.part[HASHES], self.part[COUNTS]
        if not len(own):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        return np.where(own[at] == h, c[at], 0)

    def levels(self, h: np.ndarray, kind: int) -> np.ndarray:
        """Quantised counts read from the filter: the last of the levels 1, 2, ... that is a member."""
        cells, key = self.part[CELLS], _key(h)
        q = np.zeros(len(key), np.uint8)
        live = np.arange(len(key))
        k = 0
        while len(live):
            k += 1
            kept = np.ones(len(live), bool)
            for s in _slots(key[live], k, kind, 8 * len(cells)):
                kept &= (cells[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
            live = live[kept] if k < 120 else live[:0]
            q[live] = k
        return q


def _builder(member_bits: int):
    """Add up each region's blocks; its exact word counts, its filter, and its sums."""

    def built(region: int, blocks: dict[int, list]) -> pa.RecordBatch:
        words, pairs = (_add(blocks.get(kind, [])) for kind in (WORD, PAIR))
        rows = [(HASHES, pack_sorted(words[0])), (COUNTS, pack(words[1])), (CELLS, fill([words, pairs], member_bits).tobytes())]
        sums = [[None, None, int(words[1].sum())], [None, None, len(words[0])], [None, None, float(typical(level(words[1])).sum())]]
        return pa.RecordBatch.from_pydict(
            {"region": pa.array([region] * 3, pa.int32()), "kind": pa.array([k for k, _ in rows], pa.int32()), "chunk": pa.array([-1] * 3, pa.int64()), "b": pa.array([b for _, b in rows], pa.binary())}
            | {n: pa.array(s, t) for n, s, t in zip(("tokens", "words", "typical"), sums, (pa.int64(), pa.int64(), pa.float64()), strict=True)}
        )

    def build(batches):
        at, blocks = None, {}
        for batch in batches:
            for row, (region, kind) in enumerate(zip(batch.column("region").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if region != at:
                    if blocks:
                        yield built(at, blocks)
                    at, blocks = region, {}
                blocks.setdefault(kind, []).append((unpack_sorted(batch.column("h")[row].as_buffer()), unpack(batch.column("c")[row].as_buffer()).astype(np.int64)))
                if sum(len(h) for h, _ in blocks[kind][1:]) > 2 * len(blocks[kind][0][0]) + (1 << 20):
                    blocks[kind] = [_add(blocks[kind])]
        if blocks:
            yield built(at, blocks)

    return build


def fit(training: DataFrame, text: str = "text", region_bytes: int = 24 << 20, member_bits: int = 12, prior: float = 50.0, broadcast_bytes: int = 16 << 20) -> dict:
    """Count all training texts and build the filter. An empty table, or one of null texts only, gives a model of ends only.

    Returns N (tokens), V (distinct tokens), typical (the sum of the distinct tokens' quantised counts), bits (2**bits
    regions), store (the regions' table) and, if it takes at most broadcast_bytes bytes, local (its rows, on the driver).
    """
    rows = training.select(whole_text(text))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_REGIONS, math.ceil(math.log2(size / region_bytes + 1)))
    blocks = rows.mapInArrow(_counter(bits), _BLOCK).repartition(1 << bits, "region").sortWithinPartitions("region")
    store = saved(blocks.mapInArrow(_builder(member_bits), _STORE), only=True)
    sums = store.agg(*(F.sum(c).alias(c) for c in ("tokens", "words", "typical")), F.sum(F.octet_length("b")).alias("bytes")).first()
    model = {"N": sums["tokens"] or 0, "V": sums["words"] or 0, "typical": sums["typical"] or 0.0, "bytes": sums["bytes"] or 0, "bits": bits, "prior": prior, "store": store}
    if model["bytes"] <= broadcast_bytes:
        model["local"] = [(r["region"], r["kind"], bytes(r["b"])) for r in store.select("region", "kind", "b").toLocalIterator()]
    return model


def regions(rows) -> dict[int, Region]:
    """Regions from rows (region, kind, bytes) of the store."""
    out: dict[int, Region] = {}
    for region, kind, b in rows:
        out.setdefault(region, Region()).put(kind, b)
    return out


class Scored:
    """A chunk of texts with its distinct n-grams, and its scores once their counts are known."""

    def __init__(self, texts: pa.Array, bits: int):
        self.tok, self.left, self.doc, self.n_tokens = tokens(texts)
        self.words, self.word_at = np.unique(self.tok, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair(self.left, self.tok, bits), return_inverse=True)

    def score(self, counts: np.ndarray, word_levels: np.ndarray, pair_levels: np.ndarray, m: dict) -> dict[str, np.ndarray]:
        """counts: exact ones of words; levels: quantised counts of words and pairs."""
        n = len(self.n_tokens)
        base = np.log10((counts + 1) / (m["N"] + m["V"] + 1.0))
        single = typical(word_levels)
        p1 = (single + 1) / (m["typical"] + m["V"] + 1.0)
        context = counts[np.searchsorted(self.words, self.left)]
        both = np.minimum(typical(pair_levels)[self.pair_at], context)
        p = (both + m["prior"] * p1[self.word_at]) / (context + m["prior"])
        return {
            "n_tokens": self.n_tokens.astype(np.int64), "n_known": np.bincount(self.doc, (counts > 0)[self.word_at], n).astype(np.int64),
            "base_score": np.bincount(self.doc, base[self.word_at], n), "score": np.bincount(self.doc, np.log10(p), n),
        }


def _scorer(shared, names: list[str]):
    """Scores with the whole filter, which is small."""

    def score(batches):
        m = shared.value
        known = regions(m["local"])
        none = Region()
        for batch in batches:
            for part in slices(batch, "text"):
                x = Scored(part.column("text"), m["bits"])
                counts, levels = np.zeros(len(x.words), np.int64), [np.zeros(len(g), np.uint8) for g in (x.words, x.pairs)]
                for kind, grams in enumerate((x.words, x.pairs)):
                    for k, a, b in _by_region(grams, kind, m["bits"]):
                        levels[kind][a:b] = known.get(k, none).levels(grams[a:b], kind)
                        if kind == WORD:
                            counts[a:b] = known.get(k, none).counts(grams[a:b])
                got = x.score(counts, *levels, m)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *map(pa.array, got.values())], [*names, *got])

    return score


def _packed(chunk: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A chunk's rows as one: Arrow's stream format, compressed, since they cross an exchange."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for part in parts:
            out.write_batch(part)
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "b"])


def _unpacked(rows: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in rows["b"]]).combine_chunks()


def _chunker(batches):
    """Chunks of consecutive rows of a task, about CHUNK bytes of text each: the chunk's number and its packed rows."""
    chunk, held, parts = TaskContext.get().partitionId() << 32, 0, []
    for batch in batches:
        for part in slices(batch, "text"):
            size = (pc.sum(pc.binary_length(part.column("text"))).as_py() or 0) + part.num_rows
            if held and held + size > CHUNK:
                yield _packed(chunk, parts)
                chunk, held, parts = chunk + 1, 0, []
            held += size
            parts.append(part)
    if parts:
        yield _packed(chunk, parts)


def _asker(bits: int):
    """A chunk's distinct n-grams, by region."""

    def ask(key, packed):
        x = Scored(_unpacked(packed)["text"], bits)
        rows = [(k, kind, pack_sorted(grams[a:b] if kind == WORD else _key(grams[a:b]))) for kind, grams in enumerate((x.words, x.pairs)) for k, a, b in _by_region(grams, kind, bits)]
        return pa.table({"region": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "b": pa.array([r[2] for r in rows], pa.binary())})

    return ask


def _answerer(batches):
    """Of each region, its store comes first, then chunks' n-grams: their quantised counts, and exact ones of words."""
    at, own = None, Region()
    for batch in batches:
        region, kind, b = batch.column("region").to_pylist(), batch.column("kind").to_pylist(), batch.column("b")
        asked, levels, counts = [], [], []
        for row in range(batch.num_rows):
            if region[row] != at:
                at, own = region[row], Region()
            if kind[row] < 0:
                own.put(kind[row], b[row].as_buffer())
                continue
            h = unpack_sorted(b[row].as_buffer())
            asked.append(row)
            levels.append(own.levels(h, kind[row]).tobytes())
            counts.append(pack(own.counts(h)) if kind[row] == WORD else b"")
        rows = pa.array(asked, pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("region", "kind", "chunk")), pa.array(levels, pa.binary()), pa.array(counts, pa.binary())], ["region", "kind", "chunk", "q", "c"])


def _finisher(m: dict, names: list[str]):
    """Scores of a chunk's texts; the answers, by region, are in the order of its sorted n-grams."""

    def finish(packed, answers):
        texts = _unpacked(packed)
        x = Scored(texts["text"], m["bits"])
        order = answers.sort_by([("kind", "ascending"), ("region", "ascending")])
        q = np.frombuffer(b"".join(order["q"].to_pylist()), np.uint8)
        if len(q) != len(x.words) + len(x.pairs):
            raise RuntimeError(f"{len(q)} counts for {len(x.words) + len(x.pairs)} n-grams")
        counts = np.concatenate([unpack(c) for c in order["c"].to_pylist() if c]).astype(np.int64)
        got = x.score(counts, q[: len(x.words)], q[len(x.words) :], m)
        return pa.table([*(texts[c] for c in names), *map(pa.array, got.values())], [*names, *got])

    return finish


def score(docs: DataFrame, model: dict, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """For every row: the columns of keep, n_tokens, n_known, train_tokens, base_score and score (both log10 probabilities).

    A null or empty text has one token, its end. Rows with equal texts have equal scores. Other columns of docs may have
    any names.
    """
    keep = keep or {"doc_id": F.col("doc_id")}
    named = [f"_{k}" for k in range(len(keep))]  # the caller's names could be those of this function's columns
    rows = docs.select(*keep.values(), whole_text(text)).toDF(*named, "text")
    result = with_fields(rows.schema[:-1], "n_tokens long, n_known long, base_score double, score double")
    plain = {k: model[k] for k in ("N", "V", "typical", "bits", "prior")}
    if "local" in model:
        shared = docs.sparkSession.sparkContext.broadcast(plain | {"local": model["local"]})
        scored = rows.mapInArrow(_scorer(shared, named), result)
    else:
        regions_ = 1 << model["bits"]
        # saved, since chunks follow the order of rows, which a repeated task may find changed
        texts = saved(rows.mapInArrow(_chunker, "chunk long, b binary")).repartition(regions_, "chunk")
        asked = model["store"].select("region", "kind", "chunk", "b").unionByName(texts.groupBy("chunk").applyInArrow(_asker(model["bits"]), _ASK))
        answers = asked.repartition(regions_, "region").sortWithinPartitions("region", "kind").mapInArrow(_answerer, "region int, kind int, chunk long, q binary, c binary")
        scored = texts.groupBy("chunk").cogroup(answers.repartition(regions_, "chunk").groupBy("chunk")).applyInArrow(_finisher(plain, named), result)
    names = [F.col(c).alias(k) for c, k in zip(named, keep, strict=True)]
    return scored.select(*names, "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")
