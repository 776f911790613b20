"""N-gram Jaccard join of documents: rare-first prefix filtering, exact verification, and near-duplicate classes.

A document's set holds its distinct n-word shingles (64-bit hashes). Documents link when the Jaccard similarity of their
sets is at least `percent` in a hundred, decided in whole numbers.

1. Shingle counts: tasks add up counts in 2**sketch_bits cells; the cells' logarithms (4 MB) are broadcast. They only
   order shingles, rarest first and by hash among equals; any such order gives the same links, so cells that shingles
   share cost time at most, never results.
2. Each set is sorted in that order. Two sets can only be similar enough if their prefixes share a shingle, so only
   prefixes go on. Equal sets are one class from the start: one representative stands for them.
3. Prefix shingles are dealt by hash slice in packed blocks; those of a single document end here. The others are joined,
   with the length filter, the positional filter (shared shingles still possible after the two positions) and a suffix
   filter (shingles counted in 16 hash parts: what the parts' sizes differ by cannot be shared).
4. In the first round each list gives only the pairs of its first document with the others, which ties groups of near
   copies together at linear cost. The second round gives all remaining pairs in lists, except where both documents
   are in one class already; lists longer than `block` are split into blocks of pairs, each a task's work of its own.
   A pair that comes from several lists is verified once.

Pairs are verified on whole sets. Nothing is capped: every pair that could link two classes is looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import components, pack, saved, slices, unpack, whole_text

PARTS = 16


def shingles(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, tv.Words]:
    """All n-word shingles and their documents; a text with fewer words has them all as its only one."""
    w = tv.words(col)
    h, d = tv.ngrams(w, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        extra = np.array([tv.ngrams(tv.Words(x, np.zeros(len(x), np.int64), np.array([0, len(x)])), len(x), salt=len(x))[0][0] for x in (w.hash[w.bounds[k] : w.bounds[k + 1]] for k in short)], np.uint64)
        h, d = np.concatenate([h, extra]), np.concatenate([d, short])
    return h, d, w


def _sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document's distinct shingles, documents in order: hashes and offsets."""
    h, d, _ = shingles(col, n)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[first], d[first]
    return h, np.searchsorted(d, np.arange(len(col) + 1))


def _cell_counter(n: int, bits: int):
    def count(batches):
        cells = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                h, _, _ = shingles(part.column("text"), n)
                own, c = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                cells[own] += c.astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(64), pa.int32()), "cells": pa.array([pack(x) for x in cells.reshape(64, -1)], pa.binary())})

    return count


def _cell_adder(batches):
    """Added-up cells of each block, as quantised logarithms of one byte."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
            x = unpack(cells.as_buffer())
            total[block] = total[block] + x if block in total else x
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32()), "cells": pa.array([np.round(np.log2(x + 1.0) * 4).astype(np.uint8).tobytes() for x in total.values()], pa.binary())})


def rarity(rows: DataFrame, n: int, bits: int) -> np.ndarray:
    """The quantised count of every cell; 2**bits bytes, whatever the size of the corpus."""
    schema = "block int, cells binary"
    got = rows.select("text").mapInArrow(_cell_counter(n, bits), schema).repartition(64, "block").mapInArrow(_cell_adder, schema).toArrow()
    cells = np.zeros((64, (1 << bits) // 64), np.uint8)
    for block, x in zip(got["block"].to_pylist(), got["cells"].to_pylist(), strict=True):
        cells[block] = np.frombuffer(x, np.uint8)
    return cells.ravel()


def _profiler(shared, n: int, bits: int, percent: int):
    def profile(batches):
        rare = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = _sets(part.column("text"), n)
                size = np.diff(bounds)
                doc = np.repeat(np.arange(len(size)), size)
                s1, s2 = _sums(h, bounds)
                parts = np.bincount(doc * PARTS + (h & np.uint64(PARTS - 1)).astype(np.int64), minlength=len(size) * PARTS).reshape(-1, PARTS).astype(np.int32)
                order = np.lexsort((h, rare[(h >> np.uint64(64 - bits)).astype(np.int64)], doc))
                h = h[order]
                length = size - -(-percent * size // 100) + 1
                prefix = [h[a : a + k].tobytes() if m else b"" for a, k, m in zip(bounds[:-1].tolist(), length.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(s1), pa.array(s2), pa.array(prefix, pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "prefix", "parts"])

    return profile


_POST = "seg int, h binary, rep binary, pos binary, size binary, parts binary"


def _dealer(segs: int):
    shift = np.uint64(64 - segs.bit_length() + 1)

    def deal(batches):
        for batch in batches:
            lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("prefix")]
            if not lists:
                continue
            length = np.array([len(x) for x in lists])
            h = np.concatenate(lists)
            row = np.repeat(np.arange(len(lists)), length)
            pos = (np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
            rep, size = batch.column("rep").to_numpy(), batch.column("n_shingles").to_numpy()
            seg = (h >> shift).astype(np.int64) if segs > 1 else np.zeros(len(h), np.int64)
            order = np.argsort(seg, kind="stable")
            edges = np.searchsorted(seg[order], np.arange(segs + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[k] : edges[k + 1]]
                used, back = np.unique(row[at], return_inverse=True)
                yield pa.RecordBatch.from_pydict({"seg": pa.array([k], pa.int32()), "h": [h[at].tobytes()], "rep": [rep[row[at]].tobytes()], "pos": [pos[at].tobytes()], "size": [size[row[at]].astype(np.int32).tobytes()], "parts": pa.array([b""], pa.binary())})

    return deal


def _sharer(batches):
    """Postings of the shingles that at least two documents have: h, rep, pos, size, how many documents, and the first one's rep, pos and size."""
    kept: dict[int, list] = {}
    for batch in batches:
        for row, seg in enumerate(batch.column("seg").to_pylist()):
            kept.setdefault(seg, []).append([np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("h", np.uint64), ("rep", np.int64), ("pos", np.int32), ("size", np.int32))])
    for blocks in kept.values():
        h, rep, pos, size = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.lexsort((rep, h))
        h = h[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        many = np.repeat(np.diff(edge), np.diff(edge))
        keep = many > 1
        at, first = order[keep], order[np.repeat(edge[:-1], np.diff(edge))[keep]]
        columns = [h[keep].view(np.int64), rep[at], pos[at], size[at], many[keep].astype(np.int64), rep[first], pos[first], size[first]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "rep", "pos", "size", "n", "rep0", "pos0", "size0"])


def _possible_star(percent: int):
    """possible() for a list's first document and another one, as a column."""
    x, y, px, py = F.col("size0").cast("long"), F.col("size").cast("long"), F.col("pos0"), F.col("pos")
    need = (F.lit(percent) * (x + y) + F.lit(99 + percent)) / F.lit(100 + percent)
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (F.least(x - px, y - py) >= F.floor(need))


def possible(size_x, size_y, pos_x, pos_y, percent: int):
    """Length and positional filter: whether sets of these sizes that share a shingle at these places, and none before, can be similar enough."""
    need = -(-percent * (size_x + size_y) // (100 + percent))
    return (100 * np.minimum(size_x, size_y) >= percent * np.maximum(size_x, size_y)) & (np.minimum(size_x - pos_x, size_y - pos_y) >= need)


def _cut(rows: np.ndarray, start: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists whose rows by n pairs exceed `most`, cut into portions of rows: rows, start, n and the first row of every portion."""
    step = np.maximum(1, most // np.maximum(n, 1))
    portions = -(-rows // step)
    which = np.repeat(np.arange(len(rows)), portions)
    offset = (np.arange(len(which)) - np.repeat(np.cumsum(portions) - portions, portions)) * step[which]
    return np.minimum(step[which], rows[which] - offset), start[which], n[which], offset


def _pairer(percent: int):
    """Pairs within each list (rows of one h and block pair) that cross classes."""

    def emit(found: list):
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["x", "y"])

    def pair(batches):
        own = [b for b in batches if b.num_rows]
        if not own:  # a partition without rows
            return
        table = pa.Table.from_batches(own)
        h, first, second = (table[c].to_numpy() for c in ("h", "i", "j"))
        rep, pos, size, cls, side = (table[c].to_numpy().astype(np.int64) for c in ("rep", "pos", "size", "cls", "side"))
        within = first == second
        order = np.lexsort((rep, h, first, second))
        change = np.zeros(len(rep) + 1, bool)
        change[0] = change[-1] = True
        for k in (h, first, second):
            change[1:-1] |= k[order][1:] != k[order][:-1]
        edge = np.flatnonzero(change)
        # all lists at once, in portions of about a million pairs: a list's rows against its rows
        rows, start, n, offset = _cut(np.diff(edge), edge[:-1], np.diff(edge), 1 << 18)
        total = np.concatenate([[0], np.cumsum(rows * n)])
        found, size_found, k = [], 0, 0
        while k < len(n):
            end = max(k + 1, int(np.searchsorted(total, total[k] + (1 << 18), "right")) - 1)
            m = rows[k:end] * n[k:end]
            list_ = np.repeat(np.arange(k, end), m)
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            i, j = order[start[list_] + offset[list_] + at // n[list_]], order[start[list_] + at % n[list_]]
            ok = (cls[i] != cls[j]) & np.where(within[i], rep[i] < rep[j], side[i] < side[j])
            i, j = i[ok], j[ok]
            ok = possible(size[i], size[j], pos[i], pos[j], percent)
            i, j = i[ok], j[ok]
            if len(i):
                found.append(np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], 1), axis=0))
                size_found += len(found[-1])
            k = end
            if size_found > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
                size_found = 0
                if len(found[0]) > 1 << 20:
                    yield emit(found)
                    found = []
        yield emit(found)

    return pair


def _verifier(n: int, percent: int):
    def similar(part: pa.RecordBatch) -> pa.Array:
        (x, at_x), (y, at_y) = (_sets(part.column(c), n) for c in ("text_x", "text_y"))
        keep = []
        for k in range(part.num_rows):
            a, b = x[at_x[k] : at_x[k + 1]], y[at_y[k] : at_y[k + 1]]
            both = np.concatenate([a, b])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            keep.append(100 * same >= percent * (len(a) + len(b) - same))
        return pa.array(keep, pa.bool_())

    def verify(batches):
        for batch in batches:
            for long in slices(batch, "text_x"):
                for part in slices(long, "text_y"):
                    mask = similar(part)
                    yield pa.RecordBatch.from_arrays([part.column("x").filter(mask), part.column("y").filter(mask)], ["x", "y"])

    return verify


def _sums(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """What two equal sets share: two 64-bit sums over the set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(tv.mix(h ^ np.uint64(k)))]) for k in (0x51, 0x7A3)]
        return [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]


def _place(column: str, log_size: int):
    return F.shiftrightunsigned(F.xxhash64(column), 64 - log_size)


def _bit_setter(batches):
    """Bits of each block of 65,536 places; all places of a block are in one task."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column("at").to_numpy()
        for block in np.unique(at >> 16).tolist():
            blocks.setdefault(block, np.zeros(1 << 16, bool))[at[at >> 16 == block] & 0xFFFF] = True
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(blocks), pa.int64()), "bits": pa.array([np.packbits(x).tobytes() for x in blocks.values()], pa.binary())})


def id_bits(ids: DataFrame, most: int = 28) -> tuple[np.ndarray, int]:
    """A bitmap over hashes of doc_id with eight bits or more an id, 2**most bits (32 MB) at the utmost, and the logarithm of its size.

    No id is missed. A fuller bitmap only lets more rows pass to the exact join that follows it.
    """
    log_size = min(most, max(16, (8 * ids.count()).bit_length()))
    got = ids.select(_place("doc_id", log_size).alias("at")).distinct().repartition(64, F.shiftright("at", 16)).mapInArrow(_bit_setter, "block long, bits binary").toArrow()
    bits = np.zeros(((1 << log_size) >> 16, (1 << 16) // 8), np.uint8)
    for block, x in zip(got["block"].to_pylist(), got["bits"].to_pylist(), strict=True):
        bits[block] = np.frombuffer(x, np.uint8)
    return bits.ravel(), log_size


def _set_finder(bitmap, n: int):
    """Texts whose id is in the bitmap, with the sums of their sets."""

    def find(batches):
        bits = bitmap.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            found = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for part in slices(found, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, _sums(*_sets(part.column("text"), n))), part.column("text")], ["doc_id", "s1", "s2", "text"])

    return find


def join(docs: DataFrame, text: str = "text", id_column: str = "doc_id", n: int = 5, percent: int = 80, sketch_bits: int = 22, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (doc_id, n_shingles, rep) with one row for each row of docs, and links (x, y) with x < y.

    rep stands for a set: the smallest id of the documents that have it (null for empty sets and null ids). Links hold
    representatives, namely enough of the similar pairs to connect every two that similar pairs connect: pairs within a
    class that the first round has already tied together are not all listed. Ids are whole numbers. Where an id has
    several texts, each of their sets is compared: one set goes by the id, the others by numbers from 2**62, and further
    links tie the sets of an id to one class.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text))
    cells = rarity(rows, n, sketch_bits)
    shared = spark.sparkContext.broadcast(cells)
    profile = saved(rows.mapInArrow(_profiler(shared, n, sketch_bits, percent), "doc_id long, n_shingles long, s1 long, s2 long, prefix binary, parts binary"))
    alive = profile.filter("n_shingles > 0 and doc_id is not null")
    # the one exchange of prefixes: all that follows joins narrow columns, or a saved table that is broadcast while small
    sets = saved(alive.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts")))
    # a set whose smallest id stands for another set already gets a number of its own
    taken = saved(sets.groupBy("least").agg(F.min(F.struct("s1", "s2")).alias("one"), F.count("*").alias("n")).filter("n > 1").select("least", "one"))
    number = F.xxhash64("least", "s1", "s2").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    own = F.when(F.col("one").isNull() | (F.struct("s1", "s2") == F.col("one")), F.col("least")).otherwise(number)
    named = sets.join(taken, "least", "left").withColumn("rep", own)
    reps = saved(named.select("s1", "s2", "least", "rep", "n_shingles", "parts"))
    documents = profile.select("doc_id", "n_shingles", "s1", "s2").join(reps.select("s1", "s2", "rep"), ["s1", "s2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"))
    of_id = documents.filter("rep is not null and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("most")).filter("x < most").select("doc_id", "x")
    same_id = documents.join(of_id, "doc_id").filter("rep > x").select("x", F.col("rep").alias("y")).distinct()

    total = sets.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    segs = 1 << max(4, int(np.ceil(np.log2(total / (4 << 20) + 1))))  # about half a million postings each
    postings = saved(named.select("rep", "n_shingles", "prefix").mapInArrow(_dealer(segs), _POST).repartition(segs, "seg").mapInArrow(_sharer, "h long, rep long, pos int, size int, n long, rep0 long, pos0 int, size0 int"))
    parts = reps.select("rep", "parts")

    def candidates(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that pass the suffix filter."""
        p = pairs.distinct().join(parts.withColumnsRenamed({"rep": "x", "parts": "px"}), "x").join(parts.withColumnsRenamed({"rep": "y", "parts": "py"}), "y")
        return p.mapInArrow(_suffix(percent), "x long, y long")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("x").alias("rep")).unionByName(pairs.select(F.col("y").alias("rep"))).distinct()
        wanted = saved(reps.join(ids, "rep", "left_semi").select("rep", "s1", "s2", F.col("least").alias("doc_id")))
        # texts travel, not sets: a text is shorter than the hashes of its shingles, and its set is cut again where pairs meet
        # only rows of the wanted ids (and the few whose hash meets one of theirs) leave their task; the join decides exactly
        bits, log_size = id_bits(wanted)
        bitmap = spark.sparkContext.broadcast(bits)
        made = rows.select("doc_id", "text", _place("doc_id", log_size).alias("at")).mapInArrow(_set_finder(bitmap, n), "doc_id long, s1 long, s2 long, text string")
        key = ["doc_id", "s1", "s2"]
        whole = saved(made.join(wanted.select(*key, "rep"), key).dropDuplicates(key).select("rep", "text"))
        met = pairs.join(whole.withColumnsRenamed({"rep": "x", "text": "text_x"}), "x").join(whole.withColumnsRenamed({"rep": "y", "text": "text_y"}), "y")
        return saved(met.select("x", "y", "text_x", "text_y").mapInArrow(_verifier(n, percent), "x long, y long"))

    star = postings.filter((F.col("rep") != F.col("rep0")) & _possible_star(percent)).select(F.col("rep0").alias("x"), F.col("rep").alias("y"))
    tried = saved(candidates(star))
    links = saved(verified(tried).unionByName(same_id))
    classes = components(links, "x", "y").withColumnsRenamed({"id": "rep", "component_id": "cls"})
    known = postings.select("h", "rep", "pos", "size", "n").join(classes, "rep", "left").withColumn("cls", F.coalesce("cls", "rep"))
    # lists with one class have no pair left; long lists are dealt out as pairs of blocks
    mixed = known.groupBy("h").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high").select("h")
    known = known.join(mixed, "h", "left_semi").withColumn("k", F.ceil(F.col("n") / F.lit(block)).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    dealt = known.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("h", "rep", "pos", "size", "cls", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).cast("long").alias("side"))
    more = dealt.repartition(segs, "h", "i", "j").mapInArrow(_pairer(percent), "x long, y long")
    left = saved(candidates(more.join(tried, ["x", "y"], "left_anti")))
    return documents, links.unionByName(verified(left))


def _suffix(percent: int):
    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, PARTS).astype(np.int64) for c in ("px", "py"))
            sx, sy = x.sum(1), y.sum(1)
            most = np.minimum(x, y).sum(1)
            mask = pa.array(100 * most >= percent * (sx + sy - most))
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(mask), batch.column("y").filter(mask)], ["x", "y"])

    return keep


def classes(docs: DataFrame, **options) -> DataFrame:
    """Near-duplicate classes: doc_id, n_shingles and component_id (the smallest id reachable by links, itself included).

    One row for each row of docs. Empty texts link with nothing: their component is their own id, as for null ids (null).
    """
    documents, links = join(docs, **options)
    found = components(links, "x", "y").withColumnsRenamed({"id": "rep"})
    return documents.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
