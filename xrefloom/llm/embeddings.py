"""Near-duplicate embeddings by iterative quantisation.

1. Equal vectors with equal labels are one representative, with its number of copies.
2. For each length of vectors, a rotation for binary codes is learned (PCA, then alternating code and rotation updates)
   from a bounded sample of about `sample_rows` representatives of that length; every representative gets a code of up to 64 bits.
3. Codes are indexed in tables of 16-bit substrings. Each code looks up its own substring and those that lack one of its
   bits, so that of two substrings that differ in one bit one finds the other: every pair with at most 2 * tables - 1
   differing bits is found, and most pairs beyond. A pair that several tables find is kept from the first of them, which
   both codes tell without a shuffle; pairs with more than `radius` differing bits go.
4. The remaining pairs are reranked with their original vectors, in double precision: links have cosine >= `least`.

Vectors are compared only where labels are equal and not null, and lengths are equal. Null and zero vectors and vectors
with null or non-finite components link with nothing. The
index holds all other vectors; recall is measured in the tests.

Joins whose sides grow with the vectors are merge joins by hint: Spark would broadcast a side by the size of its compressed
files, before codes are exploded into substrings, and the driver would hold all of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved

WIDTH = 16


def _matrix(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that hold a usable vector, and the vectors."""
    rows, vectors = [], []
    for k, x in enumerate(col):
        if x.is_valid and len(x.values) and not x.values.null_count:
            v = x.values.to_numpy().astype(np.float64)
            if np.isfinite(v).all() and v.any():
                rows.append(k)
                vectors.append(v)
    return np.array(rows, np.int64), vectors


def _reader(batches):
    for batch in batches:
        rows, vectors = _matrix(batch.column("v"))
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())], ["vec_id", "label", "dim", "vec"])


def learn(sample: np.ndarray, rounds: int = 40) -> dict:
    """Mean and projection (dimensions by bits) of iterative quantisation; one bit for each dimension, 64 at most."""
    dim = sample.shape[1]
    bits = min(64, dim)
    mean = sample.mean(0) if len(sample) else np.zeros(dim)
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x if len(x) else np.eye(dim))
    main = vectors[:, ::-1][:, :bits]
    v = x @ main
    rotation, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(5)).normal(size=(bits, bits)))
    for _ in range(rounds if len(v) else 0):
        code = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(code.T @ v)
        rotation = (left @ right).T
    return {"mean": mean, "project": main @ rotation, "bits": bits, "dim": dim}


def encode(x: np.ndarray, model: dict) -> np.ndarray:
    on = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) - model["mean"]) @ model["project"] >= 0
    return (on.astype(np.uint64) << np.arange(model["bits"], dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def _stacked(col: pa.Array) -> np.ndarray:
    """Packed vectors of one length as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def _lengths(col: pa.Array):
    """The lengths of packed vectors, each with its rows."""
    n = pc.binary_length(col).to_numpy() // 8
    return [(d, np.flatnonzero(n == d)) for d in np.unique(n).tolist()]


def _learner(key, table):
    x = _stacked(table["vec"])
    m = learn(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
    return pa.table({"dim": pa.array([m["dim"]], pa.int32()), "mean": pa.array([m["mean"].tobytes()], pa.binary()), "project": pa.array([np.ascontiguousarray(m["project"]).tobytes()], pa.binary())})


def _coder(shared):
    def code(batches):
        models = dict(shared.value)
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.int64)
            for d, at in _lengths(batch.column("vec")):
                if d not in models:  # nothing of this length is in the sample
                    models[d] = learn(np.zeros((0, d)))
                codes[at] = encode(_stacked(batch.column("vec").take(pa.array(at))), models[d])
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label"), batch.column("dim"), pa.array(codes)], ["rep", "label", "dim", "code"])

    return code


def _ranker(least: float):
    def rank(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = np.zeros(batch.num_rows)
            for _, at in _lengths(batch.column("vx")):
                x, y = (_stacked(batch.column(c).take(pa.array(at))) for c in ("vx", "vy"))
                with np.errstate(over="ignore", invalid="ignore"):
                    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))  # no overflow in squares
                    cosine[at] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            keep = pa.array(cosine >= least)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(keep), batch.column("y").filter(keep), pa.array(cosine).filter(keep)], ["x", "y", "cosine"])

    return rank


def candidates(codes: DataFrame, radius: int) -> DataFrame:
    """Pairs (x, y), x < y, of codes (rep, label, dim, code) with equal label and dim that agree but for one bit in a substring and differ in at most `radius` bits; each pair once."""
    tables = 64 // WIDTH  # shorter codes use only the first of them
    mask = (1 << WIDTH) - 1
    near = lambda t: F.bit_count(F.shiftrightunsigned(F.col("cx").bitwiseXOR(F.col("cy")), WIDTH * t).bitwiseAND(F.lit(mask).cast("long"))) <= 1
    parts = F.array(*(F.struct(F.lit(t).alias("t"), F.shiftrightunsigned("code", WIDTH * t).bitwiseAND(F.lit(mask).cast("long")).alias("key")) for t in range(tables)))
    own = codes.select("rep", "label", "dim", "code", F.explode(parts).alias("p")).select("rep", "label", "dim", "code", "p.t", "p.key").filter(F.col("t") * WIDTH < F.col("dim"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(WIDTH)))
    lacking = F.explode(F.filter(flips, lambda f: F.col("key").bitwiseAND(f) == f))
    asked = own.select(F.col("rep").alias("x"), "label", "dim", F.col("code").alias("cx"), "t", "key", lacking.alias("f")).select("x", "label", "dim", "cx", "t", F.col("key").bitwiseXOR(F.col("f")).alias("key"), (F.col("f") == 0).alias("same"))
    met = own.select(F.col("rep").alias("y"), "label", "dim", F.col("code").alias("cy"), "t", "key").join(asked.hint("merge"), ["label", "dim", "t", "key"])
    first = F.lit(True)
    for t in range(tables - 1):
        first = first & ((F.col("t") <= t) | ~near(t))
    once = ~F.col("same") | (F.col("x") < F.col("y"))  # equal substrings find each other
    return met.filter(once & (F.bit_count(F.col("cx").bitwiseXOR(F.col("cy"))) <= radius) & first).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def links(vectors: DataFrame, least: float = 0.93, sample_rows: int = 20_000, radius: int = 24) -> tuple[DataFrame, DataFrame]:
    """Two tables from columns vec_id, label and embedding: members (vec_id, first, rep, copies) of all usable vectors, and links (x, y, cosine) between representatives, x < y.

    Equal vectors of a label have one representative: `first`, the smallest id among them; where that id stands for
    several different vectors, each of these has a number of its own from 2**62.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v")).filter("label is not null and vec_id is not null and v is not null")
    read = saved(rows.mapInArrow(_reader, "vec_id long, label string, dim int, vec binary"))
    reps = saved(read.groupBy("label", "vec", "dim").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    several = saved(reps.groupBy("first").agg(F.count("*").alias("n")).filter("n > 1").select("first", F.lit(True).alias("many")))
    own = F.xxhash64("label", "vec", "first").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    reps = reps.join(several, "first", "left").withColumn("rep", F.when(F.col("many"), own).otherwise(F.col("first"))).drop("many")
    members = read.join(reps.hint("merge"), ["label", "vec"]).select("vec_id", "first", "rep", "copies")
    share = reps.groupBy("dim").agg(F.least(F.lit(1.0), sample_rows / F.count("*")).alias("share"))
    sample = reps.join(share, "dim").filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < (F.col("share") * (1 << 30)).cast("long")).select("dim", "vec")
    models = {}
    for r in sample.groupBy("dim").applyInArrow(_learner, "dim int, mean binary, project binary").collect():
        bits = min(64, r["dim"])
        models[r["dim"]] = {"mean": np.frombuffer(r["mean"]), "project": np.frombuffer(r["project"]).reshape(r["dim"], bits), "bits": bits, "dim": r["dim"]}
    shared = spark.sparkContext.broadcast(models)
    codes = saved(reps.select("rep", "label", "dim", "vec").mapInArrow(_coder(shared), "rep long, label string, dim int, code long"))

    pairs = candidates(codes, radius)
    vec = reps.select("rep", "vec")
    both = pairs.join(vec.withColumnsRenamed({"rep": "x", "vec": "vx"}), "x").join(vec.withColumnsRenamed({"rep": "y", "vec": "vy"}), "y")
    return members, saved(both.select("x", "y", "vx", "vy").mapInArrow(_ranker(least), "x long, y long, cosine double"))


def classes(vectors: DataFrame, **options) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links (other vectors linked directly), component_id and kept (vec_id = component_id).

    A vector that links with nothing is its own component. Rows that repeat an id all have the most links and the smallest
    component of the id's vectors, and the id's vectors are one node of its component; each counts for itself among the
    links of others. A null id has a null component and is kept.
    """
    members, found = links(vectors, **options)
    copies = members.select("rep", "copies").distinct()
    ends = found.select(F.col("x").alias("rep"), F.col("y").alias("o")).unionByName(found.select(F.col("y").alias("rep"), F.col("x").alias("o")))
    more = ends.hint("merge").join(copies.withColumnsRenamed({"rep": "o", "copies": "c"}), "o").groupBy("rep").agg(F.sum("c").alias("others"))
    numbered = members.filter("rep <> first").select("rep", "first").distinct()
    pairs = found.select("x", "y")
    for end in ("x", "y"):  # components are of ids
        pairs = pairs.join(numbered.withColumnsRenamed({"rep": end, "first": "_id"}), end, "left").withColumn(end, F.coalesce("_id", end)).drop("_id")
    ids = components(pairs, "x", "y").withColumnsRenamed({"id": "first"})
    own = members.join(more, "rep", "left").join(ids, "first", "left").select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    own = own.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))  # of an id with several vectors
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(own, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
