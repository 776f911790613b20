"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words (runs of letters and digits, A-Z lower-cased), word pairs, and pairs that skip
one word, each hashed to `bits` bits. Weights are learned by FTRL-proximal: every coordinate has its own learning rate
and an L1 penalty, so most weights are exactly zero and the model that goes to the workers is small: at most 2**bits
weights, in practice a few thousand, whatever the size of the corpus.

Training uses a bounded sample: about `sample_rows` distinct labelled texts (a documented parameter), chosen by a hash of
the text; each is one row with its mean label, weighted by its number of copies. The sample is dealt over `shards` tasks; each runs FTRL over its rows, and
the shards' weights are averaged by coordinate (a weight that L1 keeps at zero in a shard counts as zero there), and the
mean is scaled and shifted so that the sample's scores are probabilities. Scoring reads whole
texts, all rows, in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import saved, slices, whole_text, with_fields

FTRL = {"alpha": 1.5, "beta": 1.0, "l1": 5.0, "l2": 0.02}


def features(col: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and their documents, in the order of kinds; a document's features may repeat."""
    w = tv.words(col, ~tv.ALNUM)
    kinds = [(w.hash, w.doc), tv.ngrams(w, 2, salt=1), tv.ngrams(w, 2, gaps=(0, 2), salt=2)]
    h = np.concatenate([k[0] for k in kinds])
    return (h >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([k[1] for k in kinds])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal with one learning rate for each coordinate; the last coordinate is the bias, which has no L1."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == len(self.z) - 1, 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, i: np.ndarray, y: float, copies: int = 1) -> None:
        w = self.weights(i)
        g = copies * (_sigmoid(w.sum()) - y)
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def _trainer(bits: int, epochs: int, options: dict):
    def train(batches):
        model = Ftrl(bits, **options)
        rows, labels, copies = [], [], []
        for batch in batches:
            for part in slices(batch, "text"):
                f, d = features(part.column("text"), bits)
                key = np.unique((d << bits) | f)
                bounds = np.searchsorted(key >> bits, np.arange(part.num_rows + 1))
                f = (key & ((1 << bits) - 1)).astype(np.int32)
                rows += [np.append(f[a:b], 1 << bits) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                labels += part.column("y").to_pylist()
                copies += part.column("copies").to_pylist()
        order = np.random.Generator(np.random.PCG64(7))
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                model.learn(rows[k], labels[k], copies[k])
        on = np.flatnonzero(model.n)  # coordinates that no row has stay zero
        w = model.weights(on)
        on, w = on[(w != 0) | (on == 1 << bits)], w[(w != 0) | (on == 1 << bits)]  # the bias stands in for the shard itself
        yield pa.RecordBatch.from_pydict({"i": pa.array(on, pa.int32()), "w": w})

    return train


def calibrate(scores: np.ndarray, y: np.ndarray, copies: np.ndarray | float = 1.0, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift (Platt's, by Newton steps) that make scores probabilities; 1 and 0 where only one class is there.

    A row stands for its number of copies, of which the share y is of class 1.
    """
    ones, zeros = (copies * y).sum(), (copies * (1 - y)).sum()
    if not ones or not zeros:
        return 1.0, 0.0
    x = np.log(np.clip(scores, 1e-12, 1 - 1e-12) / (1 - np.clip(scores, 1e-12, 1 - 1e-12)))
    goal = y * (ones + 1) / (ones + 2) + (1 - y) / (zeros + 2)
    t = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(t[0] * x + t[1])
        v = copies * np.maximum(p * (1 - p), 1e-9)
        off = copies * (p - goal)
        gradient = np.array([(off * x).sum() + 1e-3 * (t[0] - 1), off.sum()])
        hessian = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        t = t - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(t[0]), 0.05), float(t[1])


def labelled(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with their labels, for fit: labels has the columns doc_id and y; documents of an id that repeats all have its labels."""
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text)).withColumn("text_hash", F.xxhash64("text"))
    return rows.join(labels.select("doc_id", "y"), "doc_id").select("text", "text_hash", "y")


def fit(labelled: DataFrame, bits: int = 22, sample_rows: int = 12_000, shards: int = 3, epochs: int = 4, **options) -> dict:
    """Learn from columns text and y (0 or 1; other rows are left out). Returns {i, w, bias, bits}; i and w list only non-zero weights.

    A column text_hash, if there, is xxhash64 of the text; with it, texts are counted without being shuffled.
    A table without any usable row gives a model whose every score is 0.5; one with a single class gives its rate.
    """
    if "text_hash" not in labelled.columns:
        labelled = labelled.select(whole_text("text"), "y").withColumn("text_hash", F.xxhash64("text"))
    labelled = labelled.select("text", F.col("text_hash").alias("h"), F.col("y").cast("int").alias("y")).filter("y in (0, 1)")
    n = labelled.select("h").distinct().count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = labelled.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = saved(chosen.groupBy("h", "text").agg(F.avg("y").alias("y"), F.count("*").alias("copies"))).repartition(shards, "h").sortWithinPartitions("h", "text").select("text", "y", "copies")
    parts = sample.mapInArrow(_trainer(bits, epochs, FTRL | options), "i int, w double")
    got = parts.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toArrow()  # the weights that are not zero
    i, w, n = (got[c].to_numpy() for c in ("i", "w", "n"))
    w = w / max(1, n[i == 1 << bits].sum())
    bias = float(w[i == 1 << bits].sum())
    keep = i < 1 << bits
    model = {"i": i[keep], "w": w[keep].astype(np.float32), "bias": bias, "bits": bits}
    told = score(sample, model, keep=("y", "copies")).toArrow()  # about sample_rows rows of three numbers
    a, b = calibrate(told["score"].to_numpy(), told["y"].to_numpy(), told["copies"].to_numpy())
    return model | {"w": (a * model["w"]).astype(np.float32), "bias": a * bias + b}


def _scorer(model):
    def score(batches):
        m = model.value
        bits = m["bits"]
        weight = np.zeros(1 << bits, np.float32)
        weight[m["i"]] = m["w"]
        known = weight != 0
        for batch in batches:
            for part in slices(batch, "_text"):
                f, d = features(part.column("_text"), bits)
                hit = known[f]
                key = np.unique((d[hit] << bits) | f[hit])
                total = np.bincount(key >> bits, weight[key & ((1 << bits) - 1)], part.num_rows)
                names = part.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(_sigmoid(total + m["bias"]))], [*names, "score"])

    return score


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and score (0 to 1) for every row. Null and empty texts score as the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, whole_text(text).alias("_text"))
    return rows.mapInArrow(_scorer(shared), with_fields(rows.schema[:-1], "score double"))
