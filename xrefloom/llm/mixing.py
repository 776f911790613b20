"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are added up to cells (source, language, topic) with their token counts; only this small table is raked: in
turn, the cells of each source, language and topic are scaled so that their tokens meet the target shares, until all
three marginals hold. A cell's factor, times one constant that meets the token budget, is the probability with which
each of its documents is kept. The draw is a hash of id, text and seed, so it is the same on every worker and in every run.

The cell table is a sum over all documents, however many there are. Up to `local_cells` cells, a proven bound, are raked
on the driver; a larger table (sources by the million) stays on Spark, with sums by key and joins, and the same factors.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

DIMS = ("source", "lang", "topic")


def content_topic(text: Column) -> Column:
    """A coarse topic from the text alone: what most of its lines look like."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    return (
        F.when(F.trim(t) == "", "empty").when(t.contains(" | "), "table").when(F.regexp_count(t, F.lit("[0-9]")) * 50 > n, "numeric")
        .when(F.upper(t) == t, "capitals").when(F.length(t) < 400, "note").when(F.length(t) > 8000, "long").otherwise("prose")
    )


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Targets of a dimension, not yet scaled: its tokens to a power below 1, which lifts small values. Columns: dim, target."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).filter("t > 0")
    return sums.select(dim, F.pow(F.col("t").cast("double"), F.lit(power)).alias("target"))


def _rake_local(cells: list[dict], goals: list[dict], rounds: int, tolerance: float) -> tuple[list[float], float]:
    """Weights of cells after raking, and the last round's largest correction: each dimension in turn is scaled to its goal."""
    w = np.array([c["w"] for c in cells])
    codes, wanted = [], []
    for d, goal in zip(DIMS, goals, strict=True):
        names, code = np.unique(np.array([c[d] for c in cells], object), return_inverse=True)
        codes.append(code)
        wanted.append(np.array([goal.get(n, 0.0) for n in names]))
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, wanted, strict=True):
            have = np.bincount(code, w, len(goal))
            by = np.where(have > 0, goal / np.where(have > 0, have, 1.0), 0.0)
            w = w * by[code]
            worst = max(worst, float(np.abs(by[code] - 1)[w > 0].max(initial=0.0)))
        if worst < tolerance:
            break
    return w.tolist(), worst


def _rake_spread(work: DataFrame, goal: dict[str, DataFrame], rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """The same on Spark, for any number of cells."""
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for dim in goal:
            have = work.groupBy(dim).agg(F.sum("w").alias("have")).join(goal[dim], dim).select(dim, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0).alias("by"))
            work = saved(work.join(have, dim, "left").withColumn("w", F.col("w") * F.coalesce("by", F.lit(0.0))))
            worst = max(worst, work.filter("w > 0").agg(F.max(F.abs(F.col("by") - 1))).first()[0] or 0.0)
            work = work.drop("by")
        if worst < tolerance:
            break
    return work, worst


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 20, tolerance: float = 1e-3, local_cells: int = 100_000) -> DataFrame:
    """Cells with a column factor: tokens * factor has the target shares in every dimension, as nearly as `tolerance`.

    targets: for each dimension, a table of its values and their target shares (scaled to sum to 1 over values that have
    tokens). A value without a target gets factor 0; cells without tokens have factor 1 and no say. Targets that contradict
    each other on empty cells end after `rounds` with the last round's factors, and with a warning.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("factor", F.lit(1.0))
    work = cells.withColumn("w", F.col("tokens").cast("double") / F.lit(float(total)))
    goal = {}
    for dim in DIMS:
        t = targets[dim].join(cells.filter("tokens > 0").select(dim).distinct(), dim, "left_semi").select(dim, "target")
        goal[dim] = t.withColumn("target", F.col("target") / F.lit(float(t.agg(F.sum("target")).first()[0] or 1.0)))
    if cells.limit(local_cells + 1).count() <= local_cells:
        rows = [r.asDict() for r in work.orderBy(*DIMS).collect()]
        w, worst = _rake_local(rows, [dict(goal[d].collect()) for d in DIMS], rounds, tolerance)
        work = cells.sparkSession.createDataFrame([(*(r[c] for c in cells.columns), x) for r, x in zip(rows, w, strict=True)], work.schema)
    else:
        work, worst = _rake_spread(work, {d: saved(t) for d, t in goal.items()}, rounds, tolerance)
    if worst >= tolerance:
        warnings.warn(f"raking ended after {rounds} rounds; the largest correction was still {worst:.2g}", stacklevel=2)
    return work.withColumn("factor", F.when(F.col("tokens") > 0, F.col("w") * F.lit(float(total)) / F.col("tokens")).otherwise(1.0)).drop("w")


def calibrate(cells: DataFrame, budget: float) -> float:
    """The constant c with which the expected tokens, the sum of tokens * min(1, c * factor), are `budget`; found on the cell table."""
    low, high = 0.0, 1.0
    top = cells.agg(F.max(F.when(F.col("factor") > 0, 1 / F.col("factor")))).first()[0] or 1.0
    high = max(top, 1.0)
    for _ in range(3):  # each pass narrows the range 63 times
        grid = [low + (high - low) * k / 64 for k in range(65)]
        got = cells.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(c) * F.col("factor"))).alias(f"s{k}") for k, c in enumerate(grid))).first()
        sums = [x or 0.0 for x in got]
        k = next((k for k, s in enumerate(sums) if s >= budget), 64)
        low, high = grid[max(0, k - 1)], grid[k]
    return high


def mix(docs: DataFrame, share: float = 0.5, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, seed: int = 1, text: str = "text", id_column: str = "doc_id", dims: tuple[str, str] = DIMS[:2], keep: tuple[str, ...] = ("doc_id", "source", "lang"), topic: Column | None = None, **options) -> DataFrame:
    """For every row: the columns of keep, topic, n_tokens, factor, probability and sampled.

    share: the expected share of all tokens that is kept. Targets are tempered shares (powers by dimension) unless given.
    A null source, language or topic is a value of its own. Rows without tokens have factor 1 and the probability of
    factor 1. Equal rows (same id and text) are kept or left out together. dims: the columns of docs that hold source and
    language; keep must not hold names of the result. Texts are read once and never shuffled: the columns of keep are
    written to the shared folder with what the draw needs.
    """
    powers = {"source": 0.7, "lang": 0.7, "topic": 0.9} | (powers or {})
    null = "\x00"
    own_dims = [F.coalesce(F.col(c).cast("string"), F.lit(null)).alias(f"_{d}") for c, d in zip(dims, DIMS, strict=False)]
    tokens = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_column), F.col(text)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    one = saved(docs.select(*keep, *own_dims, F.coalesce(topic if topic is not None else content_topic(F.col(text)), F.lit(null)).alias("_topic"), tokens.alias("n_tokens"), draw.alias("_draw")))
    cells = saved(one.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMS)).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    goals = {d: (targets or {}).get(d) for d in DIMS}
    goals = {d: tempered(cells, d, powers[d]) if t is None else t.withColumn(d, F.coalesce(F.col(d).cast("string"), F.lit(null))) for d, t in goals.items()}
    raked = saved(rake(cells, goals, **options))
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    c = calibrate(raked, share * total) if total else share
    known = raked.select(*(F.col(d).alias(f"_{d}") for d in DIMS), "factor")
    out = one.join(known, [f"_{d}" for d in DIMS], "left").withColumn("probability", F.least(F.lit(1.0), F.lit(c) * F.col("factor")))
    return out.select(*keep, F.when(F.col("_topic") != null, F.col("_topic")).alias("topic"), "n_tokens", "factor", "probability", (F.col("_draw") < F.col("probability")).alias("sampled"))
