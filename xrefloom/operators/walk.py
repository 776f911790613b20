"""The bounded call-graph walk, level by level."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tickets import path_of
from .units import keeps

#: Walks of at most so many symbols keep their levels on the driver and look the next one up by value.
FEW = 2000
FOREST = "id long, parent long, depth long, ticket string"
_own: list[str] = []


def _cut(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors must share.

    A session in one local process may do without one and gets a folder of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="walk-"))
    return _own[0]


def neighbours(calls: DataFrame, direction: str) -> DataFrame:
    """From, to, side and order of the steps that a direction allows; of `both`, callers come before callees.

    Up from a symbol are the functions that call it themselves (direct calls), down from one all that it or a definition inside it calls.
    """
    if direction not in ("up", "down", "both"):
        raise ValueError("direction is up, down or both")
    zero = F.lit(0).cast("long")
    direct = calls.filter("direct") if "direct" in calls.columns else calls
    up = direct.select(F.col("callee_ticket").alias("at"), F.col("caller_ticket").alias("next"), F.lit(0).alias("side"), zero.alias("k1"), zero.alias("k2"))
    down = calls.select(F.col("caller_ticket").alias("at"), F.col("callee_ticket").alias("next"), F.lit(1).alias("side"), F.col("ds").cast("long").alias("k1"), F.col("at").cast("long").alias("k2"))
    return up if direction == "up" else down if direction == "down" else up.unionByName(down)


def callgraph(calls: DataFrame, roots: DataFrame, direction: str = "down", depth: int = 3, max_syms: int = 200, within: str = "", without: str = "", stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """Breadth-first forest from the tickets in roots: id, parent (-1 for roots), depth, ticket.

    Equal to a first-in-first-out walk: within a level, nodes come in order of their discoverer's id, side and rank; each
    ticket belongs to its first discoverer; tickets that the path filter rejects are not walked through; the walk ends
    when max_syms nodes are found (roots are all kept). `stored` holds the steps up and down as tables bucketed by `at`:
    the levels of a walk of few symbols are then looked up by value, which reads their buckets only. A larger walk joins, and
    writes each level to the shared folder.
    """
    if stored is None:
        steps = neighbours(calls, direction)
    elif direction in ("up", "down"):
        steps = stored[direction]
    elif direction == "both":
        steps = stored["up"].unionByName(stored["down"])
    else:
        raise ValueError("direction is up, down or both")
    roots = roots.select("ticket").distinct()
    if max_syms <= FEW:
        first = [r["ticket"] for r in roots.orderBy("ticket").limit(FEW + 1).collect()]
        if len(first) <= FEW:
            return _few(steps, first, depth, max_syms, within, without)
    return _many(steps, roots, depth, max_syms, within, without)


def _few(steps: DataFrame, roots: list[str], depth: int, max_syms: int, within: str, without: str) -> DataFrame:
    spark = steps.sparkSession
    found = [(k, -1, 0, t) for k, t in enumerate(roots)]
    level = found
    for d in range(1, depth + 1):
        if len(found) >= max_syms or not level:
            break
        ids = spark.createDataFrame([(t, k) for k, _, _, t in level], "at string, parent long")
        met = steps.filter(F.col("at").isin(*(r[3] for r in level)) & ~F.col("next").isin(*(r[3] for r in found))).join(F.broadcast(ids), "at").filter(keeps(path_of(F.col("next")), within, without))
        new = met.groupBy("next").agg(F.min(F.struct("parent", "side", "k1", "k2")).alias("o")).orderBy("o", "next").limit(max_syms - len(found)).collect()
        level = [(len(found) + k, r["o"]["parent"], d, r["next"]) for k, r in enumerate(new)]
        found = found + level
    return spark.createDataFrame(found, FOREST)


def _many(steps: DataFrame, roots: DataFrame, depth: int, max_syms: int, within: str, without: str) -> DataFrame:
    folder = shared_folder(steps.sparkSession)
    by_ticket = Window.orderBy("ticket")
    found = _cut(roots.select((F.row_number().over(by_ticket) - 1).cast("long").alias("id"), F.lit(-1).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"), "ticket"), folder)
    level, total = found, found.count()
    for d in range(1, depth + 1):
        if total >= max_syms:
            break
        met = level.select(F.col("id").alias("parent"), F.col("ticket").alias("at")).join(steps, "at").withColumn("ticket", F.col("next")).filter(keeps(path_of(F.col("next")), within, without))
        new = met.join(found, "ticket", "left_anti").groupBy("ticket").agg(F.min(F.struct("parent", "side", "k1", "k2", "next")).alias("o"))
        # the level's first nodes, as many as the walk still takes: a top-k, so only those are numbered in one task
        top = new.orderBy("o").limit(max_syms - total)
        level = _cut(top.select((F.row_number().over(Window.orderBy("o")) - 1 + total).cast("long").alias("id"), F.col("o.parent").alias("parent"), F.lit(d).cast("long").alias("depth"), "ticket"), folder)
        n = level.count()
        if not n:
            break
        total += n
        found = _cut(found.unionByName(level), folder)
    return found
