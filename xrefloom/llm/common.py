"""What the operators of this subpackage share: folds, batch slices, scratch tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[str] = []


def whole_text(name: str) -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("text")


def fold(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % n, F.lit(-1))


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """Consecutive parts of a batch with about `most` bytes of text each (at least one row), so that scratch arrays stay small."""
    if not batch.num_rows:
        return
    col = batch.column(text)
    size = np.cumsum(np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float)))
    start, base = 0, 0.0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(start, end - start)
        start, base = end, size[end - 1]


def pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes: how many bytes the largest one takes, then all first bytes, all second bytes, ..."""
    x = x.astype("<u8", copy=False)
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b) -> np.ndarray:
    x = np.frombuffer(b, np.uint8)
    width = int(x[0])
    out = np.zeros(((len(x) - 1) // width, 8), np.uint8)
    out[:, :width] = x[1:].reshape(width, -1).T
    return out.view("<u8").ravel()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that no operator's columns have, and these names by the old ones."""
    names = {c: f"_own{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def with_fields(kept, more: str) -> T.StructType:
    """The schema of kept fields, whatever their types and names, and the columns written in `more`."""
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *T.StructType.fromDDL(more)])


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of at most 1,000 rows and about 4 MB, so that a worker's memory does not hang on their lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one is made only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loom-"))
    return _own[0]


#: Whether Spark deletes a query's shuffle files at the query's end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, only: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage is cut, and it survives lost executors.

    only: nothing else reads what the table is made from, so its shuffle files are deleted once it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true" if only else before)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _forest(batches):
    """Union-find inside one task: passes on a spanning star of each local component instead of all its links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield _stars(parent, find)
            parent.clear()
    yield _stars(parent, find)


def _stars(parent, find):
    pairs = [(x, find(x)) for x in list(parent)]
    return pa.RecordBatch.from_pydict({"a": pa.array([x for x, r in pairs if x != r], pa.int64()), "b": pa.array([r for x, r in pairs if x != r], pa.int64())})


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links: one row (id, component_id) for every linked id; component_id is its component's smallest id.

    Each round contracts links inside tasks, then points every id at the smallest neighbour (a partial aggregation, so a
    hub is no hot spot) and rewrites the links between neighbours' smallest ids, until every component is a star around
    its smallest id. Rounds grow with the logarithm of the longest path. Only a count of changes comes to the driver.
    Links with a null end are ignored; links of an id with itself do no harm. An empty table gives an empty table.
    """
    work = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    work = saved(work.mapInArrow(_forest, "a long, b long"))  # (x, root) with root < x
    for _ in range(most_rounds):
        # every id's smallest neighbour, itself included
        low = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # both ends of every link go to the smaller of the ends' minima; each id also to its own minimum
        ends = work.join(low.withColumnRenamed("m", "ma"), "a").join(low.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
        moved = ends.select(F.explode(F.array(F.struct(F.col("a"), F.least("ma", "mb").alias("b")), F.struct(F.col("b").alias("a"), F.least("ma", "mb").alias("b")), F.struct(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b")))).alias("s")).select("s.*").filter("a <> b").distinct()
        work = saved(moved.mapInArrow(_forest, "a long, b long").distinct())
        # a forest of stars: nothing that is a root somewhere has a parent itself, and every id has one parent
        left = work.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or work.select("b").join(work.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not left:
            break
    else:
        raise RuntimeError("components did not settle")
    star = work.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return star.unionByName(work.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def crc32_sql(s: str) -> str:
    """CRC-32 (unsigned) of an ASCII string in DuckDB, bit by bit from the lowest."""
    bits = f"list_transform(range(8 * length({s})), lambda j: CAST((ascii({s}[1 + j // 8]) >> (j % 8)::INT) & 1 AS BIGINT))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, {0xEDB88320} * (xor(c, b) & 1)), CAST({0xFFFFFFFF} AS BIGINT)), {0xFFFFFFFF})"
