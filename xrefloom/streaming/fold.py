"""Incremental folding of entries into a deduplicated store, with their names, by Structured Streaming.

Files are admitted first: each batch, cut at so many files or so many bytes, whichever comes first, is one small file of
paths in out/admitted, and the stream takes one of these at a time. Rows that an earlier batch had are known by a digest
in the query's keyed state (RocksDB), so a batch looks up its own rows and reads nothing of the store. All rows of a
batch (entries, names, and the files that it folded) are one write to a folder of its own, and a manifest that names the
folder makes them visible at once. Readers follow manifests. A run that stops anywhere repeats its batch, to the same rows.

Layout of out: admitted/, data/batch=<number>-<run>/output=<name>/, manifests/batch=<number>/, checkpoint/.
The number of state partitions is spark.sql.shuffle.partitions of the first run.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.names import name_pairs
from ..sources.entries import parse_lines
from ..sources.files import lines

#: A batch is cut at so many files, or at so many bytes.
BATCH_FILES, BATCH_BYTES = 48, 2 << 30
#: So many files, the oldest first, are admitted by one listing.
LISTED = 10_000

_MANIFEST = "batch long, folder string"
_ADMITTED = "path string, bytes long"
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _there(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a file or folder there (files whose names start with a dot or an underscore do not count)."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def cut(sizes: list[int], files: int, size: int) -> list[int]:
    """The batch number of each file, in order: a batch closes with the file that brings it to `files` files or to `size` bytes."""
    out, batch, n, total = [], 0, 0, 0
    for s in sizes:
        out.append(batch)
        n, total = n + 1, total + s
        if n >= files or total >= size:
            batch, n, total = batch + 1, 0, 0
    return out


def admit(spark: SparkSession, folder: str, out: str, glob: str = "*.entries*", files: int = BATCH_FILES, size: int = BATCH_BYTES, listed: int = LISTED) -> int:
    """Cut the files of a folder that are not admitted yet into batches and log them; returns how many batches.

    Only names and lengths are read; files without a byte are passed over (until they have some). A listing of at most `listed` files is on the driver at a time.
    """
    batches = 0
    while True:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.col("length").alias("bytes"), "modificationTime")
        if _there(spark, f"{out}/admitted"):
            found = found.join(admitted(spark, out).select("path"), "path", "left_anti")
        rows = found.orderBy("modificationTime", "path").limit(listed).collect()
        if not rows:
            return batches
        numbers, run = cut([r.bytes for r in rows], files, size), uuid.uuid4().hex
        log = [(f"{run}-{n:06}", r.path, r.bytes) for n, r in zip(numbers, rows, strict=True)]
        # one task, so each batch is one file, which comes into sight whole
        spark.createDataFrame(log, f"cut string, {_ADMITTED}").coalesce(1).write.mode("append").partitionBy("cut").json(f"{out}/admitted")
        batches += numbers[-1] + 1


def admitted(spark: SparkSession, out: str) -> DataFrame:
    """All admitted files (path, bytes), folded or not."""
    return spark.read.schema(_ADMITTED).option("recursiveFileLookup", "true").json(f"{out}/admitted")


def _read_lines(batches):
    for batch in batches:
        for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            # the file itself, for the ledger, then its lines
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "value": pa.array([None], pa.string())})
            for part in lines(path):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.int64()), part], ["path", "bytes", "value"])


def tagged(rows: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """Rows for `fold`: each output is a list of structs, whose elements become rows (output, its struct, null for the other outputs' structs)."""
    lists = rows.select(*(c.alias(name) for name, c in outputs.items()))

    def own(name: str) -> Column:
        return F.transform(name, lambda x: F.struct(F.lit(name).alias("output"), *((x if n == name else F.get(n, F.lit(-1))).alias(n) for n in outputs)))

    return lists.select(F.explode(F.concat(*map(own, outputs))).alias("r")).select("r.*")


def _commit(spark: SparkSession, out: str, number: int, folder: str | None) -> None:
    spark.createDataFrame([(number, folder)], _MANIFEST).coalesce(1).write.mode("append").json(f"{out}/manifests/batch={number}")


def manifests(spark: SparkSession, out: str) -> dict[int, str | None]:
    """The folders of the committed batches; null for a batch without rows."""
    if not _there(spark, f"{out}/manifests"):
        return {}
    rows = spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").json(f"{out}/manifests").collect()
    return {r.batch: r.folder for r in rows}


def fold(rows: DataFrame, out: str) -> None:
    """Drain a stream of tagged rows: every batch adds its rows that no earlier batch had, all outputs at once, then is committed."""
    spark = rows.sparkSession
    kept = {k: spark.conf.get(k, None) for k in _STATE}
    key = F.unhex(F.sha2(F.to_json(F.struct(*rows.columns)), 256))

    def each(batch: DataFrame, number: int) -> None:
        if number in manifests(spark, out):  # stopped after its manifest: the rows are there, only the state is to be made again
            batch.write.format("noop").mode("overwrite").save()
            return
        folder = f"{out}/data/batch={number}-{uuid.uuid4().hex}"
        batch.drop("_key").write.partitionBy("output").parquet(folder)
        _commit(spark, out, number, folder.rpartition("/")[2] if _there(spark, folder) else None)

    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        new = rows.withColumn("_key", key).dropDuplicates(["_key"])
        query = new.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_store(spark: SparkSession, out: str, output: str) -> DataFrame:
    """The rows of an output in all committed batches."""
    folders = [f"{out}/data/{f}" for f in manifests(spark, out).values() if f]
    if not folders:
        raise FileNotFoundError(f"{out} has no committed batch with rows")
    rows = spark.read.option("basePath", f"{out}/data").parquet(*folders)
    return rows.filter(F.col("output") == output).select(f"{output}.*")


def index_stream(spark: SparkSession, folder: str, out: str, resume: bool = False, default_corpus: str = "", files: int = BATCH_FILES, size: int = BATCH_BYTES) -> DataFrame:
    """Fold all entry files of a folder that are not folded yet into the outputs entries, names and files of `out`; returns the entries.

    Files that an earlier run has admitted are not admitted again. An existing store without `resume` is an error, and so is one whose checkpoint is lost.
    """
    if _there(spark, f"{out}/manifests"):
        if not resume:
            raise FileExistsError(f"{out} is a store already")
        if not _there(spark, f"{out}/checkpoint"):
            raise FileNotFoundError(f"{out}/checkpoint is lost; batches would be numbered anew, without the state of the store")
    admit(spark, folder, out, files=files, size=size)
    log = spark.readStream.schema(_ADMITTED).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(f"{out}/admitted")
    read = log.repartition(files).mapInArrow(_read_lines, f"{_ADMITTED}, value string")
    entries = parse_lines(read, default_corpus, keep=("path", "bytes"))
    here, entry = F.col("path").isNotNull(), [c for c in entries.columns if c not in ("path", "bytes")]

    def only(there: Column, item: Column) -> Column:
        return F.filter(F.array(F.when(there, item)), lambda x: x.isNotNull())

    outputs = {"files": only(here, F.struct("path", "bytes")), "entries": only(~here, F.struct(*entry)), "names": F.when(here, F.array()).otherwise(name_pairs())}
    fold(tagged(entries, outputs), out)
    return read_store(spark, out, "entries")
