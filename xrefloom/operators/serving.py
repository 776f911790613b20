"""Serving tables from entries: edges, facts, files, anchors with lines, cross-references and call edges."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tickets import squeeze, ticket
from ..schema import FACTS, Facts

OPEN_END = (1 << 63) - 1
#: Lines are cut into blocks of this many bytes (as a power of two), so that a place meets the lines of its own block only.
LINE_BLOCK = 12
#: A span is kept under the first of these powers of two that its length does not exceed, in at most two blocks.
SPAN_BLOCKS = (10, 14, 20, 30, 63)
SERVING = ("names", "labels", "xrefs", "edges", "facts", "anchors", "files", "call_edges")
#: The columns that queries look a table up by.
LOOKUP = {
    "edges": ("source_ticket",), "facts": ("ticket",), "files": ("file_ticket",), "anchors": ("file_ticket",), "call_edges": ("caller_ticket",), "xrefs": ("target_ticket",), "names": ("name",), "labels": ("ticket",),
    "grams": ("gram", "name"), "gram_counts": ("gram",), "tree": ("corpus", "folder"), "first_definitions": ("ticket",),
}
#: Tables of whole steps of the call graph, kept in buckets of the symbol that a step starts from.
STEPS = {"calls_down": "down", "calls_up": "up"}
#: Rows of a bucket, about, and the most buckets of a table; beyond that buckets grow.
BUCKET_ROWS, MOST_BUCKETS = 1 << 20, 10_000


class Tables(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, make: dict[str, Callable]):
        self._make, self._made = make, {}

    def __getitem__(self, name: str):
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._make)

    def __len__(self) -> int:
        return len(self._make)

    def __contains__(self, name) -> bool:
        return name in self._make


def dedup(entries: DataFrame) -> DataFrame:
    """Distinct entries; two that differ in their values only are both kept."""
    return entries.dropDuplicates()


def conflicts(entries: DataFrame) -> DataFrame:
    """Facts with more than one value: ticket, fact_name, values."""
    return facts(entries).groupBy("ticket", "fact_name").agg(F.count_distinct("fact_value").alias("values")).filter("values > 1")


def facts(entries: DataFrame) -> DataFrame:
    return entries.filter("edge_kind = ''").select(ticket(F.col("source")).alias("ticket"), "fact_name", "fact_value")


def edges(entries: DataFrame) -> DataFrame:
    """Every edge forward and, with its kind marked by %, reversed. An ordinal after the kind's last dot is a column of its own."""
    ordinal = F.regexp_extract("edge_kind", r"^(.*)\.(\d{1,9})$", 2)
    kind = F.when(ordinal == "", F.col("edge_kind")).otherwise(F.regexp_extract("edge_kind", r"^(.*)\.(\d{1,9})$", 1))
    one = entries.filter("edge_kind <> '' and target is not null").select(ticket(F.col("source")).alias("source_ticket"), kind.alias("kind"), F.nullif(ordinal, F.lit("")).cast("int").alias("ordinal"), ticket(F.col("target")).alias("target_ticket"))
    one = one.distinct()
    back = one.select(F.col("target_ticket").alias("source_ticket"), F.concat(F.lit("%"), "kind").alias("kind"), "ordinal", F.col("source_ticket").alias("target_ticket"), F.lit(True).alias("reverse"))
    return one.withColumn("reverse", F.lit(False)).unionByName(back)


def files(entries: DataFrame, f: Facts = FACTS) -> DataFrame:
    """Files with their texts: file_ticket, corpus, path, text."""
    return entries.filter(F.col("fact_name") == f.text).groupBy(ticket(F.col("source")).alias("file_ticket"), F.col("source.corpus").alias("corpus"), F.col("source.path").alias("path")).agg(F.min("fact_value").cast("string").alias("text"))


def lines(files_: DataFrame) -> DataFrame:
    """Each file's lines (numbers from 1) with the byte range of each; a line's end is that of its line break."""
    cut = files_.select("file_ticket", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    by = Window.partitionBy("file_ticket").orderBy("n")
    end = F.sum(F.octet_length("line").cast("long") + 1).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("line_end", end).select("file_ticket", (F.col("n") + 1).cast("long").alias("line_number"), (F.col("line_end") - F.octet_length("line") - 1).alias("line_start"), "line_end", F.col("line").alias("line_text"))


def place(anchors_: DataFrame, files_: DataFrame) -> DataFrame:
    """Anchors with line (from 1), col (bytes, from 0) and snippet (the trimmed line); 0, 0 and '' where the file or place is unknown.

    An equi-join on file and block of bytes, with the line's range as the rest of the condition: an anchor meets the few
    lines of its block, however large its file is.
    """
    blocks = F.sequence(F.shiftright("line_start", LINE_BLOCK), F.shiftright(F.col("line_end") - 1, LINE_BLOCK))
    # a line is trimmed once, not once for each of its anchors
    ls = lines(files_).select(F.col("file_ticket").alias("_file"), "line_number", "line_start", "line_end", squeeze(F.col("line_text")).alias("_snippet")).withColumn("_block", F.explode(blocks))
    on = (F.col("file_ticket") == F.col("_file")) & (F.shiftright("start_byte", LINE_BLOCK) == F.col("_block")) & (F.col("start_byte") >= F.col("line_start")) & (F.col("start_byte") < F.col("line_end"))
    zero = F.lit(0).cast("long")
    return anchors_.join(ls, on, "left").select(*anchors_.columns, F.coalesce("line_number", zero).alias("line"), F.coalesce(F.col("start_byte") - F.col("line_start"), zero).alias("col"), F.coalesce("_snippet", F.lit("")).alias("snippet"))


def anchors(entries: DataFrame, f: Facts = FACTS, files_: DataFrame | None = None) -> DataFrame:
    """Anchors and what they point to: anchor_ticket, file_ticket, path, start_byte, end_byte, kind, target_ticket, line, col, snippet.

    The file is the anchor's parent, else the file node of its own corpus, root and path. files_: the table of files, where
    it is stored, so that texts are not gathered from the entries again.
    """
    own = entries.filter(F.col("fact_name").isin(f.start, f.end, f.node_kind)).groupBy("source").agg(*(F.min(F.when(F.col("fact_name") == n, F.col("fact_value").cast("string"))).alias(c) for n, c in ((f.start, "start"), (f.end, "end"), (f.node_kind, "node_kind"))))
    own = own.filter("node_kind = 'anchor'")
    kind = F.regexp_replace("edge_kind", r"\.\d{1,9}$", "")
    out = entries.filter("edge_kind <> '' and target is not null").select("source", kind.alias("kind"), ticket(F.col("target")).alias("target_ticket"), F.col("target.path").alias("target_path"))
    parents = out.filter(F.col("kind") == f.childof).groupBy("source").agg(F.min(F.struct("target_ticket", "target_path")).alias("parent"))
    itself = F.struct(F.lit("").alias("signature"), F.col("source.corpus"), F.col("source.root"), F.col("source.path"), F.lit("").alias("language"))
    found = own.join(out.filter(F.col("kind") != f.childof).drop("target_path").distinct(), "source").join(parents, "source", "left")
    rows = found.select(
        ticket(F.col("source")).alias("anchor_ticket"), F.coalesce("parent.target_ticket", ticket(itself)).alias("file_ticket"), F.coalesce("parent.target_path", "source.path").alias("path"),
        F.expr("try_cast(start as bigint)").alias("start_byte"), F.expr("try_cast(end as bigint)").alias("end_byte"), F.regexp_replace("kind", "^/kythe/edge/", "").alias("kind"), "target_ticket",
    )
    return place(rows, files(entries, f) if files_ is None else files_)


def role(kind: Column, f: Facts = FACTS) -> Column:
    """definition, extent (a defining anchor other than the name), call or reference, from the kind of an anchor's edge; null for others."""
    short = lambda k: k.rpartition("edge/")[2]
    return F.when(kind == short(f.definition), "definition").when(kind.isin([short(k) for k in f.defines]), "extent").when(F.contains(kind, F.lit(f.call)), "call").when((kind == short(f.refs)) | F.startswith(kind, F.lit(short(f.refs) + "/")), "reference")


def call_edges(anchors_: DataFrame, f: Facts = FACTS) -> DataFrame:
    """Distinct calls (caller_ticket, callee_ticket) with each side's order and `direct`: calls inside the byte range of a definition.

    Every definition that holds a call has it among its callees; `direct` marks the innermost one, which alone is the
    call's caller. An unknown end reaches to the end of the file, definitions without a file are left out. Callees are
    ranked by definition start, call start and ticket; callers by ticket.
    """
    spans = anchors_.filter(F.col("kind").isin([k.rpartition("edge/")[2] for k in f.defines])).filter("file_ticket is not null").select("file_ticket", F.col("target_ticket").alias("caller_ticket"), F.coalesce("start_byte", F.lit(0)).alias("ds"), F.coalesce("end_byte", F.lit(OPEN_END)).alias("de"))
    calls = anchors_.filter(F.contains("kind", F.lit(f.call))).filter("target_ticket <> ''").select("file_ticket", F.col("target_ticket").alias("callee_ticket"), F.coalesce("start_byte", F.lit(0)).alias("at"))
    no, yes = F.lit(False).alias("direct"), F.lit(True).alias("direct")
    both = span_calls(spans, calls).select("*", no).unionByName(innermost_calls(spans, calls).select("caller_ticket", "callee_ticket", "ds", "at", yes))
    first = both.groupBy("caller_ticket", "callee_ticket").agg(F.min(F.struct("ds", "at")).alias("first"), F.max("direct").alias("direct"))
    return first.select("caller_ticket", "callee_ticket", F.col("first.ds").alias("ds"), F.col("first.at").alias("at"), "direct")


def _size(length: Column) -> Column:
    """The number of the block size under which a span of this length is kept."""
    size = F.lit(len(SPAN_BLOCKS) - 1)
    for k, power in reversed(list(enumerate(SPAN_BLOCKS[:-1]))):
        size = F.when(length <= 1 << power, k).otherwise(size)
    return size


def _block(at: Column, size: Column) -> Column:
    out = F.lit(0).cast("long")  # the largest size has one block
    for n, power in enumerate(SPAN_BLOCKS[:-1]):
        out = F.when(size == n, F.shiftright(at, power)).otherwise(out)
    return out


def _span_cells(spans: DataFrame) -> DataFrame:
    """Spans with their size `_size`, once for each of the at most two blocks `_block` that they touch; an empty span touches none."""
    s = spans.filter("ds < de").withColumn("_size", _size(F.col("de") - F.col("ds")))
    return s.withColumn("_block", F.explode(F.array_distinct(F.array(_block(F.col("ds"), F.col("_size")), _block(F.col("de") - 1, F.col("_size"))))))


def _call_cells(calls: DataFrame) -> DataFrame:
    """Calls, once for each block size, with the block that holds them."""
    places = F.array(*(F.struct(F.lit(k).alias("size"), _block(F.col("at"), F.lit(k)).alias("block")) for k in range(len(SPAN_BLOCKS))))
    return calls.withColumn("_place", F.explode(places)).select(*calls.columns, F.col("_place.size").alias("_size"), F.col("_place.block").alias("_block"))


def span_calls(spans: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls (file_ticket, callee_ticket, at) inside half-open spans (file_ticket, caller_ticket, ds, de), distinct, with callee order.

    An equi-join on file and block, where a span's block size follows its length: a call looks in one block of each size
    and meets the spans that touch it, however many its file has. An empty span holds nothing.
    """
    met = _span_cells(spans).join(_call_cells(calls), ["file_ticket", "_size", "_block"]).filter("at >= ds and at < de")
    return met.filter("callee_ticket <> ''").groupBy("caller_ticket", "callee_ticket").agg(F.min(F.struct("ds", "at")).alias("first")).select("caller_ticket", "callee_ticket", F.col("first.ds").alias("ds"), F.col("first.at").alias("at"))


def _sweep(batches):
    """Of each cell's spans and calls by place: every call with the innermost span around it, by a stack of the spans that have begun.

    A span that has ended goes once it is on top, so the top is the latest start among those that go on.
    """
    cell, stack = None, []
    names = ["file_ticket", "callee_ticket", "at", "caller_ticket", "ds", "de"]
    for b in batches:
        out = []
        for file, size, block, at, end, ticket_ in zip(*(b.column(c).to_pylist() for c in ("file_ticket", "_size", "_block", "pos", "end", "ticket")), strict=True):
            if cell != (file, size, block):
                cell, stack = (file, size, block), []
            if end is not None:
                stack.append((ticket_, at, end))
                continue
            while stack and stack[-1][2] <= at:
                stack.pop()
            if stack:
                out.append((file, ticket_, at, *stack[-1]))
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("ticket") else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def innermost_calls(spans: DataFrame, calls: DataFrame) -> DataFrame:
    """Each call (file_ticket, callee_ticket, at) that a span holds, once, with its innermost span (caller_ticket, ds, de).

    Innermost is the latest start, then the earliest end, then the smallest ticket. Spans and calls meet in cells of a file,
    a block size and a block; a sweep over each cell with a stack finds one candidate a cell, so nesting multiplies nothing;
    of a call's candidates (one for each block size) the innermost stays. A task holds the stack of one cell. A call that no
    span of its cell reaches, as in most block sizes, is dropped before the sweep.
    """
    begun = _span_cells(spans).select("file_ticket", "_size", "_block", F.col("ds").alias("pos"), F.col("de").alias("end"), F.col("caller_ticket").alias("ticket"))
    asked = _call_cells(calls).select("file_ticket", "_size", "_block", F.col("at").alias("pos"), F.lit(None).cast("long").alias("end"), F.col("callee_ticket").alias("ticket"))
    cell = ["file_ticket", "_size", "_block"]
    # at one place spans come before calls, and the longest of them and largest ticket first
    order = ["pos", F.col("end").desc_nulls_last(), F.col("ticket").desc()]
    reach = F.max("end").over(Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    events = begun.unionByName(asked).repartition(*cell).withColumn("_reach", reach).filter("end is not null or _reach > pos").drop("_reach").sortWithinPartitions(*cell, *order)
    found = events.mapInArrow(_sweep, "file_ticket string, callee_ticket string, at long, caller_ticket string, ds long, de long")
    best = found.groupBy("file_ticket", "callee_ticket", "at").agg(F.min(F.struct((-F.col("ds")).alias("n"), "de", "caller_ticket", "ds")).alias("b"))
    return best.select("file_ticket", "callee_ticket", "at", "b.caller_ticket", "b.ds", "b.de")


def _xrefs(anchors_: DataFrame, calls: DataFrame, f: Facts) -> DataFrame:
    """Cross-references, some of them more than once where two anchors have one ticket."""
    place_ = ["file_ticket", "path", "start_byte", "line", "col", "snippet"]
    own = anchors_.withColumn("role", role(F.col("kind"), f)).filter("role is not null").select("target_ticket", "role", F.col("anchor_ticket").alias("item_ticket"), *place_)
    at = own.filter("role = 'definition'").select(F.col("target_ticket").alias("caller_ticket"), *place_)
    callers = calls.filter("direct").select("caller_ticket", "callee_ticket").join(at, "caller_ticket").select(F.col("callee_ticket").alias("target_ticket"), F.lit("caller").alias("role"), F.col("caller_ticket").alias("item_ticket"), *place_)
    return own.unionByName(callers)


def xrefs(anchors_: DataFrame, calls: DataFrame, f: Facts = FACTS) -> DataFrame:
    """Cross-references in long form: target_ticket, role, item_ticket, and the place (path, line, col, snippet, file_ticket, start_byte).

    Roles: definition, reference, call (the call's place), caller (the definition of the innermost function that calls).
    """
    return _xrefs(anchors_, calls, f).distinct()


def first_definitions(xrefs_: DataFrame) -> DataFrame:
    """ticket and path of the first definition that has a path."""
    d = xrefs_.filter("role = 'definition' and coalesce(path, '') <> ''")
    return d.groupBy(F.col("target_ticket").alias("ticket")).agg(F.min(F.struct("file_ticket", "start_byte", "path")).alias("m")).select("ticket", F.col("m.path").alias("path"))


def tree(files_: DataFrame) -> DataFrame:
    """The folders of files: corpus, folder (without a slash at its end; the top one is empty), entry (whole path) and is_file, once for each folder and entry."""
    parts = F.split("path", "/")
    upto = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    n = F.size(parts)
    steps = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.when(k == 1, F.lit("")).otherwise(upto(k - 1)).alias("folder"), upto(k).alias("entry"), (k == n).alias("is_file")))
    return files_.select("corpus", F.explode(steps).alias("s")).select("corpus", "s.folder", "s.entry", "s.is_file").distinct()


def put(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write one serving table, which must not be there yet: range-partitioned and sorted by the columns that queries look up, so that row-group statistics prune reads."""
    return _write(_ranged(df, name), folder, name)


def _ranged(df: DataFrame, name: str) -> DataFrame:
    """Rows range-partitioned for a serving table. Equal rows meet, so they can be made distinct without a further exchange."""
    return df.repartitionByRange(*LOOKUP[name])


def _write(ranged: DataFrame, folder: str, name: str) -> DataFrame:
    ranged.sortWithinPartitions(*LOOKUP[name]).write.mode("errorifexists").parquet(f"{folder}/{name}")
    return ranged.sparkSession.read.schema(ranged.schema).parquet(f"{folder}/{name}")


def _distinct_facts(entries: DataFrame) -> DataFrame:
    """The facts of distinct entries, range-partitioned for their table."""
    keyed = entries.filter("edge_kind = ''").withColumn("ticket", ticket(F.col("source")))
    return _ranged(keyed, "facts").dropDuplicates().select("ticket", "fact_name", "fact_value")


def _distinct_xrefs(anchors_: DataFrame, calls: DataFrame, f: Facts) -> DataFrame:
    """`xrefs`, range-partitioned for their table."""
    return _ranged(_xrefs(anchors_, calls, f), "xrefs").distinct()


def _table_name(folder: str, name: str) -> str:
    return f"{name}_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"


def put_steps(calls: DataFrame, folder: str) -> None:
    """Write the steps of the call graph in both directions, each bucketed and sorted by the symbol that it starts from, so that a level of a walk reads the buckets of its own symbols only."""
    from .walk import neighbours

    buckets = max(1, min(MOST_BUCKETS, -(-calls.count() // BUCKET_ROWS)))
    calls.sparkSession.range(1).select(F.lit(buckets).alias("n")).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/buckets")
    for name, direction in STEPS.items():
        steps = neighbours(calls, direction)
        # one task a bucket, so that each bucket is one file
        steps.repartition(buckets, "at").write.mode("errorifexists").bucketBy(buckets, "at").sortBy("at").option("path", f"{folder}/{name}").saveAsTable(_table_name(folder, name))


def steps_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The written steps; a session that did not write them declares their buckets anew."""
    out = {}
    for name, direction in STEPS.items():
        own = _table_name(folder, name)
        if not spark.catalog.tableExists(own):
            plain = spark.read.parquet(f"{folder}/{name}")
            buckets = spark.read.parquet(f"{folder}/buckets").first()["n"]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
            spark.sql(f"CREATE TABLE {own} ({columns}) USING parquet CLUSTERED BY (`at`) SORTED BY (`at`) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'")
        out[direction] = spark.table(own)
    return out


def together(spark: SparkSession, *jobs: Callable[[], object]) -> None:
    """Run jobs that need nothing of each other at once, so that one's last tasks leave no cores idle; an error is raised when all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


def build(entries: DataFrame, folder: str, f: Facts = FACTS) -> None:
    """Write all serving tables as Parquet below a folder, and those made from them: the substring index, folders, first definitions and the call graph's steps. A table that is there already is an error.

    Entries may repeat. Only facts need them made distinct first; all other tables are distinct by themselves.
    """
    from .names import gram_counts, grams_of, labels_of, names_of

    spark = entries.sparkSession

    def placed() -> None:
        texts = put(files(entries, f), folder, "files")
        a = put(anchors(entries, f, texts), folder, "anchors")
        calls = put(call_edges(a, f), folder, "call_edges")
        together(
            spark,
            lambda: put(first_definitions(_write(_distinct_xrefs(a, calls, f), folder, "xrefs")), folder, "first_definitions"),
            lambda: put_steps(calls, folder),
            lambda: put(tree(texts.select("corpus", "path")), folder, "tree"),
        )

    def named() -> None:
        found = put(names_of(entries), folder, "names")
        together(spark, lambda: put(labels_of(found), folder, "labels"), lambda: put(gram_counts(put(grams_of(found), folder, "grams")), folder, "gram_counts"))

    together(spark, placed, named, lambda: put(edges(entries), folder, "edges"), lambda: _write(_distinct_facts(entries), folder, "facts"))
