"""Conversation prefix trie: nodes for all shared beginnings of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns. It is keyed by a digest of that sequence, and a conversation's turns become
digests once, so texts cross one exchange and all later tables hold digests and numbers. A sequence's digest is a chain over
its turns within aligned blocks of BLOCK turns; what comes before a block enters as the digest of the sequence of the blocks
before, made in the same way from one digest a block. So no task holds more than a block of a conversation, and equal
sequences have equal digests whatever their conversations.

Each node has an edge to the digest of its sequence without the last turn. Leaf counts and savings reach all ancestors by
doubling: after round k a node holds the sums over its descendants at distances below 2**k and a pointer to its ancestor at
distance 2**k; a round adds each node's sums to the node it points at (a partial aggregation, so one parent of many is no hot
spot) and replaces the pointer by that node's own. The rounds are the logarithm of the deepest node's depth, which is all
that comes to the driver.

The members that end at a node are hashed in ascending order by runs: range-partitioned and sorted ids become texts of many
ids, and only those meet by node, so that a node at which a third of all conversations end is one long hash but no large
group.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_sql, saved

#: Turns that one task chains; a parameter of the digest, not a limit.
BLOCK = 1024
#: Characters of ids that are sent to a node's hash as one text.
RUN = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _turns(batches):
    """Of turns in order: each one's place among those of its conversation that this task has, its digest and its characters."""
    now, at = None, 0
    for b in batches:
        part = b.column("part").to_pylist()
        ids, places, digests, sizes = [], [], [], []
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            at = at + 1 if conv == now else 0
            now = conv
            r = role.encode()
            ids.append(conv)
            places.append(at)
            digests.append(_hash(len(r).to_bytes(8, "big"), r, text.encode()))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array(places, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], ["conv_id", "part", "place", "turn", "chars"])


def placed(conversations: DataFrame) -> DataFrame:
    """Every turn's conv_id, rank (from 0, by turn with null first, then role and text), digest `turn` and `chars`.

    Turns are dealt by ranges of conversation and turn, so a conversation of any length is cut between tasks; ranks
    go on from the tasks before. At most one conversation goes on from before in each task, so these offsets are as few
    as tasks and are broadcast.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("t"), text("role").alias("role"), text("text").alias("text")).filter("conv_id is not null")
    first = [F.col("conv_id"), F.col("t").asc_nulls_first(), F.left("role", F.lit(16)), F.left("text", F.lit(16))]
    dealt = rows.repartitionByRange(*first).sortWithinPartitions(*first, "role", "text").withColumn("part", F.spark_partition_id())
    own = saved(dealt.mapInArrow(_turns, "conv_id long, part int, place long, turn binary, chars long"))
    counts = own.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = counts.withColumn("before", before).filter("before is not null").select("conv_id", "part", "before")
    return own.join(F.broadcast(later), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("rank"), "turn", "chars")


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's rebuilt conversations: turns (conv_id, pos from 0, turn, chars), and all of their conv_ids with their numbers of turns."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", head_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    heads = turns.filter("conv_id % 100 = 0 and rank < 5")  # of each hundred, at most five turns and a hundred conversations
    taken = convs.select("conv_id", "h", "base").join(heads.withColumnRenamed("conv_id", "base"), "base").filter("rank < h")
    bases = convs.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    sizes = saved(convs.join(bases, "base", "left").select("conv_id", F.least("h", F.coalesce("there", F.lit(0))).alias("lent"), "h", (F.least("h", F.coalesce("there", F.lit(0))) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")))
    short = sizes.filter("lent < h").select("conv_id", (F.col("h") - F.col("lent")).alias("less"))
    rest = turns.filter(F.col("rank") >= head_turns(F.col("conv_id"))).join(short, "conv_id", "left").select("conv_id", (F.col("rank") - F.coalesce("less", F.lit(0))).alias("pos"), "turn", "chars")
    return taken.select("conv_id", F.col("rank").alias("pos"), "turn", "chars").unionByName(rest), sizes.select("conv_id", "turns")


def _chains(batches):
    """Of turns in order: the digest of each block up to the turn, and up to the one before."""
    now, digest = None, ROOT
    for b in batches:
        up_to, before = [], []
        for conv, block, turn in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "turn")), strict=True):
            if (conv, block) != now:
                now, digest = (conv, block), ROOT
            before.append(digest)
            digest = _hash(digest, turn)
            up_to.append(digest)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "pos", "block", "chars")), pa.array(up_to, pa.binary()), pa.array(before, pa.binary())], ["conv_id", "pos", "block", "chars", "digest", "before"])


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of turns (conv_id, pos, turn, chars): the digest of each one's sequence up to it, and the digest `before` of the sequence up to the turn before."""
    cut = turns.withColumn("block", F.floor(F.col("pos") / block))
    within = saved(cut.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(_chains, "conv_id long, pos long, block long, chars long, digest binary, before binary"))
    later = within.filter("block > 0")
    if later.isEmpty():
        return within.drop("block")
    # full blocks are the turns of a conversation of blocks
    full = within.filter(F.col("pos") % block == block - 1).select("conv_id", F.col("block").alias("pos"), F.col("digest").alias("turn"), "chars")
    up_to = prefixes(full, block).select("conv_id", (F.col("pos") + 1).alias("block"), F.col("digest").alias("so_far"))
    chain = lambda c: F.unhex(F.substring(F.sha2(F.concat("so_far", c), 256), 1, 32))
    first = F.col("pos") % block == 0
    # the sequence before a block's first turn is that of the block before, up to its end
    ended = within.filter(F.col("pos") % block == block - 1).select("conv_id", (F.col("block") + 1).alias("block"), F.col("digest").alias("last"))
    ends = ended.join(up_to.select("conv_id", F.col("block").alias("b"), F.col("so_far").alias("earlier")).withColumn("block", F.col("b") + 1).drop("b"), ["conv_id", "block"], "left")
    ends = ends.select("conv_id", "block", F.when(F.col("earlier").isNull(), F.col("last")).otherwise(F.unhex(F.substring(F.sha2(F.concat("earlier", "last"), 256), 1, 32))).alias("end"))
    rest = later.join(up_to, ["conv_id", "block"]).join(ends, ["conv_id", "block"])
    rest = rest.select("conv_id", "pos", "chars", chain("digest").alias("digest"), F.when(first, F.col("end")).otherwise(chain("before")).alias("before"))
    return within.filter("block = 0").drop("block").unionByName(rest.select("conv_id", "pos", "chars", "digest", "before"))


def _runs(batches):
    """Of (node, conv_id) in order: texts of consecutive ids of a node, each with its first id."""
    node, first, ids, size = None, None, [], 0
    done: list[tuple] = []
    for b in batches:
        for n, c in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if ids and (n != node or size > RUN):
                done.append((node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = n, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(done) > 500:
            yield _batch(done, ("node", "first", "ids"), (pa.binary(), pa.int64(), pa.string()))
            done = []
    if ids:
        done.append((node, first, ",".join(ids)))
    if done:
        yield _batch(done, ("node", "first", "ids"), (pa.binary(), pa.int64(), pa.string()))


def _sums(batches):
    """Of runs in order: the hash of each node's ids."""
    node, digest, done = None, None, []
    for b in batches:
        for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(done) > 5000:
            yield _batch(done, ("node", "sha"), (pa.binary(), pa.string()))
            done = []
    if node is not None:
        yield _batch([*done, (node, digest.hexdigest())], ("node", "sha"), (pa.binary(), pa.string()))


def _batch(rows: list[tuple], names: tuple, types: tuple):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def end_hashes(ends: DataFrame) -> DataFrame:
    """Of (node, conv_id): the SHA-256 of each node's decimal ids, ascending and comma-joined."""
    by = ["node", "conv_id"]
    runs = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_runs, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_sums, "node binary, sha string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Nodes (node, up, depth, leaves, saved) with leaves and saved summed over their subtrees, by pointer jumping; up of a root is null."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        # the nodes that still point somewhere are those of depth `reach` and more; what they point at is 2 * reach from their next target
        pointing = nodes.filter(F.col("depth") >= reach)
        more = pointing.groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        summed = nodes.join(more, "node", "left").select("node", "up", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        ups = nodes.filter(F.col("depth") >= reach).select(F.col("node").alias("up"), F.col("up").alias("next"))
        far = summed.filter(F.col("depth") >= 2 * reach).join(ups, "up", "left").select("node", F.col("next").alias("up"), "depth", "leaves", "saved")
        near = summed.filter(F.col("depth") < 2 * reach).withColumn("up", F.lit(None).cast("binary"))
        nodes = saved(far.unionByName(near))
        reach *= 2
    return nodes


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes of the conversations in convs (conv_id, turns: how many), whose turns are (conv_id, pos from 0, turn: a digest, chars).

    One row a node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Conversations without turns are members of the root. An empty table has no nodes.
    """
    rows = prefixes(turns, block)
    last = rows.join(convs.select("conv_id", (F.col("turns") - 1).alias("pos")), ["conv_id", "pos"])
    ends = last.select(F.col("digest").alias("node"), "conv_id").unionByName(convs.filter("turns = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    grown = rows.groupBy(F.col("digest").alias("node")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("before").alias("up"), (F.first("pos") + 1).alias("depth"), F.first("chars").alias("chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(F.lit(ROOT).alias("node"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"))
    nodes = saved(grown.unionByName(root))
    children = nodes.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    with_children = saved(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = with_children.select("node", "up", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = rolled_up(own).select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    parents = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = with_children.join(parents, "up", "left").join(sums, "node").join(end_hashes(ends), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The contract's result over conversations (conv_id, turn, role, text): rebuilt first, then the trie.

    Rows without a conv_id belong to no conversation. Null roles and texts are empty. Rows of one turn are ordered by
    role and text (by the first 16 characters of both, then by both), so repeated rows are turns of their own.
    """
    turns, convs = rebuilt(placed(conversations))
    return trie(turns, convs, block)


def duckdb_sql() -> str:
    """The trie of the table conversations in DuckDB."""
    return f"""
WITH named AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 16), left(text, 16), role, text) - 1 AS r FROM named),
convs AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM own GROUP BY conv_id),
whole AS (
  SELECT c.conv_id, 0 AS part, r, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND r < h
  UNION ALL SELECT conv_id, 1, r, role, text FROM own JOIN convs USING (conv_id) WHERE r >= h),
steps AS (SELECT conv_id, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), ',') OVER w AS seq, length(text) AS chars FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY part, r)),
pre AS (SELECT conv_id, d, seq, coalesce(lag(seq) OVER (PARTITION BY conv_id ORDER BY d), '') AS up, chars FROM steps UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM convs),
sizes AS (SELECT conv_id, max(d) AS n FROM pre GROUP BY conv_id),
grown AS (SELECT seq, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '') AS ends FROM pre JOIN sizes USING (conv_id) GROUP BY seq, d),
kids AS (SELECT up AS seq, count(*) AS n FROM grown WHERE d > 0 GROUP BY up),
nodes AS (SELECT grown.*, coalesce(n, 0) AS n_children FROM grown LEFT JOIN kids USING (seq)),
above AS (SELECT DISTINCT a.seq AS top, b.seq FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT top AS seq, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM above JOIN nodes USING (seq) GROUP BY top)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN sums USING (seq) LEFT JOIN nodes p ON x.d > 0 AND p.seq = x.up"""
