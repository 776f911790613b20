"""The driver's tables as a code graph: parts are symbols, orders are files, lineitems are references, and so on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tickets import ticket
from ..schema import CODE_FACT, FACTS, NAMED, VNAME

CORPUS = "testdata"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vname(language: str, path: Column, signature: Column) -> Column:
    return F.struct(signature.alias("signature"), F.lit(CORPUS).alias("corpus"), F.lit("").alias("root"), path.alias("path"), F.lit(language).alias("language"))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _key(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + "#"), F.col(key).cast("string"))


def part_vname() -> Column:
    return vname("c++", F.concat_ws("/", F.lit("catalog"), "p_brand", "p_type"), _key("part", "p_partkey"))


def region_vname() -> Column:
    return vname("region", F.concat_ws("/", F.lit("geo"), "r_name"), _key("region", "r_regionkey"))


def nation_vname() -> Column:
    return vname("nation", F.concat_ws("/", F.lit("geo"), "r_name", "n_name"), _key("nation", "n_nationkey"))


def member_vname(kind: str, key: str) -> Column:
    return vname(kind, F.concat_ws("/", F.lit("geo"), "r_name", "n_name", F.lit(kind)), _key(kind, key))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named nodes: source (name struct) and name. A part's name has a method descriptor, so it is indexed with and without."""
    geo = _geo(spark, sf_dir)
    members = [table(spark, sf_dir, t).join(geo, F.col(f"{t[0]}_nationkey") == F.col("n_nationkey")).select(member_vname(t, f"{k}key").alias("source"), F.col(f"{t[0]}_name").alias("name")) for t, k in (("customer", "c_cust"), ("supplier", "s_supp"))]
    own = [table(spark, sf_dir, "region").select(region_vname().alias("source"), F.col("r_name").alias("name")), geo.select(nation_vname().alias("source"), F.col("n_name").alias("name")), table(spark, sf_dir, "part").select(part_vname().alias("source"), F.concat("p_name", F.lit("(I)V")).alias("name"))]
    return reduce(DataFrame.unionByName, [*own, *members])


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and inheritance edges as entries; every part's name comes twice, as from two units."""
    none = F.lit(None).cast("binary").alias("fact_value")
    n = nodes(spark, sf_dir)
    named = n.select("source", F.struct(F.col("name").alias("signature"), F.lit(CORPUS).alias("corpus"), F.lit("").alias("root"), F.lit("").alias("path"), F.lit("jvm").alias("language")).alias("target"), F.lit(NAMED).alias("edge_kind"), F.lit("/").alias("fact_name"), none)
    geo = _geo(spark, sf_dir)

    def edge(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(f"/kythe/edge/{kind}").alias("edge_kind"), F.lit("/").alias("fact_name"), none)

    up = [edge(table(spark, sf_dir, t).join(geo, F.col(f"{t[0]}_nationkey") == F.col("n_nationkey")), member_vname(t, f"{k}key"), nation_vname(), kind) for t, k, kind in (("customer", "c_cust", "extends"), ("supplier", "s_supp", "extends/public"))]
    return reduce(DataFrame.unionByName, [named, named.filter("source.language = 'c++'"), *up, edge(geo, nation_vname(), region_vname(), "satisfies")])


def _anchor_rows(df: DataFrame, sig: Column, at: Column, size: int, kind: Column) -> DataFrame:
    """Anchors of parts in order files, from rows with an order's path and a part's columns."""
    file = ticket(F.struct(F.lit("").alias("signature"), F.lit(CORPUS).alias("corpus"), F.lit("").alias("root"), F.col("path"), F.lit("").alias("language")))
    zero, none = F.lit(0).cast("long"), F.lit("")
    return df.select(ticket(vname("order", F.col("path"), sig)).alias("anchor_ticket"), file.alias("file_ticket"), "path", at.alias("start_byte"), (at + size).alias("end_byte"), kind.alias("kind"), F.col("part_ticket").alias("target_ticket"), zero.alias("line"), zero.alias("col"), none.alias("snippet"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", F.lit("orders"), "o_orderpriority", F.col("o_orderkey").cast("string")).alias("path"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' keys and tickets; a ticket is made once a part, not once a reference."""
    return table(spark, sf_dir, "part").select("p_partkey", ticket(part_vname()).alias("part_ticket"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference anchors of parts in order files: one for each distinct order, line, part and return flag."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").distinct()
    o = items.join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).join(_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "R", "ref/call").when(F.col("l_returnflag") == "A", "ref").otherwise("ref/call/implicit")
    return _anchor_rows(o, F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag"), F.col("l_linenumber").cast("long") * 100, 50, kind)


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition anchors of parts: each stands in the first order line that names the part. Keys find that line; paths and tickets are made for it alone."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    known = lines.join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    first = known.groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m")).select("l_partkey", "m.*")
    found = first.join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).join(_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    one = found.groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "path")).alias("m"), F.first("part_ticket").alias("part_ticket")).select("l_partkey", "part_ticket", "m.*")  # keys may repeat in orders and parts
    return _anchor_rows(one, F.concat(F.lit("def:"), F.col("l_partkey").cast("string")), F.col("l_linenumber").cast("long") * 100 + 60, 30, F.lit("defines/binding"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).unionByName(definitions(spark, sf_dir))


def supplier_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers call the parts that they deliver, in the order of the first order that has them."""
    s = table(spark, sf_dir, "supplier").join(_geo(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", ticket(member_vname("supplier", "s_suppkey")).alias("caller_ticket"))
    p = table(spark, sf_dir, "part").select("p_partkey", ticket(part_vname()).alias("callee_ticket"))
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("at"))
    return pairs.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("caller_ticket", "callee_ticket", F.lit(0).cast("long").alias("ds"), F.col("at").cast("long").alias("at"))


def event_node(user: str, kind: str) -> Column:
    return ticket(vname("events", F.concat(F.lit("users/"), F.col(user).cast("string")), F.concat(F.lit("u"), F.col(user).cast("string"), F.lit("::"), F.col(kind))))


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event type calls the type of the user's next event: a graph with cycles."""
    nxt = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.lead("event_type").over(nxt).alias("next_type")).filter("next_type is not null")
    pairs = e.groupBy("user_id", "event_type", "next_type").agg(F.min("event_id").alias("at"))
    return pairs.select(event_node("user_id", "event_type").alias("caller_ticket"), event_node("user_id", "next_type").alias("callee_ticket"), F.lit(0).cast("long").alias("ds"), F.col("at").cast("long").alias("at"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))
    file = ticket(vname("", F.col("path"), F.lit("")))
    return table(spark, sf_dir, "documents").filter("text is not null").withColumn("path", path).select("doc_id", file.alias("file_ticket"), F.lit(CORPUS).alias("corpus"), "path", "text")


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A conversation is a file, a turn a definition over its bytes, and each turn calls the next from its own first byte."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("n"))
    c = c.withColumn("de", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("ds", F.col("de") - F.col("n")).withColumn("next", F.lead("turn").over(by))
    name = lambda t: F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col(t).cast("string"))
    spans = c.select(F.col("conv_id").alias("file_ticket"), name("turn").alias("caller_ticket"), "ds", "de")
    return spans, c.filter("next is not null").select(F.col("conv_id").alias("file_ticket"), name("next").alias("callee_ticket"), F.col("ds").alias("at"))


def nested_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of turns inside turns: every second turn is a definition that goes on over as many turns as the lowest set bit of its number in the conversation; every turn calls the next from its own first byte."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    n = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_ticket"), "turn", n.alias("n"), F.row_number().over(by).alias("i"), F.lead("turn").over(by).alias("next"), F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("de"), F.count("*").over(Window.partitionBy("conv_id")).alias("turns"))
    ends = c.select("file_ticket", F.col("i").cast("long").alias("last"), F.col("de").alias("end_byte"))
    name = lambda t: F.concat_ws(":", F.lit("turn"), "file_ticket", F.col(t).cast("string"))
    last = F.least(F.col("turns"), (F.col("i") + F.col("i").bitwiseAND(-F.col("i")) - 1).cast("long"))
    defs = c.filter("i % 2 = 0").withColumn("last", last).join(ends, ["file_ticket", "last"]).select("file_ticket", F.lit("defines/binding").alias("kind"), name("turn").alias("target_ticket"), (F.col("de") - F.col("n")).alias("start_byte"), "end_byte")
    calls = c.filter("next is not null").select("file_ticket", F.lit("ref/call").alias("kind"), name("next").alias("target_ticket"), (F.col("de") - F.col("n")).alias("start_byte"), (F.col("de") - F.col("n") + 1).alias("end_byte"))
    return defs.unionByName(calls)


def length_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name edges of documents as symbols: the language is the document's, the corpus its source, the name its length."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("language"), F.coalesce("source", F.lit("")).alias("corpus"), F.coalesce(F.col("n_chars").cast("string"), F.lit("")).alias("name"))
    blank = F.lit("")
    own = F.struct(F.lit("doc").alias("signature"), "corpus", blank.alias("root"), F.col("doc_id").cast("string").alias("path"), "language")
    name = F.struct(F.col("name").alias("signature"), "corpus", blank.alias("root"), blank.alias("path"), F.lit("jvm").alias("language"))
    return d.filter("name <> ''").select(own.alias("source"), name.alias("target"), F.lit(NAMED).alias("edge_kind"), F.lit("/").alias("fact_name"), F.lit(None).cast("binary").alias("fact_value"))


def _message(*parts: Column) -> Column:
    """A marked-source message: children with the given texts (short ones), joined by two colons."""

    def field(tag: str, data: Column) -> Column:
        return F.concat(F.unhex(F.lit(tag)), F.unhex(F.lpad(F.hex(F.octet_length(data)), 2, "0")), data)

    return F.concat(*(field("1A", field("12", p.cast("binary"))) for p in parts), field("22", F.lit("::").cast("binary")))


def turn_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as code, in entries: a file with its text for each, and each turn a symbol with a definition over its bytes, a name in a code fact, and a call of the next turn from its own first byte."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    text = F.coalesce("text", F.lit(""))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), (F.octet_length(text) + 1).cast("long").alias("n"), F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"))
    c = c.withColumn("de", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("ds", F.col("de") - F.col("n")).withColumn("next", F.lead("turn").over(by))
    none, name = F.lit(None).cast("binary"), lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))

    def fact(df: DataFrame, source: Column, facts: dict[str, Column]) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("binary").alias("v")) for k, v in facts.items()))
        return df.select(source.alias("source"), F.explode(pairs).alias("f")).select("source", F.lit(None).cast(VNAME).alias("target"), F.lit("").alias("edge_kind"), F.col("f.k").alias("fact_name"), F.col("f.v").alias("fact_value"))

    def edge(df: DataFrame, source: Column, kind: str, target: Column) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(f"/kythe/edge/{kind}").alias("edge_kind"), F.lit("/").alias("fact_name"), none.alias("fact_value"))

    def text_of(n: str) -> Column:
        return F.col(n).cast("string")

    path = F.col("path")
    whole = c.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    symbol, nxt = vname("turn", path, name("t", text_of("turn"))), vname("turn", path, name("t", text_of("next")))
    place, call = vname("turn", path, name("@", text_of("ds"), ":", text_of("de"))), vname("turn", path, name("call@", text_of("ds")))
    calls = c.filter("next is not null")
    span = lambda a, b: {FACTS.node_kind: F.lit("anchor"), FACTS.start: a.cast("string"), FACTS.end: b.cast("string")}
    parts = [
        fact(whole, vname("", path, F.lit("")), {FACTS.node_kind: F.lit("file"), FACTS.text: F.col("text")}),
        fact(c, place, span(F.col("ds"), F.col("de"))), fact(calls, call, span(F.col("ds"), F.col("ds") + 1)),
        fact(c, symbol, {CODE_FACT: _message(name("c", text_of("conv_id")), name("t", text_of("turn")))}),
        edge(c, place, "defines/binding", symbol), edge(calls, call, "ref/call", nxt),
    ]
    return reduce(DataFrame.unionByName, parts)
