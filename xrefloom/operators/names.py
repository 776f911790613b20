"""The name index: names of nodes, labels, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.marked import marked_name
from ..functions.tickets import is_named_edge, is_ticket, signature_of, strip_descriptor, ticket
from ..schema import CODE_FACT

#: Characters of a substring index's keys; shorter needles are looked up without it.
GRAM = 3
#: So many names are looked up by their values instead of by a join.
FEW = 1000


def names_of(entries: DataFrame) -> DataFrame:
    """Distinct (name, ticket): targets of name edges, with and without a method descriptor, and rendered code facts.

    Entries without a name (empty target signature, malformed fact) give none.
    """
    own = ticket(F.col("source")).alias("ticket")
    edges = entries.filter(is_named_edge(F.col("edge_kind")) & (F.col("target.signature") != ""))
    sig = F.col("target.signature")
    from_edges = edges.select(F.explode(F.array_distinct(F.array_compact(F.array(sig, strip_descriptor(sig))))).alias("name"), own)
    facts = entries.filter(~is_named_edge(F.col("edge_kind")) & (F.col("fact_name") == CODE_FACT) & F.col("fact_value").isNotNull())
    from_code = facts.select(marked_name("fact_value").alias("name"), own).filter("name is not null")
    return from_edges.unionByName(from_code).distinct()


def name_pairs() -> Column:
    """What `names_of` finds in one entry, as a list of structs (name, ticket), for streams, which take each entry once."""
    sig, named, null = F.col("target.signature"), is_named_edge(F.col("edge_kind")), F.lit(None)
    edge = F.when(named & (sig != ""), F.array(sig, strip_descriptor(sig)))
    code = F.when(~named & (F.col("fact_name") == CODE_FACT), F.col("fact_value")).otherwise(null)
    every = F.array_distinct(F.array_compact(F.coalesce(edge, F.array(marked_name(code)))))
    own = ticket(F.col("source"))
    return F.transform(every, lambda name: F.struct(name.alias("name"), own.alias("ticket")))


def labels_of(names: DataFrame) -> DataFrame:
    """The shortest name of each ticket, in bytes; of equally short ones the smallest."""
    return names.groupBy("ticket").agg(F.min(F.struct(F.octet_length("name").alias("n"), F.col("name"))).alias("m")).select("ticket", F.col("m.name").alias("label"))


def label_or_signature(label: Column, ticket_: Column) -> Column:
    return F.coalesce(label, signature_of(ticket_))


def exact(names: DataFrame, name: str) -> DataFrame:
    return names.filter(F.col("name") == name).select("name", "ticket")


def _pieces(chars: Column, n: int) -> Column:
    """The distinct stretches of n characters of a list of characters."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))
    return F.when(F.size(chars) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def grams_of(names: DataFrame) -> DataFrame:
    """The substring index: every distinct name under each distinct stretch of GRAM characters that it has (gram, name)."""
    return names.select("name").distinct().select(F.explode(_pieces(F.split("name", ""), GRAM)).alias("gram"), "name")


def gram_counts(grams: DataFrame) -> DataFrame:
    """How many names each gram has (gram, n)."""
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def containing(names: DataFrame, needle: str, limit: int, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The first rows, by name and ticket, whose name contains the needle; at least one.

    With an index (grams and their counts) only the names under the needle's rarest gram are looked at. A needle that is
    shorter than a gram scans the names.
    """
    limit = max(limit, 1)
    hits = names.filter(F.contains("name", F.lit(needle)))
    if index is not None and len(needle) >= GRAM:
        own = {needle[k : k + GRAM] for k in range(len(needle) - GRAM + 1)}
        counts = {r["gram"]: r["n"] for r in index[1].filter(F.col("gram").isin(*own)).collect()}  # as many as the needle has
        if len(counts) < len(own):
            return names.select("name", "ticket").limit(0)
        rarest = min(counts, key=lambda g: (counts[g], g))
        # the first rows are rows of the first names
        found = index[0].filter((F.col("gram") == rarest) & F.contains("name", F.lit(needle))).select("name").orderBy("name").limit(limit)
        hits = names.filter(F.col("name").isin(*(r["name"] for r in found.collect()))) if limit <= FEW else names.join(found, "name", "left_semi")
    return hits.orderBy("name", "ticket").limit(limit).select("name", "ticket")


def containing_any(names: DataFrame, needles: DataFrame, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All (needle, name, ticket) for a table of needles, by equi-joins only.

    A needle meets the names under its rarest gram and is then verified; shorter ones meet the stretches of one or two
    characters that names have, which needs no check. An empty needle is in every name, a null one in none. Without an index
    the names' grams are made for this one query.
    """
    asked = needles.select("needle").filter("needle is not null").distinct()
    grams = index[0] if index is not None else grams_of(names)
    counts = index[1] if index is not None else gram_counts(grams)
    chars = F.split("needle", "")
    of = asked.filter(F.length("needle") >= GRAM).select("needle", F.explode(_pieces(chars, GRAM)).alias("gram")).join(counts, "gram", "left")
    rarest = of.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r")).filter("r.n > 0").select("needle", F.col("r.gram").alias("gram"))
    hits = grams.join(rarest, "gram").filter(F.contains(F.col("name"), F.col("needle"))).select("needle", "name")
    letters = F.split("name", "")
    short = names.select("name").distinct().select("name", F.explode(F.concat(_pieces(letters, 1), _pieces(letters, 2))).alias("needle"))
    short = short.join(asked.filter(F.length("needle").between(1, GRAM - 1)), "needle").select("needle", "name")
    out = hits.unionByName(short).join(names.select("name", "ticket"), "name").select("needle", "name", "ticket")
    if not asked.filter("needle = ''").isEmpty():
        out = out.unionByName(names.select(F.lit("").alias("needle"), "name", "ticket"))
    return out


def resolve(
    names: DataFrame, name: str, substr: bool = False, limit: int = 50, cap: int = 0, definitions: DataFrame | None = None, def_in: str = "", index: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Tickets for a name: the name itself if it is a ticket, else by exact match or (limited) substring.

    def_in keeps tickets whose first definition's path contains it; cap > 0 limits the tickets, by ticket.
    """
    if is_ticket(name):
        return names.sparkSession.createDataFrame([(name,)], "ticket string")
    found = (containing(names, name, limit, index) if substr else exact(names, name)).select("ticket").distinct()
    if def_in:
        found = found.join(definitions.filter(F.contains("path", F.lit(def_in))), "ticket", "left_semi")
    return found.orderBy("ticket").limit(cap) if cap > 0 else found


def same_name(names: DataFrame) -> DataFrame:
    """Tickets that share a name's text with others: name, ticket, and how many tickets the name has.

    Membership instead of pairs: a name that thousands of symbols have costs one row for each of them. `bridge` has those
    that are one thing in several languages.
    """
    many = names.groupBy("name").agg(F.count("*").alias("tickets")).filter("tickets > 1")
    return names.join(many, "name").select("name", "ticket", "tickets")


def bridge(entries: DataFrame) -> DataFrame:
    """Symbols of different languages that are the same, since their name edges lead to one node: name_ticket, ticket, language, tickets, languages.

    The node's corpus counts, so equal names in two corpora do not meet; class files without a corpus get one when entries are
    read (default_corpus), on both ends of the edge. The named node itself belongs to its class where entries have it as
    a node of their own. A class has one row for each of its symbols, and at least two languages among them.
    """
    edges = entries.filter(is_named_edge(F.col("edge_kind")) & F.col("target").isNotNull())
    named = edges.select(ticket(F.col("target")).alias("name_ticket"), ticket(F.col("source")).alias("ticket"), F.col("source.language").alias("language"))
    targets = edges.select("target").distinct()
    own = entries.select("source").distinct().join(targets, F.col("source") == F.col("target"), "left_semi")
    itself = own.select(ticket(F.col("source")).alias("name_ticket"), ticket(F.col("source")).alias("ticket"), F.col("source.language").alias("language"))
    members = named.unionByName(itself).distinct()
    classes = members.groupBy("name_ticket").agg(F.count("*").alias("tickets"), F.count_distinct("language").alias("languages")).filter("languages > 1")
    return members.join(classes, "name_ticket").select("name_ticket", "ticket", "language", "tickets", "languages")
