"""CodeGraph: the query verbs over serving tables, each a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tickets import path_of, ticket
from ..schema import INHERITANCE, SCHEME
from . import names as N
from . import serving as S
from .units import keeps
from .walk import callgraph

LIMIT = 50


class CodeGraph:
    """Queries over the tables names, labels, xrefs, edges, facts, anchors, files and call_edges.

    The session stays warm between queries. Filters (`within`, `without`: substrings of paths), `substr`, `def_in` and limits
    mean the same in every verb; limits are by ticket and role, and at least one row is given.
    """

    def __init__(self, tables: Mapping[str, DataFrame], derived: Mapping | None = None, stored: bool = False, by_role: Callable[[tuple[str, ...]], DataFrame] | None = None):
        """tables: the serving tables; derived: what is made from them (tree, first_definitions, grams, gram_counts, steps), where it is stored; by_role: cross-references of some roles, where they are stored apart.

        Both mappings are asked for what a verb needs, and only then.
        """
        self.t, self.derived, self.stored, self.by_role = tables, derived or {}, stored, by_role

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> CodeGraph:
        read = lambda n: spark.read.parquet(f"{folder}/{n}")
        tables = S.Tables({n: partial(read, n) for n in S.SERVING})
        derived = {n: partial(read, n) for n in ("tree", "first_definitions", "grams", "gram_counts")}
        return cls(tables, S.Tables(derived | {"steps": partial(S.steps_of, spark, folder)}), True)

    @cached_property
    def tree(self) -> DataFrame:
        return self.derived["tree"] if "tree" in self.derived else S.tree(self.t["files"])

    @cached_property
    def first(self) -> DataFrame:
        return self.derived["first_definitions"] if "first_definitions" in self.derived else S.first_definitions(self.xrefs("definition"))

    @cached_property
    def index(self) -> tuple[DataFrame, DataFrame] | None:
        return (self.derived["grams"], self.derived["gram_counts"]) if "grams" in self.derived else None

    @cached_property
    def steps(self) -> dict[str, DataFrame] | None:
        return self.derived["steps"] if "steps" in self.derived else None

    def xrefs(self, *roles: str) -> DataFrame:
        rows = self.t["xrefs"] if self.by_role is None else self.by_role(roles)
        return rows.filter(F.col("role").isin(*roles))

    @classmethod
    def from_entries(cls, entries: DataFrame) -> CodeGraph:
        a = S.anchors(entries)
        calls = S.call_edges(a)
        names = N.names_of(entries)
        return cls({"names": names, "labels": N.labels_of(names), "xrefs": S.xrefs(a, calls), "edges": S.edges(entries), "facts": S.facts(entries), "anchors": a, "files": S.files(entries), "call_edges": calls})

    def resolve(self, name: str, substr: bool = False, limit: int = LIMIT, cap: int = 0, def_in: str = "") -> DataFrame:
        return N.resolve(self.t["names"], name, substr, limit, cap, self.first if def_in else None, def_in, self.index if substr else None)

    def labelled(self, df: DataFrame, column: str = "ticket") -> DataFrame:
        labels = self.t["labels"].withColumnRenamed("ticket", column)
        return df.join(labels, column, "left").withColumn("label", N.label_or_signature(F.col("label"), F.col(column)))

    def _items(self, roles: tuple[str, ...], name: str, within: str, without: str, limit: int, section: bool = False, **by) -> DataFrame:
        return self._placed(roles, self.resolve(name, limit=limit, **by), within, without, limit, section)

    def _placed(self, roles: tuple[str, ...], found: DataFrame, within: str, without: str, limit: int, section: bool) -> DataFrame:
        rows = self.xrefs(*roles).join(found.withColumnRenamed("ticket", "target_ticket"), "target_ticket")
        path = F.coalesce(F.nullif("path", F.lit("")), path_of(F.col("item_ticket")))
        rows = rows.withColumn("path", path).filter(keeps(F.col("path"), within, without))
        parts = ["target_ticket", "role"] if section else ["target_ticket"]
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy("path", "start_byte", "item_ticket", "role"))
        rows = rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= max(limit, 1))
        return self.labelled(rows.withColumnRenamed("target_ticket", "ticket")).select("ticket", "label", "role", "item_ticket", "path", "line", "col", "snippet", "rank")

    def definitions(self, name: str, within: str = "", without: str = "", limit: int = LIMIT, **by) -> DataFrame:
        return self._items(("definition",), name, within, without, limit, **by)

    def references(self, name: str, within: str = "", without: str = "", limit: int = LIMIT, **by) -> DataFrame:
        return self._items(("reference", "call"), name, within, without, limit, **by)

    def callers(self, name: str, within: str = "", without: str = "", limit: int = LIMIT, **by) -> DataFrame:
        """Calling functions (role caller) and the calls' own places (role call), each with a limit of its own."""
        return self._items(("caller", "call"), name, within, without, limit, section=True, **by)

    def cross_references(self, name: str, references: str = "all", definitions: str = "binding", callers: str = "none", within: str = "", without: str = "", limit: int = LIMIT, **by) -> DataFrame:
        """Chosen kinds of cross-references, each with a limit of its own.

        references: all, call, noncall or none; definitions: all (extents too), binding or none; callers: direct, overrides
        (also those of the methods that the named ones override or that override them) or none.
        """
        refs = {"all": ("reference", "call"), "call": ("call",), "noncall": ("reference",), "none": ()}
        defs = {"all": ("definition", "extent"), "binding": ("definition",), "none": ()}
        if references not in refs or definitions not in defs or callers not in ("direct", "overrides", "none"):
            raise ValueError("unknown kind of cross-references")
        out = self._items((*refs[references], *defs[definitions], *(("caller",) if callers != "none" else ())), name, within, without, limit, section=True, **by)
        if callers == "overrides":
            own = self.resolve(name, limit=limit, **by).withColumnRenamed("ticket", "source_ticket")
            kin = self.t["edges"].filter(F.col("kind").isin("/kythe/edge/overrides", "%/kythe/edge/overrides")).join(own, "source_ticket").select(F.col("target_ticket").alias("ticket")).distinct()
            out = out.unionByName(self._placed(("caller",), kin.join(own.withColumnRenamed("source_ticket", "ticket"), "ticket", "left_anti"), within, without, limit, True))
        return out

    def _inheritance(self, name: str, sub: bool, within: str, without: str, limit: int, **by) -> DataFrame:
        kinds = [("%" if sub else "") + k for k in INHERITANCE]
        found = self.resolve(name, limit=limit, **by).withColumnRenamed("ticket", "source_ticket")
        rows = self.t["edges"].filter(F.col("kind").isin(kinds)).join(found, "source_ticket").groupBy("source_ticket", "target_ticket").agg(F.min(F.struct("kind", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"))).alias("o"))
        rows = rows.withColumn("path", path_of(F.col("target_ticket"))).filter(keeps(F.col("path"), within, without))
        rows = rows.orderBy("source_ticket", "o", "target_ticket").limit(max(limit, 1))
        return self.labelled(rows.select(F.col("source_ticket").alias("ticket"), F.col("o.kind").alias("kind"), "target_ticket", "path"), "target_ticket").select("ticket", "kind", "target_ticket", "label", "path")

    def supertypes(self, name: str, within: str = "", without: str = "", limit: int = LIMIT, **by) -> DataFrame:
        return self._inheritance(name, False, within, without, limit, **by)

    def subtypes(self, name: str, within: str = "", without: str = "", limit: int = LIMIT, **by) -> DataFrame:
        return self._inheritance(name, True, within, without, limit, **by)

    def callgraph(self, name: str, direction: str = "down", depth: int = 3, max_syms: int = 200, root_limit: int = 16, within: str = "", without: str = "", **by) -> DataFrame:
        forest = callgraph(self.t["call_edges"], self.resolve(name, cap=root_limit, **by), direction, depth, max_syms, within, without, self.steps)
        return self.labelled(forest).select("id", "parent", "depth", F.col("label").alias("name"), "ticket", path_of(F.col("ticket")).alias("path"))

    def identifier(self, name: str, substr: bool = False, limit: int = LIMIT) -> DataFrame:
        return N.containing(self.t["names"], name, limit, self.index) if substr else N.exact(self.t["names"], name)

    def names(self, part: str, limit: int = LIMIT) -> DataFrame:
        return N.containing(self.t["names"], part, limit, self.index)

    def names_with(self, needles: DataFrame) -> DataFrame:
        """All (needle, name, ticket) for a table of needles."""
        return N.containing_any(self.t["names"], needles, self.index)

    def edges(self, target: str, kinds: list[str] | None = None) -> DataFrame:
        rows = self.t["edges"].filter(F.col("kind").isin(kinds) if kinds else ~F.col("reverse"))
        return rows.join(self.resolve(target).withColumnRenamed("ticket", "source_ticket"), "source_ticket").select("source_ticket", "kind", "ordinal", "target_ticket")

    def nodes(self, target: str) -> DataFrame:
        return self.t["facts"].join(self.resolve(target), "ticket").select("ticket", "fact_name", "fact_value")

    def decorations(self, file: str, corpus: str = "") -> DataFrame:
        """What a file's anchors point to: a missing start is 0."""
        from ..schema import VNAME_FIELDS

        own = F.lit(file)
        if not file.startswith(SCHEME):
            own = ticket(F.struct(*(F.lit({"corpus": corpus, "path": file}.get(f, "")).alias(f) for f in VNAME_FIELDS)))
        rows = self.t["anchors"].filter((F.col("file_ticket") == own) & (F.coalesce("target_ticket", F.lit("")) != ""))
        return rows.select("target_ticket", "kind", F.coalesce("start_byte", F.lit(0)).cast("long").alias("start_byte"))

    def ls(self, folder: str = "", corpus: str | None = None) -> DataFrame:
        """Corpora, if no corpus is given; else the next path segment of the corpus's files below the folder: entry, is_file."""
        if corpus is None:
            return self.tree.filter("folder = ''").select(F.col("corpus").alias("entry"), F.lit(False).alias("is_file")).distinct()
        return self.tree.filter((F.col("corpus") == corpus) & (F.col("folder") == folder.strip("/"))).select("entry", "is_file")

    def stat(self) -> DataFrame:
        """Rows, files and bytes of the tables' files: one row for each table; tables that are not stored have no files (0) and null bytes."""

        def row(name: str, df: DataFrame) -> DataFrame:
            counts = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
            if not self.stored:
                return counts.select("*", F.lit(0).cast("long").alias("files"), F.lit(None).cast("long").alias("bytes"))
            file = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
            return counts.crossJoin(file.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes")))  # one row each

        return reduce(DataFrame.unionByName, [row(n, df) for n, df in self.t.items()])


#: By what a verb's rows are listed, as far as they have it.
ORDER = ("id", "ticket", "source_ticket", "name", "role", "kind", "ordinal", "rank", "fact_name", "start_byte", "target_ticket", "entry", "table", "item_ticket", "path")


def listed(rows: DataFrame) -> DataFrame:
    """A verb's rows in their one order: by ticket, role or kind, and rank; rows that are equal in all of these are equal in what is left as well, or ordered by it."""
    by = [c for c in ORDER if c in rows.columns]
    return rows.orderBy(*by, *(c for c, kind in rows.dtypes if c not in by and not kind.startswith("map")))


def lines_of(rows: DataFrame) -> DataFrame:
    """Result rows as text: path:line:col, two blanks, snippet."""
    return rows.select(F.format_string("%s:%d:%d  %s", "path", "line", "col", "snippet").alias("value"))
