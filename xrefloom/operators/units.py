"""Planning over compilation units: language routing, path filters, argument rules, resume, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.archive import primary_path

#: Unit languages and the labels they are routed to.
ROUTES = {"c++": "cxx", "java": "java", "jvm": "jvm", "go": "go", "protobuf": "proto", "proto": "proto", "textproto": "textproto"}
DEFAULT_LANGS = ("cxx", "java", "jvm", "go", "proto", "textproto")
#: Arguments that are dropped from every unit, by prefix, and the mark of class-path roots.
DROPPED_ARGUMENT = "-fprofile-sample-use"
CLASS_PATH = "!CLASS_PATH_JAR!"


def route(language: Column) -> Column:
    """The label of a language, whatever its case; null if units of it are skipped."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in ROUTES.items() for x in kv)), F.lower(language))


def accepts(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any of include (all paths, if it is empty) and none of exclude, as substrings; empty strings never match."""
    path = F.coalesce(path, F.lit(""))

    def any_of(parts: list[str]) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | (F.contains(path, F.lit(p)) if p else F.lit(False))
        return out

    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def keeps(path: Column, within: str = "", without: str = "") -> Column:
    """The filter of the query verbs: one substring to have and one to lack; an empty one asks nothing."""
    out = F.lit(True)
    if within:
        out = out & F.contains(path, F.lit(within))
    if without:
        out = out & ~F.contains(path, F.lit(without))
    return out


def parse_rules(rules: list[str]) -> list[tuple[str, str]]:
    """Rules `prefix::argument`, cut at the first ::; both must be there."""
    out = []
    for rule in rules:
        prefix, cut, argument = rule.partition("::")
        if not (cut and prefix and argument):
            raise ValueError(f"a rule is prefix::argument, not {rule!r}")
        out.append((prefix, argument))
    return out


def strip_arguments(argument: Column) -> Column:
    return F.filter(argument, lambda a: ~F.startswith(a, F.lit(DROPPED_ARGUMENT)))


def inject_arguments(argument: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Put the arguments of the rules whose prefix starts the path before the others, in the rules' order, unless there already."""
    out = argument
    for prefix, new in reversed(rules):
        out = F.when(F.startswith(F.coalesce(path, F.lit("")), F.lit(prefix)) & ~F.array_contains(out, new), F.array_prepend(out, F.lit(new))).otherwise(out)
    return out


def class_path_roots(unit: Column) -> Column:
    """Distinct class-path roots of a unit's inputs, in order of first sight."""
    paths = F.filter(unit["required_input"]["info"]["path"], lambda p: F.startswith(p, F.lit(CLASS_PATH)))
    return F.array_distinct(F.transform(paths, lambda p: F.regexp_extract(p, f"^({CLASS_PATH}[^/]*)", 1)))


def plan(units: DataFrame, done: DataFrame | None = None, langs: tuple[str, ...] = DEFAULT_LANGS, include: list[str] = (), exclude: list[str] = (), rules: list[tuple[str, str]] = ()) -> DataFrame:
    """Every unit with its label, primary path, transformed arguments and the reason why it is skipped, if it is: language, path or done, in this order."""
    path = primary_path(F.col("unit"))
    out = units.withColumn("label", route(F.col("unit.v_name.language"))).withColumn("primary_path", path)
    out = out.withColumn("argument", inject_arguments(strip_arguments(F.col("unit.argument")), F.col("primary_path"), list(rules)))
    seen = F.lit(False)
    if done is not None:
        out = out.join(done.select("sha").distinct().withColumn("_done", F.lit(True)), "sha", "left")
        seen = F.coalesce("_done", F.lit(False))
    wanted = F.coalesce(F.col("label").isin([x.strip() for x in langs]), F.lit(False))
    reason = F.when(~wanted, "language").when(~accepts(F.col("primary_path"), list(include), list(exclude)), "path").when(seen, "done")
    return out.withColumn("skipped", reason).drop("_done")


def skip_counts(planned: DataFrame) -> DataFrame:
    return planned.agg(*(F.count_if(F.coalesce(F.col("skipped") == r, F.lit(False))).alias(f"skipped_{r}") for r in ("language", "path", "done")), F.count_if(F.col("skipped").isNull()).alias("planned"))


def language_counts(outcomes: DataFrame) -> DataFrame:
    """Counters by label, with a grand total (label null): units, ok, empty, failed, bytes. Input: label, status, bytes."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("ok", "empty", "failed")}
    return outcomes.rollup("label").agg(F.count("*").alias("units"), *n.values(), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def failure_samples(outcomes: DataFrame, most: int = 8, tail: int = 4096) -> DataFrame:
    """At most `most` failures of each label, by sha, with the ends of their messages."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("label").orderBy("sha"))
    return outcomes.filter("status = 'failed'").withColumn("n", n).filter(F.col("n") <= most).select("label", "sha", F.expr(f"right(error, {tail})").alias("error"))
