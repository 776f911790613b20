"""Command line: python -m xrefloom VERB ... ; `build` and `name-index` write tables, the other verbs print JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import names as N
from .operators import serving as S
from .operators import units as U
from .operators.graph import LIMIT, CodeGraph, lines_of
from .sources import archive
from .sources.entries import as_json, read_entries, write_names
from .streaming.fold import BATCH_BYTES, BATCH_FILES, index_stream

PLACES = {"def": "definitions", "ref": "references", "callers": "callers", "super": "supertypes", "sub": "subtypes"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="xrefloom", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for x in positional:
            v.add_argument(x)
        return v

    verb("build", "entries", "out").add_argument("--default-corpus", default="")
    verb("name-index", "entries", "out").add_argument("--default-corpus", default="")
    stream = verb("index-stream", "entries", "out")
    stream.add_argument("--default-corpus", default="")
    stream.add_argument("--resume", action="store_true")
    stream.add_argument("--batch-files", type=int, default=BATCH_FILES)
    stream.add_argument("--batch-bytes", type=int, default=BATCH_BYTES)
    verb("normalise", "archives", "out").add_argument("--parts", type=int, default=1)
    verb("extract", "archives", "sha", "out")
    plan = verb("plan", "archives")
    plan.add_argument("--langs", default=",".join(U.DEFAULT_LANGS))
    plan.add_argument("--done", default="")
    for name, dest in (("--in", "within"), ("--not-in", "without"), ("--rule", "rule")):
        plan.add_argument(name, action="append", default=[], dest=dest)
    for name in PLACES:
        v = verb(name, "tables", "name")
        v.add_argument("--in", dest="within", default="")
        v.add_argument("--not-in", dest="without", default="")
        v.add_argument("--def-in", default="")
        v.add_argument("--substr", action="store_true")
        v.add_argument("--limit", type=int, default=LIMIT)
        v.add_argument("--json", action="store_true")
    walk = verb("callgraph", "tables", "name")
    walk.add_argument("--direction", choices=("up", "down", "both"), default="down")
    walk.add_argument("--depth", type=int, default=3)
    walk.add_argument("--max-syms", type=int, default=200)
    walk.add_argument("--in", dest="within", default="")
    walk.add_argument("--not-in", dest="without", default="")
    for name in ("identifier", "names"):
        v = verb(name, "tables", "name")
        v.add_argument("--substr", action="store_true")
        v.add_argument("--limit", type=int, default=LIMIT)
    verb("edges", "tables", "target").add_argument("--kind", action="append")
    verb("nodes", "tables", "target")
    verb("decor", "tables", "file").add_argument("--corpus", default="")
    ls = verb("ls", "tables")
    ls.add_argument("folder", nargs="?", default="")
    ls.add_argument("--corpus")
    verb("stat", "tables")
    return p


def run(spark: SparkSession, args: list[str]) -> list[str]:
    """The lines that a command prints."""
    a = parser().parse_args(args)
    if a.verb == "index-stream":
        return [f"{index_stream(spark, a.entries, a.out, a.resume, a.default_corpus, a.batch_files, a.batch_bytes).count()} entries"]
    if a.verb == "normalise":
        return ["{} units, {} files required".format(*archive.normalise(spark, a.archives, a.out, a.parts))]
    if a.verb == "extract":
        return [f"{archive.extract(archive.read_units(spark, a.archives), archive.read_files(spark, a.archives), a.sha, a.out)} files found"]
    if a.verb == "plan":
        done = spark.read.schema("sha string").text(a.done) if a.done else None
        planned = U.plan(archive.read_units(spark, a.archives).filter("status = 'ok'"), done, a.langs.split(","), a.within, a.without, U.parse_rules(a.rule))
        return [r["value"] for r in as_json(planned.select("sha", "label", "primary_path", "argument", "skipped").orderBy("sha")).collect()]
    if a.verb in ("build", "name-index"):
        entries = read_entries(spark, a.entries, a.default_corpus)
        if a.verb == "build":
            S.build(entries, a.out)
        else:
            write_names(N.names_of(entries), a.out)
        return [f"{a.out} is written"]
    g = CodeGraph.load(spark, a.tables)
    if a.verb in PLACES:
        rows = getattr(g, PLACES[a.verb])(a.name, a.within, a.without, a.limit, substr=a.substr, def_in=a.def_in)
        if not a.json and "line" in rows.columns:
            return [r["value"] for r in lines_of(rows).collect()]
    elif a.verb == "callgraph":
        rows = g.callgraph(a.name, a.direction, a.depth, a.max_syms, within=a.within, without=a.without).orderBy("id")
    elif a.verb == "identifier":
        rows = g.identifier(a.name, a.substr, a.limit)
    elif a.verb == "names":
        rows = g.names(a.name, a.limit)
    elif a.verb == "edges":
        rows = g.edges(a.target, a.kind)
    elif a.verb == "nodes":
        rows = g.nodes(a.target)
    elif a.verb == "decor":
        rows = g.decorations(a.file, a.corpus)
    else:
        rows = g.ls(a.folder, a.corpus) if a.verb == "ls" else g.stat()
    return [r["value"] for r in as_json(rows).collect()]


if __name__ == "__main__":
    import sys

    print("\n".join(run(SparkSession.builder.appName("xrefloom").getOrCreate(), sys.argv[1:])))
