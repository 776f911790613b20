"""Entries to answers on a small graph with known results; archives, streaming and planning."""

import base64
import hashlib
import json
import posixpath
import random
import re
import shutil
import zipfile
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xrefloom import __main__ as cli
from xrefloom.functions import tickets as K
from xrefloom.functions.marked import qualified_name
from xrefloom.operators import names as N
from xrefloom.operators import serving as S
from xrefloom.operators import units as U
from xrefloom.operators.graph import CodeGraph, lines_of
from xrefloom.schema import UNIT
from xrefloom.sources import archive, wire
from xrefloom.sources.entries import parse_lines, read_names, write_names
from xrefloom.streaming.fold import index_stream, read_store

PATH = "src/a.cc"


def vname(signature="", path=PATH, language="c++"):
    return {"signature": signature, "corpus": "c", "root": "", "path": path, "language": language}


def fact(source, name, value):
    return {"source": source, "fact_name": f"/kythe/{name}", "fact_value": base64.b64encode(value.encode()).decode()}


def edge(source, kind, target):
    return {"source": source, "target": target, "edge_kind": f"/kythe/edge/{kind}", "fact_name": "/"}


def golden():
    """f, g, h with definitions of 100 bytes each, k without one, their calls, and a few classes."""
    out = [fact(vname(language=""), "node/kind", "file"), fact(vname(language=""), "text", ("x" * 9 + "\n") * 30)]

    def anchor(start, end, kind, target):
        a = vname(f"@{start}:{end}:{kind}")
        out.extend([fact(a, "node/kind", "anchor"), fact(a, "loc/start", str(start)), fact(a, "loc/end", str(end)), edge(a, kind, target)])

    for n, at in (("f", 0), ("g", 100), ("h", 200)):
        anchor(at, at + 100, "defines/binding", vname(n))
    for at, n in ((10, "g"), (20, "h"), (99, "g"), (100, "h"), (150, "f"), (250, "h")):
        anchor(at, at + 1, "ref/call", vname(n))
    anchor(30, 31, "ref", vname("k"))
    anchor(260, 261, "ref/call/implicit", vname("k"))
    out += [edge(vname(n), "named", vname(f"ns::{n}", "", "")) for n in (*"fghkDm", "B", "B2", "bm")]
    out += [edge(vname("D"), "extends", vname("B")), edge(vname("D"), "extends/public", vname("B2")), edge(vname("m"), "overrides", vname("bm")), edge(vname("p"), "named", vname("p()V", "", "jvm"))]
    return out


@pytest.fixture(scope="module")
def entries(spark):
    lines = [json.dumps(e) for e in golden()]
    return parse_lines(spark.createDataFrame([(x,) for x in [*lines, *lines[:9], "{broken", ""]], "value string"))


@pytest.fixture(scope="module")
def graph(spark, entries, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("serving"))
    S.build(S.dedup(entries), f"{folder}/t")
    with pytest.raises(Exception, match="(?i)exists"):
        S.build(entries, f"{folder}/t")
    return CodeGraph.load(spark, f"{folder}/t")


def walk(graph, name, **options):
    return [(r.id, r.parent, r.depth, r.name) for r in graph.callgraph(name, **options).orderBy("id").collect()]


def test_walk(graph):
    assert walk(graph, "ns::f", depth=1) == [(0, -1, 0, "ns::f"), (1, 0, 1, "ns::g"), (2, 0, 1, "ns::h")]
    assert [x[3] for x in walk(graph, "ns::g", depth=1)] == ["ns::g", "ns::h", "ns::f"]
    assert [x[3] for x in walk(graph, "ns::h", depth=1)] == ["ns::h", "ns::k"]
    assert walk(graph, "ns::f", depth=3) == [(0, -1, 0, "ns::f"), (1, 0, 1, "ns::g"), (2, 0, 1, "ns::h"), (3, 2, 2, "ns::k")]
    assert [x[3] for x in walk(graph, "ns::f", max_syms=2)] == ["ns::f", "ns::g"]
    assert [x[3] for x in walk(graph, "ns::f", max_syms=0)] == ["ns::f"]
    assert [x[3] for x in walk(graph, "ns::f", within="zzz")] == ["ns::f"]
    assert {x[3] for x in walk(graph, "ns::k", direction="up", depth=1)} == {"ns::k", "ns::h"}
    assert len(walk(graph, "ns::g", direction="both", depth=2)) == 4
    with pytest.raises(ValueError):
        graph.callgraph("ns::f", direction="sideways")


def test_verbs(graph):
    targets = lambda df: [r.label for r in df.collect()]
    assert targets(graph.supertypes("ns::D")) == ["ns::B", "ns::B2"]
    assert targets(graph.subtypes("ns::B")) == ["ns::D"] and targets(graph.supertypes("ns::m")) == ["ns::bm"]
    d = graph.definitions("ns::g").collect()
    assert [(r.path, r.line, r.col, r.snippet) for r in d] == [(PATH, 11, 0, "x" * 9)]
    assert lines_of(graph.definitions("ns::g")).first().value == f"{PATH}:11:0  xxxxxxxxx"
    assert graph.references("ns::g").count() == 2 and graph.references("ns::k").count() == 2
    assert graph.references("ns::g", limit=0).count() == 1 and graph.references("ns::g", without="src").count() == 0
    assert {r.role for r in graph.callers("ns::g").collect()} == {"caller", "call"}
    assert {r.name for r in graph.identifier("ns::B", substr=True).collect()} == {"ns::B", "ns::B2"}
    assert {r.name for r in graph.identifier("p").collect()} == {"p"} and graph.identifier("none").count() == 0
    ticket = graph.identifier("ns::f").first().ticket
    assert graph.definitions(ticket).count() == 1
    assert {r.kind for r in graph.edges("ns::D").collect()} == {"/kythe/edge/extends", "/kythe/edge/extends/public", "/kythe/edge/named"}
    file = graph.decorations(PATH, "c")
    assert file.count() == 11 and graph.decorations("elsewhere", "c").count() == 0
    assert [tuple(r) for r in graph.ls().collect()] == [("c", False)] and [tuple(r) for r in graph.ls("src", "c").collect()] == [(PATH, True)]
    assert graph.nodes(file.first().target_ticket).count() == 0
    stat = {r.table: r for r in graph.stat().collect()}
    assert stat["call_edges"].rows == 6 and all(r.files > 0 and r.bytes > 0 for r in stat.values())
    roles = lambda **by: sorted(r.role for r in graph.cross_references("ns::g", **by).collect())
    assert roles(definitions="none") == ["call"] * 2 and roles(references="noncall") == ["definition"] and roles(references="none", definitions="all", callers="direct") == ["caller", "definition"]
    assert roles(references="none", definitions="none", callers="overrides") == ["caller"]
    with pytest.raises(ValueError):
        graph.cross_references("ns::g", callers="some")
    assert graph.resolve("ns::g", def_in="a.cc").count() == 1 and graph.resolve("ns::k", def_in="a.cc").count() == 0


def test_built_equals_direct(graph, entries):
    own = CodeGraph.from_entries(entries)
    for name, df in graph.t.items():
        assert sorted(map(str, own.t[name].select(df.columns).distinct().collect())) == sorted(map(str, df.distinct().collect())), name


def test_span_calls_equal_all_pairs(spark):
    r = random.Random(3)
    spans = [(r.choice("fg"), f"s{k}", a := r.randrange(1 << r.choice([8, 16, 24, 34])), r.choice([a, a + r.randrange(1, 1 << r.choice([3, 10, 14, 20, 33])), S.OPEN_END])) for k in range(300)]
    calls = [(r.choice("fgh"), f"c{k}", r.choice([r.randrange(1 << 35), *(x for s in r.sample(spans, 3) for x in (s[2], s[3] - 1, min(s[3], S.OPEN_END)))])) for k in range(400)]
    got = S.span_calls(spark.createDataFrame(spans, "file_ticket string, caller_ticket string, ds long, de long"), spark.createDataFrame(calls, "file_ticket string, callee_ticket string, at long"))
    want = {(s[1], c[1], s[2], c[2]) for s in spans for c in calls if s[0] == c[0] and s[2] <= c[2] < s[3]}
    assert len(want) > 500 and {tuple(x) for x in got.collect()} == want


def test_place_in_long_lines(spark):
    text = "\n".join(["a" * 9000, "", "  b c\t", "x" * 4095, "y" * 4096, "é" * 3000, "end"])
    size = len(text.encode())
    marks = [("f", at) for at in (0, 4095, 4096, 8999, 9000, 9001, 9002, 9005, 13105, 17203, size - 1, size, size + 1)] + [("g", 3), ("f", None)]
    got = {(x.file_ticket, x.start_byte): (x.line, x.col) for x in S.place(spark.createDataFrame(marks, "file_ticket string, start_byte long"), spark.createDataFrame([("f", text)], "file_ticket string, text string")).collect()}
    for f, at in marks:
        known = f == "f" and at is not None and at <= size
        before = text.encode()[:at] if known else b""
        assert got[f, at] == ((before.count(b"\n") + 1, at - (before.rfind(b"\n") + 1)) if known else (0, 0))


def test_same_name(spark):
    names = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t1"), ("c", "t3"), ("a", "t4")], "name string, ticket string")
    assert sorted(map(tuple, N.same_name(names).collect())) == [("a", "t1", 3), ("a", "t2", 3), ("a", "t4", 3)]
    assert N.same_name(names.limit(0)).count() == 0


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.entries").write_text("\n".join(json.dumps(e) for e in golden()))
    run = lambda *args: cli.run(spark, [str(a) for a in args])
    assert run("build", tmp_path / "in", tmp_path / "t") == [f"{tmp_path / 't'} is written"]
    assert run("def", tmp_path / "t", "ns::g") == [f"{PATH}:11:0  xxxxxxxxx"] and len(run("ref", tmp_path / "t", "ns::g", "--json")) == 2
    assert [json.loads(x)["name"] for x in run("callgraph", tmp_path / "t", "ns::f", "--depth", 1)] == ["ns::f", "ns::g", "ns::h"]
    assert json.loads(run("super", tmp_path / "t", "ns::m")[0])["label"] == "ns::bm" and run("ls", tmp_path / "t") == ['{"entry":"c","is_file":false}']
    assert len(run("names", tmp_path / "t", "ns::", "--limit", 3)) == 3 and len(run("stat", tmp_path / "t")) == 8
    assert run("name-index", tmp_path / "in", tmp_path / "n") and read_names(spark, str(tmp_path / "n")).count() == 11
    with pytest.raises(SystemExit):
        run("def", tmp_path / "t")


def test_conflicts(spark):
    rows = [fact(vname("a"), "x", "1"), fact(vname("a"), "x", "2"), fact(vname("b"), "x", "1")]
    e = parse_lines(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
    assert [r["values"] for r in S.conflicts(e).collect()] == [2]


def escaped(text, keep=""):
    return quote(text, safe="-_.~" + keep)


def cleaned(path):
    return posixpath.normpath("/" + path.lstrip("/") if path.startswith("/") else path) if path else ""


def written(v):
    """A ticket, written out anew."""
    parts = [("lang", escaped(v["language"])), ("path", escaped(cleaned(v["path"]), "/")), ("root", escaped(v["root"], "/"))]
    return "kythe:" + ("//" + escaped(v["corpus"], "/") if v["corpus"] else "") + "".join(f"?{k}={x}" for k, x in parts if x) + (f"#{escaped(v['signature'])}" if v["signature"] else "")


def test_tickets(spark):
    r = random.Random(11)
    text = lambda signs, n: "".join(r.choice(signs) for _ in range(r.randrange(n)))
    signs, path_signs = "aZ09-_.~+ %#?=&:/é€", "ab/../. é#"
    rows = [{"signature": text(signs, 8), "corpus": text(signs, 6), "root": text(signs.replace("/", ""), 4), "path": text(path_signs, 12), "language": text(signs, 4)} for _ in range(400)]
    df = spark.createDataFrame(rows, "signature string, corpus string, root string, path string, language string")
    for x in df.select("*", K.ticket(F.struct(*rows[0])).alias("t"), K.clean_path(F.col("path")).alias("c")).collect():
        assert x.c == cleaned(x.path) and x.t == written(x.asDict())
    again = df.withColumn("t", K.ticket(F.struct(*rows[0]))).select("t", "path", "signature", K.path_of(F.col("t")).alias("p"), K.signature_of(F.col("t")).alias("s")).collect()
    assert all((x.p, x.s or "") == (cleaned(x.path) or x.t, x.signature) for x in again)


def test_descriptors_and_base64(spark):
    r = random.Random(12)
    kind = lambda: "[" * r.randrange(2) + r.choice([*"ZBCSIJFD", f"L{r.choice('xyz')}/K{r.randrange(9)};"])
    names = [".".join(r.choice(["lamp", "Coil", "m3"]) for _ in range(r.randrange(1, 4))) for _ in range(60)]
    pairs = [(n, f"{n}({''.join(kind() for _ in range(r.randrange(4)))}){r.choice(['V', kind()])}") for n in names]
    got = spark.createDataFrame(pairs, "n string, d string").select("n", K.strip_descriptor(F.col("d")).alias("cut"), K.strip_descriptor(F.col("n")).alias("none")).collect()
    assert all(x.cut == x.n and x.none is None for x in got)
    data = [r.randbytes(r.randrange(1, 20)) for _ in range(60)]
    coded = [(base64.b64encode(d).decode(),) for d in data]
    spaced = [(c[0][:3] + " " + c[0][3:],) for c in coded]
    got = spark.createDataFrame([*coded, *spaced, ("?",)], "s string").select(K.from_base64(F.col("s")).alias("b")).collect()
    assert [x.b and bytes(x.b) for x in got] == [*data, *data, None]


def message(pre="", children=(), joiner="", post="", final=False):
    out = b""
    for number, value in ((2, pre.encode()), *((3, c) for c in children), (4, joiner.encode()), (5, post.encode())):
        if value:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out + (bytes([10 << 3, 1]) if final else b"")


def test_marked_source():
    scope = message(children=[message("a"), message("b")], joiner="::", final=True)
    assert qualified_name(message(children=[message("int "), message(children=[scope, message("f")]), message("(", post=")")])) == "a::b::f"
    assert qualified_name(scope) == "a::b" and qualified_name(b"") is None and qualified_name(b"\xff") is None and qualified_name(None) is None


def made(k, language, inputs=(), sources=(), arguments=()):
    """A unit; an input's digest is the hash of its path."""
    needs = [{"v_name": vname("", p), "info": {"path": p, "digest": digest(p)}} for p in inputs]
    return {"v_name": vname(f"target {k}", f"build/{k}", language), "required_input": needs, "argument": list(arguments), "source_file": list(sources), "output_key": f"key {k}", "working_directory": "", "entry_context": ""}


def digest(path):
    return hashlib.sha256(path.encode()).hexdigest()


def encoded(*pairs):
    """A message of (field number, bytes), written out anew."""

    def number(n):
        return bytes([n]) if n < 128 else bytes([n % 128 + 128]) + number(n // 128)

    return b"".join(number(8 * k + 2) + number(len(data)) + data for k, data in pairs)


def encoded_unit(u):
    texts = lambda values: [(k, x.encode()) for k, x in enumerate(values, 1) if x]
    name = lambda v: encoded(*texts([v[f] for f in ("signature", "corpus", "root", "path", "language")]))
    needs = [(3, encoded((1, name(i["v_name"])), (2, encoded(*texts([i["info"]["path"], i["info"]["digest"]]))))) for i in u["required_input"]]
    lists = [(5, x.encode()) for x in u["argument"]] + [(6, x.encode()) for x in u["source_file"]]
    ends = [(7 + k, u[f].encode()) for k, f in enumerate(("output_key", "working_directory", "entry_context")) if u[f]]
    return encoded((1, encoded((1, name(u["v_name"])), *needs, *lists, *ends)))


def camel(value):
    if isinstance(value, dict):
        return {re.sub("_(.)", lambda m: m[1].upper(), k): camel(v) for k, v in value.items()}
    return [camel(v) for v in value] if isinstance(value, list) else value


VNAMES = st.fixed_dictionaries({f: st.text(max_size=200) for f in ("signature", "corpus", "root", "path", "language")})
INPUTS = st.fixed_dictionaries({"v_name": VNAMES, "info": st.fixed_dictionaries({"path": st.text(), "digest": st.text()})})
UNITS = st.fixed_dictionaries({"v_name": VNAMES, "required_input": st.lists(INPUTS, max_size=3), "argument": st.lists(st.text(), max_size=3), "source_file": st.lists(st.text(), max_size=3), "output_key": st.text(), "working_directory": st.text(), "entry_context": st.text()})


@settings(max_examples=60, deadline=None)
@given(UNITS)
def test_unit_codec(u):
    assert wire.to_proto(u) == encoded_unit(u) and wire.from_proto(encoded_unit(u)) == u
    assert wire.from_json(json.dumps({"unit": u}).encode()) == u == wire.from_json(json.dumps({"unit": camel(u)}).encode())
    with pytest.raises(ValueError):
        wire.from_proto(encoded_unit(u)[:-1] if u["entry_context"] else b"\x0a\x7f")


ONE = made(1, "Java", ["tools/mill.kt"], arguments=["--fast", "-fprofile-sample-use=p", "--deep"])
TWO = made(2, "C++", ["tools/mill.kt", "press/a.h", "press/gone.h"], ["press/main.cc"])


@pytest.fixture()
def zipped(tmp_path):
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        for d in archive.FOLDERS:
            z.writestr(d, b"")
        z.writestr("root/pbunits/one", encoded_unit(ONE))
        z.writestr("root/units/one", json.dumps({"unit": made(1, "twin")}))
        z.writestr("root/units/two", json.dumps({"unit": camel(TWO)}))
        z.writestr("root/units/broken", b"[1")
        z.writestr("root/units/below/deep", b"{}")
        for p in ("tools/mill.kt", "press/a.h", "nobody/asks"):
            z.writestr(f"root/files/{digest(p)}", p * 3)
    return str(tmp_path / "in.zip")


def test_archives(spark, zipped, tmp_path):
    units = archive.read_units(spark, zipped)
    assert {(r.sha, r.encoding, r.status) for r in units.collect()} == {("one", "proto", "ok"), ("two", "json", "ok"), ("broken", "json", "failed")}
    assert archive.normalise(spark, zipped, str(tmp_path / "out")) == (2, 3)
    again = archive.read_units(spark, str(tmp_path / "out"))
    assert {(r.sha, r.encoding) for r in again.collect()} == {("one", "proto"), ("two", "proto")}
    assert {r.digest: bytes(r.content) for r in archive.read_files(spark, str(tmp_path / "out")).collect()} == {digest(p): p.encode() * 3 for p in ("tools/mill.kt", "press/a.h")}
    assert archive.extract(units, archive.read_files(spark, zipped), "one", str(tmp_path / "single")) == 1
    changed = archive.with_arguments(units.filter("status = 'ok'"), U.strip_arguments(F.col("unit.argument")))
    assert {r.sha: (r.unit.argument, r.raw) for r in changed.collect()}["one"] == (["--fast", "--deep"], None)


def test_planning(spark, zipped):
    units = archive.read_units(spark, zipped).filter("status = 'ok'")
    done = spark.createDataFrame([("two",)], "sha string")
    got = {r.sha: r for r in U.plan(units, done, rules=U.parse_rules(["tools::--first", "tools::--fast"])).collect()}
    assert (got["one"].label, got["one"].primary_path, got["one"].argument, got["one"].skipped) == ("java", "tools/mill.kt", ["--first", "--fast", "--deep"], None)
    assert (got["two"].primary_path, got["two"].skipped) == ("press/main.cc", "done")
    assert {r.sha: r.skipped for r in U.plan(units, done, langs=("cxx",), include=["nowhere"]).collect()} == {"one": "language", "two": "path"}
    assert tuple(U.skip_counts(U.plan(units, done)).first()) == (0, 0, 1, 1)
    with pytest.raises(ValueError):
        U.parse_rules(["::x"])


def test_class_path_roots_and_failures(spark):
    paths = ["!CLASS_PATH_JAR!lib/K.class", "src/x.java", "!CLASS_PATH_JAR!gen/a/L.class", "!CLASS_PATH_JAR!lib/M.class"]
    units = spark.createDataFrame([(made(1, "jvm", paths),)], T.StructType([T.StructField("unit", UNIT)]))
    assert units.select(U.class_path_roots(F.col("unit")).alias("r")).first().r == ["!CLASS_PATH_JAR!lib", "!CLASS_PATH_JAR!gen"]
    rows = [("java", f"{k:02}", "failed", f"{k} " * 9) for k in range(12)] + [("go", "a", "ok", None), ("go", "b", "failed", "end")]
    got = U.failure_samples(spark.createDataFrame(rows, "label string, sha string, status string, error string"), most=3, tail=4).collect()
    assert sorted(map(tuple, got)) == [("go", "b", "end"), *(("java", f"{k:02}", f"{k} {k} ") for k in range(3))]


def test_default_corpus_on_both_ends(spark):
    bare = vname("x") | {"corpus": ""}
    e = parse_lines(spark.createDataFrame([(json.dumps(edge(bare, "named", bare)),), (json.dumps(edge(vname("y"), "named", bare)),)], "value string"), "late")
    assert sorted((r.source.corpus, r.target.corpus) for r in e.collect()) == [("c", "late"), ("late", "late")]


def test_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    lines = [json.dumps(e) for e in golden()]
    (folder / "a.entries").write_text("\n".join(lines[:40]))
    index_stream(spark, str(folder), out)
    with pytest.raises(FileExistsError):
        index_stream(spark, str(folder), out)
    (folder / "b.entries").write_text("\n".join([*lines, "{broken"]))
    found = index_stream(spark, str(folder), out, resume=True)
    assert found.count() == len(lines) == index_stream(spark, str(folder), out, resume=True).count()
    names = read_store(spark, out, "names")
    assert names.count() == names.distinct().count() == 11
    write_names(names, str(tmp_path / "names"))
    assert read_names(spark, str(tmp_path / "names")).count() == 11
    shutil.rmtree(f"{out}/checkpoint")
    with pytest.raises(FileNotFoundError):
        index_stream(spark, str(folder), out, resume=True)
