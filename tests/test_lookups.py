"""Substring index, innermost callers, names across languages, folders and bucketed steps, each against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from xrefloom.operators import names as N
from xrefloom.operators import serving as S
from xrefloom.operators import walk as W
from xrefloom.operators.graph import CodeGraph
from xrefloom.schema import ENTRY, FACTS


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_innermost_equals_brute_force(spark):
    r = random.Random(5)
    spans, calls = [], []
    for file in "fg":
        for k in range(40):
            a, e = r.randrange(1 << 20), 0
            e = a + r.randrange(64, 1 << r.choice([8, 12, 16, 21, 31]))
            for depth in range(5):  # five inside each other, ends and starts shared at times
                spans.append((file, f"s{k}.{depth}", a, r.choice([e, e, S.OPEN_END]) if depth == 0 else e))
                calls += [(file, f"c{k}.{depth}", at) for at in (a, e - 1, e)]
                a, e = a + r.randrange(0, 6), e - r.randrange(0, 6)
    spans += [("f", "empty", 7, 7), ("h", "alone", 0, 9)]
    calls += [("i", "nowhere", 3), ("h", "in", 8), ("h", "out", 9)]
    got = S.innermost_calls(spark.createDataFrame(spans, "file_ticket string, caller_ticket string, ds long, de long"), spark.createDataFrame(calls, "file_ticket string, callee_ticket string, at long"))
    want = set()
    for file, callee, at in calls:
        around = [(-ds, de, t) for f, t, ds, de in spans if f == file and ds <= at < de]
        if around:
            start, end, t = min(around)
            want.add((file, callee, at, t, -start, end))
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == sorted(want)


def test_one_direct_caller(spark):
    a = [("f", "defines/binding", f"d{k}", k, 100 - k) for k in range(5)] + [("f", "ref/call", "g", 50, 51)]
    calls = S.call_edges(spark.createDataFrame(a, "file_ticket string, kind string, target_ticket string, start_byte long, end_byte long"))
    assert sorted((r.caller_ticket, r.direct) for r in calls.collect()) == [(f"d{k}", k == 4) for k in range(5)]
    assert [r.next for r in W.neighbours(calls, "up").collect()] == ["d4"] and W.neighbours(calls, "down").count() == 5


@pytest.mark.parametrize("stored", [True, False])
def test_substrings_equal_brute_force(spark, stored):
    r = random.Random(6)
    text = lambda n: "".join(r.choice("ab:é😀%_") for _ in range(n))
    rows = sorted({(text(r.randrange(9)), f"t{k % 90}") for k in range(300)})
    names = spark.createDataFrame(rows, "name string, ticket string")
    grams = N.grams_of(names).cache()
    index = (grams, N.gram_counts(grams).cache()) if stored else None
    needles = [*(text(n) for n in (1, 2, 2, 3, 3, 3, 4)), *(x[0][1:6] for x in rows[-9:]), "", "zzzz", None]
    got = N.containing_any(names, spark.createDataFrame([(n,) for n in needles], "needle string"), index)
    want = sorted({(n, name, t) for n in needles if n is not None for name, t in rows if n in name})
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == want
    if stored:
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
        for needle in needles[3:12]:
            for limit in (0, 3, 5000):
                assert list(map(tuple, N.containing(names, needle, limit, index).collect())) == [x for x in rows if needle in x[0]][: max(limit, 1)]


def test_bridge_keeps_corpora_apart(spark):
    v = lambda sig, corpus, language: (sig, corpus, "", "", language)
    named = "/kythe/edge/named"
    rows = [
        (v("k1", "a", "java"), v("ns.f", "a", "jvm"), named), (v("k2", "a", "kotlin"), v("ns.f", "a", "jvm"), named), (v("k3", "b", "kotlin"), v("ns.f", "b", "jvm"), named),
        (v("k4", "a", "java"), v("ns.g", "a", "jvm"), named), (v("k5", "a", "java"), v("ns.g", "a", "jvm"), named),
        (v("k6", "a", "java"), v("ns.h", "a", "jvm"), named), (v("ns.h", "a", "jvm"), None, ""), (v("k1", "a", "java"), v("ns.f", "a", "jvm"), named),
    ]
    name = "struct<signature:string,corpus:string,root:string,path:string,language:string>"
    got = N.bridge(spark.createDataFrame(rows, f"source {name}, target {name}, edge_kind string"))
    assert sorted((r.ticket.split("#")[1], r.language, r.tickets, r.languages) for r in got.collect()) == [("k1", "java", 2, 2), ("k2", "kotlin", 2, 2), ("k6", "java", 2, 2), ("ns.h", "jvm", 2, 2)]


def test_tree(spark):
    r = random.Random(7)
    paths = sorted({"/".join(r.choice("ab") for _ in range(r.randrange(1, 5))) + f"/{r.randrange(3)}" for _ in range(30)} | {"top"})
    got = {tuple(x) for x in S.tree(spark.createDataFrame([("c", p) for p in paths], "corpus string, path string")).collect()}
    want = {("c", p[: max(at, 0)].rstrip("/"), "/".join(p.split("/")[: k + 1]), k + 1 == len(p.split("/"))) for p in paths for k in range(len(p.split("/"))) for at in [len("/".join(p.split("/")[:k]))]}
    assert got == want


@pytest.mark.parametrize("direction", ["up", "down", "both"])
def test_stored_steps_give_the_same_walk(spark, tmp_path, monkeypatch, direction):
    monkeypatch.setattr(S, "BUCKET_ROWS", 40)
    r = random.Random(8)
    edges = sorted({(f"s{r.randrange(60)}", f"s{r.randrange(60)}") for _ in range(400)})
    calls = spark.createDataFrame([(a, b, r.randrange(9), r.randrange(9), r.random() < 0.7) for a, b in edges], "caller_ticket string, callee_ticket string, ds long, at long, direct boolean")
    S.put_steps(calls, str(tmp_path))
    roots = spark.createDataFrame([("s1",), ("s2",)], "ticket string")
    walk = lambda stored: sorted(map(tuple, W.callgraph(calls, roots, direction, 3, 40, stored=stored).collect()))
    stored = S.steps_of(spark, str(tmp_path))
    first = walk(stored)
    assert len(first) > 10 and first == walk(None)
    for name in S.STEPS:  # another session knows no tables
        spark.sql(f"DROP TABLE {S._table_name(str(tmp_path), name)}")
    stored = S.steps_of(spark, str(tmp_path))
    assert first == walk(stored)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan names the buckets
    found = stored["up"].filter(F.col("at").isin("s1"))
    assert "SelectedBucketsCount: 1 out of" in plan_of(found) and "Exchange" not in plan_of(found)
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    monkeypatch.setattr(W, "FEW", 0)
    assert first == walk(stored)


@pytest.mark.parametrize(("name", "needs"), [("v01_def", "names xrefs labels"), ("p03_def_in", "names xrefs first_definitions"), ("j02_substr_bulk", "names grams gram_counts"), ("v06_callgraph_both", "call_edges steps")])
def test_a_first_query_writes_what_it_needs(spark, monkeypatch, name, needs):
    from xrefloom.plans import adapters as A
    from xrefloom.plans import queries as P

    put, put_steps, written = S.put, S.put_steps, []
    monkeypatch.setattr(P, "_built", {})
    monkeypatch.setattr(S, "put", lambda df, folder, table: (written.append(table), put(df, folder, table))[1])
    monkeypatch.setattr(S, "put_steps", lambda calls, folder: (written.append("steps"), put_steps(calls, folder))[1])
    monkeypatch.setattr(A, "references", lambda *_: pytest.fail("made all references"))
    first, again = (sorted(map(tuple, P.Q[name](spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert sorted(written) == sorted(needs.split()) and first == again


def test_definitions_with_odd_keys(spark, tmp_path):
    """Orders and parts that are missing, lines that come twice, and an order key that comes twice."""
    from xrefloom.plans import adapters as A

    tables = {
        "orders": ([(5, "LOW"), (7, "URGENT"), (7, "HIGH")], "o_orderkey long, o_orderpriority string"), "part": ([(1, "b", "t"), (2, "b", "u"), (4, "b", "u")], "p_partkey long, p_brand string, p_type string"),
        "lineitem": ([(3, 1, 1), (5, 2, 1), (5, 2, 1), (5, 1, 1), (7, 3, 2), (7, 1, 9), (6, 1, 4)], "l_orderkey long, l_linenumber int, l_partkey long"),
    }
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert sorted((r.path, r.start_byte, r.end_byte, r.target_ticket.rpartition("#")[2]) for r in A.definitions(spark, str(tmp_path)).collect()) == [("orders/HIGH/7", 360, 390, "part%232"), ("orders/LOW/5", 160, 190, "part%231")]


def repeated_entries(spark):
    """Two files with definitions and calls, names of code and of edges; one file's path is written in two ways, and every entry comes three times."""
    name = lambda signature, path, language="c++": (signature, "c", "", path, language)
    rows = []
    fact = lambda source, kind, value: rows.append((source, None, "", kind, value.encode()))
    edge = lambda source, kind, target: rows.append((source, target, f"/kythe/edge/{kind}", "/", None))
    for path in ("d/a", "d//a", "d/b"):
        fact(name("", path, ""), FACTS.node_kind, "file")
        fact(name("", path, ""), FACTS.text, "\n".join(f"  line {k} of it " for k in range(9)))
        for k in range(4):
            edge(name(f"f{k}", path), "named", name(f"ns::f{k}()V", "", "jvm"))
            for start, end, kind, target in ((k * 30, k * 30 + 25, "defines/binding", f"f{k}"), (k * 30 + 5, k * 30 + 6, "ref/call", f"f{(k + 1) % 4}"), (k * 30 + 27, k * 30 + 28, "ref/call", "f0")):
                own = name(f"@{start}", path)
                for f, v in ((FACTS.node_kind, "anchor"), (FACTS.start, str(start)), (FACTS.end, str(end))):
                    fact(own, f, v)
                edge(own, kind, name(target, path))
    return spark.createDataFrame(rows * 3, ENTRY)


def test_build_of_repeated_entries(spark, tmp_path):
    entries = repeated_entries(spark)
    S.build(entries, str(tmp_path / "t"))
    got, want = CodeGraph.load(spark, str(tmp_path / "t")).t, CodeGraph.from_entries(S.dedup(entries)).t
    for table in S.SERVING:
        # two paths of one ticket are two entries, copies of an entry are one
        assert sorted(map(repr, got[table].select(want[table].columns).collect())) == sorted(map(repr, want[table].collect())), table
        assert got[table].count() > 0
    with pytest.raises(Exception, match="(?i)exists"):
        S.build(entries, str(tmp_path / "t"))


def test_tables_are_written_after_one_exchange(spark, tmp_path):
    entries = repeated_entries(spark)
    assert plan_of(S._distinct_facts(entries)).split("Physical Plan")[1].count("Exchange ") == 1
    files = S.files(entries).localCheckpoint()
    calls = "caller_ticket string, callee_ticket string, ds long, at long, direct boolean"
    a = S.anchors(entries, files_=files)
    assert FACTS.text not in plan_of(a)  # stored texts are not gathered again
    assert sorted(map(repr, a.collect())) == sorted(map(repr, S.anchors(entries).collect()))
    plan = plan_of(S._distinct_xrefs(a.localCheckpoint(), spark.createDataFrame([], calls), FACTS)).split("Physical Plan")[1]
    assert plan.count("rangepartitioning") == 1 and "REPARTITION_BY_COL" in plan and "hashpartitioning(target_ticket" not in plan


def test_calls_that_no_span_reaches_are_not_swept(spark, monkeypatch):
    spans = spark.createDataFrame([("f", f"s{k}", 10 * k, 10 * k + 5) for k in range(9)], "file_ticket string, caller_ticket string, ds long, de long")
    calls = spark.createDataFrame([("f", f"c{k}", k) for k in range(90)], "file_ticket string, callee_ticket string, at long")
    sweep = S._sweep

    def few(batches):  # 9 spans and 45 calls inside them, in one block of one size
        batches = list(batches)
        assert sum(b.num_rows for b in batches) <= 54
        return sweep(iter(batches))

    monkeypatch.setattr(S, "_sweep", few)
    assert {(r.callee_ticket, r.caller_ticket) for r in S.innermost_calls(spans, calls).collect()} == {(f"c{k}", f"s{k // 10}") for k in range(90) if k % 10 < 5}


def test_jobs_together_raise_their_error(spark):
    done = []

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        S.together(spark, fails, lambda: done.append(1))
    assert done == [1]
