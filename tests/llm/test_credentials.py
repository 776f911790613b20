"""Secret scan against a plain scan in Python, on planted parts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from xrefloom.llm import credentials as C

PARTS = [
    'password = "hunter2x"', "TOKEN:abc", "api_key: A/b+c=d.e_f-1", "apikey='zzzzzz'", "Secret  =  s3cr3t!", "password=token: abcdefgh", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "xAKIAAKIA" + "C" * 12, "0123456789abcdef01234567",
    "deadbeef" * 5 + "g", "0" * 23, "user: root@db", "username = x", "login=admin", "pwd: correct-horse", "pass=abc", "https://db.example.org:5432/x", "host: db1.internal", "endpoint=x", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "A" * 31,
]


def plain(text: str, reach: int) -> tuple:
    parts = []
    for n, k in enumerate(C.KINDS):
        pattern = {"hex": "[0-9a-f]+"}.get(k.name, k.pattern)
        for m in re.finditer(pattern, text, re.A):
            if len(m[k.group]) >= (24 if k.name == "hex" else k.least) and not (k.other and re.search(k.other, m[0])):
                parts.append((m.start(), n, m.end()))
    scopes = [0, *(m.end() for m in re.finditer(r"\n[ \t\r]*\n", text))]
    windows = {}
    for p in parts:
        first = max(s for s in scopes if s <= p[0])
        for w in ((p[0] - first) // reach - 1, (p[0] - first) // reach):
            windows.setdefault((first, w), []).append(p)
    linked = {p for w in windows.values() if len({C.KINDS[p[1]].role == "secret" for p in w}) == 2 for p in w if C.KINDS[p[1]].weak}
    base = [p for p in parts if not C.KINDS[p[1]].weak]
    text_of = lambda x: ",".join(f"{C.KINDS[k].name}:{s}:{e}" for s, k, e in sorted(x))
    return (*(sum(p[1] == n for p in base) for n in range(3)), hashlib.sha256(text_of(base).encode()).hexdigest(), text_of({*base, *linked}), len(linked))


def texts() -> list:
    r = random.Random(11)
    gaps = [" ", "\n", "\n\n", " \n \t\n", ", é😀 ", " word " * 12, "x" * 90 + " "]
    out = ["".join(r.choice(gaps) + r.choice(PARTS) for _ in range(r.randrange(0, 9))) for _ in range(120)]
    return [*out, *out[:15], "", None, "plain prose without any", " ".join(PARTS[:3] * 700), "token=abcdef" * 3]


def test_equals_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 5)
    monkeypatch.setattr(C, "BLOCK", 4)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in C.digests(C.scan(df, reach=40)).collect()}
    assert got == {i: plain(t or "", 40) for i, t in rows}
    assert sum(v[5] for v in got.values()) > 50


def test_weak_candidates_need_company(spark):
    rows = [(1, "login = admin and nothing else"), (2, "login = admin\npwd = opensesame"), (3, "login = admin\n\npwd = opensesame"), (4, "pwd = opensesame " + "x" * 900 + " https://db.example.org"), (5, "token = abcdef at https://db.example.org"), (None, "login = admin pwd = opensesame")]
    got = {r.doc_id: r.n_linked for r in C.digests(C.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: 0, 2: 2, 3: 0, 4: 0, 5: 1, None: 2}


def test_odd_tables(spark):
    odd = spark.createDataFrame([(1, "token=abcdef", {"a": 1}, ("x",), "y")], "doc_id long, text string, base map<string,int>, linked struct<`x y`:string>, _s0 string")
    out = C.scan(odd, keep=("doc_id", "_s0"))
    assert [(r.doc_id, r._s0, [tuple(x) for x in r.base], r.linked) for r in out.collect()] == [(1, "y", [(0, 0, 12)], [])]
    assert C.digests(C.scan(odd.limit(0))).count() == 0
    assert C.scan(odd.withColumn("text", F.lit(None).cast("string"))).first().base == []
