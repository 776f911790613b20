"""Registered queries against their SQL, on tables with planted cases."""

import duckdb
import numpy as np
import pytest

from xrefloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    d = spark.read.parquet(f"{SF}/documents.parquet")
    notes = ["login = admin\npwd: opensesame1", "password=token: abcdefgh AKIA" + "Q" * 18, "see https://db.example.org/x token = 'abcdef'\n\nhost: db1.internal", "blob wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY for user: root@db"]
    d.unionByName(spark.createDataFrame([(10_000 + k, t, "en", "notes", len(t)) for k, t in enumerate([*notes, notes[0], ""])], d.schema)).write.parquet(f"{folder}/documents.parquet")
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    c.unionByName(spark.createDataFrame([(conv, turn, role, text) for conv in (300, 307, 1205) for turn in (None, 0, 1, 1, 5) for role, text in ((None, "Same."), ("user", None), ("assistant", "Same."))], c.schema)).write.parquet(f"{folder}/conversations.parquet")
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rng = np.random.default_rng(4)
    rows = [(r.vec_id, r.embedding, r.label) for r in v.collect()]
    near = [(10_000 + 10 * k + j, [float(x) for x in np.array(e) + rng.normal(size=len(e)) * np.std(e) * 0.1], label) for k, (_, e, label) in enumerate(rows[:40]) for j in range(2)]
    odd = [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [None] * 64, 1), (20_003, [float("nan")] * 64, 1), (20_004, rows[3][1], None), (20_005, [], 1)]
    spark.createDataFrame([*rows, *near, *odd], v.schema).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    got = queries.queries()[name](spark, tables)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
