"""Streams: admission by files and bytes, keyed state, manifests, resume; all against plain readings of the same files."""

import gzip
import json
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import StreamingQueryException
from test_graph import edge, fact, golden, vname

from xrefloom.operators import names as N
from xrefloom.sources.entries import read_entries
from xrefloom.sources.files import lines
from xrefloom.streaming import fold as S


@given(st.lists(st.integers(0, 50)), st.integers(1, 6), st.integers(1, 100))
def test_a_batch_closes_at_whichever_limit_comes_first(sizes, files, size):
    groups = {}
    for k, b in enumerate(S.cut(sizes, files, size)):
        groups.setdefault(b, []).append(sizes[k])
    assert [s for b in sorted(groups) for s in groups[b]] == sizes and sorted(groups) == list(range(len(groups)))
    for b, group in groups.items():
        assert len(group) <= files and sum(group[:-1]) < size
        assert b == len(groups) - 1 or len(group) == files or sum(group) >= size


def rows(df):
    return sorted(map(repr, df.collect()))


def put(folder, name, entries):
    folder.mkdir(exist_ok=True)
    text = "".join(json.dumps(e) + "\n" for e in entries)
    if name.endswith(".gz"):
        (folder / name).write_bytes(gzip.compress(text.encode()))
    else:
        (folder / name).write_text(text)


def check(spark, folder, out):
    want = read_entries(spark, str(folder)).distinct()
    assert rows(S.read_store(spark, out, "entries")) == rows(want)
    assert rows(S.read_store(spark, out, "names")) == rows(N.names_of(want))
    assert sorted(os.path.basename(r.path) for r in S.read_store(spark, out, "files").collect()) == sorted(f for f in os.listdir(folder) if os.path.getsize(folder / f))


def test_batches_by_files_and_by_bytes(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    every = [*golden(), fact(vname("q"), "code", "no marked source"), edge(vname("q"), "named", vname("", "", ""))]
    for k in range(4):
        put(folder, f"{k}.entries", every[:3])
    put(folder, "4.entries.gz", every)
    put(folder, "5.entries", [])
    big = os.path.getsize(folder / "0.entries")
    S.index_stream(spark, str(folder), out, files=3, size=2 * big)
    batches = {}
    for r in S.admitted(spark, out).select("*", "_metadata.file_path").collect():
        batches.setdefault(r.file_path, []).append(r.bytes)
    assert len(batches) >= 3 and all(len(b) <= 3 and (len(b) == 1 or sum(b) - min(b) <= 2 * big) for b in batches.values())
    assert len(S.manifests(spark, out)) == len(batches)
    check(spark, folder, out)


def test_a_batch_reads_nothing_of_the_store(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    every = golden()
    put(folder, "a.entries", every[:40])
    S.index_stream(spark, str(folder), out)
    os.rename(f"{out}/data", f"{out}/away")  # earlier batches are out of reach
    put(folder, "b.entries", every)
    with pytest.raises(Exception):
        S.index_stream(spark, str(folder), out, resume=True).count()
    for f in os.listdir(f"{out}/away"):
        os.rename(f"{out}/away/{f}", f"{out}/data/{f}")
    check(spark, folder, out)


@pytest.mark.parametrize("after_manifest", [False, True])
def test_a_stop_around_the_manifest(spark, tmp_path, monkeypatch, after_manifest):
    folder, out, commit = tmp_path / "in", str(tmp_path / "out"), S._commit
    put(folder, "a.entries", golden()[:40])
    S.index_stream(spark, str(folder), out)
    old = rows(S.read_store(spark, out, "names")), rows(S.read_store(spark, out, "entries"))
    put(folder, "b.entries", golden())

    def stop(*args):
        if after_manifest:
            commit(*args)
        raise RuntimeError("stopped")

    monkeypatch.setattr(S, "_commit", stop)
    with pytest.raises(StreamingQueryException):
        S.index_stream(spark, str(folder), out, resume=True)
    if not after_manifest:  # the data are written, but nothing of them is to be seen
        assert len(os.listdir(f"{out}/data")) == 2
        assert old == (rows(S.read_store(spark, out, "names")), rows(S.read_store(spark, out, "entries")))
    monkeypatch.undo()
    S.index_stream(spark, str(folder), out, resume=True)
    check(spark, folder, out)


@given(st.lists(st.text(st.characters(exclude_characters="\r\n", codec="utf-8"), max_size=30)), st.integers(1, 20), st.booleans())
def test_lines(tmp_path_factory, texts, chunk, closed):
    path = tmp_path_factory.mktemp("lines") / "x"
    path.write_bytes(("\n".join(texts) + ("\n" if closed and texts else "")).encode())
    got = [x for part in lines(f"file:{path}", chunk) for x in part.to_pylist()]
    want = "\n".join(texts).split("\n") if texts else []
    assert got[: len(want)] == want or [x for x in got if x] == [x for x in texts if x]
    assert [x for x in got if x] == [x for x in texts if x]
