"""Archives of units: ranged reads by offset, filters that reach the reader, twins, packing, folders and URIs."""

import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from test_graph import UNITS, encoded_unit, made

from xrefloom import __main__ as cli
from xrefloom.sources import archive, wire


def want_path(u):
    first = u["required_input"][0] if u["required_input"] else {"v_name": {"path": ""}, "info": {"path": ""}}
    return u["source_file"][0] if u["source_file"] else first["v_name"]["path"] or first["info"]["path"] or u["v_name"]["path"] or None


@settings(max_examples=100, deadline=None)
@given(UNITS)
def test_peek_is_the_path_of_the_decoded_unit(u):
    data = encoded_unit(u)
    assert wire.peek_path(data) == wire.path_of_unit(wire.from_proto(data)) == want_path(u)
    for end in range(len(data)):  # what is cut short may still tell its path, but never another than a unit that can be decoded
        try:
            whole = wire.path_of_unit(wire.from_proto(data[:end]))
        except ValueError:
            wire.peek_path(data[:end])
        else:
            assert wire.peek_path(data[:end]) == whole


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three archives of 60 units, packed in three ways; every fourth unit is JSON, every tenth has a JSON twin with another path in the next archive."""
    root, units = tmp_path_factory.mktemp("archives"), {}
    zips = [zipfile.ZipFile(root / f"{k}.zip", "w", m) for k, m in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2))]
    for k in range(60):
        u = made(k, random.Random(k).choice(["java", "c++"]), [f"lib/{k % 7}/x{k}.h"], [f"app/{k % 5}/m{k}.cc"] if k % 3 else [])
        units[f"u{k:02}"] = u
        if k % 4:
            zips[k % 3].writestr(f"root/pbunits/u{k:02}", encoded_unit(u))
            if k % 10 == 1:
                zips[(k + 1) % 3].writestr(f"root/units/u{k:02}", json.dumps({"unit": made(k, "go", [], ["twin/of.cc"])}))
        else:
            zips[k % 3].writestr(f"root/units/u{k:02}", json.dumps({"unit": u}))
    zips[0].writestr("root/pbunits/broken", b"\x0a\x7f")
    for z in zips:
        z.close()
    (root / ".hidden").write_text("no archive")
    return str(root), units


FILTERS = [([], []), (["app/3"], []), ([], ["app/3", "lib"]), (["app/1", "lib/2"], ["x9"]), (["twin"], []), ([""], [])]


@pytest.mark.parametrize(("include", "exclude"), FILTERS)
def test_filtered_reads(spark, folder, include, exclude):
    path, units = folder
    for uri in (path, f"file://{path}"):
        got = archive.read_units(spark, uri, include, exclude)
        rows = {r.sha: r for r in got.filter("status = 'ok'").collect()}
        want = {k for k, u in units.items() if (not include or any(x in want_path(u) for x in include)) and not any(x in want_path(u) for x in exclude)}
        assert set(rows) == want
        assert all(r.primary_path == want_path(units[k]) and r.unit.asDict(True) == units[k] for k, r in rows.items())
        assert got.filter("status = 'failed'").count() == (not include and not exclude)
    same = archive.read_units(spark, path).filter("status = 'ok'").filter(archive.primary_path(F.col("unit")) != F.col("primary_path"))
    assert same.count() == 0


def test_what_a_filter_saves(folder, monkeypatch):
    path, units = folder
    decoded = []
    monkeypatch.setattr(wire, "from_proto", lambda data, own=wire.from_proto: decoded.append(1) or own(data))
    for filters, holds in (([D.StringContains(("primary_path",), "app/3")], lambda p: "app/3" in p), ([D.Not(D.StringStartsWith(("primary_path",), "app")), D.EqualTo(("sha",), "u05")], lambda p: not p.startswith("app"))):
        reader = archive._Reader({"path": path, "membersPerPartition": "7"})
        assert list(reader.pushFilters(filters)) == filters  # Spark holds them again
        decoded.clear()
        slices = reader.partitions()
        shas = [row[0] for s in slices for row in reader.read(s)]
        proto = [k for k, u in units.items() if int(k[1:]) % 4 and holds(want_path(u))]
        assert len(decoded) == len(proto) and set(proto) <= set(shas) and len(shas) == len(set(shas))
        assert all(len(s.members) <= 7 and s.members == sorted(s.members, key=lambda m: m.offset) for s in slices)


def test_filters_reach_the_reader(spark, folder):
    some = archive.read_units(spark, folder[0], exclude=["lib"]).filter(F.startswith("primary_path", F.lit("app")))
    execution = some._jdf.queryExecution()
    assert execution.executedPlan().executeCollect() is not None
    leaf = execution.executedPlan().collectLeaves().head()
    want = {k for k, u in folder[1].items() if want_path(u).startswith("app")}
    # the rows that left the scan: JSON units are decoded to know their paths, proto units only where these pass
    assert leaf.metrics().apply("numOutputRows").value() == len(want | {k for k in folder[1] if int(k[1:]) % 4 == 0})
    assert {r.sha for r in some.collect()} == want


def test_bad_members(tmp_path):
    u = encoded_unit(made(1, "java", ["a.java"]))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("root/pbunits/good", u)
        z.writestr("root/pbunits/flipped", u)
        z.writestr("root/pbunits/lzma", u, zipfile.ZIP_LZMA)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    at = data.find(b"a.java", data.find(b"root/pbunits/flipped"))
    data[at] ^= 1
    (tmp_path / "a.zip").write_bytes(data)
    reader = archive._Reader({"path": str(tmp_path / "a.zip")})
    got = {r[0]: (r[4], r[5]) for s in reader.partitions() for r in reader.read(s)}
    assert got["good"] == ("ok", None) and got["flipped"][0] == got["lzma"][0] == "failed" and "checksum" in got["flipped"][1]


def test_written_archives_are_plain_zip_files(spark, tmp_path, folder):
    units = archive.read_units(spark, folder[0])
    files = spark.createDataFrame([(i["info"]["digest"], b"x") for u in folder[1].values() for i in u["required_input"]] * 2, "digest string, content binary")
    archive.write_archives(archive.members(units, files), f"file://{tmp_path}/out", 2)
    names = []
    for f in (tmp_path / "out").iterdir():
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None and z.namelist()[:4] == list(archive.FOLDERS)
            names += z.namelist()[4:]
    assert len(names) == len(set(names)) == 2 * 60
    empty = archive.read_units(spark, folder[0]).filter("false")
    archive.write_archives(archive.members(empty, files), str(tmp_path / "none"))
    assert archive.read_units(spark, str(tmp_path / "none")).count() == 0


def test_command_line(spark, folder, tmp_path):
    path, units = folder
    rows = [json.loads(x) for x in cli.run(spark, ["plan", path, "--in", "app/3", "--in", "lib/2", "--langs", "java,cxx", "--rule", "app::-x"])]
    assert [r["sha"] for r in rows] == sorted(units)
    for r in rows:
        p = want_path(units[r["sha"]])
        assert r.get("skipped") == (None if "app/3" in p or "lib/2" in p else "path")
        assert r["argument"] == (["-x"] if p.startswith("app") else [])
    (tmp_path / "done").write_text("u05\nu06\n")
    assert [r["sha"] for r in map(json.loads, cli.run(spark, ["plan", path, "--done", str(tmp_path / "done")])) if r.get("skipped") == "done"] == ["u05", "u06"]
    assert cli.run(spark, ["normalise", path, str(tmp_path / "all"), "--parts", "2"]) == ["60 units, 60 files required"]
    assert cli.run(spark, ["extract", path, "u07", str(tmp_path / "one")]) == ["0 files found"]
    assert [r.sha for r in archive.read_units(spark, str(tmp_path / "one")).collect()] == ["u07"]
