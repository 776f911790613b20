"""Archives of compilation units (zip files with fixed member names) as a Spark data source, for reading and writing.

    spark.dataSource.register(UnitArchive)
    spark.read.format("unit_archive").load(path)                      # units: sha, encoding, unit, raw, status, error
    spark.read.format("unit_archive").option("what", "files").load(path)  # blobs: digest, content
    members.write.format("unit_archive").mode("append").save(folder)  # rows (member, content): one archive for each task

A path is one archive or a folder of archives, local or a URI of any file system that Arrow opens. The directory of an
archive is read once, on the driver, by ranged reads, and its members are dealt out to tasks in slices by their offsets; a
task reads the bytes of its members and nothing else. A JSON unit whose sha any archive of the folder also has as proto
is left out there, before a member is read.
Filters on the column primary_path reach the reader (`read_units` turns that on): a proto unit is walked only as far as
its path, and decoded if the path passes. Spark applies the filters again.
"""

from __future__ import annotations

import bz2
import re
import struct
import uuid
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import UNIT
from . import wire
from .files import located

# Member names. Only direct children count, neither folders nor deeper paths.
UNIT_MEMBER = re.compile(r"root/(pbunits|units)/([^/]+)")
FILE_MEMBER = re.compile(r"root/(files)/([^/]+)")
FOLDERS = ("root/", "root/pbunits/", "root/units/", "root/files/")

_UNIT_ROW = f"sha string, encoding string, unit {UNIT.simpleString()}, raw binary, status string, error string, primary_path string"
#: How members may be packed, by the number of the method.
_UNPACK = {zipfile.ZIP_STORED: bytes, zipfile.ZIP_DEFLATED: lambda data: zlib.decompress(data, -15), zipfile.ZIP_BZIP2: bz2.decompress}


@dataclass
class _Member:
    name: str
    offset: int
    packed: int
    method: int
    crc: int

    def read(self, archive) -> bytes:
        archive.seek(self.offset)
        head = archive.read(30)  # the local header: a name and extra bytes follow, whose lengths stand at its end
        archive.seek(self.offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        data = archive.read(self.packed)
        if self.method not in _UNPACK:
            raise ValueError(f"{self.name} is packed by method {self.method}")
        data = _UNPACK[self.method](data)
        if zlib.crc32(data) != self.crc:
            raise ValueError(f"{self.name} has a wrong checksum")
        return data


@dataclass
class _Slice(InputPartition):
    archive: str
    members: list[_Member] = field(default_factory=list)


@dataclass
class _Written(WriterCommitMessage):
    path: str


def _archives(path: str) -> list[str]:
    system, name = located(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = (f.base_name for f in system.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File)
    return sorted(f"{path.rstrip('/')}/{f}" for f in found if not f.startswith((".", "_")))


def _directory(archive: str, pattern: re.Pattern) -> list[_Member]:
    system, name = located(archive)
    with system.open_input_file(name) as f, zipfile.ZipFile(f) as z:
        return [_Member(i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC) for i in z.infolist() if pattern.fullmatch(i.filename)]


def _holds(test: D.Filter, path: str) -> bool:
    match test:
        case D.Not(child):
            return not _holds(child, path)
        case D.EqualTo(_, value):
            return path == value
        case D.In(_, values):
            return path in values
        case D.StringContains(_, value):
            return value in path
        case D.StringStartsWith(_, value):
            return path.startswith(value)
        case D.StringEndsWith(_, value):
            return path.endswith(value)
    raise ValueError(test)


def _on_path(test: D.Filter) -> bool:
    if isinstance(test, D.Not):
        return _on_path(test.child)
    return isinstance(test, (D.EqualTo, D.In, D.StringContains, D.StringStartsWith, D.StringEndsWith)) and test.attribute == ("primary_path",)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.files = options["path"], options.get("what", "units") == "files"
        self.size = int(options.get("membersPerPartition", 2000))
        self.tests: list[D.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if not self.files and _on_path(f):
                self.tests.append(f)
            yield f  # a failed unit has no path, which only Spark's own filter knows

    def partitions(self):
        pattern, archives = FILE_MEMBER if self.files else UNIT_MEMBER, _archives(self.path)
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(lambda a: _directory(a, pattern), archives))
        if not self.files:
            key = {m.name: UNIT_MEMBER.fullmatch(m.name).groups() for members in found for m in members}
            proto = {sha for kind, sha in key.values() if kind == "pbunits"}
            found = [[m for m in members if key[m.name][0] == "pbunits" or key[m.name][1] not in proto] for members in found]
        out = []
        for archive, members in zip(archives, found, strict=True):
            members.sort(key=lambda m: m.offset)
            out += [_Slice(archive, members[k : k + self.size]) for k in range(0, len(members), self.size)]
        return out or [_Slice("")]

    def read(self, partition):
        if not partition.members:
            return
        system, name = located(partition.archive)
        with system.open_input_file(name) as archive:
            for m in partition.members:
                if self.files:
                    yield FILE_MEMBER.fullmatch(m.name)[2], m.read(archive)
                elif row := self._unit(m, archive):
                    yield row

    def _unit(self, member: _Member, archive) -> tuple | None:
        kind, sha = UNIT_MEMBER.fullmatch(member.name).groups()
        encoding, data = "proto" if kind == "pbunits" else "json", None
        try:
            data = member.read(archive)
            if self.tests and encoding == "proto":
                path = wire.peek_path(data)
                if path is None or not all(_holds(t, path) for t in self.tests):
                    return None
            unit = wire.from_proto(data) if encoding == "proto" else wire.from_json(data)
            inputs = [((*i["v_name"].values(),), (*i["info"].values(),)) for i in unit["required_input"]]
            row = ((*unit["v_name"].values(),), inputs, unit["argument"], unit["source_file"], unit["output_key"], unit["working_directory"], unit["entry_context"])
            return sha, encoding, row, data if encoding == "proto" else None, "ok", None, wire.path_of_unit(unit)
        except (ValueError, TypeError, AttributeError, zlib.error) as e:  # one bad unit does not fail the archive
            return sha, encoding, None, data, "failed", str(e)[:4096], None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator):
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        hidden = f"{folder}/.{uuid.uuid4().hex}.zip"
        with system.open_output_stream(hidden) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
            for d in FOLDERS:
                z.writestr(d, b"")
            for row in iterator:
                z.writestr(row.member, bytes(row.content))
        return _Written(hidden)

    def commit(self, messages):
        system, _ = located(self.path)
        for m in filter(None, messages):
            folder, _, name = m.path.rpartition("/")
            system.move(m.path, f"{folder}/{name[1:]}")

    def abort(self, messages):
        system, _ = located(self.path)
        for m in filter(None, messages):
            if system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


class UnitArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "unit_archive"

    def schema(self) -> str:
        return "digest string, content binary" if self.options.get("what") == "files" else _UNIT_ROW

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def primary_path(unit: Column) -> Column:
    """First source file, even if empty; else the first input's name path or file path, else the unit's own path; null if all are empty."""
    first = F.get(unit["required_input"], 0)
    none = F.lit("")
    return F.coalesce(F.get(unit["source_file"], 0), F.nullif(first["v_name"]["path"], none), F.nullif(first["info"]["path"], none), F.nullif(unit["v_name"]["path"], none))


def read_units(spark: SparkSession, path: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Units of archives, by sha; of two encodings of one sha the proto stays, whatever the filter. Undecodable units have status failed.

    include, exclude: substrings of the primary path, any of which it must have, and none of which it may have. Several
    to include are for Spark alone; one, all to exclude, and what else callers filter on primary_path, reach the reader.
    Units without a path, failed ones too, pass only if there is neither.
    """
    spark.dataSource.register(UnitArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    units, at = spark.read.format("unit_archive").load(path), F.col("primary_path")
    if include:
        units = units.filter(reduce(or_, (F.contains(at, F.lit(x)) for x in include)))
    for x in exclude:
        units = units.filter(~F.contains(at, F.lit(x)))
    return units


def read_files(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(UnitArchive)
    return spark.read.format("unit_archive").option("what", "files").load(path)


@F.udf(T.BinaryType())
def _proto(unit):
    return wire.to_proto(unit.asDict(recursive=True))


def members(units: DataFrame, files: DataFrame) -> DataFrame:
    """Members of a normalised archive: every decoded unit as proto (its raw bytes where it has them) and each distinct required blob that exists."""
    good = units.filter("status = 'ok'")
    unit_rows = good.select(F.concat(F.lit("root/pbunits/"), "sha").alias("member"), F.coalesce("raw", _proto("unit")).alias("content"))
    needed = good.select(F.explode("unit.required_input.info.digest").alias("digest")).filter("digest <> ''").distinct()
    return unit_rows.unionByName(files.dropDuplicates(["digest"]).join(needed, "digest", "left_semi").select(F.concat(F.lit("root/files/"), "digest").alias("member"), "content"))


def write_archives(rows: DataFrame, folder: str, archives: int = 1) -> None:
    """Write members as `archives` archive files; equal members are expected to be distinct already."""
    rows.sparkSession.dataSource.register(UnitArchive)
    rows.coalesce(archives).write.format("unit_archive").mode("append").save(folder)


def normalise(spark: SparkSession, source: str, folder: str, archives: int = 1) -> tuple[int, int]:
    """Write a normalised copy of an archive; returns its units and the distinct digests that they require, whether there or not."""
    units = read_units(spark, source)
    write_archives(members(units, read_files(spark, source)), folder, archives)
    n = units.filter("status = 'ok'").agg(F.count("*").alias("u")).first()["u"]
    return n, units.select(F.explode("unit.required_input.info.digest").alias("d")).distinct().count()


def extract(units: DataFrame, files: DataFrame, sha: str, folder: str) -> int:
    """Write the archive of one unit; returns how many of its blobs were found."""
    own = members(units.filter(F.col("sha") == sha), files)
    write_archives(own, folder)
    return own.filter("startswith(member, 'root/files/')").count()


def with_arguments(units: DataFrame, argument: Column) -> DataFrame:
    """Units with changed arguments; the raw bytes stay exactly where nothing changed."""
    changed = units.withColumn("_a", argument)
    return changed.withColumn("raw", F.when(F.col("_a") == F.col("unit.argument"), F.col("raw"))).withColumn("unit", F.col("unit").withField("argument", F.col("_a"))).drop("_a")
