"""Files of any file system that Arrow opens (local, HDFS, S3, GCS, Azure), for Python code that runs inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

_CHUNK = 4 << 20
#: Schemes by which Hadoop calls what Arrow calls s3 and gs.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. A path without a scheme, or with file:, is local and taken as it stands."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):/", path)
    if scheme is None:
        return fs.LocalFileSystem(), path
    name = scheme[1].lower()
    if name == "file":
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:(//[^/]*)?/+", "", path)
    return fs.FileSystem.from_uri(_SCHEMES.get(name, name) + path[len(name) :])


def lines(path: str, chunk: int = _CHUNK) -> Iterator[pa.Array]:
    """The lines of a text file, without their ends, in arrays of about `chunk` bytes; a compressed file (by its suffix) is unpacked.

    Bytes that are no UTF-8 become replacement characters. No more than a chunk and the longest line are in memory.
    """
    system, name = located(path)
    rest: list[bytes] = []
    with system.open_input_stream(name) as stream:
        while data := stream.read(chunk):
            cut = data.rfind(b"\n") + 1
            if not cut:
                rest.append(data)
                continue
            yield _split(b"".join([*rest, data[: cut - 1]]))
            rest = [data[cut:]]
    if last := b"".join(rest):
        yield _split(last)


def _split(data: bytes) -> pa.Array:
    return pa.array([x.removesuffix("\r") for x in data.decode("utf-8", "replace").split("\n")], pa.string())
