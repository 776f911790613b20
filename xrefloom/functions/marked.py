"""Names from marked source: the one recursive message of the format, rendered in an Arrow-batched function."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field numbers of the message.
PRE_TEXT, CHILD, JOINER, POST_TEXT, FINAL_JOINER = 2, 3, 4, 5, 10


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("varint ends early")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes):
    """(number, value) of each field of a message; bytes for length-delimited ones, numbers for the others."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}.get(kind, len(data) + 1), at)
            if at + size > len(data):
                raise ValueError("field ends early")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def render(data: bytes, depth: int = 0) -> str | None:
    """The text of a message and its children; null if it is malformed. Malformed and empty children are left out."""
    if depth > 100:
        return None
    pre = post = joiner = ""
    final, children = False, []
    try:
        for number, value in fields(data):
            if number == CHILD and isinstance(value, bytes):
                children.append(value)
            elif number == FINAL_JOINER:
                final = value not in (0, b"")
            elif isinstance(value, bytes) and number in (PRE_TEXT, JOINER, POST_TEXT):
                text = value.decode("utf-8", "replace")
                pre, joiner, post = (text if number == n else old for n, old in ((PRE_TEXT, pre), (JOINER, joiner), (POST_TEXT, post)))
    except ValueError:
        return None
    shown = [s for s in (render(c, depth + 1) for c in children) if s]
    return pre + joiner.join(shown) + (joiner if final and shown else "") + post


def qualified_name(data: bytes | None) -> str | None:
    """The name in a rendered message: before the first parenthesis, the last word, without colons at its end."""
    text = render(data) if data else None
    words = (text or "").split("(", 1)[0].split()
    return (words[-1].rstrip(":") if words else "") or None


@F.arrow_udf(T.StringType())
def marked_name(values: pa.Array) -> pa.Array:
    return pa.array([qualified_name(v.as_py()) for v in values], pa.string())
