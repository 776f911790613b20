"""Compilation units to and from their two encodings: protocol-buffer bytes and JSON."""

from __future__ import annotations

import json

from ..functions.marked import fields

# Field numbers of the messages. A list means a repeated field, a dict a nested message.
VNAME = {"signature": (1, None), "corpus": (2, None), "root": (3, None), "path": (4, None), "language": (5, None)}
INFO = {"path": (1, None), "digest": (2, None)}
INPUT = {"v_name": (1, VNAME), "info": (2, INFO)}
UNIT = {"v_name": (1, VNAME), "required_input": (3, [INPUT]), "argument": (5, [None]), "source_file": (6, [None]), "output_key": (7, None), "working_directory": (8, None), "entry_context": (9, None)}
INDEXED = {"unit": (1, UNIT)}


def empty(spec):
    return "" if spec is None else [] if isinstance(spec, list) else {name: empty(s) for name, (_, s) in spec.items()}


def decode(data: bytes, spec: dict) -> dict:
    """A message as a dict with all fields of spec; unknown fields and wire types are skipped. Raises ValueError on bytes that are no message."""
    out = empty(spec)
    by_number = {number: (name, s) for name, (number, s) in spec.items()}
    for number, value in fields(data):
        if number not in by_number or not isinstance(value, bytes):
            continue
        name, s = by_number[number]
        inner = s[0] if isinstance(s, list) else s
        item = value.decode("utf-8") if inner is None else decode(value, inner)
        if isinstance(s, list):
            out[name].append(item)
        else:
            out[name] = item
    return out


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(value: dict, spec: dict) -> bytes:
    """A message's bytes: fields by number, empty strings left out, nested messages always written."""
    out = b""
    for name, (number, s) in sorted(spec.items(), key=lambda x: x[1][0]):
        v = value.get(name) if isinstance(value, dict) else getattr(value, name)
        inner = s[0] if isinstance(s, list) else s
        for item in v or [] if isinstance(s, list) else [v]:
            data = (item or "").encode() if inner is None else encode(item or {}, inner)
            if data or inner is not None or isinstance(s, list):
                out += _number(number << 3 | 2) + _number(len(data)) + data
    return out


def _take(value: dict, spec: dict) -> dict:
    out = empty(spec)
    for name, (_, s) in spec.items():
        camel = name.split("_")[0] + "".join(p.title() for p in name.split("_")[1:])
        v = value.get(name, value.get(camel))
        if v is None:
            continue
        inner = s[0] if isinstance(s, list) else s
        make = (lambda x: x) if inner is None else lambda x, i=inner: _take(x, i)
        out[name] = [make(x) for x in v] if isinstance(s, list) else make(v)
        if inner is None and not all(isinstance(x, str) for x in (out[name] if isinstance(s, list) else [out[name]])):
            raise ValueError(f"{name} is not text")
    return out


def from_json(data: bytes) -> dict:
    """A unit from JSON, with snake_case or camelCase names; unknown fields are skipped, missing ones empty."""
    value = json.loads(data)
    if not isinstance(value, dict):
        raise ValueError("no object")
    return _take(value, INDEXED)["unit"]


def from_proto(data: bytes) -> dict:
    return decode(data, INDEXED)["unit"]


def path_of_unit(unit: dict) -> str | None:
    """The primary path of a decoded unit, as `archive.primary_path` has it."""
    if unit["source_file"]:
        return unit["source_file"][0]
    inputs = unit["required_input"][:1]
    return next((p for p in (*(i[k]["path"] for i in inputs for k in ("v_name", "info")), unit["v_name"]["path"]) if p), None)


def peek_path(data: bytes) -> str | None:
    """The primary path of a proto unit, from as few of its bytes as tell it; null if it has none, or cannot be read so far.

    Where the whole unit can be decoded, this is its path: the walk stops at the first source file, and of the inputs only
    the first is opened.
    """
    try:
        body = [v for n, v in fields(data) if n == INDEXED["unit"][0] and isinstance(v, bytes)][-1:]
        found = empty(UNIT)
        for number, value in fields(body[0]) if body else ():
            if not isinstance(value, bytes):
                continue
            if number == UNIT["source_file"][0]:
                return value.decode("utf-8")
            if number == UNIT["required_input"][0] and not found["required_input"]:
                found["required_input"].append(decode(value, INPUT))
            elif number == UNIT["v_name"][0]:
                found["v_name"] = decode(value, VNAME)
        return path_of_unit(found)
    except ValueError:
        return None


def to_proto(unit: dict) -> bytes:
    return encode({"unit": unit}, INDEXED)
