"""Ticket and path functions, all as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NAMED, SCHEME, VNAME_FIELDS


def escape(s: Column, keep_slash: bool) -> Column:
    """Percent-encode every UTF-8 byte except A-Z a-z 0-9 - . _ ~ (and / if keep_slash), with upper-case digits."""
    out = F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def decode(s: Column) -> Column:
    """Percent-decode; malformed escapes and + stay as they are, invalid UTF-8 becomes U+FFFD."""
    return F.url_decode(F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def clean_path(p: Column) -> Column:
    """Collapse //, . and ..; a rooted path cannot leave its root; an empty relative path is `.`, the empty string stays."""
    rooted = F.startswith(p, F.lit("/"))
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        return F.when(x.isin("", "."), acc).when(x == "..", F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(rooted, acc).otherwise(F.array_append(acc, F.lit("..")))).otherwise(F.array_append(acc, x))

    body = F.array_join(F.aggregate(F.split(p, "/"), none, step), "/")
    clean = ~F.rlike(p, F.lit(r"(^|/)\.{0,2}(/|$)"))  # most paths: no empty, . or .. piece
    return F.when((p == "") | clean, p).when(rooted, F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def ticket(v: Column) -> Column:
    """The URI of a node name; empty and null parts are left out. A null name has no ticket."""
    part = {f: F.coalesce(v.getField(f), F.lit("")) for f in VNAME_FIELDS}

    def piece(name: str, before: str, keep_slash: bool, value: Column | None = None) -> Column:
        return F.when(part[name] == "", "").otherwise(F.concat(F.lit(before), escape(part[name] if value is None else value, keep_slash)))

    made = F.concat(F.lit(SCHEME), piece("corpus", "//", True), piece("language", "?lang=", False), piece("path", "?path=", True, clean_path(part["path"])), piece("root", "?root=", True), piece("signature", "#", False))
    return F.when(v.isNotNull(), made)


def path_of(t: Column) -> Column:
    """The decoded path of a ticket; the whole ticket if it has none."""
    return F.when(F.contains(t, F.lit("?path=")), decode(F.regexp_extract(t, r"(?s)^.*?\?path=([^?#]*)", 1))).otherwise(t)


def signature_of(t: Column) -> Column:
    """The decoded signature after the last #; empty if there is none."""
    return F.when(F.contains(t, F.lit("#")), decode(F.substring_index(t, "#", -1))).otherwise("")


def is_ticket(name: str) -> bool:
    return name.startswith(SCHEME)


def is_named_edge(kind: Column) -> Column:
    """Whether an edge kind, without an ordinal after its first dot, is that of a name."""
    return F.substring_index(kind, ".", 1) == NAMED


def strip_descriptor(sig: Column) -> Column:
    """A JVM method signature without its descriptor; null if there is none."""
    return F.nullif(F.regexp_extract(sig, r"(?s)^(.*)\([A-Za-z0-9;\[/$_]*\)[A-Za-z0-9;\[/$_]+\z", 1), F.lit(""))


def from_base64(s: Column) -> Column:
    """Bytes of base64 text with or without padding or blanks; null if a character is not of the alphabet."""
    return F.try_to_binary(F.regexp_replace(s, r"[\s=]", ""), F.lit("base64"))


def squeeze(s: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
