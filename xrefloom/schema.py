"""Schemas of the graph's tables, and the names that the input format fixes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

VNAME_FIELDS = ("signature", "corpus", "root", "path", "language")
VNAME = T.StructType([T.StructField(f, T.StringType()) for f in VNAME_FIELDS])

#: One row of the interchange format as it is in JSON lines; fact_value is base64 text there and bytes in ENTRY.
ENTRY_JSON = T.StructType([T.StructField("source", VNAME), T.StructField("target", VNAME), T.StructField("edge_kind", T.StringType()), T.StructField("fact_name", T.StringType()), T.StructField("fact_value", T.StringType())])
ENTRY = T.StructType([*ENTRY_JSON.fields[:-1], T.StructField("fact_value", T.BinaryType())])

FILE_INPUT = T.StructType([T.StructField("v_name", VNAME), T.StructField("info", T.StructType([T.StructField("path", T.StringType()), T.StructField("digest", T.StringType())]))])
UNIT = T.StructType(
    [
        T.StructField("v_name", VNAME),
        T.StructField("required_input", T.ArrayType(FILE_INPUT)),
        T.StructField("argument", T.ArrayType(T.StringType())),
        T.StructField("source_file", T.ArrayType(T.StringType())),
        T.StructField("output_key", T.StringType()),
        T.StructField("working_directory", T.StringType()),
        T.StructField("entry_context", T.StringType()),
    ]
)

# Fixed values of the interchange format: the ticket scheme, fact and edge names, and the six inheritance kinds.
SCHEME = "kythe:"
NAMED = "/kythe/edge/named"
CODE_FACT = "/kythe/code"
INHERITANCE = ("/kythe/edge/extends", "/kythe/edge/extends/public", "/kythe/edge/extends/protected", "/kythe/edge/extends/private", "/kythe/edge/overrides", "/kythe/edge/satisfies")


@dataclass(frozen=True)
class Facts:
    """Fact names and edge kinds that place anchors in files. Indexers may use others; pass a changed copy then."""

    node_kind: str = "/kythe/node/kind"
    text: str = "/kythe/text"
    start: str = "/kythe/loc/start"
    end: str = "/kythe/loc/end"
    childof: str = "/kythe/edge/childof"
    defines: tuple[str, ...] = ("/kythe/edge/defines", "/kythe/edge/defines/binding")
    definition: str = "/kythe/edge/defines/binding"
    refs: str = "/kythe/edge/ref"
    call: str = field(default="ref/call")


FACTS = Facts()
