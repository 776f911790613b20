"""Readers and writers of entries and name lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tickets import from_base64
from ..schema import ENTRY_JSON, VNAME_FIELDS


def normalised(df: DataFrame, default_corpus: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Null name parts become empty; names without a corpus get the default one. A null target stays null. The columns of keep follow."""

    def name(c: str):
        v = F.col(c)
        parts = [F.coalesce(v[f], F.lit("")).alias(f) for f in VNAME_FIELDS]
        if default_corpus:
            parts[1] = F.when(F.coalesce(v["corpus"], F.lit("")) == "", default_corpus).otherwise(v["corpus"]).alias("corpus")
        return F.struct(*parts)

    empty = F.lit("")
    return df.select(name("source").alias("source"), F.when(F.col("target").isNotNull(), name("target")).alias("target"), F.coalesce("edge_kind", empty).alias("edge_kind"), F.coalesce("fact_name", empty).alias("fact_name"), "fact_value", *keep)


def parse_lines(lines: DataFrame, default_corpus: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries from a column `value` of JSON lines; lines that are no such object, or have no source, are left out.

    keep: more columns to pass on; rows in which one of them is not null stay, whatever their line is.
    """
    parsed = lines.select(F.from_json("value", ENTRY_JSON).alias("e"), *keep).select("e.*", *keep)
    parsed = parsed.filter(" or ".join(f"`{c}` is not null" for c in ("source", *keep)))
    return normalised(parsed.withColumn("fact_value", from_base64(F.coalesce("fact_value", F.lit("")))), default_corpus, keep)


def read_entries(spark: SparkSession, path: str, default_corpus: str = "") -> DataFrame:
    """All *.entries* files of a folder; an empty folder is an error."""
    return parse_lines(spark.read.text(f"{path}/*.entries*"), default_corpus)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A name list of lines `name TAB ticket`; lines without a TAB are left out."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).filter(F.contains("value", F.lit("\t"))).select(parts[0].alias("name"), parts[1].alias("ticket"))


def write_names(names: DataFrame, path: str) -> None:
    """A sorted name list as text."""
    names.orderBy("name", "ticket").select(F.concat_ws("\t", "name", "ticket").alias("value")).write.mode("errorifexists").text(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object for each row, in a column `value`."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
