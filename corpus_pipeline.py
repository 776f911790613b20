"""A training-data pipeline of five stages over the table documents; each applies one operator and acts on its decisions.

1. toxicity: documents that score 0.5 or more go.
2. near_duplicates: of each class of near copies the document with the smallest id stays.
3. decontamination: documents that contain a test item go.
4. pii: validated personal data become pseudonyms.
5. mixing: documents are sampled by probabilities that bring sources, languages and topics to their targets.

Stages return the columns of documents; the last adds topic, n_tokens, factor and probability.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xrefloom.llm import decontaminate, mixing, ngram_join, pii, toxicity
from xrefloom.llm.common import bounded_batches, renamed, saved, table

#: The key of the pseudonyms in tests; a real run sets its own secret.
PII_KEY = b"a key for tests"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents of this stage's input; keeps rows that score below 0.5. Null and empty texts stay unless the bias alone rejects them."""
    bounded_batches(spark)
    labels = table(spark, sf_dir, "labels").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    model = toxicity.fit(toxicity.labelled(docs, labels))
    rows, own = renamed(docs)
    scored = toxicity.score(rows, model, text=own["text"], keep=tuple(rows.columns))
    return scored.filter("score < 0.5").select(rows.columns).toDF(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class; rows without an id all stay.

    Rows that repeat an id and a text count once (the smallest by the other columns stays). Of the different texts of an
    id, the one with the smallest hash goes by the id, the others by numbers from 2**62 that hash id and text, so they
    stay unless their class has another representative.
    """
    bounded_batches(spark)
    docs, own = renamed(docs)
    key = F.struct(F.xxhash64(own["text"]).alias("a"), F.xxhash64(F.lit(1), own["text"]).alias("b"), F.isnull(own["text"]).alias("n"))
    all_rows = docs.withColumn("doc_id", F.col(own["doc_id"]).cast("long"))
    rows = all_rows.filter("doc_id is not null").withColumn("_key", key)
    row = F.struct(*docs.columns)
    maps = [f.name for f in docs.schema if "map<" in f.dataType.simpleString()]  # which have no order of their own
    first = F.min_by(row, F.struct(*(F.to_json(F.struct(c)) if c in maps else F.col(c) for c in docs.columns))) if maps else F.min(row)
    one = rows.groupBy("doc_id", "_key").agg(first.alias("_row")).select("_row.*", "doc_id", "_key")
    several = rows.groupBy("doc_id").agg(F.min("_key").alias("_least"), F.max("_key").alias("_most")).filter("_least <> _most").select("doc_id", "_least")
    other = F.xxhash64("doc_id", "_key").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    node = F.when(F.coalesce(F.col("_key") != F.col("_least"), F.lit(False)), other).otherwise(F.col("doc_id"))
    nodes = saved(one.join(several, "doc_id", "left").withColumn("_node", node).select(*docs.columns, "_node"))
    found = ngram_join.classes(nodes.select(F.col("_node").alias("doc_id"), F.col(own["text"]).alias("text")))
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_node")).distinct()
    kept = nodes.join(stay, "_node", "left_semi").select(docs.columns)
    return kept.unionByName(all_rows.filter("doc_id is null").select(docs.columns)).toDF(*own)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that contain no item of the table benchmark."""
    bounded_batches(spark)
    rows, own = renamed(docs)
    return decontaminate.clean(rows, table(spark, sf_dir, "benchmark"), text=own["text"]).toDF(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with pseudonyms in the text and its new length in n_chars, if there is that column (null for null texts)."""
    bounded_batches(spark)
    rows, own = renamed(docs)
    rest = tuple(c for c in rows.columns if c != own["text"])
    new = pii.pseudonymise(rows, PII_KEY, text=own["text"], keep=rest)
    if "n_chars" in own:
        new = new.withColumn(own["n_chars"], F.length(own["text"]).cast("long"))
    return new.select(rows.columns).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled rows, about half of the tokens, with topic, n_tokens, factor and probability, which replace columns of docs with these names."""
    bounded_batches(spark)
    rows, own = renamed(docs)
    mixed = mixing.mix(rows, text=own["text"], id_column=own["doc_id"], dims=(own["source"], own["lang"]), keep=tuple(rows.columns)).filter("sampled")
    new = ("topic", "n_tokens", "factor", "probability")
    return mixed.select(*(F.col(c).alias(k) for k, c in own.items() if k not in new), *new)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express learned scores, shingle classes, BM25 retrieval or keyed permutations; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
