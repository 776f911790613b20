"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, decontaminate, embeddings, language, licenses, lm, mixing, ngram_join, pii, prefix_trie, repair, token_counts, toxicity
from .common import bounded_batches, fold, table

#: The key of the registered query's pseudonyms; a real run passes its own secret.
PII_KEY = b"a key for tests"

#: The vocabulary of the registered token counts; the operator takes any file of that form.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    model = toxicity.fit(toxicity.labelled(docs.filter(fold("doc_id", 5) != 0), labels))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold("doc_id", 5) != 0))
    found = language.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "n_langs")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.classes(table(spark, sf_dir, "embeddings"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.fit(docs.filter(fold("doc_id", 7) != 2))
    return lm.score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": fold("doc_id", 7) == 2})


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.load_ranks(VOCABULARY))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digests(credentials.scan(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bounded(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: bounded(f) for f in (op1_toxicity, op2_language, op3_embeddings, op4_lm, op5_token_counts, op6_ngram_join, op7_decontaminate, op8_licenses, op9_pii, op10_mixing, op11_credentials, op12_prefix_trie, op13_repair)}


EMBEDDINGS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS dim FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
walk(x, y) AS (SELECT x, y FROM pairs UNION SELECT w.x, p.y FROM walk w JOIN pairs p ON w.y = p.x),
low AS (SELECT x, min(y) AS y FROM walk GROUP BY x), n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.y, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id"""

NGRAM_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM texts WHERE len(w) >= 5),
rolling AS (SELECT doc_id, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS s FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
sets AS (SELECT DISTINCT doc_id, s FROM rolling WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
pairs AS (SELECT x, y FROM shared JOIN sizes i ON i.doc_id = x JOIN sizes j ON j.doc_id = y WHERE 100 * n_both >= 80 * (i.n + j.n - n_both)),
walk(x, y) AS (SELECT x, y FROM pairs UNION SELECT w.x, p.y FROM walk w JOIN pairs p ON w.y = p.x),
low AS (SELECT x, min(y) AS y FROM walk GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low.y, doc_id)) AS component_id FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.x = doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the others are tested against brute force or held-out rows in tests/llm."""
    return {"op3_embeddings": EMBEDDINGS_SQL, "op6_ngram_join": NGRAM_SQL, "op8_licenses": licenses.duckdb_sql(), "op11_credentials": credentials.duckdb_sql(), "op12_prefix_trie": prefix_trie.duckdb_sql(), "op13_repair": repair.duckdb_sql()}
