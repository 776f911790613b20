"""License scan by diagonal voting, with DataFrame functions only.

Every text is cut into words; all rolling pairs of neighbouring words (k = 2, as the shortest phrase has two words) are
joined, by hash and then by the words themselves, to the positions of the same pairs in the templates. A hit at word p of a
text and word t of a template votes for the diagonal p - t. Votes are added up by text, template and diagonal;
neighbouring diagonals (a word more or less in the text than in the template shifts the diagonal by one) are merged; and
merged spans are verified: in the order of the text, hits must go on in the template, with at most `slack` words more or less
between them, and the template's pairs that such a run covers, over all of its pairs, must reach `least_cover`.

The base phrases are templates too, but count only where the whole phrase stands on one diagonal.

The template table is a constant of a few hundred rows, so the join broadcasts it and never moves texts. Texts are read and
cut once: each row leaves one record of its own and its hits, which alone are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, whole_text

#: The base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Notices and sentences of well-known public licenses, and the labels that they give.
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one letter outside ASCII whose lower case is an ASCII letter alone; it is no k here.
KELVIN = "\u212a"


def words(text: Column) -> Column:
    """The words of a text: A-Z as a-z, split at everything in ASCII that is neither a letter nor a digit."""
    return F.filter(F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit("\u00e9"))), SEPARATORS), lambda x: x != "")


def template_rows(templates: list[tuple[str, str]]) -> list[tuple]:
    """One row for each pair position of the base phrases and templates: number, label, is_base, t, first word, second word, n_pairs."""
    rows = []
    for number, (label, phrase) in enumerate([*BASE, *templates]):
        w = phrase.split(" ")
        rows += [(number, label, number < len(BASE), t, a, b, len(w) - 1) for t, (a, b) in enumerate(zip(w[:-1], w[1:], strict=True))]
    return rows


def template_pairs(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame(template_rows(templates), "template int, label string, is_base boolean, t int, first string, second string, n_pairs int")
    return rows.withColumn("hash", F.xxhash64("first", "second"))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: list[tuple[str, str]] = TEMPLATES, least_cover: float = 0.7, slack: int = 2) -> DataFrame:
    """For every row: the columns of keep, n_words, n_base, first_word, last_word, base_labels, labels and score.

    A null or empty text has no words, no places and empty labels. score is the largest share of any template's word
    pairs that one run covers (0 to 1; 1 wherever a base phrase stands). slack: how far apart two diagonals may be and
    still be neighbours. Equal rows have equal results.
    """
    names = [f"_own{k}" for k in range(len(keep))]
    rows = docs.select(*keep, whole_text(text)).toDF(*names, "text")
    key = ["k0", "k1", "k2"]  # of a row, by its own columns and its text
    keyed = rows.select(*names, F.xxhash64(F.lit(0), *names).alias("k0"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    # the empty word after a text's last one is the row's own record
    rolling = keyed.select(*names, *key, "w", F.posexplode("w").alias("p", "word")).withColumn("next", F.get("w", F.col("p") + 1))
    met = rolling.withColumn("hash", F.xxhash64("word", "next")).join(F.broadcast(template_pairs(docs.sparkSession, templates)), "hash", "left")
    met = met.filter("word = '' or (word = first and next = second)").select(*(F.when(F.col("word") == "", F.col(c)).alias(c) for c in names), *key, "p", "template", "label", "is_base", "t", "n_pairs")
    met = saved(met)

    hits = met.filter("template is not null").select(*key, "template", "label", "is_base", "n_pairs", "p", "t")
    votes = hits.groupBy(*key, "template", "label", "is_base", "n_pairs", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("at"))
    on_base = votes.filter("is_base and size(at) = n_pairs").groupBy(*key).agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_labels"))
    by = Window.partitionBy(*key, "template").orderBy("diagonal")
    spans = votes.filter("not is_base").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > slack).cast("int"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).select(*key, "template", "label", "n_pairs", "diagonal", "span", F.explode("at").alias("t"))
    spans = spans.withColumn("p", F.col("diagonal") + F.col("t"))
    by = Window.partitionBy(*key, "template", "span").orderBy("p", "t")
    step_p, step_t = F.col("p") - F.lag("p").over(by), F.col("t") - F.lag("t").over(by)
    runs = spans.withColumn("new", F.coalesce(((step_t < 1) | (F.abs(step_p - step_t) > slack)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    cover = runs.groupBy(*key, "template", "label", "n_pairs", "span", "run").agg(F.count("*").alias("covered")).withColumn("cover", F.col("covered") / F.col("n_pairs"))
    own = cover.groupBy(*key).agg(F.max("cover").alias("cover"), F.collect_set(F.when(F.col("cover") >= least_cover, F.col("label"))).alias("own_labels"))

    # written, so that the join below deals both sides anew and Spark can split what many equal rows share
    found = saved(on_base.join(own, key, "full"))
    out = met.filter("template is null").join(found, key, "left")
    none = F.array().cast("array<string>")
    base = F.coalesce("base_labels", none)
    return out.select(
        *(F.col(c).alias(k) for c, k in zip(names, keep, strict=True)), F.col("p").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.coalesce("own_labels", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def duckdb_sql(templates: list[tuple[str, str]] = TEMPLATES, least_cover: float = 0.7, slack: int = 2) -> str:
    """The same scan of the table documents in DuckDB."""
    pairs = ", ".join(f"({n}, '{label}', {base}, {t}, '{a}', '{b}', {m})" for n, label, base, t, a, b, m in template_rows(templates))
    return rf"""
WITH pairs(template, label, is_base, t, a, b, n_pairs) AS (VALUES {pairs}),
texts AS (SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
placed AS (SELECT rn, unnest(w) AS word, unnest(range(len(w))) AS p FROM texts),
rolling AS (SELECT rn, p, word, lead(word) OVER (PARTITION BY rn ORDER BY p) AS next FROM placed),
hits AS (SELECT rn, p, template, label, is_base, n_pairs, t, p - t AS diagonal FROM rolling JOIN pairs ON word = a AND next = b),
on_base AS (
  SELECT rn, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list_distinct(list(label)) AS base_labels
  FROM (SELECT rn, template, label, n_pairs, diagonal FROM hits WHERE is_base GROUP BY ALL HAVING count(DISTINCT t) = n_pairs) GROUP BY rn),
diagonals AS (SELECT rn, template, diagonal, coalesce(CAST(diagonal - lag(diagonal) OVER (PARTITION BY rn, template ORDER BY diagonal) > {slack} AS INT), 1) AS new FROM (SELECT DISTINCT rn, template, diagonal FROM hits WHERE NOT is_base)),
spans AS (SELECT rn, template, diagonal, sum(new) OVER (PARTITION BY rn, template ORDER BY diagonal) AS span FROM diagonals),
steps AS (
  SELECT rn, template, label, n_pairs, span, p, t, t - lag(t) OVER o AS step_t, p - lag(p) OVER o AS step_p FROM hits JOIN spans USING (rn, template, diagonal)
  WINDOW o AS (PARTITION BY rn, template, span ORDER BY p, t)),
runs AS (SELECT rn, template, label, n_pairs, span, sum(coalesce(CAST(step_t < 1 OR abs(step_p - step_t) > {slack} AS INT), 1)) OVER (PARTITION BY rn, template, span ORDER BY p, t) AS run FROM steps),
cover AS (SELECT rn, label, count(*) / n_pairs AS cover FROM runs GROUP BY rn, template, label, n_pairs, span, run),
own AS (SELECT rn, max(cover) AS cover, list_distinct(list(label) FILTER (cover >= {least_cover})) AS own_labels FROM cover GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(own_labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0)::DOUBLE END AS score
FROM texts LEFT JOIN on_base USING (rn) LEFT JOIN own USING (rn)"""
