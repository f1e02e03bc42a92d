"""License scan by diagonal voting, in DataFrame operations only.

Every rolling 2-gram of a document's words is joined by hash (and compared word by word) with
the 2-grams of the templates. A hit at word i on template position j votes for diagonal i - j.
Votes are bit sets of template positions, so a repeated hit counts once. A base phrase stands
wherever its diagonal holds every position. For notices, diagonals at most GAP apart merge (an
inserted or dropped word shifts the rest of the notice to the next diagonal) and the merged
span is accepted when it covers enough of the notice.

Nulls and edge cases: null or empty text has no words, no places, empty labels and score 0; a
null doc_id is a document like any other; repeated rows give a result row each; other columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by contract: phrase, label.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public notices as they stand in source files and pages, by the label they add.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance "
     "with the license you may obtain a copy of the license at", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
GAP = 3
COVER = 0.75
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def templates() -> list[tuple[int, bool, str, int, int, str, str]]:
    """(template, is base, label, number of 2-grams, position, word, next word); at most 62 2-grams each."""
    rows = []
    for t, (phrase, label) in enumerate(BASE + NOTICES):
        w = phrase.split()
        assert 2 <= len(w) <= 63
        rows += [(t, t < len(BASE), label, len(w) - 1, j, w[j], w[j + 1]) for j in range(len(w) - 1)]
    return rows


def grams(spark: SparkSession) -> DataFrame:
    """The templates' 2-grams with their hash: a constant of about 150 rows, so it is broadcast."""
    schema = "template int, base boolean, label string, grams int, j int, w0 string, w1 string"
    return F.broadcast(spark.createDataFrame(templates(), schema).withColumn("gram", F.xxhash64("w0", "w1")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), words.alias("words"))
    # Element 0 stands for the document itself, so that one without hits keeps a row.
    each = rows.select("*", F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("p", "w")).select(
        "doc_id", "h", F.size("words").cast("long").alias("n_words"), "p", "w",
        F.get("words", F.col("p")).alias("nxt"),
    )
    t = grams(docs.sparkSession)
    hits = each.join(
        t, (F.xxhash64("w", "nxt") == t.gram) & (F.col("w") == t.w0) & (F.col("nxt") == t.w1), "left"
    ).filter((F.col("p") == 0) | F.col("template").isNotNull())
    votes = hits.groupBy(
        "doc_id", "h", "template", "base", "label", "grams", (F.col("p") - 1 - F.col("j")).alias("diagonal")
    ).agg(
        F.sum((F.col("p") == 0).cast("long")).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.bit_or(F.expr("shiftleft(1L, j)")).alias("seen"),
    )
    order = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > GAP), 1).otherwise(0)
    runs = votes.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order))
    spans = runs.groupBy("doc_id", "h", "template", "base", "label", "grams", "run").agg(
        F.max("copies").alias("copies"), F.max("n_words").alias("n_words"),
        F.min("diagonal").cast("long").alias("place"),
        (F.bit_count(F.bit_or("seen")) / F.col("grams")).alias("cover"),
    )
    whole = F.col("base") & (F.col("cover") == 1)
    good = whole | (~F.col("base") & (F.col("cover") >= COVER))
    joined = lambda on: F.array_join(F.sort_array(F.collect_set(F.when(on, F.col("label")))), ",")
    out = spans.groupBy("doc_id", "h").agg(
        F.max("copies").alias("copies"), F.max("n_words").alias("n_words"),
        F.count_if(F.coalesce(whole, F.lit(False))).alias("n_base"),
        F.min(F.when(whole, F.col("place"))).alias("first_word"),
        F.max(F.when(whole, F.col("place"))).alias("last_word"),
        joined(whole).alias("base_labels"), joined(good).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("h", "copies", "_copy")


def oracle() -> str:
    """The same scan as DuckDB SQL over documents."""
    values = ", ".join(f"({t}, {base}, '{label}', {n}, {j}, '{a}', '{b}')" for t, base, label, n, j, a, b in templates())
    return f"""
WITH t(template, base, label, grams, j, w0, w1) AS (VALUES {values}),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
             '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i - 1 AS i, words[i] AS a, words[i + 1] AS b
      FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w)),
v AS (SELECT doc_id, template, base, label, grams, i - j AS diagonal, bit_or(1::BIGINT << j) AS seen
      FROM g JOIN t ON a = w0 AND b = w1 GROUP BY ALL),
a AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP}
             THEN 1 ELSE 0 END AS apart FROM v),
r AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM a),
s AS (SELECT doc_id, base, label, min(diagonal) AS place, bit_count(bit_or(seen)) / grams::DOUBLE AS cover
      FROM r GROUP BY doc_id, template, base, label, grams, run),
d AS (SELECT doc_id, count(*) FILTER (base AND cover = 1) AS n_base,
             min(place) FILTER (base AND cover = 1) AS first_word, max(place) FILTER (base AND cover = 1) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND cover = 1) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND cover = 1 OR NOT base AND cover >= {COVER}) AS labels,
             max(cover) AS score FROM s GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN d USING (doc_id)"""
