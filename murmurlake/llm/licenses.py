"""License scan by diagonal voting.

All rolling k-grams of words of all texts are joined, as 64-bit hashes, to the places they have in the license templates.
A hit at word i of a text and word j of a template votes for the diagonal i - j. Votes of a text, template and diagonal are
added up; diagonals that lie within `SLACK` words of each other, as an inserted or a lost word makes them, are merged. The
span of text that a merged group takes up is verified: the template's words that the hits confirm, word by word, must be
`VERIFIED` of the longer one of template and span.

The base phrases are templates too, of two-word grams: a place is a diagonal on which every gram of the phrase has a vote,
and isn't merged with others.

The templates are few, from one sentence to whole license texts, so they are broadcast (MOST_GRAMS at most). What is
gathered for a diagonal is a set of places in its template, so it never grows with a text.

Defined results: null text is empty; texts without words have no hits, score 0 and null words; a text with fewer words
than a gram has nothing; repeated rows each get the same result; long texts are whole, cut into rows of grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, chunks, documents, plain_words, table, window_hashes

K = 3
K_BASE = 2
SLACK = 2
VERIFIED = 0.8
MOST_GRAMS = 100_000
SEED = 4

#: Phrases that count wherever their words stand consecutively, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public license notices, as (label, text).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-4.0", "licensed under cc by 4.0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
]


KNOWN = "gram long, template int, j int, label string, n int, k int"


def template_grams(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, int, str, int, int]]:
    """Rows of KNOWN: every k-gram of every template."""
    split = [plain_words(t.encode()) for _, t in templates]
    if any(len(w) < k for w in split):
        raise ValueError(f"a template has {k} words at least")
    words = Words(split)
    if words.total > MOST_GRAMS:
        raise ValueError(f"templates have {MOST_GRAMS} words together at most")
    grams = window_hashes(words.hashes(SEED), k, SEED + k).astype(np.int64)
    return [(int(grams[i]), int(words.owner[i]), int(i - words.offsets[words.owner[i]]), templates[words.owner[i]][0], int(words.counts[words.owner[i]]), k) for i in words.within(k)]


def grams_of(batches: Iterator[pa.RecordBatch], *sizes: int) -> Iterator[pa.RecordBatch]:
    """A row for each rolling k-gram of the given sizes."""
    for rows, texts in chunks(batches):
        words = Words([plain_words(t) for t in texts])
        ids, ths, x = rows["doc_id"].to_numpy(), rows["th"].to_numpy(), words.hashes(SEED)
        for k in sizes:
            at, grams = words.within(k), window_hashes(x, k, SEED + k).astype(np.int64)
            for part in np.array_split(at, max(1, len(at) // 100_000)):
                own = words.owner[part]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ths[own]), pa.array((part - words.offsets[own]).astype(np.int32)), pa.array(grams[part])], names=["doc_id", "th", "place", "gram"])


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), rows["th"].combine_chunks(), pa.array([len(plain_words(t)) for t in texts], pa.int64())], names=["doc_id", "th", "n_words"])


_TEXT = ["doc_id", "th"]
_ONE = [*_TEXT, "template", "label", "n", "k"]


def votes(docs: DataFrame, known: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Each diagonal of each text and template with the places of the template that have a vote. docs: documents()."""
    hits = docs.mapInArrow(lambda it: grams_of(it, *sizes), "doc_id long, th long, place int, gram long").join(F.broadcast(known), "gram")
    return hits.groupBy(*_ONE, (F.col("place") - F.col("j")).alias("diagonal")).agg(F.collect_set("j").alias("js"))


def places(voted: DataFrame) -> DataFrame:
    """doc_id, th, label, start of templates that stand in a text word by word."""
    return voted.where(F.size("js") == F.col("n") - F.col("k") + 1).select(*_TEXT, "label", F.col("diagonal").cast("long").alias("start"))


def spans(voted: DataFrame, verified: float = VERIFIED) -> DataFrame:
    """doc_id, th, template, label, first, last (words), similarity: each place of each template that was verified."""
    by = Window.partitionBy(*_TEXT, "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > SLACK, F.lit(True)).cast("int")
    each = voted.withColumn("new", new).withColumn("island", F.sum("new").over(by)).select(*_ONE, "island", "diagonal", F.explode("js").alias("j"))
    merged = each.groupBy(*_ONE, "island").agg(F.collect_set("j").alias("js"), F.min(F.col("diagonal") + F.col("j")).alias("first"), (F.max(F.col("diagonal") + F.col("j")) + F.col("k") - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + F.col("k") - 1)))))
    return merged.withColumn("similarity", covered / F.greatest("n", F.col("last") - F.col("first") + 1)).where(F.col("similarity") >= verified).select(*_TEXT, "template", "label", "first", "last", "similarity")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """A row for each document: base phrases, and the labels of both base and templates with a score."""
    spark, docs = docs.sparkSession, documents(docs)
    phrases = [(label, phrase) for phrase, label in base.items()]
    # Templates are numbered on from the phrases, so that both share one pass over the texts.
    rows = template_grams(phrases, K_BASE) + [(g, t + len(phrases), *rest) for g, t, *rest in template_grams(templates, K)]
    voted = votes(docs, spark.createDataFrame(rows, KNOWN), (K_BASE, K))
    is_base = F.col("template") < len(phrases)
    based = places(voted.where(is_base)).groupBy(*_TEXT).agg(F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.collect_set("label").alias("base_found"))
    found = spans(voted.where(~is_base)).groupBy(*_TEXT).agg(F.collect_set("label").alias("found"), F.max("similarity").alias("best"), F.count("*").alias("n_spans"))
    none = F.array().cast("array<string>")
    x = docs.mapInArrow(word_counts, "doc_id long, th long, n_words long").join(based, _TEXT, "left").join(found, _TEXT, "left")
    labels = F.array_sort(F.array_union(F.coalesce("base_found", none), F.coalesce("found", none)))
    return x.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.concat_ws(",", F.array_sort("base_found")).alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    cut = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    known = ", ".join(f"({i}, '{label}', {str(k == K_BASE).lower()}, {k}, '{text}')" for i, (label, text, k) in enumerate([(label, p, K_BASE) for p, label in BASE.items()] + [(label, t, K) for label, t in TEMPLATES]))
    return f"""
WITH d AS (SELECT doc_id, {cut.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT template, label, base, k, {cut.format("text")} AS w FROM (VALUES {known}) AS v(template, label, base, k, text)),
tg AS (SELECT template, label, base, k, len(w) AS n, j - 1 AS j, array_to_string(list_slice(w, j, j + k - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM t)),
dg AS (SELECT doc_id, i - 1 AS i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES ({K_BASE}), ({K})) AS s(k) WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, template, label, base, n, tg.k, j, i - j AS diagonal FROM dg JOIN tg ON dg.k = tg.k AND dg.g = tg.g),
b AS (SELECT doc_id, label, diagonal FROM h WHERE base GROUP BY doc_id, template, label, n, k, diagonal HAVING count(*) = n - k + 1),
ba AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word FROM b GROUP BY doc_id),
v AS (SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER q <= {SLACK} THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, template, diagonal FROM h WHERE NOT base) WINDOW q AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM v),
m AS (SELECT h.*, s.island FROM h JOIN s USING (doc_id, template, diagonal)),
e AS (SELECT doc_id, template, island, count(DISTINCT w) AS covered FROM (SELECT doc_id, template, island, unnest(range(j, j + k)) AS w FROM m) GROUP BY ALL),
f AS (SELECT doc_id, template, label, island, n, min(diagonal + j) AS a, max(diagonal + j) + k - 1 AS z FROM m GROUP BY doc_id, template, label, island, n, k),
x AS (SELECT doc_id, label, covered / greatest(n, z - a + 1)::DOUBLE AS similarity FROM e JOIN f USING (doc_id, template, island) WHERE covered / greatest(n, z - a + 1)::DOUBLE >= {VERIFIED}::DOUBLE),
xa AS (SELECT doc_id, max(similarity) AS best, count(*) AS n_spans FROM x GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, string_agg(label, ',' ORDER BY label) FILTER (base) AS base_labels
  FROM (SELECT doc_id, label, max(base) AS base FROM (SELECT doc_id, label, true AS base FROM b UNION ALL SELECT doc_id, label, false FROM x) GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN ba USING (doc_id) LEFT JOIN xa USING (doc_id) LEFT JOIN l USING (doc_id)
"""


SQL = _sql()
