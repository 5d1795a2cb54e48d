"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The windows of a benchmark's items (ten consecutive words; a shorter item is one window) are the phrases. The index holds a
posting (term, document, position) for each place where the corpus has one of a phrase's RAREST rarest terms (of those that
occur at all; ties: the first in the phrase); it is written once. Each posting, less the term's offset in the phrase, is where
the phrase would start. These offset-adjusted lists are intersected by document, phrase and start: where all of a phrase's
lists meet, the text's words confirm the terms between them, and the start is an exact match. A start of any of the lists where
at least NEAR of the phrase's different words lie within SLOP places is a proximity match, so one whose rarest word was replaced
is found by the next.

The corpus is cut into words three times: to count the benchmark's terms, for the postings, and to confirm their starts;
only postings of rarest terms are shuffled. What is broadcast comes from the benchmark and is counted first; a benchmark of
more than BOUND words is joined by shuffles instead.

Defined results: null and empty texts have no words and no hits; an item without words has no window, and rows without
item_id are no items; items that repeat an item_id are windows of one item; the digest of no items is that of the empty
string; repeated rows each get the same result; long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, documents, table

WINDOW = 10
RAREST = 2
SLOP = 3
NEAR = 0.8
BOUND = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z in lower case; runs of ASCII letters, digits and whatever is outside ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def phrases(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """phrase, words, item_id: each window of each item."""
    x = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    x = x.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.least(F.lit(width), F.size("w"))).alias("words"))
    return x.groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("phrase", F.xxhash64("words"))


def postings(docs: DataFrame, terms: DataFrame, bound: int = BOUND) -> DataFrame:
    """The positional index of some terms: term, doc_id, th, position, one row each. docs: documents()."""
    tokens = docs.select("doc_id", "th", F.posexplode(words_of(F.col("text"))).alias("position", "term"))
    return tokens.join(bounded_broadcast(terms, bound), "term")


def term_counts(docs: DataFrame, terms: DataFrame, bound: int = BOUND) -> DataFrame:
    """term, df: in how many places of the corpus each term occurs, 0 included."""
    found = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(bounded_broadcast(terms, bound), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def anchors(docs: DataFrame, phrase: DataFrame, rarest: int = RAREST) -> DataFrame:
    """term, phrase, offset, nth, lists: for each phrase its rarest terms of those that occur (ties: the first place), each at its first place, numbered, and how many these are."""
    terms = phrase.select("phrase", F.posexplode("words").alias("offset", "term")).groupBy("phrase", "term").agg(F.min("offset").alias("offset"))
    counted = terms.join(term_counts(docs, terms.select("term").distinct()), "term").where("df > 0")
    first = F.slice(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))), 1, rarest)
    return counted.groupBy("phrase").agg(first.alias("x")).select("phrase", F.size("x").alias("lists"), F.posexplode("x").alias("nth", "x")).select("phrase", "lists", "nth", "x.offset", "x.term")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, n_words, exact, near for each document: arrays of (start, n, items) with starts in ascending order.

    What comes from the benchmark, and the postings, are written on the way, so that no pass over the corpus runs twice.
    """
    docs = documents(docs)
    phrase = cut(phrases(benchmark))
    anchor = cut(anchors(docs, phrase))
    index = cut(postings(docs, anchor.select("term").distinct()))
    starts = index.join(bounded_broadcast(anchor, BOUND), "term").select("doc_id", "th", "phrase", (F.col("position") - F.col("offset")).alias("start"), "nth", "lists")
    # Dealt by document once, as numbers; the phrases' words come to what the lists of a start have left.
    met = starts.repartition("doc_id", "th").groupBy("doc_id", "th", "phrase", "start").agg((F.bit_or(F.expr("shiftleft(1, nth)")) == F.max(F.expr("shiftleft(1, lists) - 1"))).alias("all"))
    met = met.join(bounded_broadcast(phrase.select("phrase", "words", "items"), BOUND), "phrase").where(F.col("start") > -F.size("words"))
    candidate = met.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "words", "items", "all")).alias("candidates"))
    x = docs.join(candidate, ["doc_id", "th"], "left").select("doc_id", "th", "candidates", words_of(F.col("text")).alias("w"))
    # Words from `slop` before the start to `slop` after the end, as far as the text has them.
    first = lambda c, slop: F.greatest(F.lit(1), c["start"] + 1 - slop)
    here = lambda c, slop: F.slice(F.col("w"), first(c, slop), F.greatest(F.lit(0), c["start"] + F.size(c["words"]) + slop + 1 - first(c, slop)))
    short = lambda c: F.struct(c["start"].alias("start"), F.size(c["words"]).alias("n"), c["items"].alias("items"))
    exact = lambda c: c["all"] & (c["start"] >= 0) & (here(c, 0) == c["words"])
    near = lambda c: ~exact(c) & (F.size(F.array_intersect(here(c, SLOP), c["words"])) >= F.lit(NEAR) * F.size(F.array_distinct(c["words"])))
    return x.select("doc_id", "th", "w", F.size("w").alias("n_words"), *(F.array_sort(F.transform(F.filter(F.coalesce("candidates", F.array().cast(x.schema["candidates"].dataType)), f), short)).alias(k) for k, f in (("exact", exact), ("near", near))))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, n_near for each document.

    The result is written before it is returned: a filter on it would else move below the matching and cut a document into
    words again for each of its candidates.
    """
    x = matches(docs, benchmark)
    # Starts ascend: what a match adds is what lies beyond the end of all before it.
    ends = F.aggregate("exact", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), lambda a, m: F.struct(F.greatest(a["end"], m["start"] + m["n"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), m["start"] + m["n"] - F.greatest(a["end"], m["start"]))).alias("hit")))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("exact", lambda m: m["items"]))))
    return cut(x.select("doc_id", F.col("n_words").cast("long").alias("n_words"), ends["hit"].cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.size("near").cast("long").alias("n_near")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), p AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s FROM p),
l AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, l WHERE len(w) >= n),
m AS (SELECT doc_id, i, g.n, item_id FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM g) g JOIN q ON g.n = q.n AND g.s = q.s),
f AS (SELECT x, count(*) AS df FROM (SELECT unnest(w) AS x FROM d) GROUP BY x),
u AS (SELECT DISTINCT n, s, string_split(s, ' ') AS ws FROM q), v AS (SELECT s, n, ws, x, j FROM (SELECT s, n, ws, unnest(ws) AS x, unnest(range(n)) AS j FROM u)),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, n ORDER BY df, j) AS k FROM (SELECT s, n, x, any_value(ws) AS ws, min(j) AS j, any_value(df) AS df FROM v JOIN f USING (x) GROUP BY s, n, x)) WHERE k <= 2),
z AS (SELECT DISTINCT doc_id, i - 1 - j AS a, s, n, ws, dw FROM (SELECT doc_id, w AS dw, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) t JOIN y ON t.x = y.x),
e AS (SELECT doc_id, count(*) AS n_near FROM z WHERE a > -n AND NOT (a >= 0 AND list_slice(dw, a + 1, a + n) = ws) AND len(list_intersect(list_distinct(list_slice(dw, greatest(1, a - 2), a + n + 3)), list_distinct(ws))) >= 0.8::DOUBLE * len(list_distinct(ws)) GROUP BY doc_id),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN e ON d.doc_id = e.doc_id LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
