"""Raw documents to a training mix: five stages, each an operator of murmurlake.llm applied to all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one. All but
the last return the columns of documents. Rows without doc_id are no documents and leave at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.llm import decontaminate, language, lines, minhash, mixing
from murmurlake.llm.common import cut, table

#: Below this score a language is not told from the others.
LEAST_SCORE = 0.5
#: What the mix adds to the columns of documents.
ADDED = ("size", "quality", "source_size", "target", "taken")


def fresh(name: str, taken: list[str]) -> str:
    """name, or what it takes to be a name that isn't taken, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language in particular, go. Where no document has a label no language can be told, so all with a letter stay; an empty table stays empty."""
    if language.training_rows(docs).isEmpty():
        return docs.where("doc_id IS NOT NULL AND rlike(text, '\\\\p{L}')")
    lang, sure = fresh("found_lang", docs.columns), fresh("found_score", docs.columns)
    x = language.identify(docs.where("doc_id IS NOT NULL"), docs.columns, language.training_rows(docs), names=(lang, sure))
    return x.where((F.col(lang) != "und") & (F.col(sure) >= LEAST_SCORE)).select(docs.columns)


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first document that has each; documents stay. n_chars follows the text."""
    x = lines.dedup_lines(docs, counts=None)
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return x.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; of rows that repeat its id, the one whose hash is smallest."""
    found = minhash.near_duplicates(docs)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    row = F.struct(*[docs[c] for c in docs.columns])
    x = docs.select(F.col("doc_id").cast("long").alias("kept_id"), row.alias("row"), F.xxhash64(F.to_json(row)).alias("by")).join(kept, "kept_id", "left_semi")
    return x.groupBy("kept_id").agg(F.min_by("row", "by").alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    hit = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with how many; none of an empty table. Columns of docs that have a name of ADDED stay, as input_<name>."""
    for c in [c for c in docs.columns if c.lower() in ADDED]:
        docs = docs.withColumnRenamed(c, fresh(f"input_{c}", docs.columns))
    return mixing.mix(docs, keep=tuple(docs.columns)).where("taken > 0").select(*docs.columns, *ADDED)


STAGES = [("language_id", languages), ("line_dedup", recurring_lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixture)]

#: Language ID and line templates can't be put in SQL. The tests hold line dedup against plain Python, near dedup against all pairs, decontamination and mixing
#: against SQL, each on what its predecessor kept, and language ID against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
