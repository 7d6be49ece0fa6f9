"""A training-corpus pipeline: quality rules, line dedup, near duplicates, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir). What it returns is written as Parquet, and read again as the next one's docs. All
stages but the last return the columns of docs.

Defined results, besides those of each operator: documents without a text fail the quality rules; a document may lose lines but stays, with
n_chars as its new length where docs has that column; of repeated rows one stays; the mix repeats rows of a document that it takes more than once.
The last stage returns a row for each row of the mix. Documents of a mix are joined to it by id and text, so equal ids with other texts stay apart.
Where repeated rows do reach the mix, each is taken as often as the one that comes first. Null ids are ids, and a null source is a source. Columns
of any name pass through. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolens.llm import line_dedup, mixing, ngram_join, quality, queries
from gyrolens.llm.common import bound_batches, fresh, new_path, remove, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts are rejected; each repeated row is judged by itself."""
    bound_batches(spark)
    verdict = fresh(docs, "__quality")
    return quality.apply_rules(docs, out=verdict).where(F.col(f"{verdict}.kept")).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources share. Null texts stay null; a text that loses all lines is empty."""
    removed = fresh(docs, "__n_removed")
    cleaned = line_dedup.dedup_lines(docs, n_lines_col=fresh(docs, "__n_lines"), n_removed_col=removed)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id, ties by the text's hash. Texts without words are no group."""
    bound_batches(spark)
    return ngram_join.keep_one(docs).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the mix: files by range of finish time, rows of a file in order."""
    columns, text = docs.columns, F.col("text")
    key, entry = fresh(docs, "__key"), fresh(docs, "__entry")
    # Texts differ by now, so an id and a text name a row.
    keyed = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.xxhash64(text), F.lit(0)), F.xxhash64(F.lit(1), text)))
    _, mix = mixing.mix_sources(keyed.select(key, "source", "text"), id_col=key)
    # An entry for each pass of a document, of which there are few.
    passes = [F.min(F.when(F.col("pass") == p, F.struct("place", "part"))) for p in range(mixing.MAX_REPEATS)]
    entries = mix.groupBy(F.col("doc_id").alias(key)).agg(F.array_compact(F.array(*passes)).alias(entry)).select(key, F.explode(entry).alias(entry))
    parts = 1 + (mix.agg(F.max("part").alias("last")).first()["last"] or 0)
    return keyed.join(entries, key).repartitionById(parts, F.col(f"{entry}.part")).sortWithinPartitions(f"{entry}.place").select(*columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    bound_batches(spark)
    return queries.encode_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("byte-level BPE", bpe_encoding),
]

#: Byte-level BPE can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        with scratch(spark):  # tables on the way go when the stage is written
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
