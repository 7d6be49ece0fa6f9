"""The queries of the ten operators over their whole tables, and their SQL (see sql.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolens.llm import ann, langid, license_scan, line_dedup, mixing, ngram_join, quality, token_counts, warc
from gyrolens.llm.bpe import BpeCodec, parse_ranks, read_ranks
from gyrolens.llm.common import bound_batches

#: Vocabulary of operators 1 and 8.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_documents(spark, sf_dir))


def encode_digests(docs: DataFrame) -> DataFrame:
    """Digests of the operator's ids and bytes. They are taken in the worker that made these, so neither is sent to the JVM."""

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digests(done: pa.Array) -> pa.Array:
        ids, decoded = done.field("ids"), done.field("decoded")
        return pa.StructArray.from_arrays(
            [
                pa.array([len(x.values) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(str, x.values.to_pylist())).encode()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], pa.string()),
            ],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    codec = BpeCodec(docs.sparkSession, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return docs.select("doc_id", digests(codec.round_trip(F.col("text"))).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return cleaned.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix_sources(_documents(spark, sf_dir))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = langid.train(docs.where(~held_out))
    predicted = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return predicted.select("doc_id", "held_out", F.col("prediction.lang").alias("lang_pred"), F.col("prediction.score").alias("score"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(_documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    index = warc.warc_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    count = token_counts.token_counter(spark, parse_ranks(read_ranks(public_tokenizers.path(RANKS))), public_tokenizers.PATTERN)
    return docs.select("doc_id", count(F.col("text")).alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


#: First words of texts that stand for licence files.
NOTICE = r"(?i)^\W*(this work is )?(licensed|released|dedicated|copyright|copying|permission)\b"


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files /source/block of 1000/block of 100/doc_id.txt. One that begins with a notice is its block of 1000's licence file."""
    docs = _documents(spark, sf_dir)
    source = F.coalesce("source", F.lit("unknown"))
    upper = F.concat_ws("/", source, F.floor(F.col("doc_id") / 1000).cast("string"))
    path = F.when(F.col("text").rlike(NOTICE), F.concat_ws("/", upper, F.concat(F.lit("LICENSE."), F.col("doc_id")))).otherwise(
        F.concat_ws("/", upper, F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id"), F.lit(".txt")))
    )
    return license_scan.scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_byte_bpe, op2_line_dedup, op3_source_mix, op4_language, op5_quality, op6_warc, op7_nearest, op8_token_counts, op9_licenses, op10_ngram_join)
    return {f.__name__: f for f in ops}
