"""Token counts through a cache of digests: only contents not counted before are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut, small_batches
from .encoding import encoder

CACHE = "version string, digest binary, n_tokens long"


def version(path: str) -> str:
    """Digest of a tokenizer's file: another vocabulary never meets this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, text, digest, n_bytes)``; the normal form of content is its UTF-8 text, null as empty.

    Nothing else is folded, because any other change of a text may change its tokens. One row per row, repeated ones and null ids too; an empty table gives
    an empty result; other columns are ignored whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    digest = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    return chosen.withColumns({"digest": digest, "n_bytes": F.octet_length("text").cast("long")})


def encode_counts(texts: DataFrame, vocabulary: str) -> DataFrame:
    """Rows ``(digest, n_tokens)`` of rows ``(digest, text)``, one each: repeated rows stay repeated, null text counts as empty, an empty table gives an empty
    result, other columns are ignored. Whole texts of any length, in small batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).ids
        for batch in small_batches(batches, "text"):
            counts = pa.array([len(count(t)) for t in as_text(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, vocabulary: str, cache: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_tokens, over_limit)``, one per document.

    ``cache`` is the path of a table ``(version, digest, n_tokens)`` that is read first and gets the new counts
    appended; none: every distinct content is a miss. Null text counts as empty; repeated texts are encoded once;
    an empty table gives an empty result; other columns are ignored.

    Copies collapse before the shuffle (first text per digest, map-side), stored digests are dropped by an anti-join
    on the digest, and only the misses reach Python. Counts return to documents by a join of narrow rows, whose one hot
    digest adaptive execution may split. Texts are shuffled once, and only the distinct ones.
    """
    spark = docs.sparkSession
    marked = digests(docs, id_col, text_col)
    key = version(vocabulary)
    stored = spark.createDataFrame([], CACHE)
    if cache is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            stored = spark.read.schema(CACHE).parquet(cache)
    # one row a digest, even if two runs stored it; materialised, so that the last join's sides are plain exchanges, which
    # adaptive execution can split where a digest is hot
    stored = stored.where(F.col("version") == key).select("digest", "n_tokens")
    if cache is not None:
        stored = cut(stored.dropDuplicates(["digest"]))
    distinct = marked.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct if cache is None else distinct.join(stored.select("digest"), "digest", "left_anti")
    fresh = cut(encode_counts(misses, vocabulary))
    if cache is not None:
        fresh.select(F.lit(key).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    known = fresh if cache is None else fresh.union(stored)
    narrow = marked.select("doc_id", "digest", "n_bytes")
    return narrow.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
