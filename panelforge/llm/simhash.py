"""SimHash near-duplicates: fingerprints, pigeonhole block join, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import as_bytes, components, cut, small_batches

BITS = 64
MAX_BITS = 2


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted.

    Words are runs of bytes other than the six ASCII blanks, A-Z lower-cased. Fewer than ``shingle`` words: the whole
    sequence is the one shingle. No word (null, empty, blank): zero. A bit is 1 if set in more than half the hashes.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, 65_536):
        stop = min(n, start + 65_536)
        parts = zip(*(words[start + k : stop + k] for k in range(shingle))) if n > 1 or len(words) == shingle else [words]
        hashes = np.array([digest(b" ".join(p), seed) for p in parts], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text_col: str, name: str, shingle: int = 3) -> DataFrame:
    """All columns of ``docs`` and, as ``name``, the SimHash of ``text_col`` as a signed long. One narrow pass; long texts come in small batches.

    Null, empty and blank texts have fingerprint zero; every row stays, repeated ones and those without an id too; ``name`` must be none of the table's
    columns; an empty table gives an empty one.
    """
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            fps = pa.array([fingerprint(t, shingle) for t in as_bytes(batch, text_col)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*columns, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows ``(doc_id, fp)``: one per document, ``fp`` the SimHash as a signed long. Other columns are ignored."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_fingerprint(chosen, "text", "fp", shingle).select("doc_id", "fp")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(blocks: int) -> list[int]:
    """Masks that keep all but ``MAX_BITS`` of ``blocks`` blocks: a close pair agrees under at least one (pigeonhole)."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(keep)) for keep in combinations(parts, blocks - MAX_BITS)]


def close_links(fps: DataFrame, blocks: int = 4, bucket_cap: int = 64) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that keep the components of "at most two bits apart" whole.

    ``fps`` has one column ``fp`` of distinct values. Each fingerprint is keyed by all but two of its ``blocks`` blocks;
    pairs that share a key are joined and verified. A key that more than ``bucket_cap`` fingerprints share is not
    paired up: its members take an exact way of linear size. Two values at most two bits apart have a common
    neighbour at most one bit from each, and all values around one neighbour are within two bits of each other; so each
    value is dealt to its 65 neighbours and linked to the smallest value there (at most 65 meet).
    """
    masks = block_masks(blocks)
    keys = F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.m", "k.v")
    shared = cut(keyed.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(keyed.join(shared, ["m", "v"]))
    few = members.where(F.col("n") <= bucket_cap).select("m", "v", "fp")
    pairs = few.toDF("m", "v", "a").join(few.toDF("m", "v", "b"), ["m", "v"])
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    paired = pairs.where((F.col("a") < F.col("b")) & close).select("a", "b")

    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS)))
    many = members.where(F.col("n") > bucket_cap).select("fp").distinct()
    around = many.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("near"))
    least = F.min("fp").over(Window.partitionBy("near"))
    starred = around.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b").distinct()
    return paired.union(starred.select("b", "a"))


def fp_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def labelled(marked: DataFrame, blocks: int = 4, bucket_cap: int = 64) -> DataFrame:
    """``(fp, least, label)`` of the distinct fingerprints of ``marked(doc_id, fp)``: the smallest id of each, and its component's label."""
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(close_links(nodes.select("fp"), blocks, bucket_cap)).withColumnRenamed("node", "fp")
    return nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, blocks: int = 4, bucket_cap: int = 64
) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)``, one per row of ``docs``.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest doc_id reachable. Copies are
    collapsed to one node by fingerprint first. Null doc_ids never name a component (null if it has no other id);
    repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    named = labelled(marked, blocks, bucket_cap)
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = cut(named.join(names, "label").select("fp", "component_id"))
    return marked.join(groups, "fp").select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component one row with its smallest id stays.

    All columns of ``docs`` are returned, whatever their names. A row is known by its id and fingerprint: unlike texts under one id are judged
    apart, of rows that repeat both one stays, and of unlike texts in one component under its smallest id the one with the least fingerprint. Rows
    without an id belong to no component and stay. Null and empty texts are alike (fingerprint zero). An empty table gives an empty one.
    """
    fp = next(n for n in (f"fp_{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    named = with_fingerprint(docs.where(F.col(id_col).isNotNull()), text_col, fp)
    marked = cut(named.select(F.col(id_col).cast("long").alias("doc_id"), F.col(fp).alias("fp")))
    winners = labelled(marked).groupBy("label").agg(F.min(F.struct("least", "fp")).alias("w"))
    winners = cut(winners.select(F.col("w.least").alias(id_col), F.col("w.fp").alias(fp)))
    kept = named.dropDuplicates([id_col, fp]).join(winners, [id_col, fp], "left_semi")
    return kept.select(*docs.columns).union(docs.where(F.col(id_col).isNull()))
